"""Language-model scores from a causal self-attention model over subword ids.

A text is its words, lower-cased in A-Z, each after one space, and its end.
Attention over the ids before a place says how much each of TOPICS kinds of text
this may be, and a mixture of the kinds' transition tables gives the next id's
probability. That is a proper distribution over ids.

The tables are counted over all training ids. Ids have classes: the most
frequent have one each, the others share the rest by a hash and have their
frequency within it. How often two classes lie some ids apart is counted first;
a factorisation of that matrix finds the kinds, and a kind's transitions are
counted over the blocks that it fits best. All tables have fixed sizes.

Attention is trained in numpy on every training id, in rounds: each round has
its share of the documents, every partition goes on from the same weights, and
the weights are averaged, weighted by ids.

Scoring cuts a text into blocks. A window is a block and the BACK blocks before
it; a query at each place attends under a mask to the window's groups of GROUP
ids up to that place, many windows at once, and each id is scored once.
"""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORD, byte_characters, slices
from .common import documents, saved, saved_parts
from .labelled import held_out
from .textnum import Words, mix, sequence_hash

BLOCK, GROUP, BACK, DIM, TOPICS = 32, 8, 2, 16, 8
KEYS = BLOCK // GROUP
WIDE = (BACK + 1) * KEYS
OWN, SHARED = 991, 32
CLASSES = OWN + SHARED + 1  # the last is a text's begin
LAGS = (23, 41)  # ids apart: too far for anything but the kind of text to tell
SPAN, SCORED = 64, 128  # blocks at a time in training and scoring: their arrays stay in the cache
STEP = 256  # blocks in a step of training
ROUNDS = ((1, 0.01), (2, 0.006), (4, 0.004), (9, 0.002))  # sixteenths of the documents, and the rate, of each round
SLOTS, INLINE = 1 << 20, 6  # words whose ids a worker keeps, and the most ids of such a word
PIECES = 64  # pieces of the weights that are averaged side by side


class Subwords:
    """Ids of texts' words by tiktoken, and the words' hashes from their ids."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        of, special = byte_characters(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # ids that go over the border of two words aren't used, so that a space is always an id's first byte
        ranks = {t: i for t, i in ranks.items() if b" " not in t[1:]}
        self.coder = tiktoken.Encoding("subwords", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})
        self.begin = max(spec["model"]["vocab"].values()) + 1
        self.end, self.size = self.begin + 1, self.begin + 2
        own = [b""] * self.size
        for t, i in ranks.items():
            own[i] = t
        #: of each id: whether it begins a word, and a number to hash words by
        self.opens, self.value = np.array([t[:1] == b" " for t in own]), mix(np.arange(self.size, dtype=np.uint64))
        #: how ids are stored
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.key, self.ids, self.size_of = np.zeros(SLOTS, np.uint64), np.zeros((SLOTS, INLINE), "<u4"), np.zeros(SLOTS, np.uint8)

    def apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each encoded on its own after a space, in a row, and the words' borders in them."""
        text = b" ".join(words).decode()
        if len(text.split()) == len(words):
            ids = self.coder.encode_to_numpy(" " + text)
            return ids, np.append(np.flatnonzero(self.opens[ids]), len(ids))
        # white space of other alphabets inside a word would go together with its neighbours'
        each = [self.coder.encode_to_numpy(" " + w.decode()) for w in words]
        return np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the texts' borders in them; nulls are empty.

        Words are known by their hash. A table of fixed size keeps ids of words
        seen; a word takes the place of another that meets it there.
        """
        words = Words(column)
        slot = (words.hash & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = self.key[slot] == words.hash
        size = np.where(hit, self.size_of[slot], 0).astype(np.int64)
        missing = np.flatnonzero(~hit)
        if len(missing):
            fresh, first, back = np.unique(words.hash[missing], return_index=True, return_inverse=True)
            whole, at = words.text.tobytes(), missing[first]
            ids, borders = self.apart([whole[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())])
            fresh_size = np.diff(borders)
            size[missing] = fresh_size[back]
        place = np.append(0, np.cumsum(size))
        out = np.zeros(int(place[-1]), "<u4")
        known = np.flatnonzero(hit)
        for j in range(INLINE):
            known = known[size[known] > j]
            out[place[known] + j] = self.ids[slot[known], j]
        if len(missing):
            n = size[missing]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(place[missing], n) + inside] = ids[np.repeat(borders[:-1][back], n) + inside]
            # what is kept: one word a place
            short = np.flatnonzero(fresh_size <= INLINE)
            into, one = np.unique(slot[at[short]], return_index=True)
            keep = short[one]
            self.key[into], self.size_of[into] = fresh[keep], fresh_size[keep]
            for j in range(INLINE):
                has = np.flatnonzero(fresh_size[keep] > j)
                self.ids[into[has], j] = ids[borders[:-1][keep[has]] + j]
        return out, place[words.first]

    def words(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words that ids spell, and the texts' borders in them. Each word is encoded on its own, so its ids name it."""
        start = np.flatnonzero(self.opens[ids])
        end = np.append(start[1:], len(ids))[: len(start)]
        return sequence_hash(np.take(self.value, ids), start, end, mixed=True), np.searchsorted(start, borders)


@functools.lru_cache(maxsize=2)
def subwords(vocabulary: str) -> Subwords:
    return Subwords(vocabulary)


class Counts:
    """Numbers of keys, gathered batch by batch in sorted arrays."""

    def __init__(self, most: int = 1_500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(keys, np.bincount(back, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64))]
        self.held = sum(len(k) for k, _ in self.parts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        found = self.parts[0] if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.held = [], 0
        return found


class Lookup:
    """Values by 64-bit key: a table by the key's low bits, and a sorted rest for keys that met there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys)).bit_length() + 2 * (len(keys) < 1_000_000))
        self.low = np.uint64((1 << bits) - 1)
        slot = (keys & self.low).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        self.key[slot[first]], self.value[slot[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.worth = keys[rest], values[rest]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, 0 where a key isn't held."""
        slot = (keys & self.low).astype(np.int64)
        value, same = self.value[slot], self.key[slot] == keys
        out = np.where(same, value, self.value.dtype.type(0))
        if len(self.more):
            miss = np.flatnonzero(~same & (value > 0))
            place = np.minimum(np.searchsorted(self.more, keys[miss]), len(self.more) - 1)
            same = self.more[place] == keys[miss]
            out[miss[same]] = self.worth[place[same]]
        return out


# --- ids of many texts as arrays


def encoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """rows (id, hash, held_out, part, text) with ids, as bytes of small integers, in place of the text; written to be read several times, by part."""

    def run(batches):
        coder = subwords(vocabulary)
        for big in batches:
            for batch in slices(big):
                ids, borders = coder.encode(batch.column(4))
                ids = ids.astype(coder.kind)
                at = pa.py_buffer((ids.itemsize * borders).astype(np.int64).tobytes())
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, at, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids], ["id", "hash", "held_out", "part", "ids"])

    return saved_parts(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash long, held_out boolean, part int, ids binary"), "part", "zstd")


def flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of texts in a row, and each text's borders in them; kind: how they are stored."""
    column, size = column.cast(pa.large_binary()), np.dtype(kind).itemsize
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    ids = np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0]) if at[-1] > at[0] else np.empty(0, kind)
    return ids.astype(np.int64), (at - at[0]) // size


class Blocks:
    """Texts cut into blocks of places: the class before each place, the id and class at it, whether it exists, and each block's number in its text."""

    def __init__(self, ids: np.ndarray, borders: np.ndarray, t: dict, begin: int, end: int):
        sizes = np.diff(borders) + 1
        blocks = -(-sizes // BLOCK)
        self.edge = np.append(0, np.cumsum(blocks))
        first = np.append(0, np.cumsum(sizes))[:-1]
        place = np.repeat(self.edge[:-1] * BLOCK - first, sizes) + np.arange(int(sizes.sum()))
        n = int(self.edge[-1]) * BLOCK
        self.came, self.id, self.live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.came[place] = t["of"][np.insert(ids, borders[:-1], begin)]
        self.id[place] = np.insert(ids, borders[1:], end)
        self.live[place] = True
        self.goes = t["of"][self.id]
        self.order = np.arange(len(self)) - np.repeat(self.edge[:-1], blocks)

    def __len__(self) -> int:
        return int(self.edge[-1])


def summed(ids: DataFrame, keys, size: int) -> np.ndarray:
    """How often each key from 0 to size - 1 comes; keys gives those of a batch's column. At most size rows, in practice the few that occur, reach the driver."""

    def run(batches):
        total = np.zeros(size, np.int32)
        for big in batches:
            for batch in slices(big):
                np.add.at(total, keys(batch.column(0)), np.int32(1))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["key", "n"])

    found = ids.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.float32)
    out[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(np.float32)
    return out


# --- counted tables


def count_words(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(kind, key, n): how often each word (kind 0, by its hash) and each id (kind 1) occurs in a column ids."""

    def run(batches):
        coder = subwords(vocabulary)
        words, single = Counts(), np.zeros(coder.size, np.int64)

        def rows(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for big in batches:
            for batch in slices(big):
                own, borders = flat(batch.column(0), coder.kind)
                single += np.bincount(own, minlength=coder.size)
                single[coder.end] += batch.num_rows
                words.add(coder.words(own, borders)[0])
                if words.held > words.most // 2:
                    yield rows(0, *words.take())
        yield rows(0, *words.take())
        some = np.flatnonzero(single)
        yield rows(1, some, single[some])

    return ids.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def classes(n: np.ndarray, begin: int) -> np.ndarray:
    """Each id's class: 0 to OWN - 1 for the most frequent ids, else one of the shared by a hash; begin has the last."""
    of = OWN + (mix(np.arange(len(n), dtype=np.uint64)) % np.uint64(SHARED)).astype(np.int64)
    top = np.argsort(-n, kind="stable")[:OWN]
    of[top] = np.arange(len(top))
    of[begin] = CLASSES - 1
    return of


def kinds(far: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Each kind's share of each class (TOPICS x CLASSES): far is nearly a sum over kinds of outer products of these, found by expectation maximisation."""
    far = far.astype(np.float64) + far.T
    base = (far.sum(axis=0) + 0.1) / (far.sum() + 0.1 * len(far))
    share = base * np.random.default_rng(3).uniform(0.5, 1.5, (TOPICS, len(far)))
    share /= share.sum(axis=1, keepdims=True)
    weight = np.full(TOPICS, 1 / TOPICS)
    for _ in range(rounds if far.any() else 0):
        made = (share * weight[:, None]).T @ share
        gain = share * (share @ np.divide(far, made, out=np.zeros_like(far), where=far > 0)) * weight[:, None] + 1e-9
        weight = gain.sum(axis=1) / gain.sum()
        share = gain / gain.sum(axis=1, keepdims=True)
    return 0.98 * share + 0.02 * base


def tables(ids: DataFrame, n: np.ndarray, begin: int, end: int, stored: str) -> dict:
    """Classes, kinds, and how often classes follow each other by kind, from all texts (a column ids); n: how often each id occurs."""
    far_of = classes(n, begin)

    def apart(column):
        own, borders = flat(column, stored)
        kind, text = far_of[own], np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        return np.concatenate([(kind[:-lag] * CLASSES + kind[lag:])[text[:-lag] == text[lag:]] for lag in LAGS])

    log_share = np.log(kinds(summed(ids, apart, CLASSES * CLASSES).reshape(CLASSES, CLASSES))).T.astype(np.float32)

    def steps(column):
        b = Blocks(*flat(column, stored), {"of": far_of}, begin, end)
        return ((b.came * CLASSES + b.goes) * TOPICS + np.repeat(fits(log_share, b), BLOCK))[b.live]

    counts = summed(ids, steps, CLASSES * CLASSES * TOPICS)
    some = np.flatnonzero(counts)
    return {"of": far_of, "n": n, "share": log_share, "keys": some.astype(np.int32), "times": counts[some], "begin": begin, "stored": stored, "name": uuid.uuid4().hex}


_BUILT: dict[str, dict] = {}


def built(counted: dict) -> dict:
    """The probabilities of counted tables; those counted last stay in a worker's memory, so that only counts that aren't 0 travel."""
    if counted["name"] not in _BUILT:
        counts = np.zeros(CLASSES * CLASSES * TOPICS, np.float32)
        counts[counted["keys"]] = counted["times"]
        _BUILT.clear()
        _BUILT[counted["name"]] = {"of": counted["of"]} | probabilities(counted["of"], counted["n"], counts, counted["begin"])
    return _BUILT[counted["name"]]


def fits(log_share: np.ndarray, b: Blocks) -> np.ndarray:
    """The kind that fits each block best, its neighbours counting half."""
    own = log_share[b.goes]
    own[~b.live] = 0
    own = own.reshape(-1, BLOCK, TOPICS).sum(axis=1)
    total = own.copy()
    goes_on = b.order[1:] > 0
    total[1:][goes_on] += 0.5 * own[:-1][goes_on]
    total[:-1][goes_on] += 0.5 * own[1:][goes_on]
    return total.argmax(axis=1)


def probabilities(of: np.ndarray, n: np.ndarray, counts: np.ndarray, begin: int) -> dict:
    """step: the probability of each class after each class, by kind; within: the log probability of an id in its class.

    A kind's table leans on that of all kinds, and this on the classes alone, by
    as much as there are unlike followers (Witten and Bell's rule).
    """
    counts = counts.reshape(CLASSES, CLASSES, TOPICS)
    total = n + 0.1
    total[begin] = 0
    in_class = np.bincount(of, total, CLASSES)

    def leaning(own: np.ndarray, on: np.ndarray) -> np.ndarray:
        unlike = (own > 0).sum(axis=1, keepdims=True, dtype=np.float32) + 1
        return (own + unlike * on) / (own.sum(axis=1, keepdims=True) + unlike)

    whole = leaning(counts.sum(axis=2), (in_class / in_class.sum()).astype(np.float32))
    step = np.empty(counts.shape, np.float32)
    for z in range(TOPICS):
        step[:, :, z] = leaning(counts[:, :, z], whole)
    within = np.log(total / np.where(in_class > 0, in_class, 1)[of], out=np.full(len(of), -np.inf), where=total > 0)
    return {"step": step.reshape(-1, TOPICS), "within": within}


# --- attention

SHAPES = {"e": (CLASSES, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "r": (WIDE,), "out": (DIM, TOPICS), "own": (DIM, TOPICS), "bias": (TOPICS,)}
SCALE = np.float32(DIM**-0.5)
#: how much is summed by class, and the places of each class's pairs of numbers in it
_EACH = 2 * DIM + TOPICS
_PAIRS = np.arange(CLASSES * _EACH // 2).reshape(CLASSES, -1)
_PLACE, _KEY = np.arange(BLOCK), np.arange(WIDE)
#: the last place of each group of a window, from the block's begin on
_LAST = (_KEY + 1) * GROUP - 1 - BACK * BLOCK
#: how many groups back each key is from each place, and which keys a place may see
_AGO = np.clip((_PLACE[:, None] - _LAST[None, :]) // GROUP, 0, WIDE - 1)
_SEEN = np.where(_LAST[None, :] <= _PLACE[:, None], 0.0, -1e9).astype(np.float32)
#: sums along rows, as wide as what they scale: rows of a few numbers are slow to broadcast along
_SUM, _OVER, _ACROSS = (np.ones(s, np.float32) for s in ((TOPICS, TOPICS), (WIDE, DIM), (DIM, WIDE)))
#: which keys a text's first blocks lack
_LACK = np.array([np.where(_KEY < (BACK - order) * KEYS, -1e9, 0.0) for order in range(BACK)], np.float32)[:, None, :]


def start_weights(log_share: np.ndarray) -> dict:
    """Ids begin with what they say of each kind, and attention with their mean."""
    rng = np.random.default_rng(11)
    w = {k: (rng.standard_normal(s) / np.sqrt(DIM)).astype(np.float32) for k, s in SHAPES.items()}
    w["e"] *= 0.3
    w["e"][:, :TOPICS] = np.clip(log_share - np.log(np.exp(log_share).mean(axis=1, keepdims=True)), -4, 4)
    eye = np.eye(DIM, TOPICS, dtype=np.float32)
    return w | {"q": 0.1 * w["q"], "v": np.eye(DIM, dtype=np.float32), "out": 3 * eye, "own": 0.3 * eye, "r": np.zeros(WIDE, np.float32), "bias": np.zeros(TOPICS, np.float32)}


def ready(w: dict) -> dict:
    """Weights as attend uses them: what depends on a place's class alone is a table by class."""
    scaled = w["q"] * SCALE
    return w | {
        "asks": w["e"] @ scaled, "says": w["e"] @ w["own"] + w["bias"], "kv": np.concatenate([w["k"], w["v"]], axis=1) / GROUP,
        "scaled": scaled, "mask": w["r"][_AGO] + _SEEN,
    }


def attend(w: dict, came: np.ndarray, order: np.ndarray) -> tuple:
    """The kinds' weights at each place of blocks that follow each other (and what led there); order: each block's number in its text."""
    n = len(order)
    x = np.take(w["e"], came, axis=0)
    q = np.take(w["asks"], came, axis=0).reshape(n, BLOCK, DIM)
    # a group's key and value come from its ids' mean
    group = x.reshape(-1, GROUP * DIM)
    while group.shape[1] > DIM:
        half = group.shape[1] // 2
        group = group[:, :half] + group[:, half:]
    own = np.zeros((n + BACK, KEYS, 2 * DIM), x.dtype)
    np.matmul(group, w["kv"], out=own[BACK:].reshape(-1, 2 * DIM))
    # a block's keys lie behind those of the blocks before it, so windows overlap and needn't be copied
    kv = np.ndarray((n, WIDE, 2 * DIM), own.dtype, own, 0, own.strides)
    k, v = kv[:, :, :DIM], kv[:, :, DIM:]
    s = q @ k.transpose(0, 2, 1)
    s += w["mask"]
    early = np.flatnonzero(order < BACK)
    s[early] += _LACK[order[early]]
    np.minimum(s, 30, out=s)
    np.exp(s, out=s)
    # a place that sees no group yet gathers nothing: 1 stands for that
    inverse = s.reshape(-1, WIDE) @ _OVER
    inverse += 1
    np.divide(1, inverse, out=inverse)
    c = (s @ v).reshape(-1, DIM)
    c *= inverse
    p = c @ w["out"]
    p += np.take(w["says"], came, axis=0)
    np.minimum(p, 60, out=p)
    np.exp(p, out=p)
    p /= p @ _SUM
    return q, group, k, v, s, inverse, c, p


def log_probabilities(w: dict, t: dict, b: Blocks) -> np.ndarray:
    """The natural log probability of the id at each place; w: ready weights."""
    out = np.zeros(len(b) * BLOCK)
    for a in range(0, len(b), SCORED):
        z, lead = min(len(b), a + SCORED), min(a, BACK)
        order = np.minimum(b.order[a - lead : z], np.arange(z - a + lead) + (BACK if lead == BACK else 0))
        p = attend(w, b.came[(a - lead) * BLOCK : z * BLOCK], order)[-1][lead * BLOCK :]
        at = slice(a * BLOCK, z * BLOCK)
        p *= np.take(t["step"], b.came[at] * CLASSES + b.goes[at], axis=0)
        out[at] = np.log(p @ _SUM[:, 0])
    out += t["within"][b.id]
    out[~b.live] = 0
    return out


class Gradients:
    """Of the loss summed over the live places of blocks, gathered part by part. w: ready weights.

    What depends on a place's class alone is summed by class: what comes to its
    query, to its share of its group's key and value, and to its own say.
    """

    def __init__(self, w: dict, t: dict):
        self.w, self.t, self.loss, kind = w, t, 0.0, w["e"].dtype
        self.by_class, self.kv, self.out, self.ago = (np.zeros(s, kind) for s in ((CLASSES, _EACH), (DIM, 2 * DIM), (DIM, TOPICS), BLOCK * WIDE))

    def add(self, came: np.ndarray, goes: np.ndarray, live: np.ndarray, order: np.ndarray) -> None:
        """Blocks that follow each other."""
        n, w = len(order), self.w
        q, group, k, v, s, inverse, c, p = attend(w, came, order)
        right = np.take(self.t["step"], came * CLASSES + goes, axis=0) * p
        total = right @ _SUM
        self.loss -= float(np.log(total[:, 0]) @ live)
        right /= total
        d = np.empty((len(p), _EACH), p.dtype)
        dp = np.subtract(p, right, out=d[:, 2 * DIM :])
        dp[~live] = 0
        dc = dp @ w["out"].T
        dc *= inverse
        meet = (dc * c) @ _ACROSS
        dc = dc.reshape(n, BLOCK, DIM)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= meet.reshape(n, BLOCK, WIDE)
        ds *= s
        np.matmul(ds, k, out=d.reshape(n, BLOCK, _EACH)[:, :, :DIM])
        wide = np.empty((n, WIDE, 2 * DIM), d.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=wide[:, :, :DIM])
        np.matmul(s.transpose(0, 2, 1), dc, out=wide[:, :, DIM:])
        own = wide[:, BACK * KEYS :].copy()
        for back in range(1, min(BACK, n - 1) + 1):
            own[:-back] += wide[back:, (BACK - back) * KEYS : (BACK - back + 1) * KEYS]
        own = own.reshape(-1, 2 * DIM)
        # every id of a group has the same share in its key and value
        d.reshape(-1, GROUP, _EACH)[:, :, DIM : 2 * DIM] = (own @ w["kv"].T)[:, None, :]
        # two numbers at a time, as one complex number
        pair = np.result_type(d, np.complex64)
        np.add.at(self.by_class.view(pair).reshape(-1), np.take(_PAIRS, came, axis=0).reshape(-1), d.view(pair).reshape(-1))
        self.kv += group.T @ own
        self.out += c.T @ dp
        self.ago += np.ones(n, ds.dtype) @ ds.reshape(n, -1)

    def take(self) -> dict:
        w, (q, x, own) = self.w, np.split(self.by_class, [DIM, 2 * DIM], axis=1)
        kv = self.kv / GROUP
        return {
            "e": q @ w["scaled"].T + x + own @ w["own"].T, "q": w["e"].T @ q * SCALE, "k": kv[:, :DIM], "v": kv[:, DIM:],
            "r": np.bincount(_AGO.reshape(-1), self.ago, WIDE), "out": self.out, "own": w["e"].T @ own, "bias": own.sum(axis=0),
        }


def gradients(w: dict, t: dict, came: np.ndarray, goes: np.ndarray, live: np.ndarray, order: np.ndarray) -> tuple[dict, float]:
    """Of the loss summed over the live places of blocks that follow each other; w: ready weights."""
    own = Gradients(w, t)
    own.add(came, goes, live, order)
    return own.take(), own.loss


class Trainer:
    """Adam from given weights, a step for each STEP blocks or what is left."""

    def __init__(self, weights: dict, rate: float):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.s = {k: np.zeros_like(v) for k, v in weights.items()}
        self.rate, self.steps, self.seen, self.loss = rate, 0, 0, 0.0

    def learn(self, t: dict, b: Blocks) -> None:
        for a in range(0, len(b), STEP):
            stop = min(len(b), a + STEP)
            total = Gradients(ready(self.w), t)
            for y in range(a, stop, SPAN):
                z = min(stop, y + SPAN)
                at = slice(y * BLOCK, z * BLOCK)
                # what lies before this part of the blocks isn't seen here
                total.add(b.came[at], b.goes[at], b.live[at], np.minimum(b.order[y:z], np.arange(z - y)))
            n = int(b.live[a * BLOCK : stop * BLOCK].sum())
            self.loss += total.loss
            self.seen += n
            self.step({k: x / n for k, x in total.take().items()})

    def step(self, g: dict) -> None:
        self.steps += 1
        fix = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, grad in g.items():
            grad = grad.astype(np.float32)
            self.m[k] += np.float32(0.1) * (grad - self.m[k])
            self.s[k] += np.float32(0.01) * (grad * grad - self.s[k])
            self.w[k] -= np.float32(self.rate * fix) * self.m[k] / (np.sqrt(self.s[k]) + np.float32(1e-6))


def train(ids: DataFrame, begin: int, end: int, counted: dict, shared: Broadcast, rounds=ROUNDS) -> dict:
    """Attention weights from all training texts (columns part, ids); each round's average is all that the driver receives.

    A text is in the round of its part, and all its ids are learnt from. shared: counted, broadcast.
    """
    sizes = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
    weights, stored = start_weights(counted["share"]), counted["stored"]

    def one_round(start: dict, rate: float):
        def run(batches):
            own, t = Trainer(start, rate), built(shared.value)
            for big in batches:
                for batch in slices(big):
                    own.learn(t, Blocks(*flat(batch.column(0), stored), t, begin, end))
            if own.seen:
                cut = np.array_split(np.concatenate([own.w[k].reshape(-1) for k in SHAPES]), PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([own.seen] * PIECES, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], ["piece", "seen", "weights"])

        return run

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        mean = np.average([np.frombuffer(b, np.float32) for b in rows["weights"]], axis=0, weights=rows["seen"])
        return pd.DataFrame({"piece": rows["piece"][:1], "weights": [mean.astype(np.float32).tobytes()]})

    for part, (_, rate) in enumerate(rounds):
        learnt = ids.where(F.col("part") == part).select("ids").mapInArrow(one_round(weights, rate), "piece int, seen long, weights binary")
        found = learnt.groupBy("piece").applyInPandas(average, "piece int, weights binary").collect()
        if found:
            whole = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["piece"])])
            weights = {k: whole[a:b].reshape(SHAPES[k]) for k, a, b in zip(SHAPES, sizes, sizes[1:])}
    return weights


def part_of(rounds=ROUNDS):
    """The round that a row (id, hash) is in, by a hash."""
    draw, out, upto = F.pmod(F.xxhash64("id", "hash"), F.lit(sum(n for n, _ in rounds))), F.lit(len(rounds) - 1), 0
    cuts = []
    for i, (n, _) in enumerate(rounds[:-1]):
        upto += n
        cuts.append((upto, i))
    for upto, i in reversed(cuts):
        out = F.when(draw < upto, i).otherwise(out)
    return out


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, common_words: int = 1 << 17) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id as text, modulo modulus, isn't remainder;
    the others, and null ids, are held out. base_score is the add-one unigram
    log10 probability of the text's words and its end; score is the model's, of
    the same words' subwords and the end. Null texts are empty: their end alone
    is scored. Repeated rows each count and each get a row. Without training rows
    all words are unknown and the model falls back to its start. Other columns
    play no part.

    Words are known by 64-bit hashes. The common_words most frequent are
    broadcast, a number that bounds their size; all others are joined.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), held_out(id_col, modulus, remainder).alias("held_out"), text.alias("text"))
    rows = rows.select("id", "hash", "held_out", F.when(F.col("held_out"), -1).otherwise(part_of()).alias("part"), "text")
    id_kind = rows.schema["id"].dataType.simpleString()
    coder = subwords(vocabulary)
    begin, end = coder.begin, coder.end
    spark = docs.sparkSession

    ids = encoded(rows, vocabulary)
    training = ids.where("part >= 0")
    counted = saved(count_words(training.select("ids"), vocabulary))
    words = counted.where("kind = 0").select("key", "n")
    single = counted.where("kind = 1").toPandas()
    n = np.zeros(coder.size)
    n[single["key"].to_numpy(np.int64)] = single["n"].to_numpy(np.float64)
    texts = int(n[end])
    counted_tables = tables(training.select("ids"), n, begin, end, coder.kind)
    shared = spark.sparkContext.broadcast(counted_tables)
    weights = train(training, begin, end, counted_tables, shared)

    row = words.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_all, unlike = int(row["words"]) + texts, int(row["kinds"]) + (texts > 0)
    common = words.orderBy(F.desc("n"), "key").limit(common_words).toPandas()
    model = spark.sparkContext.broadcast((ready(weights), common["key"].to_numpy(np.int64).view(np.uint64), np.log10(common["n"].to_numpy(float) + 1)))

    def run(batches):
        # the worker's own coder: the driver's would travel with its table
        coder, t, (weights, keys, logs) = subwords(vocabulary), built(shared.value), model.value
        lookup = Lookup(keys, logs)
        for big in batches:
            for batch in slices(big):
                own, borders = flat(batch.column(4), coder.kind)
                b = Blocks(own, borders, t, begin, end)
                score = np.add.reduceat(log_probabilities(weights, t, b), b.edge[:-1] * BLOCK) / np.log(10)
                hashes, first = coder.words(own, borders)
                value, of = lookup.get(hashes), np.repeat(np.arange(batch.num_rows), np.diff(first))
                rare = np.flatnonzero(value == 0)
                columns = [
                    *batch.columns[:4], pa.array(np.diff(first).astype(np.int64) + 1), pa.array(np.bincount(of, value > 0, batch.num_rows).astype(np.int64)),
                    pa.array(np.bincount(of, value, batch.num_rows).astype(np.float64)), pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first).astype(np.int32)), pa.array(hashes[rare].view(np.int64))), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "hash", "held_out", "n_tokens", "common", "common_log", "rare", "score"])

    schema = f"row long, id {id_kind}, hash long, held_out boolean, n_tokens long, common long, common_log double, rare array<long>, score double"
    found = saved(ids.select(F.monotonically_increasing_id().alias("row"), "id", "hash", "held_out", "ids").mapInArrow(run, schema))
    rare = found.select("row", F.explode("rare").alias("key")).join(words, "key")
    rare = rare.groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("log"))
    end_known, end_log = int(texts > 0), float(np.log10(texts + 1))
    return found.drop("rare").join(rare, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("common") + F.coalesce("known", F.lit(0)) + end_known).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("log", F.lit(0.0)) + end_log - F.col("n_tokens") * float(np.log10(n_all + unlike + 1))).alias("base_score"),
        "score",
    )


def op10_lm(spark, sf_dir):
    import public_tokenizers

    return score_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
