"""Byte-level BPE by speculation and verification.

A word's tokens are first proposed by greedy longest match. A proposal is the
true BPE result exactly when every adjacent pair of its tokens is compatible:
no merge that crosses the pair's border comes before the merges that built its
two sides. That test runs for all pairs of a batch at once, descending the
merge trees with array operations. Only words with an incompatible pair undergo
exact merging.

Words repeat, so each batch's pieces of text are grouped first, and the results
of distinct ones are kept within a Python worker, in tables of bounded size.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .textnum import PieceTable, Recent, utf8

#: How byte-level BPE cuts text into words (a fixed value of the format).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = np.iinfo(np.int64).max


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encodes and decodes texts with the vocabulary of a tokenizers file (byte-level BPE)."""

    def __init__(self, path: str, keep: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        vocab = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in of for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t in self.special:
            vocab.pop(t.encode(), None)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.size, self.keep = size, keep
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: a byte
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(of[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = (r, made)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, r
        self.pair_rank = {p: r for p, (r, _) in self.merges.items()}
        self.made = {r: made for r, made in self.merges.values()}
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]

        # a token may be proposed if BPE makes it of its own bytes
        made = np.flatnonzero(self.rank >= 0)
        sound = self.compatible(self.left[made], self.right[made], self.rank[made])
        unsound = set(made[~sound].tolist())
        self.prefixes: dict[bytes, int] = {}
        for t, i in vocab.items():
            for n in range(1, len(t)):
                self.prefixes.setdefault(t[:n], -1)
            if i not in unsound:
                self.prefixes[t] = i
        self.cut = regex.compile(WORD)
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.base = [vocab[bytes([b])] for b in range(256)]
        self.pieces, self.words = PieceTable(self._learn, keep), Recent(keep)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether BPE leaves their border: no merge across it has a rank under its limit."""
        fine = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), _NEVER) if limit is None else limit
        while len(at):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crosses = (self.keys[place] == key) & (self.key_rank[place] < limit)
            fine[at[crosses]] = False
            # the side built last is taken apart; a tie goes to the merge further left
            ra, rb = self.rank[a], self.rank[b]
            go = ~crosses & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return fine

    def greedy(self, word: bytes) -> list[int]:
        ids, at, n, known = [], 0, len(word), self.prefixes
        while at < n:
            best, end, stop = self.base[word[at]], at + 1, at + 1
            while stop < n:
                stop += 1
                found = known.get(word[at:stop])
                if found is None:
                    break
                if found >= 0:
                    best, end = found, stop
            ids.append(best)
            at = end
        return ids

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE: the merge of least rank first, the leftmost of equals."""
        if len(word) > 48:
            return self.merged_long(word)
        ids, rank, made = [self.base[b] for b in word], self.pair_rank.get, self.made
        ranks = [rank(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = (made[least],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NEVER)
        return ids

    def merged_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words whose length squared would be felt."""
        ids = [self.base[b] for b in word]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(r, i, made, ids[i], ids[i + 1]) for r, made, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.merges:
                    r, new = self.merges[p]
                    heapq.heappush(heap, (r, k, new, *p))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        raw = [w.encode() for w in words]
        proposed = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for ids in proposed for i in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[which]
        for w in np.unique(owner[inside[bad]]).tolist():
            proposed[w] = self.merged(raw[w])
        return [np.array(ids, "<u4").tobytes() for ids in proposed]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of text that can't affect each other."""
        cut = [self.cut.findall(p.decode()) for p in pieces]
        kinds = list({w for ws in cut for w in ws})
        ids = dict(zip(kinds, self.words.fill(kinds, self.encode_words), strict=True))
        return [b"".join(map(ids.__getitem__, ws)) for ws in cut]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column's texts in a row, and each text's borders in them, as the tokenizers library gives them: special tokens' strings are their ids, nulls are empty."""
        raw, _ = utf8(column)
        whole = raw.tobytes()
        if not any(t.encode() in whole for t in self.special):
            return self.pieces.encode(column)
        parts, special, sizes = [], [], []
        for text in texts_of(column):
            own = [p for p in self.split.split(text) if p]
            sizes.append(len(own))
            parts += ["" if p in self.special else p for p in own]
            special += [self.special.get(p, -1) for p in own]
        ids, borders = self.pieces.encode(pa.array(parts, pa.string()))
        named = np.array(special, np.int64)
        at = np.flatnonzero(named >= 0)
        ids = np.insert(ids, borders[at], named[at])
        borders = borders + np.append(0, np.cumsum(named >= 0))
        return ids, borders[np.append(0, np.cumsum(sizes))]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a vocabulary and Python worker."""
    return Codec(path)


def slices(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded) for each row of docs, in one pass without a shuffle.

    ids are those of the vocabulary without further special tokens; decoded is
    the text that these ids stand for. A null text is empty and has no ids. Each
    row stands alone: repeated rows and null ids are kept as they are; other
    columns play no part.
    """

    def run(batches):
        own = codec(vocabulary)
        for big in batches:
            for batch in slices(big):
                flat, borders = own.encode(batch.column(1))
                ids = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(flat.astype(np.int32)))
                texts = [own.decode(flat[a:b]) for a, b in zip(borders.tolist(), borders[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    out = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
