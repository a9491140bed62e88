"""Toxicity by a weighted finite-state pattern grammar.

A clause is a string of symbols: insult, threat, modal, target, negation,
reporting, other. Five transducers rewrite it in turn: negation marks what it
denies, reported speech what is only quoted, targets what is aimed at someone,
threats join a modal, a violent verb and a target; the last gives each mark its
weight. They are composed into one machine, and a clause's score is the weight
of its path. Insults also carry a weight of their own, so that a mark scales it.

Which words are insults is partly stated and mostly learnt: words and word
beginnings that labelled toxic documents have far more often than others.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents, saved
from .labelled import held_out, logistic, sample
from .textnum import spans, utf8

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT = range(7)
#: What transducers write beside these.
DENIED, QUOTED, AIMED, MENACE, WEAK = range(7, 12)
#: Stated words, by symbol.
STATED = {
    INSULT: "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting fool dumb imbecile imbécile débile connard connasse crétin salaud dumm dummkopf arschloch trottel vollidiot abschaum idiota imbécil estúpido estúpida tonto cabrón inútil",
    THREAT: "kill hurt beat destroy punch stab shoot strangle murder tuer frapper détruire töten umbringen schlagen vernichten matar golpear destruir",
    MODAL: "will shall gonna going must vais va werde wirst voy vas",
    TARGET: "you your yours he him his she her they them their we us tu toi ton vous votre il elle ils du dich dein ihr euch er sie tú usted él ella ellos",
    NEGATION: "not no never nobody isn't aren't don't doesn't isnt dont pas jamais aucun nicht kein keine nie nunca jamás",
    REPORT: "said says say told tells called calls claimed quoted wrote writes according dit disait selon sagte sagt schrieb laut dijo dice según escribió",
}
#: Weight of each mark in a clause's score; an insult's own weight is multiplied by it.
WEIGHT = {INSULT: 1.0, AIMED: 1.2, DENIED: 0.7, QUOTED: 0.75, MENACE: 1.5, WEAK: 0.02}
STATED_WEIGHT = 2.0
PREFIXES = range(4, 9)  # bytes of a word's beginning that may be learnt; 0: the whole word


class Transducer:
    """Deterministic: step(state, symbol) gives (state, symbol written, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes, and weights multiply."""

        def step(state, symbol):
            a, symbol, v = self.step(state[0], symbol)
            b, symbol, w = other.step(state[1], symbol)
            return (a, b), symbol, v * w

        return Transducer((self.start, other.start), step)


def within(opens: int, reads: int, writes: int, reach: int) -> Transducer:
    """After the symbol opens, for reach more symbols, each reads becomes writes; the state counts what is left."""

    def step(left, symbol):
        if symbol == opens:
            return reach, symbol, 1.0
        return max(0, left - 1), writes if left and symbol == reads else symbol, 1.0

    return Transducer(0, step)


def threats() -> Transducer:
    """A violent verb is a menace after a modal within four symbols, else weak."""

    def step(left, symbol):
        if symbol == MODAL:
            return 4, symbol, 1.0
        return max(0, left - 1), (MENACE if left else WEAK) if symbol == THREAT else symbol, 1.0

    return Transducer(0, step)


def weights() -> Transducer:
    return Transducer(0, lambda state, symbol: (0, symbol, WEIGHT.get(symbol, 0.0)))


@functools.cache
def grammar() -> tuple[np.ndarray, np.ndarray]:
    """The composed machine as tables by state and symbol: next state, and weight. State 0 starts a clause."""
    machine = within(NEGATION, INSULT, DENIED, 3).then(within(REPORT, INSULT, QUOTED, 12)).then(within(TARGET, INSULT, AIMED, 4)).then(threats()).then(weights())
    number, todo, rows = {machine.start: 0}, [machine.start], []
    for state in todo:
        arcs = [machine.step(state, symbol) for symbol in range(7)]
        for to, _, _ in arcs:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
        rows.append(([number[to] for to, _, _ in arcs], [w for _, _, w in arcs]))
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(c).isalnum() or c == 39 for c in range(128)]
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;\n")] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class Tokens:
    """Letter runs of a batch, lower-cased for Latin letters: place, row and clause of each."""

    def __init__(self, column):
        raw, borders = utf8(column)
        low = _LOW[raw]
        accent = np.zeros(len(raw), bool)  # U+00C0 to U+00DE
        accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[accent] += 0x20
        self.low, self.rows = low, len(borders) - 1
        solid = np.append(_LETTER[raw], False)
        before = np.append(False, solid[:-1])
        before[borders] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.append(solid[1:], False)
        last = borders[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, borders)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        ends = np.append(0, np.cumsum(_ENDS[raw]))
        self.clause = ends[self.start]
        self.clauses = ends[borders[1:]] - ends[borders[:-1]] + 1

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(which words, their hashes): of whole words if size is 0, else of the first size bytes of longer words."""
        if not size:
            return np.arange(len(self.start)), spans(self.low, self.start, self.end)
        which = np.flatnonzero(self.end - self.start > size)
        return which, spans(self.low, self.start[which], self.start[which] + size)


def stated() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the stated words, their symbols and weights."""
    words = [(w, s) for s, ws in STATED.items() for w in ws.split()]
    column = pa.array([w for w, _ in words])
    tokens = Tokens(column)
    symbol = np.array([s for _, s in words])
    return tokens.hashes(0)[1], symbol, np.where(symbol == INSULT, STATED_WEIGHT, 1.0)


def symbols(tokens: Tokens, lexicon: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's symbol and weight: stated, or an insult by the heaviest entry (size, hash, weight) that it meets."""
    symbol, weight = np.zeros(len(tokens.start), np.int8), np.zeros(len(tokens.start))

    def meet(size: int, keys: np.ndarray):
        """(words, entries) where a word's hash is an entry's; a small table of bits passes over most words."""
        which, hashes = tokens.hashes(size)
        bits = np.zeros(1 << 16, bool)
        bits[keys & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(bits[hashes & np.uint64(0xFFFF)])
        order = np.argsort(keys)
        place = np.minimum(np.searchsorted(keys[order], hashes[maybe]), len(keys) - 1)
        same = keys[order][place] == hashes[maybe]
        return which[maybe[same]], order[place[same]]

    keys, kind, worth = stated()
    words, entries = meet(0, keys)
    symbol[words], weight[words] = kind[entries], worth[entries]
    for size in sorted({s for s, _, _ in lexicon}):
        own = [(h, w) for s, h, w in lexicon if s == size]
        words, entries = meet(size, np.array([h for h, _ in own], np.uint64))
        symbol[words] = INSULT
        weight[words] = np.maximum(weight[words], np.array([w for _, w in own])[entries])
    return symbol, weight


CLAUSE_FEATURES = 6


def clause_scores(tokens: Tokens, lexicon: list[tuple[int, int, float]]) -> np.ndarray:
    """For each row: sum, greatest and (log) number of clause scores, their share of clauses, the sum of menaces, log of words."""
    symbol, weight = symbols(tokens, lexicon)
    to, worth = grammar()
    out = np.zeros((tokens.rows, CLAUSE_FEATURES))
    # only clauses with an insult or a threat have a score; runs of others between marks only let reaches end
    hit = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    group = np.unique(np.column_stack([tokens.row[hit], tokens.clause[hit]]), axis=0) if len(hit) else np.empty((0, 2), int)
    key = tokens.row * (np.int64(1) << 40) + tokens.clause
    for row, clause in group.tolist():
        a, b = np.searchsorted(key, [row * (1 << 40) + clause, row * (1 << 40) + clause + 1])
        state, total, menace, before = 0, 0.0, 0.0, a
        marks = a + np.flatnonzero(symbol[a:b])
        for i in marks.tolist():
            for _ in range(min(i - before, 12)):  # no reach is longer
                state = to[state, OTHER]
            s = symbol[i]
            gain = worth[state, s] * weight[i]
            total += gain
            menace += gain if s == THREAT else 0.0
            state, before = to[state, s], i + 1
        out[row, 0] += total
        out[row, 1] = max(out[row, 1], total)
        out[row, 2] += total > 0.5
        out[row, 4] += menace
    out[:, 3] = out[:, 2] / tokens.clauses
    out[:, 2] = np.log1p(out[:, 2])
    out[:, 0] = np.log1p(out[:, 0])
    out[:, 5] = np.log1p(np.diff(tokens.first)) / 10
    return out


def learn_lexicon(chosen: DataFrame, least: int = 4, entries: int = 400) -> list[tuple[int, int, float]]:
    """At most entries words and beginnings, as (size, hash, weight), that toxic documents of chosen (id, text, label) have far more often."""

    def count(batches):
        seen: dict[tuple[int, int], list[int]] = {}
        totals = [0, 0]
        for big in batches:
            for batch in slices(big):
                tokens, label = Tokens(batch.column(1)), batch.column(2).to_numpy()
                totals[0] += int((label > 0).sum())
                totals[1] += int((label <= 0).sum())
                for size in (0, *PREFIXES):
                    which, hashes = tokens.hashes(size)
                    pairs = np.unique(np.rec.fromarrays([tokens.row[which], hashes]))
                    values, back = np.unique(pairs["f1"], return_inverse=True)
                    bad = np.bincount(back, label[pairs["f0"]] > 0, len(values))
                    all_ = np.bincount(back, minlength=len(values))
                    for h, x, n in zip(values.tolist(), bad.tolist(), all_.tolist(), strict=True):
                        own = seen.setdefault((size, h), [0, 0])
                        own[0] += int(x)
                        own[1] += int(n - x)
                if len(seen) > 400_000:
                    yield flush(seen)
                    seen = {}
        seen[-1, 0] = totals
        yield flush(seen)

    def flush(seen):
        columns = ([k[0] for k in seen], [np.int64(np.uint64(k[1])).item() if k[1] < 1 << 63 else k[1] - (1 << 64) for k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["size", "hash", "toxic", "clean"])

    counts = saved(chosen.mapInArrow(count, "size int, hash long, toxic long, clean long").groupBy("size", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = counts.where("size = -1").first()
    if totals is None:
        return []
    odds = lambda n: F.log((F.col(n) + 0.5) / (F.lit(totals[n]) - F.col(n) + 0.5))
    found = counts.where("size >= 0").where(F.col("toxic") >= least).withColumn("weight", odds("toxic") - odds("clean"))
    # far more often: the difference is several of its standard errors
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = found.where((F.col("weight") > 1.5) & (F.col("weight") > 2.5 * error)).orderBy(F.desc(F.col("weight") / error), "size", "hash").limit(entries)
    return [(r["size"], r["hash"] % (1 << 64), float(r["weight"])) for r in found.collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 18_000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The lexicon and the curve from clause scores to a probability, from at most rows labelled documents.

    The lexicon comes from two thirds of these and the curve from the others.
    """
    chosen = sample(docs, labels, label, rows, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)))
    lexicon = learn_lexicon(chosen.where("part > 0").select("id", "text", "label"))

    def describe(batches):
        for big in batches:
            for batch in slices(big):
                found = clause_scores(Tokens(batch.column(1)), lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found)), batch.column(2)], ["id", "x", "label"])

    rest = chosen.where("part = 0").select("id", "text", "label")
    found = rest.mapInArrow(describe, f"id {rest.schema['id'].dataType.simpleString()}, x array<double>, label int").toPandas().sort_values("id")
    x = np.array(list(found["x"])).reshape(-1, CLAUSE_FEATURES)
    return {"lexicon": lexicon, "curve": logistic(x, (found["label"].to_numpy() > 0).astype(float))}


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and a column name: the probability that the whole text is toxic.

    A null text counts as empty, which has a score too. Rows stand alone, so
    repeated rows get equal scores and null ids are kept. The new column takes
    the place of one of its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        for big in batches:
            for batch in slices(big):
                x = clause_scores(Tokens(batch.column(at).cast(pa.string())), own["lexicon"])
                p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ own["curve"], -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = score(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
