"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Pieces are dealt to many small groups and each is packed by best-fit decreasing.
Dual feasible functions give a lower bound on the sequences that a group's
lengths need, before rounding up. A group that meets its bound is certified and
done. In the others most sequences are kept, and the pieces of the least filled
are exchanged: dealt to fewer, mixed groups and packed again.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORD, byte_characters, codec, slices, texts_of
from .common import documents, saved


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; lengths descend. Each goes where the least room is left over, else into a new bin."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, made = 0, 0  # bit r of some: a bin has exactly r left
    for i, length in enumerate(lengths.tolist()):
        fits = some >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            own = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, own, made = capacity, made, made + 1
        bins[i] = own
        if left := r - length:
            if not room[left]:
                some |= 1 << left
            room[left].append(own)
    return bins


@functools.lru_cache(maxsize=4)
def _dual_feasible(capacity: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of dual feasible functions: a row of integer worths by length for each function, and what a bin can hold of it."""
    x = np.arange(1, capacity + 1, dtype=np.int64)
    k = np.arange(0, capacity // 2 + 1)[:, None]
    # items over capacity - k fill a bin, those under k count nothing
    cut = np.where(x > capacity - k, capacity, np.where(x < k, 0, x))
    # x -> floor((k + 1) x / capacity) / k, and x / capacity where that is whole
    k = np.arange(1, 65)[:, None]
    steps = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
    # what a large item leaves is counted in units of e
    e = np.arange(1, capacity // 2 + 1)[:, None]
    units = np.where(2 * x > capacity, capacity // e - (capacity - x) // e, (x >= e).astype(np.int64))
    return [(cut, np.full(len(cut), capacity)), (steps, k[:, 0] * capacity), (units, capacity // e[:, 0])]


def bounds(lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins that the lengths need at least, and the same before rounding up, which sums over groups."""
    n = np.bincount(lengths, minlength=capacity + 1)[1:].astype(np.int64)
    worth = [(w @ n, most) for w, most in _dual_feasible(capacity)]
    return max(int((-(-v // most)).max()) for v, most in worth), max(float((v / most).max()) for v, most in worth)


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The vocabulary for tiktoken, whose ranks are these ids: the ids follow the order of merges."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    of, special = byte_characters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=WORD, mergeable_ranks=ranks, special_tokens=special)


def _ids(vocabulary: str, text: str) -> np.ndarray:
    own = _encoder(vocabulary)
    try:
        return own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    except Exception as e:  # its pattern gives up on extreme runs of white space
        if "tack" not in str(e):
            raise
        return codec(vocabulary).encode(pa.array([text]))[0]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids, then end_id, cut where longer than capacity; only the first piece may be shorter."""

    def run(batches):
        for big in batches:
            for batch in slices(big, 512):
                rows = []
                for i, text in enumerate(texts_of(batch.column(1))):
                    ids = np.append(_ids(vocabulary, text), np.uint32(end_id)).astype("<u4")
                    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    rows += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                at, *rest = (pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rest], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _group_packer(names: list[str], capacity: int, exchange: float, r: int, last: bool):
    """Packs one group in round r; last: whatever its bound, it stays so."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_group").sort_values(["length", *(c for c in names if c != "length")], ascending=False, kind="stable")
        length = rows["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(length, capacity)
        count = int(bins.max()) + 1
        fill = np.bincount(bins, length).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        start = np.zeros(count, np.int64)
        start[1:] = np.cumsum(fill)[:-1]
        place = np.empty(len(rows), np.int64)
        place[order] = before - start[bins[order]]
        exact = bounds(length, capacity)[1]
        # the least filled sequences go, until their room is several times what the bound says is too much
        slack = capacity - fill
        worst = np.argsort(-slack, kind="stable")
        spent = np.cumsum(slack[worst]) - slack[worst]
        kept = np.ones(count, bool)
        if not last and count > exact:
            kept[worst[(spent < exchange * (count - exact) * capacity) & (slack[worst] > 0)]] = False
        number = (r << 58) + (int(key[0]) << 32) + bins
        return rows.assign(sequence_id=number, place=place, done=kept[bins])

    return run


def pack(items: DataFrame, capacity: int, group_rows: int = 4096, least_groups: int = 64, gain: float = 0.8, exchange: float = 4.0) -> DataFrame:
    """items (with a column length, 1 to capacity) and sequence_id, place (its offset); each row is packed once, whatever repeats.

    A group whose sequences meet its bound keeps them all; another gives up its
    least filled ones, with exchange times as much room as it has too much. The
    rounds end when nothing is given up, when one group packs the rest, or when a
    round had more than gain times as many rows as the one before.
    """
    fields = items.schema
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, place long, done boolean"
    names, done, left = fields.names, [], items
    before = 0
    for r in range(32):  # gain under 1 ends them much earlier
        n = left.count()
        if r and not n:
            break
        groups = max(1, -(-n // group_rows), 0 if r else min(least_groups, -(-n // 256)))
        last = r > 0 and (groups == 1 or n > gain * before or r == 31)
        before = n

        # a row's place in the table sends equal rows to unlike groups
        dealt = left.withColumn("_group", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id(), F.lit(r)), F.lit(groups)))
        packed = saved(dealt.groupBy("_group").applyInPandas(_group_packer(names, capacity, exchange, r, last), out_schema))
        done.append(packed.where("done").drop("done"))
        left = packed.where("NOT done").select(*names)
        if last:
            break
    return functools.reduce(DataFrame.union, done)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): all documents packed into sequences of at most capacity tokens.

    A null or empty text is its end token alone. Repeated rows and null ids are
    documents of their own. An empty table gives no rows; other columns play no
    part.
    """
    items = saved(pieces(docs, vocabulary, end_id, capacity, id_col, text_col))
    packed = pack(items, capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset"))


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """(sequences used, lower bound); only counts by length, at most capacity rows, reach the driver."""
    counts = packed.groupBy("length").count().collect()
    lengths = np.repeat([r["length"] for r in counts], [1] * len(counts)).astype(np.int64)
    n = np.zeros(capacity + 1, np.int64)
    n[lengths] = [r["count"] for r in counts]
    return packed.select("sequence_id").distinct().count(), bounds(np.repeat(np.arange(capacity + 1), n), capacity)[0]


def op8_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
