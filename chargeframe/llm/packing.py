"""Packing of tokenised documents into sequences of a fixed length by the sum-of-squares rule.

A document longer than a sequence is cut into full pieces and a rest. The pieces are
dealt to lanes; in a lane every piece, longest first, goes where the sum over all gaps
of the squared number of open bins with that gap becomes smallest. A round closes the
bins that are nearly full and deals the pieces of the others to fewer lanes, until
one lane holds all that is left. A lane sees lengths only, and no more than ``lane`` of
them on average, whatever the size of the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.memory import releasing
from chargeframe.llm.wordbpe import encoder
from chargeframe.runtime import materialize, union_all

#: Tokens per sequence.
CAPACITY = 4096
#: Id put after every document.
END_ID = 1
#: Pieces per lane.
LANE = 16384

_NONE = -(1 << 40)


def sum_of_squares(lengths, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), taken in the order given.

    A piece of length s moves a bin from gap g to gap g - s, which changes the sum of
    squares by 2 N[g-s] - 2 N[g] + 2, or by 1 - 2 N[g] if it fills the bin; a new bin adds
    2 N[c-s] + 1. The change is kept as 2N + 1 per gap (0 for a full bin); among equal
    changes an open bin goes before a new one and the smallest gap before others.
    """
    into = np.ones(capacity + 1, np.int64)
    into[0] = 0
    out_of = np.full(capacity + 1, _NONE, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths):
        rest, chosen = capacity - s, -1
        if rest:
            change = into[:rest] - out_of[s:capacity]
            best = int(change.argmin())
            if change[best] + 2 <= into[rest]:
                rest, chosen = best, best + s
        if chosen >= 0:
            bins[i], offsets[i] = open_bins[chosen].pop(), capacity - chosen
            into[chosen] -= 2
            out_of[chosen] = into[chosen] if open_bins[chosen] else _NONE
        else:
            bins[i], offsets[i] = n, 0
            n += 1
        if rest:
            open_bins[rest].append(int(bins[i]))
            into[rest] += 2
            out_of[rest] = into[rest]
    return bins, offsets


def _cut(path: str | None, capacity: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = code.encode(text or "") + tail
                    for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[begin:begin + 4 * capacity]
                        for column, value in zip(out, (doc_id, piece, begin // 4, len(own) // 4, zlib.crc32(own), own)):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(arrays[:5 + with_ids], names[:5 + with_ids])
    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of each document's ids followed by ``end_id``; ``ids`` as little-endian
    unsigned 32-bit integers if asked for. A null or empty text is the end id alone."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return narrow.mapInArrow(releasing(_cut(path, capacity, end_id, with_ids)), ddl)


def _lane(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        rows["bin"], rows["offset"] = sum_of_squares(rows["length"].tolist(), capacity)
        rows["filled"] = rows.groupby("bin")["length"].transform("sum")
        return rows
    return run


def place(items: DataFrame, capacity: int = CAPACITY, lane: int = LANE, slack: int | None = None) -> DataFrame:
    """A sequence and an offset for each row of (row, length), row being unique.

    Bins with a gap of at most ``slack`` (capacity / 256) close after a round. Adds
    sequence_id and offset; the offsets in a sequence run on from 0 without a gap.
    """
    slack = capacity // 256 if slack is None else slack
    done, left, level, n = [], items.select("row", "length"), 0, items.count()
    while n:
        lanes = -(-n // lane)
        salted = left.withColumn("lane", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(lanes)))
        packed = materialize(salted.groupBy("lane").applyInPandas(
            _lane(capacity), "row long, length long, lane long, bin long, offset long, filled long"), f"packed-{level}")
        # level in the lowest bits, the lane's own number above it, the bin within the lane on top
        number = (F.col("bin") * lanes + F.col("lane")) * 64 + level
        closed = (F.col("filled") >= capacity - slack) if lanes > 1 else F.lit(True)
        done.append(packed.filter(closed).select("row", "length", number.alias("sequence_id"), "offset"))
        left = packed.filter(~closed).select("row", "length")
        before, n, level = n, left.count() if lanes > 1 else 0, level + 1
        if n == before:  # no bin closed: deal larger lanes
            lane *= 2
    if not done:
        return left.select("row", "length", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return union_all(*done)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         lane: int = LANE, with_ids: bool = False) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids). Rows that repeat an id or a text are documents of their own; null ids stay
    null. An empty table gives no piece; other columns are ignored.
    """
    cut = materialize(pieces(docs, path, capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = place(cut, capacity, lane).drop("length")
    return cut.join(placed, "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack(with_ids=True)``: sequence_id, n_tokens, ids and the
    documents in it in order. A sequence holds at most its capacity, so a group is small."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("pieces"))
