"""Compression of vectors to codes: one codebook per part of the vector, learnt over metric trees.

Each task cuts its vectors into chunks and builds one tree per chunk and part, once; the trees are a
table. A round is one pass over that table: balls give their cached sums to the entries that own them, and only
a sum and a number per part, entry and component leave a task.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.llm import balltree
from chargeframe.runtime import materialize, small_side

#: Factor that components are multiplied by before they are rounded down.
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors per chunk.
CHUNK = 4096


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(rows: DataFrame, key: str, vector: str, label: str, parts: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the usable rows, x padded with zeros to a multiple of ``parts``."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * scale).cast("long"))
    out = rows.filter(_usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    short = F.pmod(-F.size("x"), F.lit(parts))
    return out.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), short)))


def _chunks(parts: int, width: int, chunk: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                own = batch.slice(at, chunk)
                values = own.column(2).flatten().to_numpy(zero_copy_only=False)
                points = values.reshape(own.num_rows, parts, width)
                trees = [balltree.build(np.ascontiguousarray(points[:, p])) for p in range(parts)]
                narrow = np.int32 if -2**31 <= values.min(initial=0) and values.max(initial=0) < 2**31 else np.int64
                lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([pickle.dumps(points.astype(narrow))], pa.binary()), pa.array([pickle.dumps(trees)], pa.binary())],
                    ["vec_id", "label", "points", "trees"])
    return run


def _loaded(batch: pa.RecordBatch):
    """Points (n, parts, width) and trees of each chunk of a batch."""
    for points, trees in zip(batch.column("points"), batch.column("trees")):
        yield pickle.loads(points.as_py()).astype(np.int64), pickle.loads(trees.as_py())


def _round(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for points, trees in _loaded(batch):
                for p in range(parts):
                    t, n = balltree.sums(trees[p], np.ascontiguousarray(points[:, p]), books[p])
                    total[p] += t
                    count[p] += n
        used = np.argwhere(np.broadcast_to(count[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(used[:, 2], pa.int32()),
             pa.array(total[tuple(used.T)]), pa.array(count[used[:, 0], used[:, 1]])], ["part", "entry", "at", "total", "n"])
    return run


def _coder(books: np.ndarray):
    parts, entries, width = books.shape
    digits = np.array([f"{e:02x}" for e in range(max(entries, 1))])

    def run(batches):
        for batch in batches:
            for row, (points, trees) in enumerate(_loaded(batch)):
                code, error = None, np.zeros(len(points), np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(points[:, p])
                    entry = balltree.labels(trees[p], own, books[p])
                    error += ((own - books[p][entry]) ** 2).sum(axis=1)
                    code = digits[entry] if code is None else np.char.add(code, digits[entry])
                ids, labels = (batch.column(c)[row].values for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), pa.array(error)],
                                                 ["vec_id", "label", "code", "error"])
    return run


class Compressor:
    """Codebooks (parts, entries, components per part)."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books

    @property
    def digest(self) -> str:
        """Of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def encode(self, trees: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) per vector of a table of trees."""
        kind = trees.schema["label"].dataType.elementType.simpleString()
        return trees.mapInArrow(_coder(self.books), f"vec_id long, label {kind}, code string, error long")


def plant(vectors: DataFrame, parts: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """The table of trees over (vec_id, label, x): one row per chunk, written to the shared folder."""
    kind = vectors.schema["label"].dataType.simpleString()
    grown = vectors.mapInArrow(_chunks(parts, width, chunk), f"vec_id array<long>, label array<{kind}>, points binary, trees binary")
    return materialize(grown, "trees")


def fit(trees: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> Compressor:
    """Rounds of assigning every part to its nearest entry and moving each used entry to its parts' mean, rounded down."""
    books = start.copy()
    for _ in range(rounds):
        # at most parts * entries * components rows, whatever the number of vectors
        moved = trees.select("points", "trees").mapInArrow(_round(books), "part int, entry int, at int, total long, n long").groupBy(
            "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        for r in moved:
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return Compressor(books)


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK,
             key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Codes of all usable vectors.

    Returns per vector: vec_id, code (two hex digits per part), error (squared distance to the coded vector),
    label_error (sum of the errors with the same label, nulls together) and codebooks_sha256. Rows whose vector is null or
    holds null or non-finite components are left out, and rows whose padded vector is not as long as that of the
    smallest id. Vectors whose length the parts do not divide are padded with zeros. Repeated ids, null ids (the largest)
    and repeated vectors each give a row; of equal ids the smaller vector starts first. With fewer vectors than
    entries the codebooks have as many entries as vectors. An empty table gives none; other columns are ignored.
    Distances are exact while components times ``SCALE`` stay below 2 ** 27.
    """
    vectors = whole_numbers(rows, key, vector, label, parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(1).collect()
    length = len(first[0]["x"]) if first else 0
    vectors = vectors.filter(F.size("x") == length)
    head = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not head or not length:
        none = vectors.select("vec_id", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    width = length // parts
    start = np.array([r["x"] for r in head], np.int64).reshape(len(head), parts, width).transpose(1, 0, 2)
    trees = plant(vectors, parts, width, chunk)
    model = fit(trees, start, rounds)
    coded = materialize(model.encode(trees), "codes")
    per_label = small_side(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"))
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest).alias("codebooks_sha256"))
