"""Ranked lexical search over bit-sliced Bloom signatures.

The index keeps blocks of documents of similar size. A block is a matrix of bits: a column per document, a row
(slice) per hash position; a document sets the slices of its terms, and those of a term at the levels that its
frequency reaches. The conjunction of a term's slices is a bitmap of the documents that may hold it, never fewer than do.
Summed with the terms' weights, the bitmaps bound every document's score from above. The best bounds
are rescored on the texts first; their scores then exclude documents, and all others are rescored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chargeframe.runtime import durable, materialize, small_side, union_all

TOP = 20
#: Bits per term and level of a document, and slices that a term sets.
BITS, PROBES = 12, 4
#: Least frequency of each level; a document of a level has at most one less than the next.
LEVELS = (1, 2, 3, 5, 9)
#: Documents and bits of a block at most; a block of very long documents has 8 documents at least.
ROWS, CELLS = 2048, 1 << 23
#: Terms whose number of documents is kept together, and hashes of terms remembered by a worker.
KNOWN, REMEMBERED = 400_000, 200_000
#: Bytes of a text that are taken at once.
STRETCH = 1 << 20
#: Terms (with repeats) of the items that one pass over the index serves; a larger item has a pass of its own.
PASS_TERMS = 100_000

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_FULL = 1_000_000


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term of a whole text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    data = (text or "").encode().lower()  # of bytes, only A-Z change
    if len(data) <= STRETCH:
        return Counter(_TERM.findall(data))
    counts, at = Counter(), 0
    while at < len(data):
        stop = _BREAK.search(data, at + STRETCH)
        end = stop.start() if stop else len(data)
        counts.update(_TERM.findall(data, at, end))
        at = end
    return counts


class _Hashes:
    """64-bit hashes of terms; those of the terms met last are kept."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, terms) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for t in terms:
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh3_64_intdigest(t)
            out.append(h)
        return np.array(out, np.uint64)


_PROBE = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _slices(hashes: np.ndarray, level: int, m: int) -> np.ndarray:
    """The slices of terms at a level: (terms, PROBES)."""
    x = (hashes ^ np.uint64(level * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))[:, None] * (_PROBE | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(m)).astype(np.int64)


class _Shelf:
    """Documents of one class of sizes, gathered until they fill a block."""

    def __init__(self, entries: int) -> None:
        self.m = BITS * entries
        self.room = max(8, min(ROWS, CELLS // self.m // 8 * 8))
        self.ids, self.lengths, self.bits = [], [], []

    def add(self, doc_id, length: int, hashes: np.ndarray, often: np.ndarray) -> bool:
        found = [_slices(hashes[often >= least], level, self.m).ravel() for level, least in enumerate(LEVELS)]
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.bits.append(np.concatenate(found))
        return len(self.ids) >= self.room

    def block(self) -> tuple:
        wide = -(-len(self.ids) // 8) * 8
        cells = np.zeros((self.m, wide), bool)
        for column, rows in enumerate(self.bits):
            cells[rows, column] = True
        out = (self.ids, self.lengths, self.m, np.packbits(cells, axis=1).tobytes())
        self.ids, self.lengths, self.bits = [], [], []
        return out


_INDEX = "ids array<long>, lengths array<long>, slices long, bits binary, terms binary, documents binary"
_KINDS = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _rows(*rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _INDEX.replace(",", "").split()[::2])


def _size_class(entries: int) -> int:
    """The next power of the square root of 2, so that little of a block is empty."""
    return math.ceil(2 ** (math.ceil(2 * math.log2(max(entries, 8))) / 2))


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, shelves, seen = _Hashes(), {}, Counter()

    def blocks(block: tuple) -> pa.RecordBatch:
        return _rows((*block, None, None))

    def documents() -> pa.RecordBatch:
        terms = np.fromiter(seen.keys(), np.uint64, len(seen))
        order = np.argsort(terms)
        own = np.fromiter(seen.values(), np.int64, len(seen))[order]
        return _rows((None, None, None, None, terms[order].tobytes(), own.tobytes()))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts = term_counts(text)
                if not counts:
                    continue
                own = hashes.of(counts)
                often = np.fromiter(counts.values(), np.int64, len(counts))
                seen.update(own.tolist())
                entries = _size_class(int(sum((often >= least).sum() for least in LEVELS)))
                shelf = shelves.get(entries)
                if shelf is None:
                    shelf = shelves[entries] = _Shelf(entries)
                if shelf.add(doc_id, int(often.sum()), own, often):
                    yield blocks(shelf.block())
                if len(seen) > KNOWN:
                    yield documents()
                    seen.clear()
                if sum(map(_held, shelves.values())) > CELLS:
                    yield blocks(max(shelves.values(), key=_held).block())
    for shelf in shelves.values():
        if shelf.ids:
            yield blocks(shelf.block())
    if seen:
        yield documents()


def _held(shelf: _Shelf) -> int:
    """Numbers of slices that a shelf holds."""
    return len(shelf.ids) * shelf.m * PROBES // BITS


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all whole texts, written to the shared folder.

    A row is a block of documents (ids, lengths, slices, bits) or a part of the counts of documents per hashed
    term (terms, documents). Texts without a term are not in it. Terms that share a 64-bit hash would share
    their count: the chance is the number of query terms times that of all terms over 2 ** 64.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(narrow.mapInArrow(_indexer, _INDEX), "signatures")


class Query:
    """The items of one pass: their terms' hashes and weights, and for each item its terms with their repeats."""

    def __init__(self, items: list[tuple[int, Counter]], documents: int, total: int, df: dict[int, int]) -> None:
        self.documents, self.total = documents, total
        self.terms = sorted({t for _, c in items for t in c})
        place = {t: i for i, t in enumerate(self.terms)}
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], np.uint64)
        self.weights = [weight(documents, df.get(int(h), 0)) for h in self.hashes]
        self.items = [(i, np.array([place[t] for t in c], np.int64), np.array([n * self.weights[place[t]] for t, n in c.items()], np.int64))
                      for i, c in items]
        self.pairs = [[(t, n * self.weights[place[t]]) for t, n in c.items()] for _, c in items]

    def damping(self, lengths):
        """m of documents of these lengths."""
        return 75 + (25 * lengths * self.documents) // self.total

    def score(self, counts: Counter, wanted: list[int]) -> list[tuple[int, int]]:
        """(item, score) of one document, for the positions in ``wanted``, where above 0."""
        m = self.damping(sum(counts.values()))
        found = ((self.items[k][0], sum(w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)) for t, w in self.pairs[k] if (tf := counts.get(t))))
                 for k in wanted)
        return [(i, s) for i, s in found if s > 0]

    def bounds(self, lengths: np.ndarray, m: int, bits: np.ndarray) -> np.ndarray:
        """An upper bound of every item's score (items, documents) from a block's slices."""
        n = len(lengths)
        damping = self.damping(lengths)
        out, before, reached = np.zeros((len(self.items), n), np.int64), np.zeros(n, np.int64), None
        for level in range(len(LEVELS)):
            rows = _slices(self.hashes, level, m)
            own = np.bitwise_and.reduce([bits[rows[:, k]] for k in range(PROBES)])
            reached = own if reached is None else reached & own
            if level + 1 < len(LEVELS):
                most = LEVELS[level + 1] - 1
                share = (1_000_000_000 * most) // (1000 * most + 12 * damping)
            else:
                share = np.full(n, _FULL, np.int64)
            # weighted sum of the slices, times what this level adds to the share
            held = reached.any(axis=1)
            place = np.cumsum(held) - 1
            cells = np.unpackbits(reached[held], axis=1, count=n)
            for k, (_, terms, weights) in enumerate(self.items):
                there = held[terms]
                if there.any():
                    sums = weights[there].astype(float) @ cells[place[terms[there]]].astype(float)  # whole numbers far below 2 ** 53
                    out[k] += sums.astype(np.int64) * (share - before)
            before = share
        return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _bounded(query: Query, least: np.ndarray | None, top: int):
    """Per document that is not excluded: the positions of its items. Without ``least``, per block and item the ``top`` best bounds."""
    def run(batches):
        for batch in batches:
            for ids, lengths, m, bits in zip(batch.column("ids"), batch.column("lengths"), batch.column("slices"), batch.column("bits")):
                own = np.array(lengths.as_py(), np.int64)
                cells = np.frombuffer(bits.as_py(), np.uint8).reshape(m.as_py(), -1)
                bound = query.bounds(own, m.as_py(), cells)
                if least is None:
                    at = np.argsort(-bound, axis=1, kind="stable")[:, :top]
                    item, column = np.repeat(np.arange(len(bound)), at.shape[1]), at.ravel()
                    item, column = item[bound[item, column] > 0], column[bound[item, column] > 0]
                else:
                    item, column = np.nonzero((bound >= least[:, None]) & (bound > 0))
                found = ids.values.take(pa.array(column))
                yield pa.RecordBatch.from_arrays([found, pa.array(item, pa.int32()), pa.array(bound[item, column])], ["doc_id", "item", "bound"])
    return run


def _rescored(query: Query):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc_id, text, wanted in zip(*(part.column(c).to_pylist() for c in range(3))):
                    out += [(doc_id, i, s) for i, s in query.score(term_counts(text), wanted)]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                                 ["doc_id", "item", "score"])
    return run


def _rescore(docs: DataFrame, wanted: DataFrame, query: Query) -> DataFrame:
    """Exact scores (doc_id, item, score) of the wanted (doc_id, item), read from the whole texts again."""
    lists = small_side(wanted.groupBy("doc_id").agg(F.collect_set("item").alias("items")).withColumnRenamed("doc_id", "__id"))
    found = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "items")
    return found.mapInArrow(_rescored(query), "doc_id long, item long, score long")


def _best(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _passes(items: list[tuple[int, Counter]]) -> Iterator[list[tuple[int, Counter]]]:
    own, held = [], 0
    for i, c in items:
        if own and held + len(c) > PASS_TERMS:
            yield own
            own, held = [], 0
        own.append((i, c))
        held += len(c)
    if own:
        yield own


def _counter(wanted: np.ndarray):
    """Sums up, per wanted hash, the documents of the index's parts."""
    wanted = np.sort(wanted)

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, documents in zip(batch.column("terms"), batch.column("documents")):
                hashes, own = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(documents.as_py(), np.int64)
                at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                total += np.where(hashes[at] == wanted, own[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(total)], ["term", "n"])
    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, signatures: DataFrame | None = None, key: str = "doc_id",
           text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of each item: item_id, rank (from 1), doc_id, score.

    The items are the stated query set; they are read to the driver and served in passes of PASS_TERMS terms, each against all
    documents. Every row of ``items`` is a query of its own, so repeated ids have repeated ranks. Null and empty
    texts have no term: such items and documents are in no result. Documents that share an id are ranked each
    on its own text, null ids last among equal scores; other columns are ignored. Only scores above 0 count,
    so an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = items.schema[item].dataType
    rows = items.select(F.col(item), F.col(item_text).cast("string")).collect()
    signatures = index(docs, key, text) if signatures is None else signatures
    size = signatures.filter("ids is not null").agg(
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("total")).first()
    blocks, parts = signatures.filter("ids is not null"), signatures.filter("terms is not null").select("terms", "documents")
    queries = [(k, term_counts(r[1])) for k, r in enumerate(rows)] if size["n"] else []
    out = [spark.createDataFrame([], "item long, doc_id long, score long, rank int")]
    for own in _passes([(k, c) for k, c in queries if c]):
        hashes = np.array(sorted({xxhash.xxh3_64_intdigest(t) for _, c in own for t in c}), np.uint64)
        df = {r["term"] & (1 << 64) - 1: r["n"] for r in parts.mapInArrow(_counter(hashes), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        query = Query(own, size["n"], size["total"], df)
        ddl = "doc_id long, item int, bound long"
        order = Window.partitionBy("item").orderBy(F.desc("bound"))
        first = blocks.mapInArrow(_bounded(query, None, 2 * top), ddl).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= 2 * top)
        known = _best(_rescore(narrow, first, query), top)
        # the score that a document must reach: at most one row per item
        reached = {r["item"]: r["score"] for r in known.filter(F.col("rank") == top).select("item", "score").collect()}
        least = np.array([reached.get(k, 1) for k, *_ in query.items], np.int64)
        left = durable(blocks.mapInArrow(_bounded(query, least, top), ddl).select("doc_id", "item"))
        out.append(_best(_rescore(narrow, left, query), top).select("item", "doc_id", "score", "rank"))
    named = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], T.StructType([
        T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    return union_all(*out).join(small_side(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
