"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their normalised text. A task puts the texts
of its bucket into an open-addressing table that compares complete contents. Texts that
do not fit the table's memory go to a spill table in the shared folder, which the next
level deals to buckets by another hash; levels go on until nothing is spilled. Every
text lies either wholly in a table or wholly in the spill, so no group is torn apart.

Before anything is shuffled, each scan task runs its rows through a table of the same
kind and passes on one record per distinct text, so a text that makes up a third of all
rows travels once per task (once per table filling), and its rows never meet in one place.
Everything between the passes is written to the shared folder, so a lost executor costs
only the tasks it was running.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.memory import releasing
from chargeframe.runtime import materialize, union_all

#: Bytes of distinct text that one table holds.
TABLE_BYTES = 24 << 20
#: Bytes of records that a bucket should have.
BUCKET_BYTES = 16 << 20
#: Rows per batch that a task passes on.
BATCH = 1024

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(b"  +")


def normalised(text: bytes | None) -> bytes:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    if not text:
        return b""
    text = text.translate(_SPACES)
    return _RUN.sub(b" ", text) if b"  " in text else text


class ContentTable:
    """Open addressing with linear probing over complete contents, bounded in bytes."""

    def __init__(self, max_bytes: int) -> None:
        self.max_bytes = max_bytes
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of the content and whether it is new; entry -1 if it does not fit.

        An empty table takes any content, so each filling makes progress."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        if self.contents and self.bytes + len(content) + 100 > self.max_bytes:
            return -1, False
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1, True


_FIRST = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()),
                    ("n_bytes", pa.int64()), ("digest", pa.binary()), ("content", pa.binary())])
_FIRST_DDL = "uid long, doc_id long, row long, n long, n_bytes long, digest binary, content binary"
_LEVEL = pa.schema([*_FIRST, ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_LEVEL_DDL = _FIRST_DDL + ", keep_id long, keep_row long, group_size long"


def _order(doc_id: int | None, row: int) -> tuple:
    return (doc_id is None, doc_id or 0, row)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batches(schema: pa.Schema, rows):
    """Rows in batches bounded in number and in bytes of content."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or b"")
        if len(held) >= BATCH or size > 8 << 20:
            yield _table(schema, held)
            held, size = [], 0
    if held:
        yield _table(schema, held)


def _local(table_bytes: int):
    """One row per document (uid of its record, its id, its number) and one per record."""
    def run(batches):
        base = TaskContext.get().partitionId() << 40

        def rows():
            table, first, counts, uids = ContentTable(table_bytes), [], [], []
            n_rows = n_uids = 0

            def records():
                for e, content in enumerate(table.contents):
                    doc_id, row = first[e]
                    yield (uids[e], doc_id, row, counts[e], len(content), hashlib.sha256(content).digest(), content)

            for batch in batches:
                for start in range(0, batch.num_rows, BATCH):
                    part = batch.slice(start, BATCH)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        content, row = normalised(text), base + n_rows
                        n_rows += 1
                        h = hash(content)
                        e, new = table.find_or_add(h, content)
                        if e < 0:
                            yield from records()
                            table.clear()
                            first, counts, uids = [], [], []
                            e, new = table.find_or_add(h, content)
                        if new:
                            first.append((doc_id, row))
                            counts.append(0)
                            uids.append(base + n_uids)
                            n_uids += 1
                        counts[e] += 1
                        if _order(doc_id, row) < _order(*first[e]):
                            first[e] = (doc_id, row)
                        yield (uids[e], doc_id, row, None, None, None, None)
            yield from records()

        yield from _batches(_FIRST, rows())
    return run


def _bucket(table_bytes: int):
    """Resolves the records of a bucket; those that do not fit pass through with their content."""
    def run(batches):
        def rows():
            table, first, counts, members = ContentTable(table_bytes), [], [], []
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    for record in zip(*(c.to_pylist() for c in part.columns)):
                        uid, doc_id, row, n, _, digest, content = record
                        e, new = table.find_or_add(int.from_bytes(digest[:8], "little"), content)
                        if e < 0:
                            yield (*record, None, None, None)
                            continue
                        if new:
                            first.append((doc_id, row))
                            counts.append(0)
                        counts[e] += n
                        if _order(doc_id, row) < _order(*first[e]):
                            first[e] = (doc_id, row)
                        members.append((uid, e, digest))
            for uid, e, digest in members:
                yield (uid, None, None, None, None, digest, None, *first[e], counts[e])

        yield from _batches(_LEVEL, rows())
    return run


def groups(docs: DataFrame, table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of rows with equal normalised text.

    Returns per row: doc_id, keep_id (smallest id of the group), group_size, kept and
    text_sha256 (of the normalised text, lowercase hex). Exactly one row of a group has
    kept = true: the one with the smallest id, and among rows that repeat this id the
    first one read. A null text counts as empty, and empty texts are a group like any
    other. A null id comes after all numbers; keep_id is null only if all ids of the
    group are. An empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    spill = materialize(narrow.mapInArrow(releasing(_local(table_bytes)), _FIRST_DDL), "grace-0")
    rows = spill.filter(F.col("n").isNull()).select("uid", "doc_id", "row")
    records = spill.filter(F.col("n").isNotNull())
    resolved, level = [], 0
    while True:
        size = records.agg(F.sum("n_bytes")).first()[0]
        if size is None:
            break
        level += 1
        buckets = size // bucket_bytes + 1
        dealt = records.repartition(buckets, F.xxhash64("digest", F.lit(level)))
        out = materialize(dealt.mapInArrow(releasing(_bucket(table_bytes)), _LEVEL_DDL), f"grace-{level}")
        resolved.append(out.filter(F.col("group_size").isNotNull()).select("uid", "keep_id", "keep_row", "group_size", "digest"))
        records = out.filter(F.col("group_size").isNull()).select(*_FIRST.names)
    if not resolved:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    return rows.join(union_all(*resolved), "uid").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
