"""Near-duplicate groups by MinHash with tensored banding.

Two collections hold ``tables`` keys each, made of ``rows`` minhashes. A table key is a
pair of one key from either collection, so ``2 * rows * tables`` minhashes serve
``tables ** 2`` tables of ``2 * rows`` minhashes. At similarity 0.8 the defaults miss a link
with a chance of 2 * (1 - 0.8 ** 4) ** 24 = 6e-6.

Equal sets become one. Documents that share a key of the first collection are compared with
the smallest among them, which links nearly all of a group at linear cost. Only buckets
that then still hold several components go on, and only pairs from different components are
compared there: two documents share a table if they share a key of both collections, which is
looked up for small buckets and is made the bucket of large ones. A pair is looked at in
the first bucket that it shares. Sketches (a byte per minhash) and then an upper bound of the
intersection from 16-bit fingerprints of all shingles sort out what cannot be linked;
the rest is confirmed on full sets. Large buckets are dealt in blocks; none is capped.
Full sets are made again from the text, for documents in shared buckets alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.components import components
from chargeframe.llm.memory import releasing
from chargeframe.llm.shingles import MinHasher, overlap, shingle_sets
from chargeframe.runtime import materialize, small_side

#: Words per shingle, and the similarity that links, in percent.
SHINGLE, PERCENT = 2, 80
#: Minhashes per key and keys per collection.
ROWS, TABLES = 4, 24
#: Share of equal sketch bytes below which a pair is not compared in full: 4.8 standard
#: deviations of the estimate below similarity 0.8.
SKETCH_SHARE = 0.66
#: Members of a bucket that meet in one block, and members from which on a bucket is split by
#: the keys of the second collection.
BLOCK, SPLIT = 2048, 8192
#: Digests that a scan task remembers to spot equal sets early, and texts that it hashes at once.
REMEMBERED, TEXTS = 100_000, 64


def _bytes(column) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_BASE_DDL = "uid long, doc_id long, n_shingles long, digest binary, u array<long>, v array<long>, sketch binary, mark long"


def _lists(arrays: list) -> pa.Array:
    """A list per entry, null for None."""
    return pa.array([None if a is None else a.view(np.int64) for a in arrays], pa.list_(pa.int64()))


def _scan(size: int, rows: int, tables: int):
    def run(batches):
        hasher, base, n_rows, known = MinHasher(rows, tables), TaskContext.get().partitionId() << 40, 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out: tuple[list, ...] = tuple([] for _ in range(8))
                for doc_id, mark, shingles in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(_bytes(part.column(1)), size)):
                    row, digest = base + n_rows, _digest(shingles)
                    n_rows += 1
                    uid, u, v, sketch = known.get(digest), None, None, None
                    if uid is None or not len(shingles):
                        uid = row
                        if len(shingles):
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[digest] = uid
                            values = hasher.values(shingles)
                            keys = hasher.keys(values)
                            u, v, sketch = keys[:tables], keys[tables:], hasher.sketch(values).tobytes()
                    for column, value in zip(out, (uid, doc_id, len(shingles), digest, u, v, sketch, mark)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.binary()), _lists(out[4]), _lists(out[5]), pa.array(out[6], pa.binary()),
                    pa.array(out[7], pa.int64())], ["uid", "doc_id", "n_shingles", "digest", "u", "v", "sketch", "mark"])
    return run


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """The distinct upper 16 bits of sorted shingles."""
    return np.unique((shingles >> np.uint64(48)).astype(np.uint16))


def _sets(size: int):
    """Sets of the wanted rows, checked by their digest, and their fingerprints."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [(rid, s.tobytes(), fingerprints(s).tobytes()) for rid, want, s in zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(_bytes(part.column(2)), size))
                    if _digest(s) == want]
                kinds = (pa.int64(), pa.binary(), pa.binary())
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rid", "shingles", "prints"])
    return run


def _likely(share: float):
    """Pairs whose sketches agree often enough and that share a key in both collections."""
    def run(frames):
        for f in frames:
            if len(f):
                alike = np.array([(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean() >= share
                                  and (np.asarray(x) == np.asarray(y)).any()
                                  for a, b, x, y in zip(f["sketch_a"], f["sketch_b"], f["v_a"], f["v_b"])])
                f = f[alike]
            yield f[["a", "b"]]
    return run


def _linked(percent: int):
    def run(frames):
        for f in frames:
            keep = []
            for a, b in zip(f["set_a"], f["set_b"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield f.loc[np.array(keep, bool), ["a", "b"]]
    return run


class _Block:
    """The members of one bucket, or of two blocks of it, as arrays."""

    def __init__(self, group: pd.DataFrame) -> None:
        self.rid, self.label, self.block, self.size = (group[c].to_numpy() for c in ("rid", "label", "block", "n_shingles"))
        self.u, self.v = (np.stack(group[c].to_numpy()) for c in "uv")
        self.sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        self.key_u, self.key_v = group["bucket_u"].iloc[0], group["bucket_v"].iloc[0]
        self.across = group["first"].iloc[0] != group["second"].iloc[0]
        self.prints = [np.frombuffer(p, np.uint16) for p in group["prints"]]
        self.bits: dict[int, np.ndarray] = {}

    def bitmap(self, i: int) -> np.ndarray:
        if i not in self.bits:
            flags = np.zeros(1 << 16, bool)
            flags[self.prints[i]] = True
            self.bits[i] = np.packbits(flags).view(np.uint64)
        return self.bits[i]

    def bound(self, i: int, j: int) -> int:
        """At least the size of the intersection: fingerprints in common, and those that a set has more than once."""
        common = int(np.bitwise_count(self.bitmap(i) & self.bitmap(j)).sum())
        return common + min(self.size[i] - len(self.prints[i]), self.size[j] - len(self.prints[j]))

    def partners(self, i: int, percent: int, share: float) -> np.ndarray:
        """Members of other components that may be linked with member i and belong to this bucket first."""
        meets = (self.label != self.label[i]) & (self.rid > self.rid[i])
        if self.across:
            meets &= self.block != self.block[i]
        at = np.flatnonzero(meets)
        small, large = np.minimum(self.size[at], self.size[i]), np.maximum(self.size[at], self.size[i])
        at = at[100 * small >= percent * large]
        at = at[(self.sketch[at] == self.sketch[i]).mean(axis=1) >= share] if len(at) else at
        if not len(at):
            return at
        same = self.u[at] == self.u[i]
        at = at[self.u[i][same.argmax(axis=1)] == self.key_u]
        same = self.v[at] == self.v[i]
        fits = same.any(axis=1)
        if self.key_v:
            fits &= self.v[i][same.argmax(axis=1)] == self.key_v
        return np.array([j for j in at[fits] if (100 + percent) * self.bound(i, j) >= percent * (self.size[i] + self.size[j])], np.int64)


def _blocks(percent: int, share: float):
    """Pairs that may be linked within each (bucket, block pair) of rows sorted by these."""
    keys = ["bucket_u", "bucket_v", "first", "second"]

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        block = _Block(group)
        found = [(i, block.partners(i, percent, share)) for i in range(len(group))] if group["label"].nunique() > 1 else []
        empty = np.empty(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *(np.full(len(at), block.rid[i]) for i, at in found)]),
                             "b": np.concatenate([empty, *(block.rid[at] for _, at in found)])})

    def run(frames):
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if f.empty:
                continue
            names = f[keys].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)]))
            for s, e in zip(starts, starts[1:]):
                yield pairs(f.iloc[s:e])
            held = f.iloc[starts[-1]:]
        if held is not None and len(held):
            yield pairs(held)
    return run


class _Search:
    """The steps over one table of distinct sets: rid, n_shingles, u, v, sketch."""

    def __init__(self, reps: DataFrame, members: DataFrame, sets: DataFrame, percent: int, share: float, block: int, split: int) -> None:
        self.reps, self.members, self.sets = reps, members, sets
        self.percent, self.share, self.block, self.split = percent, share, block, split

    def stars(self) -> DataFrame:
        """Likely pairs of each member of a shared bucket with the smallest one."""
        pairs = self.members.filter("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct()
        side = self.reps.select("rid", "v", "sketch")
        both = pairs.join(side.toDF("a", "v_a", "sketch_a"), "a").join(side.toDF("b", "v_b", "sketch_b"), "b")
        return both.mapInPandas(releasing(_likely(self.share)), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked by their full sets."""
        sets = self.sets.select("rid", "shingles")
        both = pairs.distinct().join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return materialize(both.mapInPandas(releasing(_linked(self.percent)), "a long, b long"), "links")

    def labelled(self, labels: DataFrame) -> DataFrame:
        found = self.members.join(labels.withColumnRenamed("node", "rid"), "rid", "left")
        return found.select("u", "rid", F.coalesce("label", "rid").alias("label"))

    def across(self, labels: DataFrame) -> DataFrame:
        """Pairs of different components that share a table and may be linked."""
        members = self.labelled(labels)
        mixed = members.groupBy("u").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        rows = members.join(mixed.select("u", "n"), "u").select(F.col("u").alias("bucket_u"), "n", "rid", "label")
        whole = rows.join(self.reps.select("rid", "u", "v", "sketch", "n_shingles"), "rid").join(self.sets.select("rid", "prints"), "rid")
        none = F.array(F.lit(0).cast("long"))
        keyed = whole.withColumn("bucket_v", F.explode(F.when(F.col("n") > self.split, F.col("v")).otherwise(none)))
        keyed = keyed.withColumn("blocks", F.ceil(F.col("n") / self.block).cast("int")).withColumn(
            "block", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("blocks")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["bucket_u", "bucket_v", "first", "second"]
        dealt = keyed.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).select(
            *keys, "block", "rid", "label", "n_shingles", "u", "v", "sketch", "prints").repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInPandas(releasing(_blocks(self.percent, self.share)), "a long, b long")

    def labels(self) -> DataFrame:
        links = self.confirmed(self.stars())
        return components(links.union(self.confirmed(self.across(components(links)))))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, tables: int = TABLES,
           share: float = SKETCH_SHARE, block: int = BLOCK, split: int = SPLIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their word shingles.

    Returns per row: doc_id, n_shingles, component_id (smallest id reachable) and kept
    (doc_id = component_id). Words are runs other than ASCII white space, A-Z lower-cased; a
    text with fewer words than a shingle is one shingle. Null, empty and blank texts have
    no shingle and are linked with nothing. Rows that repeat an id or a text are linked
    as any equal texts are. A null id comes after all numbers. An empty table gives an
    empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # rows that share an id, null for one, are told apart by a hash of their text
    narrow = narrow.withColumn("mark", F.xxhash64("text"))
    base = materialize(narrow.mapInArrow(releasing(_scan(shingle, rows, tables)), _BASE_DDL), "shingled")
    filled = base.filter("n_shingles > 0")
    firsts = filled.filter(F.col("u").isNotNull())
    per_set = filled.groupBy("digest").agg(F.min("uid").alias("rid"), F.min("doc_id").alias("low"))
    owner = materialize(firsts.select("uid", "digest", "doc_id", "mark").join(per_set, "digest"), "set-owners")
    heads = owner.filter("uid = rid")
    reps = materialize(firsts.select(F.col("uid").alias("rid"), "n_shingles", "u", "v", "sketch").join(heads.select("rid"), "rid"), "distinct-sets")
    keys = reps.select("rid", F.explode("u").alias("u"))
    shared = keys.groupBy("u").agg(F.count("*").alias("n"), F.min("rid").alias("pivot")).filter("n > 1").select("u", "pivot")
    members = materialize(keys.join(shared, "u"), "shared-keys")
    wanted = heads.join(members.select("rid").distinct(), "rid").select("rid", "digest", "doc_id", "mark")
    texts = narrow.join(small_side(wanted.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    texts = texts.select("rid", "digest", "text")
    sets = materialize(texts.mapInArrow(releasing(_sets(shingle)), "rid long, shingles binary, prints binary").dropDuplicates(["rid"]), "full-sets")
    labels = _Search(reps, members, sets, percent, share, block, split).labels()
    found = owner.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select(
        "uid", F.coalesce("label", "rid").alias("label"), "low")
    lowest = found.groupBy("label").agg(F.min("low").alias("component"))
    joined = base.select("uid", "doc_id", "n_shingles").join(found.join(lowest, "label").select("uid", "component"), "uid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
