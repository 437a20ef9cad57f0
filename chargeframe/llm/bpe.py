"""BPE encoding and decoding; long texts by tree concatenation.

Short texts are encoded where they are read. A longer text is cut into leaves that
other tasks encode in parallel, without regard for words. Two neighbours are then joined
by encoding a window around their border again, which grows until it reproduces a
token of either side: a BPE sequence is valid if each pair of neighbouring tokens is,
so from such a token on both encodings go on alike and the join is exact. If the
sides never agree, the window ends up covering both and the result is the plain encoding.
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.wordbpe import encoder
from chargeframe.runtime import materialize

#: Characters of a leaf; longer texts are cut.
LEAF = 32768
#: Characters on each side of a border in the first window.
WINDOW = 64

#: Tokens as (id, first character, character after the last).
Tokens = list[tuple[int, int, int]]


def _encode(tokenizer, text: str, begin: int, end: int) -> Tokens:
    found = tokenizer.encode(text[begin:end], add_special_tokens=False)
    return [(i, s + begin, e + begin) for i, (s, e) in zip(found.ids, found.offsets)]


def _whole(tokens: Tokens, i: int) -> bool:
    """Whether the token shares none of its characters with a neighbour (as parts of one character do)."""
    _, s, e = tokens[i]
    return (i == 0 or tokens[i - 1][2] <= s) and (i + 1 == len(tokens) or tokens[i + 1][1] >= e)


def _starter(text: str, at: int) -> bool:
    """Whether the character there never composes with the one before it."""
    return at >= len(text) or not (unicodedata.combining(text[at]) or "ᅠ" <= text[at] <= "ᇿ")


def concatenate(tokenizer, text: str, left: Tokens, right: Tokens, begin: int, border: int, end: int,
                window: int = WINDOW) -> Tokens:
    """Tokens of text[begin:end] from those of text[begin:border] and text[border:end].

    The first window shows any special token that the border cuts.
    """
    window = max([window, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    starts = [t[1] for t in left]
    ends = [t[2] for t in right]
    while True:
        # the window runs from the start of a token of the left side to the end of one of the right side
        i = bisect.bisect_right(starts, border - window) - 1
        while i >= 0 and not (_whole(left, i) and _starter(text, left[i][1])):
            i -= 1
        j = bisect.bisect_left(ends, border + window)
        while j < len(right) and not (_whole(right, j) and _starter(text, right[j][2])):
            j += 1
        lo = left[i][1] if i >= 0 else begin
        hi = right[j][2] if j < len(right) else end
        middle = _encode(tokenizer, text, lo, hi)
        known = {t: k for k, t in enumerate(middle) if _whole(middle, k)}
        a = c = 0  # tokens kept of the left side, first token taken from the window
        if lo > begin:
            k = next((k for k in range(len(left) - 2, i - 1, -1) if left[k] in known and _whole(left, k)), -1)
            a, c = (k, known[left[k]]) if k >= 0 else (-1, 0)
        b, d = len(right), len(middle)  # first token kept of the right side, window tokens taken
        if hi < end and a >= 0:
            found = [k for k in range(min(j + 1, len(right))) if known.get(right[k], len(middle)) < len(middle) - 1 and _whole(right, k)]
            b, d = (found[0], known[right[found[0]]]) if found else (-1, 0)
        if a >= 0 and b >= 0 and (c <= d):
            return left[:a] + middle[c:d] + right[b:]
        if lo == begin and hi == end:
            return middle
        window *= 2


def tree(tokenizer, text: str, parts: list[Tokens], cuts: list[int], window: int = WINDOW) -> Tokens:
    """Joins the encodings of text[cuts[i]:cuts[i+1]] pairwise, level by level."""
    while len(parts) > 1:
        parts, cuts = [
            concatenate(tokenizer, text, parts[i], parts[i + 1], cuts[i], cuts[i + 1], cuts[i + 2], window)
            if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
        ], [*cuts[:-1:2], cuts[-1]]
    return parts[0] if parts else []


def tree_encode(tokenizer, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """Ids of a text, encoded leaf by leaf and joined."""
    cuts = [*range(0, len(text), leaf), len(text)]
    return [t[0] for t in tree(tokenizer, text, [_encode(tokenizer, text, a, b) for a, b in zip(cuts, cuts[1:])], cuts, window)]


_NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
_DDL = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", "ids binary", "decoded string"]


def _digests(doc_id, ids: bytes, decoded: str, full: bool) -> tuple:
    own = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return own + (ids, decoded) if full else own


def _short(path: str | None, full: bool):
    width = 6 if full else 4

    def run(batches):
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_digests(i, *code.encode_and_decode(t or ""), full)
                        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES[:width])
    return run


def _leaves(path: str | None):
    def run(frames):
        tokenizer = encoder(path).tokenizer
        for rows in frames:
            out = []
            for part in rows["part"]:
                tokens = np.array(_encode(tokenizer, part, 0, len(part)), "<i4").reshape(-1, 3)
                out.append(tokens.tobytes())
            rows["tokens"] = out
            yield rows
    return run


def _grow(path: str | None, full: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokenizer = encoder(path).tokenizer
        rows = rows.sort_values("seq")
        cuts, parts = [0], []
        for part, held in zip(rows["part"], rows["tokens"]):
            tokens = np.frombuffer(held, "<i4").reshape(-1, 3) + np.array([0, cuts[-1], cuts[-1]])
            parts.append([tuple(t) for t in tokens.tolist()])
            cuts.append(cuts[-1] + len(part))
        ids = [t[0] for t in tree(tokenizer, "".join(rows["part"]), parts, cuts)]
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        doc_id = rows["doc_id"].iloc[0]
        row = _digests(None if pd.isna(doc_id) else int(doc_id), np.array(ids, "<u4").tobytes(), decoded, full)
        return pd.DataFrame([row], columns=_NAMES[:len(row)]).astype({"doc_id": "Int64"})
    return run


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, full: bool = False,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text encoded and decoded again.

    Returns per row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 and, if ``full``, the ids and the decoded text. A null or
    empty text has no tokens and decodes to the empty text. Rows that repeat an id or
    a text each give a row; an empty table gives none; other columns are ignored.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ddl = ", ".join(_DDL[:6 if full else 4])
    is_long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = narrow.filter(~is_long).mapInArrow(_short(path, full), ddl)
    long = materialize(narrow.filter(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    seq = F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / leaf).cast("int")))
    leaves = long.withColumn("seq", seq).select(
        "row", "doc_id", "seq", F.substring("text", F.col("seq") * leaf + 1, F.lit(leaf)).alias("part"))
    encoded = leaves.repartition("row", "seq").mapInPandas(_leaves(path), "row long, doc_id long, seq int, part string, tokens binary")
    return short.unionByName(encoded.groupBy("row").applyInPandas(_grow(path, full), ddl))
