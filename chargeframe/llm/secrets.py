"""Secret scans with DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal strings. Two character
Markov models, one of random strings and one of ordinary identifiers, judge the other long
tokens by their log-likelihood ratio. Both are fitted on labelled samples: strings encoded
from digests, and identifiers joined from the words of a bounded sample of documents.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.sampling import hash_sample

#: The patterns of the kinds, in the order that breaks ties between spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "markov"]
#: Shortest value of an assignment.
VALUE_LENGTH = 6
#: Documents (about) that the labelled samples are made from, chosen by a hash of their id.
SAMPLE_DOCS = 500
#: Log-likelihood ratio (natural) from which a token counts as random.
THRESHOLD = 12.0
#: Fewest different characters of a random token, which also has a digit and a letter: rulers and
#: runs have pairs of characters that neither model knows.
DISTINCT = 8
#: Printable ASCII; other characters are not part of a token.
FIRST, SIZE = 32, 95
#: Added to every count of a pair of characters.
SMOOTHING = 0.5

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _pairs(strings: DataFrame, label: str) -> DataFrame:
    """Counts of neighbouring characters of the column ``s``; at most SIZE * SIZE rows."""
    spread = strings.select(F.split("s", "").alias("c")).select(F.explode(F.arrays_zip(
        F.slice("c", 1, F.size("c") - 1).alias("x"), F.slice("c", 2, F.size("c") - 1).alias("y"))).alias("p"))
    known = [F.ascii(f"p.{c}").between(FIRST, FIRST + SIZE - 1) for c in "xy"]
    return spread.filter(known[0] & known[1]).groupBy(F.ascii("p.x").alias("x"), F.ascii("p.y").alias("y")).agg(
        F.count("*").alias("n")).withColumn("label", F.lit(label))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary.

    Only the sampled documents are used, and at most 2 * SIZE ** 2 counts reach the driver."""
    chosen = hash_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", sample)
    words = chosen.select("k", F.regexp_extract_all("t", F.lit(r"[A-Za-z]{2,}[0-9]{0,3}"), F.lit(0)).alias("w"))
    triples = words.filter(F.size("w") >= 3).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - 2, F.lit(3)), lambda i: F.slice("w", i, 3))).alias("w"))
    joined = [F.array_join(F.transform("w", F.lower), sep) for sep in "_-/"] + [
        F.array_join(F.transform("w", F.initcap), ""), F.array_join("w", "="), F.upper(F.array_join("w", "_"))]
    ordinary = triples.select(F.explode(F.array(*joined)).alias("s"))
    digests = chosen.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.sha2(F.concat_ws(":", F.col("k").cast("string"), i.cast("string")), 256))).alias("d"))
    coded = F.base64(F.unhex("d"))
    random = digests.select(F.explode(F.array(
        coded, F.translate(coded, "+/=", "-_"), F.regexp_replace(coded, "[+/=]", ""), F.substring("d", 1, 40))).alias("s"))
    counts = {(r["label"], r["x"] - FIRST, r["y"] - FIRST): r["n"]
              for r in _pairs(ordinary, "ordinary").union(_pairs(random, "random")).collect()}

    def log_share(label: str) -> list[float]:
        out = []
        for x in range(SIZE):
            row = [counts.get((label, x, y), 0) + SMOOTHING for y in range(SIZE)]
            out += [math.log(n / sum(row)) for n in row]
        return out

    return [a - b for a, b in zip(log_share("random"), log_share("ordinary"))]


def _llr(token: Column, table: Column) -> Column:
    chars = F.split(token, "")
    n = F.size(chars) - 1
    steps = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.element_at(
        table, (F.ascii(a) - FIRST) * SIZE + F.ascii(b) - FIRST + 1))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, as (start, kind, end).

    The text between the matches and the matches themselves alternate, so the positions
    are running sums of their lengths. ``keep`` gets the matches' array and a position."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), F.transform(hits, F.length), lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    walked = F.aggregate(steps, zero, lambda a, s: F.struct(
        (a["at"] + s["g"] + s["h"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + s["g"]).alias("start"), F.lit(kind).alias("kind"),
                                            (a["at"] + s["g"] + s["h"]).alias("end")))).alias("out")))["out"]
    if keep is not None:
        walked = F.filter(walked, lambda s, i: keep(i))
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_SPAN))


def _found(docs: DataFrame, ratios: list[float], threshold: float, text: str) -> DataFrame:
    """Adds the columns __base and __spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    values = F.regexp_extract_all(whole, F.lit(ASSIGN), F.lit(1))
    base = F.array_sort(F.concat(
        _spans(whole, ASSIGN, 0, lambda i: F.length(F.get(values, i)) >= VALUE_LENGTH),
        _spans(whole, ACCESS, 1), _spans(whole, HEX, 2)))
    # whole numbers in thousandths keep the literal short
    table = F.transform(F.from_json(F.lit(json.dumps([round(1000 * r) for r in ratios])), "array<int>"), lambda r: r / F.lit(1000.0))
    tokens = F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0))

    def is_random(i: Column) -> Column:
        token = F.get(tokens, i)
        mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT)
        return mixed & (_llr(token, table) >= threshold)

    random = _spans(whole, TOKEN, 3, is_random)
    out = docs.withColumn("__base", base).withColumn("__random", random)
    more = F.filter("__random", lambda s: ~F.exists("__base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return out.withColumn("__spans", F.array_sort(F.concat("__base", more))).drop("__random")


def _count(kind: int) -> Column:
    return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Returns per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans),
    spans (kind:start:end, code points, by start, then kind) and n_markov. Null and empty texts
    have no span. Rows are judged one by one, so repeated rows and null ids each give a
    row; an empty table gives none; other columns are ignored. ``ratios`` comes from
    ``fit``, on the same table unless given.
    """
    ratios = fit(docs, key, text) if ratios is None else ratios
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = _found(narrow, ratios, threshold, "text")
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts[:3], F.sha2(_written("__base"), 256).alias("base_sha256"),
                        _written("__spans").alias("spans"), counts[3])


def redact(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD,
           key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every secret replaced by ``mark``, overlapping ones by a single mark.

    All columns are kept; n_chars, if there is one, follows the new text. Texts without a secret,
    nulls included, stay as they are."""
    ratios = fit(docs, key, text) if ratios is None else ratios
    found = _found(docs, ratios, threshold, text)
    whole = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("__spans", zero, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
        .otherwise(a["out"]).alias("out")))
    hit = F.size("__spans") > 0
    out = found.withColumn("__done", F.when(hit, done)).withColumn(
        text, F.when(hit, F.concat("__done.out", F.substring(whole, F.col("__done.at") + 1, F.length(whole)))).otherwise(whole))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
