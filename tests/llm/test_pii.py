from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from chargeframe.llm import pii
from chargeframe.llm.textspans import fold
from tests.llm.conftest import ROWS, SF

MORE = [
    (20, "a@b.c_d@e.f x@y a@b. @c.d .%+@a-b.c..d e@f.g.h 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3"),
    (21, "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 card 5500005555555559 37828224631000 5"),
    (22, "+1 (017) 555-7713 +1+22 333 444 55555 +12345678901234567 +1...... ++49 30 1234567)"),
    (23, "IBAN DE89 3704 0044 0532 0130 00 THE NEXT GB82WEST12345698765432 DE89370400440532013001 xGB82WEST12345698765432"),
    (24, "ssn 123-45-6789, order 123-45-6780 or 000-12-3456; call (030) 1234 5678, part 030 1234 5678"),
    (25, "me [at] site [dot] org or e.f(at)g.h 😀 é@é.é ü1.2.3.4ü"),
    (26, "a" * 3000 + "@" + "b." * 3000 + " " + "1 " * 5000 + "+1" + "." * 5000 + "1.2.3.4 " * 700 + "iban GB82WEST12345698765432"),
    (27, "server 10.0.0.1, version 1.2.3.4, no-reply@x.y e-mail q@r.st"),
]

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def confirmed(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if confirmed(kind, m[0])]
    return sorted(found)


def mod97(hit):
    own = hit.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def added_spans(text):
    """Kept spans of the added kinds, from their declared patterns and words."""
    valid = {"iban": mod97, "call": lambda h: 8 <= len(re.sub("[^0-9]", "", h)) <= 13}
    out = []
    for k, kind in enumerate(pii.KINDS[pii.BASE:], pii.BASE):
        pattern = kind.pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "")
        hits = list(re.finditer(pattern, text))
        for i, m in enumerate(hits):
            before = text[hits[i - 1].end() if i else 0:m.start()][-pii.BEFORE:]
            after = text[m.end():hits[i + 1].start() if i + 1 < len(hits) else len(text)][:pii.AFTER]
            gain = pii.RAISE if re.search(kind.raised, before) else pii.RAISE_AFTER if re.search(kind.raised, after) else 0
            score = kind.score + gain - pii.LOWER * bool(re.search(kind.lowered, before))
            if valid.get(kind.name, lambda h: True)(m[0]) and score >= pii.THRESHOLD:
                out.append((m.start(), k, m.end()))
    return out


def written(spans):
    return ",".join(f"{pii.KINDS[k].name}:{s}:{e}" for s, k, e in spans)


def expected(text):
    text = text or ""
    base = base_spans(text)
    more = [s for s in added_spans(text) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    counts = [sum(k == j for _, k, _ in base) for j in range(4)]
    return (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)))


def test_spans_against_brute_force(spark, docs):
    rows = docs.unionByName(spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    got = [tuple(r)[:7] for r in pii.find(rows).collect()]
    assert sorted(got, key=str) == sorted(((i, *expected(t)) for i, t in ROWS + MORE), key=str)


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r[0]: tuple(r)[1:7] for r in pii.find(rows).collect()}
    assert got == {r[0]: expected(r[1]) for r in rows.collect()}


def test_validators_and_context(spark):
    rng = random.Random(3)
    texts = [f"{rng.choice(['card', 'order', 'x'])} {rng.randrange(10 ** 13, 10 ** 19)} iban GB{rng.randrange(100):02d}WEST12345698765432" for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r["spans"] for r in pii.find(rows).collect()}
    assert got == {i: expected(t)[5] for i, t in enumerate(texts)}
    assert any("card" in s for s in got.values()) and any("iban" in s for s in got.values())
    scores = {r["doc_id"]: dict(zip(r["spans"].split(","), map(int, r["scores"].split(","))))
              for r in pii.find(spark.createDataFrame(MORE, "doc_id long, text string")).collect() if r["spans"]}
    assert scores[27] == {"ip:7:15": 50, "ip:25:32": 20, "email:34:46": 55, "email:54:60": 100}
    assert "ssn:4:15" in scores[24] and "call:56:71" in scores[24] and len(scores[24]) == 2


def test_redaction(spark, docs):
    rows = docs.unionByName(spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    out = pii.redact(rows)
    assert out.columns == rows.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[6] == "x"
    assert texts[24] == "ssn [ssn], order 123-45-6780 or 000-12-3456; call [call], part 030 1234 5678"
    assert texts[23].startswith("IBAN [iban] THE NEXT [iban] DE89370400440532013001")
    assert all(not base_spans(t.replace("[", " ")) for t in texts.values() if t)
    weak = {r["doc_id"]: r["text"] for r in pii.redact(rows, least=40).collect()}
    assert weak[27] == "server [ip], version 1.2.3.4, [email] e-mail [email]"


def test_nothing_to_find(none):
    assert pii.find(none).collect() == [] and pii.redact(none).collect() == []


def test_fold_keeps_order_and_state_over_blocks(spark):
    items = F.sequence(F.lit(1), F.col("id").cast("int"))
    row = spark.range(0, 700, 233).select("id", fold(F.when(F.col("id") > 0, items).otherwise(F.array().cast("array<int>")), F.lit(0), "int",
                                                    lambda s, x: (s + x, x % 3 == 0, s + x), block=16).alias("v"))
    for r in row.collect():
        sums = [sum(range(x + 1)) for x in range(1, r["id"] + 1) if x % 3 == 0]
        assert r["v"] == sums
