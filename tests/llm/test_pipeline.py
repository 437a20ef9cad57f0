from __future__ import annotations

from collections import Counter

import corpus_pipeline
from chargeframe.llm import fertility, secrets
from chargeframe.llm.wordbpe import encoder
from tests.llm import brute
from tests.llm.conftest import SF


def test_pipeline_against_plain_steps(spark):
    """All stages over documents, against row-by-row and pair-by-pair steps."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    meter = fertility._meter(None)
    rows = [(i, t) for i, t in rows if not (lambda q: q[0] < 10 or 100 * q[4] > 20 * q[0])(brute.quality(t))
            and fertility._judge(t, meter, fertility.BANDS)[6]]
    kept = {g[0] for g in brute.exact_groups(rows) if g[3]}
    rows = [r for r in rows if r[0] in kept]
    component = brute.near_components(rows, 5)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    clean = []
    for i, t in rows:
        at, out = 0, ""
        for s, _, e in brute.base_secrets(t):
            if s >= at:
                out += t[at:s] + "[secret]"
            at = max(at, e)
        clean.append((i, out + t[at:]))
    want = Counter()
    for i, t in clean:
        for p in brute.pieces([*encoder().tokenizer.encode(t, add_special_tokens=False).ids, 1], 4096):
            want[(i, *p)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert (name, out.columns, out.collect()) == (name, docs.columns, [])
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []


def test_redaction_uses_the_spans(spark):
    docs = spark.createDataFrame([(1, "key token = abcdef12 end", 1)], "doc_id long, text string, n_chars long")
    assert secrets.redact(docs).first()["text"] == "key [secret] end"
