"""The queries over this subpackage's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chargeframe.llm import bpe, chat, codebooks, exactdedup, fertility, licences, neardup, packing, pii, secrets, signatures, toxicity, urlgraph
from chargeframe.registry.book import Book, table

BOOK = Book()
query = BOOK.query


@query("op1_markov_secrets")
def markov_secrets(spark, sf_dir):
    return secrets.find(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_minhash_neardup")
def minhash_neardup(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "documents"))


@query("op4_licence_classifier")
def licence_classifier(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op5_bpe_tree")
def bpe_tree(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


@query("op6_host_trust")
def host_trust(spark, sf_dir):
    return urlgraph.judge(table(spark, sf_dir, "pages"))


@query("op7_tokeniser_fertility")
def tokeniser_fertility(spark, sf_dir):
    return fertility.rate(table(spark, sf_dir, "documents"))


@query("op8_factorization_toxicity")
def factorization_toxicity(spark, sf_dir):
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_schema_chat", """
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    sized AS (
        SELECT *, 14 + length(regexp_replace(role, '[\\\\<#:]', 'xx', 'g'))
            + length(regexp_replace(text, '[\\\\<#]', 'xx', 'g')) AS chars FROM rows),
    whole AS (
        SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt
        FROM sized GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
           formatted_chars FROM whole
""")
def schema_chat(spark, sf_dir):
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    payload = F.to_variant_object(F.struct("role", "text", "turn"))
    return chat.digests(chat.format_turns(chat.canonical(rows.select("conv_id", "turn", payload.alias("payload")))))


@query("op10_grace_dedup", """
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
""")
def grace_dedup(spark, sf_dir):
    return exactdedup.groups(table(spark, sf_dir, "documents"))


def _codebook_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, rounds: int = codebooks.ROUNDS) -> str:
    """The rounds written out: every part against every entry, then floor(sum / count) per component."""
    steps = [f"""
    kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (
        SELECT vec_id, label, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x
        FROM kept, (SELECT unnest(range({parts})) AS part)),
    book0 AS (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
        QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
    near{r} AS MATERIALIZED (
        SELECT vec_id, label, part, x, min(d * {entries} + entry) % {entries} AS entry, min(d) AS d FROM (
            SELECT p.*, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM parts p JOIN book{r} USING (part)) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
    moved{r} AS (
        SELECT part, entry, list(c ORDER BY pos) AS c FROM (
            SELECT part, entry, pos, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS c
            FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM near{r}) GROUP BY ALL) GROUP BY ALL),
    book{r + 1} AS MATERIALIZED (
        SELECT part, entry, coalesce(m.c::BIGINT[], b.c) AS c FROM book{r} b LEFT JOIN moved{r} m USING (part, entry))""")
    return "WITH " + ",".join(steps) + f"""
    SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error,
        (sum(sum(d)) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
    FROM near{rounds} GROUP BY vec_id, label"""


@query("op11_anchor_codebooks", _codebook_sql())
def anchor_codebooks(spark, sf_dir):
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


@query("op12_validated_pii")
def validated_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op13_bitsliced_search", r"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    items AS (
        SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
    size AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS total FROM docs WHERE len(t) > 0),
    words AS (SELECT item, item_id, term, count(*) AS reps FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
    tf AS (
        SELECT row, doc_id, length, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS length, unnest(t) AS term FROM docs)
        WHERE term IN (SELECT term FROM words) GROUP BY ALL),
    df AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, n),
    scores AS (
        SELECT item, item_id, row, doc_id,
            sum(reps * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * length * n) // total))))::BIGINT AS score
        FROM words JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 20
""")
def bitsliced_search(spark, sf_dir):
    return signatures.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
