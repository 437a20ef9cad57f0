"""Chat formatting with DataFrame functions only: layouts are told apart by the fingerprint of their field paths.

A payload (a variant) is described by the set of its nested field paths. The hash of that set
selects a declared mapping, which turns prompt, instruction and message layouts into canonical
turns (role, text). Turns are written by a template whose control strings are escaped in
roles and texts, so that the output can be read back exactly; a loss mask names the
assistants' texts.

A conversation is written in chunks of a bounded range of turns, so that the rows of a long
one are sorted and joined in many tasks; its text is the chunks in order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: HEAD role BETWEEN text TAIL for each turn.
HEAD, BETWEEN, TAIL = "### ", ": ", "</turn>\n"
#: Characters that control strings need, and what stands for them in roles and texts. The
#: backslash comes first when escaping and last when reading back.
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")]
#: Characters escaped in a text; a role escapes all.
IN_TEXT = 3
#: The role whose texts the loss covers.
LOSS_ROLE = "assistant"
#: Turn numbers per chunk, as a power of two.
CHUNK_BITS = 8

_TURNS = "array<struct<role:string,text:string>>"
#: How leaf types are written in a variant's schema.
_LEAF = (r"(?<=: |ARRAY<|^)(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID)(?=[,>]|$)")


class Layout(NamedTuple):
    """A mapping: ``examples`` show the field paths that select it; ``fields`` are (role, path)
    in order, or ``items`` is the path of a list with the names of its role and text."""

    name: str
    examples: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    renamed: tuple[tuple[str, str], ...] = ()


#: Known layouts; ``renamed`` has the roles that a layout calls by other names.
LAYOUTS = (
    Layout("turn", ('{"turn":0,"role":"r","text":"t"}', '{"role":"r","text":"t"}', '{"role":"r","content":"t"}'),
           fields=(("$.role", "$.text|$.content"),)),
    Layout("messages", ('{"messages":[{"role":"r","content":"t"}]}',), items=("$.messages", "role", "content")),
    Layout("conversations", ('{"conversations":[{"from":"r","value":"t"}]}', '{"id":"i","conversations":[{"from":"r","value":"t"}]}'),
           items=("$.conversations", "from", "value"), renamed=(("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", ('{"instruction":"a","input":"b","output":"c"}', '{"instruction":"a","output":"c"}'),
           fields=(("user", "$.instruction+$.input"), ("assistant", "$.output"))),
    Layout("prompt", ('{"prompt":"a","completion":"b"}', '{"prompt":"a","response":"b"}'),
           fields=(("user", "$.prompt"), ("assistant", "$.completion|$.response"))),
    Layout("system_prompt", ('{"system":"s","prompt":"a","response":"b"}',),
           fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)


def paths(payload: Column) -> Column:
    """The nested field paths of a variant, as its schema with all leaf types alike."""
    return F.regexp_replace(F.schema_of_variant(payload), _LEAF, "_")


def fingerprint(payload: Column) -> Column:
    return F.xxhash64(paths(payload))


def _text_at(payload: Column, path: str) -> Column:
    """Text at a path; ``a|b`` takes the first there is, ``a+b`` joins those that are not empty by a line break."""
    if "|" in path:
        return F.coalesce(*(_text_at(payload, p) for p in path.split("|")))
    if "+" in path:
        return F.array_join(F.filter(F.array(*(_text_at(payload, p) for p in path.split("+"))), lambda t: t != ""), "\n")
    return F.try_variant_get(payload, path, "string")


def _role(role: Column, layout: Layout) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, known in layout.renamed:
        out = F.when(role == name, known).otherwise(out)
    return out


def _turns(payload: Column, layout: Layout) -> Column:
    if layout.items:
        path, role, text = layout.items
        found = F.try_variant_get(payload, path, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(found, lambda t: F.struct(_role(t[role], layout).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    return F.array(*(F.struct(
        (_role(_text_at(payload, role), layout) if role.startswith("$") else F.lit(role)).alias("role"),
        F.coalesce(_text_at(payload, path), F.lit("")).alias("text")) for role, path in layout.fields))


def canonical(rows: DataFrame, payload: str = "payload", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds layout (name) and turns (role, text) for each payload; a null text is empty.

    Payloads of an unknown layout keep their row, with null layout and turns."""
    print_ = F.col("__fingerprint")
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for layout in layouts:
        known = [fingerprint(F.parse_json(F.lit(e))) for e in layout.examples]
        name = F.when(print_.isin(*known), layout.name).otherwise(name)
        turns = F.when(print_.isin(*known), _turns(F.col(payload), layout).cast(_TURNS)).otherwise(turns)
    return rows.withColumn("__fingerprint", fingerprint(F.col(payload))).withColumns(
        {"layout": name, "turns": turns}).drop("__fingerprint")


def _escape(text: Column, n: int) -> Column:
    for plain, coded in ESCAPES[:n]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(rows: DataFrame, key: str = "conv_id", position: str = "turn", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The formatted chunks of conversations whose rows carry ``turns``.

    Rows of a conversation are ordered by position (nulls first), then role and text, so
    that equal positions and repeated rows have a fixed order too. Returns key, chunk (in
    order), text, and loss: the spans of the assistants' texts in it, in code points.
    """
    at = F.coalesce(F.col(position).cast("long"), F.lit(-(1 << 62)))
    listed = rows.filter(F.size("turns") > 0).select(
        F.col(key).alias("key"), F.shiftright(at, chunk_bits).alias("chunk"), F.struct(at.alias("at"), "turns").alias("row"))
    chunks = listed.groupBy("key", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    written = chunks.select("key", "chunk", F.transform(
        F.flatten(F.transform("rows", lambda r: r["turns"])), lambda t: F.struct(
            (t["role"] == LOSS_ROLE).alias("loss"),
            F.concat(F.lit(HEAD), _escape(t["role"], 4), F.lit(BETWEEN)).alias("head"),
            _escape(t["text"], IN_TEXT).alias("body"))).alias("t"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    spans = F.aggregate("t", zero, lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(TAIL)).alias("at"),
        F.when(t["loss"], F.concat(a["loss"], F.array(F.struct(
            (a["at"] + F.length(t["head"])).alias("start"),
            (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(a["loss"]).alias("loss")))["loss"]
    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    return written.select(F.col("key").alias(key), "chunk", text.alias("text"), spans.alias("loss"))


def read_back(chunks: DataFrame) -> DataFrame:
    """Adds turns, as the template marks them, and learnt, the text under the loss mask."""
    parts = F.filter(F.split("text", TAIL), lambda p: p != "")
    turn = F.transform(parts, lambda p: F.struct(
        _unescape(F.substring_index(F.substring(p, len(HEAD) + 1, F.length(p)), BETWEEN, 1)).alias("role"),
        _unescape(F.substring(p, F.locate(BETWEEN, p) + len(BETWEEN), F.length(p))).alias("text")))
    learnt = F.array_join(F.transform("loss", lambda s: _unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    return chunks.withColumn("turns", turn).withColumn("learnt", learnt)


def digests(chunks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its chunks: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per_chunk = read_back(chunks).select(key, F.struct(
        "chunk", F.size("turns").cast("long").alias("n"), said.alias("said"), "learnt", F.length("text").cast("long").alias("chars")).alias("c"))
    whole = per_chunk.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("c"))

    def total(field: str) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda n, c: n + c[field])

    def joined(field: str) -> Column:
        return F.array_join(F.transform("c", lambda c: c[field]), "")

    return whole.select(key, total("n").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
                        F.length(joined("learnt")).cast("long").alias("loss_chars"), F.sha2(joined("learnt"), 256).alias("loss_sha256"),
                        total("chars").alias("formatted_chars"))
