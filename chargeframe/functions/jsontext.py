"""JSON held in text columns: driver inputs and augmentation replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.functions.energy import behavior_rules
from chargeframe.schemas import USER_INPUT

# Fixed values.
EMPTY_TEXTS = ["", "[]", "{}", "nan", "None"]
REASONING_END = "</think>"
JSON_FENCE, FENCE = "```json", "```"
REPLY_KEY = "augmented_rows"
REPLY_FIELDS = ["urgency_score", "flexibility_index", "habit_stability", "grid_impact_proxy"]
FIELD_SUFFIXES = ["_score", "_index", "_stability"]


WHITESPACE = " \t\n\r\f\v"


def _strip(c) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITESPACE))


def is_blank_json(c) -> Column:
    """Null, or one of the texts that stand for "nothing entered"."""
    text = _strip(c)
    return text.isNull() | text.isin(EMPTY_TEXTS)


def parse_user_inputs(df: DataFrame, text: str = "userInputs", out: str = "latest",
                      count: str = "revisionCount") -> DataFrame:
    """The last revision as a struct, and the number of revisions.

    The text is a JSON list of revisions or a single one. Blank or malformed
    text, and a last element that is not an object, give a struct of nulls or
    null. The steps are columns of their own, so that each text is parsed once.
    """
    body, items, last = F.col("_body"), F.col("_items"), F.col("_last")
    single = F.when(F.try_parse_json(body).isNotNull(), F.array(body))
    listed = F.when(body.startswith("{"), single).otherwise(F.from_json(body, "array<string>"))
    return (
        df.withColumn("_body", _strip(text))
        .withColumn("_items", F.when(~body.isin(EMPTY_TEXTS), listed))
        .withColumn("_last", _strip(F.try_element_at(items, F.lit(-1))))
        .withColumns({
            out: F.from_json(F.when(last.startswith("{"), last), USER_INPUT),
            count: F.when(F.size(items) > 0, F.size(items)),
        }).drop("_body", "_items", "_last"))


def extract_json_reply(df: DataFrame, content: str = "content", out: str = "payload") -> DataFrame:
    """The JSON text of a reply, null when what is left is not valid JSON.

    Text before the last end-of-reasoning mark is cut, then the first fenced
    block is taken.
    """
    text, body = F.col("_text"), F.col("_body")

    def fenced(mark: str) -> Column:
        after = F.get(F.split(text, mark, -1), F.lit(1))
        return _strip(F.get(F.split(after, FENCE, -1), F.lit(0)))

    chosen = F.when(text.contains(JSON_FENCE), fenced(JSON_FENCE)).when(text.contains(FENCE), fenced(FENCE)).otherwise(text)
    return (df.withColumn("_text", _strip(F.substring_index(content, REASONING_END, -1))).withColumn("_body", chosen)
            .withColumn(out, F.when(F.try_parse_json(body).isNotNull(), body)).drop("_text", "_body"))


def _short_name(field: str) -> str:
    for suffix in FIELD_SUFFIXES:
        field = field.replace(suffix, "")
    return field


def reply_row(payload="payload") -> Column:
    """The one augmented row of a reply as a string map, else null.

    A reply covers one session; a list of any other length is not accepted.
    """
    payload = F.col(payload) if isinstance(payload, str) else payload
    listed = F.when(payload.startswith("{"), F.get_json_object(payload, f"$.{REPLY_KEY}")).otherwise(payload)
    rows = F.from_json(listed, "array<map<string,string>>")
    return F.when(F.size(rows) == 1, F.get(rows, F.lit(0)))


def reply_values(reply: str) -> tuple[Column, dict[str, Column]]:
    """Whether a string map ``reply`` has all fields, by their names or short names, and their typed values."""
    present, values = F.col(reply).isNotNull(), {}
    for field in REPLY_FIELDS:
        names = list(dict.fromkeys([field, _short_name(field)]))
        has = F.lit(False)
        value = F.lit(None).cast("string")
        for name in reversed(names):
            here = F.map_contains_key(reply, F.lit(name))
            value = F.when(here, F.try_element_at(reply, F.lit(name))).otherwise(value)
            has = has | here
        present = present & has
        values[field] = (value if field == "grid_impact_proxy"
                         else value.try_cast("double").cast("int" if field == "urgency_score" else "double"))
    return present, values


def merge_augmented(sessions: DataFrame, replies: DataFrame, key: str = "sessionID",
                    payload: str = "payload", order: str | None = None) -> DataFrame:
    """Behaviour columns from the replies; the rules when a reply lacks any.

    Of several replies to a session the newest usable one by ``order`` counts
    (without ``order`` the largest text), so a session stays one row.
    ``used_rules`` tells which source a row took.
    """
    read = replies.select(key, reply_row(payload).alias("_reply"), F.col(order or payload).alias("_order"))
    newest = read.groupBy(key).agg(F.max_by("_reply", F.struct(F.col("_reply").isNotNull(), "_order")).alias("_reply"))
    joined = sessions.drop(*REPLY_FIELDS).join(newest, key, "left")

    present, values = reply_values("_reply")
    rules = behavior_rules()
    typed = joined.withColumn("used_rules", ~F.coalesce(present, F.lit(False)))
    return typed.withColumns({
        field: F.when(F.col("used_rules"), rules[field]).otherwise(values[field]) for field in REPLY_FIELDS}).drop("_reply")
