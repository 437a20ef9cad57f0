"""Augmentation of arriving sessions by replies that arrive on their own.

Sessions and replies are two streams that meet in a state per session. The states of the
sessions whose ids share a hash bucket are kept, read and written as one, since a call per
session costs milliseconds whatever it does. A session whose replies are complete is given out at once; one that waits longer than
``patience`` is given out with the rules, and a reply that comes later, however
late, replaces that row. Rows are given out as versions, so the sink only appends;
``augmented`` reads the newest version of each session.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chargeframe.functions.energy import behavior_rules
from chargeframe.functions.jsontext import REPLY_FIELDS, extract_json_reply, reply_row, reply_values
from chargeframe.streaming.jobs import run_available

SESSION, REPLY, TICK = "session", "reply", "tick"
#: Orders below any stated one, for replies without.
UNORDERED = -(2**63)

#: Buckets that ids are dealt to by hash. A checkpoint belongs to one number of them.
BUCKETS = 4096

_TEXTS = ", ".join(f"{f} string" for f in REPLY_FIELDS)
_OUT_DDL = f"id string, version int, used_rules boolean, {_TEXTS}"
#: Per session of the bucket, as packed JSON: its rules, the best reply (usable, complete, ordinal, texts), what was
#: given out last (version, texts, whether by the rules), and until when it waits (null: it does not, or not any more).
_STATE_DDL = "sessions binary"
RULES, USABLE, COMPLETE, ORDINAL, ANSWER, VERSION, GIVEN, GIVEN_RULES, UNTIL = range(9)


def _new() -> list:
    return [None, False, False, UNORDERED, None, 0, None, None, None]


def _session_events(sessions: DataFrame, key: str) -> DataFrame:
    rules = behavior_rules()
    return sessions.select(
        F.col(key).cast("string").alias("id"), F.lit(SESSION).alias("kind"), F.lit(True).alias("usable"),
        F.lit(True).alias("complete"), F.lit(UNORDERED).alias("ordinal"),
        *[rules[f].cast("string").alias(f) for f in REPLY_FIELDS])


def _reply_events(replies: DataFrame, key: str, content: str, order: str) -> DataFrame:
    read = extract_json_reply(replies, content, "payload").withColumn("_reply", reply_row("payload"))
    present, values = reply_values("_reply")
    return read.select(
        F.col(key).cast("string").alias("id"), F.lit(REPLY).alias("kind"), F.col("_reply").isNotNull().alias("usable"),
        F.coalesce(present, F.lit(False)).alias("complete"),
        F.coalesce(F.col(order).cast("long"), F.lit(UNORDERED)).alias("ordinal"),
        *[values[f].cast("string").alias(f) for f in REPLY_FIELDS])


def _tick_events(ticks: DataFrame) -> DataFrame:
    return ticks.select(
        F.lit(None).cast("string").alias("id"), F.lit(TICK).alias("kind"), F.lit(False).alias("usable"),
        F.lit(False).alias("complete"), F.lit(UNORDERED).alias("ordinal"),
        *[F.lit(None).cast("string").alias(f) for f in REPLY_FIELDS])


def _rank(usable: bool, ordinal: int, values: list | None) -> tuple:
    return usable, ordinal, [v or "" for v in values or []]


def _take(own: list, kind: str, usable: bool, complete: bool, ordinal: int, values: list) -> None:
    """An event of a session."""
    if kind == SESSION:
        # of a session that comes again, the larger rules: no order of arrival matters
        own[RULES] = values if own[RULES] is None else max(own[RULES], values, key=lambda r: [v or "" for v in r])
    elif kind == REPLY and _rank(usable, ordinal, values) > _rank(own[USABLE], own[ORDINAL], own[ANSWER]):
        own[USABLE], own[COMPLETE], own[ORDINAL], own[ANSWER] = usable, complete, ordinal, values


def _version(own: list, waited: bool) -> list | None:
    """The texts to be given out now, if they are other ones than the last."""
    answered = own[USABLE] and own[COMPLETE]
    if own[RULES] is None or not (answered or waited or own[GIVEN] is not None):
        return None
    chosen = own[ANSWER] if answered else own[RULES]
    own[UNTIL] = None
    if own[GIVEN] == chosen and own[GIVEN_RULES] == (not answered):
        return None
    own[VERSION], own[GIVEN], own[GIVEN_RULES] = own[VERSION] + 1, chosen, not answered
    return [own[VERSION], own[GIVEN_RULES], *chosen]


def _step(patience_ms: int):
    """The state transition of the sessions of a bucket."""

    def step(group: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
        now, touched = state.getCurrentProcessingTimeMs(), set()
        for batch in events:
            texts = zip(*(batch[f].tolist() for f in REPLY_FIELDS))
            columns = (batch[c].tolist() for c in ("id", "kind", "usable", "complete", "ordinal"))
            for id_, kind, usable, complete, ordinal, values in zip(*columns, texts):
                if isinstance(id_, str):
                    touched.add(id_)
                    _take(sessions.setdefault(id_, _new()), kind, bool(usable), bool(complete), int(ordinal),
                          [v if isinstance(v, str) else None for v in values])
        given = []
        for id_, own in sessions.items():
            due = own[UNTIL] is not None and own[UNTIL] <= now and id_ not in touched
            if due or id_ in touched:
                version = _version(own, due)
                if version:
                    given.append((id_, *version))
                elif own[RULES] is not None and own[GIVEN] is None:
                    own[UNTIL] = now + patience_ms
        if given:
            yield pd.DataFrame(given, columns=["id", "version", "used_rules", *REPLY_FIELDS])
        if sessions:
            state.update((zlib.compress(json.dumps(sessions, separators=(",", ":")).encode(), 1),))
            first = min((own[UNTIL] for own in sessions.values() if own[UNTIL] is not None), default=None)
            if first is not None:
                state.setTimeoutDuration(max(1, first - now))

    return step


def stream_augment_replies(sessions: DataFrame, replies: DataFrame, out: str, checkpoint: str, patience_ms: int = 3_600_000,
                           ticks: DataFrame | None = None, key: str = "sessionID", content: str = "content",
                           order: str = "attempt") -> StreamingQuery:
    """Append versions of the behaviour columns of what has arrived since the last run.

    Of several replies to a session the newest usable one by ``order`` counts, as in
    ``merge_augmented``; equal orders go to the larger texts. Timers are looked at in every
    batch; rows of ``ticks`` (any columns) cause one where neither sessions nor replies
    arrive. Sessions and replies without an id cannot meet and give no version; ``augmented``
    gives such sessions the rules. The state is a few short texts per session and has no end,
    since a reply may come at any time; a batch reads and writes the buckets it has rows of.
    """
    events = _session_events(sessions, key).unionByName(_reply_events(replies, key, content, order))
    if ticks is not None:
        events = events.unionByName(_tick_events(ticks))
    known = events.filter((F.col("kind") == TICK) | F.col("id").isNotNull())
    dealt = known.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    rows = dealt.groupBy("bucket").applyInPandasWithState(
        _step(patience_ms), _OUT_DDL, _STATE_DDL, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return run_available(rows.withColumnRenamed("id", key), out, checkpoint, idle_batches=False)


def augmented(sessions: DataFrame, versions: DataFrame, key: str = "sessionID") -> DataFrame:
    """Sessions with the newest version of their behaviour columns, and ``used_rules``.

    Sessions that still wait, or have no id, take the rules; sessions that share an id take
    the same reply, each its own rules.
    """
    newest = versions.groupBy(F.col(key).alias("_id")).agg(
        F.max_by(F.struct("used_rules", *REPLY_FIELDS), "version").alias("_newest"))
    rules = behavior_rules()
    joined = sessions.drop("used_rules", *REPLY_FIELDS).join(newest, F.col(key).cast("string") == F.col("_id"), "left")
    used = joined.withColumn("used_rules", F.coalesce("_newest.used_rules", F.lit(True)))
    kinds = {"urgency_score": "int", "grid_impact_proxy": "string"}
    return used.withColumns({
        f: F.when(F.col("used_rules"), rules[f]).otherwise(F.col(f"_newest.{f}").try_cast(kinds.get(f, "double")))
        for f in REPLY_FIELDS}).drop("_id", "_newest")
