"""Chat formatting: turn order by a finite-state machine, segments and loss flags from a template.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles bear loss, and which role may follow which.

    head is followed by the role, mid, the text, and tail. The escape character and both control
    strings are replaced inside roles and texts by the escape character and a letter, which can be
    undone: in an escaped string the escape character stands only at the start of such a pair.
    """

    head: str = "### "
    mid: str = ": "
    tail: str = " </turn>\n"
    escape: str = "\\"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a turn that no transition allows makes the conversation invalid.
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final_states: tuple[str, ...] = ("answered",)


TEMPLATE = Template()


def escaped(c: Column, template: Template = TEMPLATE) -> Column:
    for plain, code in template.escapes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, template: Template = TEMPLATE) -> Column:
    for plain, code in reversed(template.escapes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation by turn, then role and text. Null roles and texts are empty.

    A conversation is one training example and one output row, so its turns meet in one row.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def final_state(turns: Column, template: Template = TEMPLATE) -> Column:
    """State of the machine after the turns; 'invalid' once a role has no transition."""

    def step(state: Column, t: Column) -> Column:
        out = F.lit("invalid")
        for name, nexts in template.transitions.items():
            for role, to in nexts.items():
                out = F.when((state == name) & (t["role"] == role), to).otherwise(out)
        return out

    return F.aggregate(turns, F.lit("start"), step)


def segments(turns: Column, template: Template = TEMPLATE) -> Column:
    """Three segments (text, loss) a turn: head with role, text, tail. Loss falls on the texts of loss roles."""

    def of(t: Column) -> Column:
        def seg(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        head = F.concat(F.lit(template.head), escaped(t["role"], template), F.lit(template.mid))
        return F.array(seg(head, no), seg(escaped(t["text"], template), t["role"].isin(*template.loss_roles)), seg(F.lit(template.tail), no))

    return F.flatten(F.transform(turns, of))


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segments, formatted, valid) for each conversation in rows (conv_id, turn, role, text).

    All conversations are formatted; valid says whether the machine accepts the order of turns. Rows
    that repeat a turn are turns of their own; a null conv_id is a conversation; no rows give no rows.
    """
    out = conversations(rows).select("conv_id", segments(F.col("turns"), template).alias("segments"), final_state(F.col("turns"), template).isin(*template.final_states).alias("valid"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, F.concat(F.lit("\\Q"), F.lit(template.tail), F.lit("\\E")), -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def of(p: Column) -> Column:
        body = F.substring(p, F.lit(len(template.head) + 1), F.length(p))
        role = F.substring_index(body, template.mid, 1)
        text = F.substring(body, F.length(role) + len(template.mid) + 1, F.length(body))
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    return F.transform(parts, of)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for i, role in enumerate(("user", "assistant"))]
    out = format_chats(rows.unionByName(extra[0]).unionByName(extra[1]))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    out = out.withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    out = out.withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e'), ': ', '\\c')"
OP5_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, x, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, x)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || {_ESCAPED.format("role")} || ': ' || {_ESCAPED.format("text")} || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' ELSE false END) AND arg_max(role, i) = 'assistant' AS valid
FROM n GROUP BY conv_id
"""
