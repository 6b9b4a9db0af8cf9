"""Chat formatting with DataFrame functions only.

A conversation's turns are collected as structs in segments of consecutive turn
numbers, sorted, and written as marked blocks; adjacent turns of one role share
a block. Segments are then joined in order, so that a long conversation is
formatted by many tasks and only its finished pieces meet in its output row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that one segment spans.
SEGMENT = 64


@dataclass(frozen=True)
class Template:
    """Control strings: a block is open role middle text (between text)* close."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    between: str = "<|im_turn|>"
    close: str = "<|im_end|>"
    #: Control strings of other templates, which no text may bring in either.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    def controls(self) -> list[str]:
        return [self.open, self.middle, self.between, self.close, *self.foreign]


def _quoted(text: str) -> str:
    return "".join(x if x.isalnum() else "\\" + x for x in text)


def escape(text: Column, template: Template) -> Column:
    r"""Text in which no control string stands: a backslash becomes \b, and \z goes after the first character of a control string."""
    rule = "|".join(f"{_quoted(x[0])}(?={_quoted(x[1:])})" for x in template.controls())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), f"({rule})", "$1\\\\z")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\z"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _segment_pieces(turns: Column, template: Template) -> Column:
    """Per turn: what stands before its text, and its text with the loss flag. The first turn's open and the last one's close are left to the join of segments."""

    def one(turn: Column, k: Column) -> Column:
        same = (k > 0) & (F.get(turns, k - 1)["role"] == turn["role"])
        lead = F.when(same, F.lit(template.between)).otherwise(
            F.concat(F.when(k > 0, F.lit(template.close)).otherwise(F.lit("")), F.lit(template.open), turn["role"], F.lit(template.middle))
        )
        return F.array(
            F.struct(F.when((k == 0), F.lit(None).cast("string")).otherwise(lead).alias("text"), F.lit(False).alias("loss")),
            F.struct(turn["text"].alias("text"), (turn["role"] == "assistant").alias("loss")),
        )

    return F.flatten(F.transform(turns, one))


def format_chats(
    turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv, formatted (the whole text) and pieces (its consecutive parts with a loss flag).

    The loss mask covers the texts of assistant turns, not the marks around
    them. Order: turn number, nulls first, then role, then text, so repeated
    rows and ties have one result. Null role or text counts as empty. A null
    conversation id is a conversation of its own; other columns are left out;
    an empty table gives no rows.
    """
    clean = turns.select(
        F.col(conv).alias("__conv"),
        F.floor(F.coalesce(F.col(turn), F.lit(-1)) / SEGMENT).alias("__segment"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit("")), template).alias("role"),
            escape(F.coalesce(F.col(text), F.lit("")), template).alias("text"),
        ).alias("__turn"),
    )
    segments = (
        clean.groupBy("__conv", "__segment")
        .agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
        .select(
            "__conv",
            F.struct(
                F.col("__segment").alias("segment"),
                F.element_at("__turns", 1)["role"].alias("first"),
                F.element_at("__turns", -1)["role"].alias("last"),
                _segment_pieces(F.col("__turns"), template).alias("pieces"),
            ).alias("__part"),
        )
    )
    parts = F.col("__parts")

    def joined(part: Column, k: Column) -> Column:
        same = (k > 0) & (F.get(parts, k - 1)["last"] == part["first"])
        lead = F.when(same, F.lit(template.between)).otherwise(
            F.concat(F.when(k > 0, F.lit(template.close)).otherwise(F.lit("")), F.lit(template.open), part["first"], F.lit(template.middle))
        )
        return F.concat(F.array(F.struct(lead.alias("text"), F.lit(False).alias("loss"))), F.slice(part["pieces"], F.lit(2), F.greatest(F.size(part["pieces"]) - 1, F.lit(0))))

    pieces = F.concat(F.flatten(F.transform(parts, joined)), F.array(F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss"))))
    whole = segments.groupBy("__conv").agg(F.sort_array(F.collect_list("__part")).alias("__parts"))
    return whole.select(F.col("__conv").alias(conv), pieces.alias("pieces")).select(
        conv, F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("formatted"), "pieces"
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The array of (role, text) turns that a formatted text holds, unescaped."""
    blocks = F.filter(F.split(formatted, _quoted(template.close)), lambda x: x != "")

    def block(part: Column) -> Column:
        cut = F.split(F.substr(part, F.lit(len(template.open) + 1)), _quoted(template.middle))
        return F.transform(
            F.split(F.get(cut, F.lit(1)), _quoted(template.between)),
            lambda x: F.struct(unescape(F.get(cut, F.lit(0))).alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, block))


def digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests of each formatted conversation, read back from the formatted text and its loss mask."""
    done = format_chats(conversations, template)
    back = done.select("conv_id", "formatted", "pieces", read_turns(F.col("formatted"), template).alias("turns"))
    loss = unescape(F.array_join(F.transform(F.filter("pieces", lambda x: x["loss"]), lambda x: x["text"]), ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query formats beside the table's: control strings as texts.
CONTROL_ID, CONTROL_TEXT = -7, "</s>[INST] ok [/INST]"


def with_control(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = spark.range(2).select(
        F.lit(CONTROL_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


#: Each control string grows by one \\z for its first character, each backslash by one b.
def oracle() -> str:
    template = Template()
    quoted = lambda text: "".join(x if x.isalnum() or x in "<>/" else "\\" + x for x in text)
    rule = "|".join(quoted(x) for x in template.controls())
    return f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES ({CONTROL_ID}, 0, 'user', '{CONTROL_TEXT}'), ({CONTROL_ID}, 1, 'assistant', '{CONTROL_TEXT}')) AS v(conv_id, turn, role, text)),
sized AS (
  SELECT *, length(text) + 2 * len(regexp_extract_all(text, '{rule}')) + len(regexp_extract_all(text, '\\\\')) AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN before = role THEN {len(template.between)} ELSE length(role) + {len(template.open) + len(template.middle) + len(template.close)} END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
