"""Chat formatting with Spark expressions only: sorted turn structs, merged and concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import field, laid_out, packed, text_or_empty

# The template: <turn ROLE>TEXT<same>TEXT</turn>NEWLINE. <same> parts the texts of adjacent turns of
# one role. No text or role holds a raw <, > or \: they are written \l, \g and \b.
OPEN, SAME, CLOSE = "<turn ", "<same>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Undo :func:`escaped`. The backslash comes last: until then every one starts a code."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) for turns (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text; nulls come first, so ties and repeated rows
    have one order and all stay. A null text or role is empty, a null conv_id is a conversation of
    its own. ``loss_mask`` lists (start, length) in code points of ``formatted``, one per turn of
    ``learned_role`` in order. Further columns are ignored; an empty table gives no row.

    A conversation is one output row, so its turns meet in one task, but only there: the turns are
    collected per conversation after a map-side combine, and no step looks across conversations.
    """
    rows = packed(turns).select(
        field("conv_id").alias("conv_id"),
        F.struct(
            field("turn").alias("turn"),
            F.coalesce(field("role"), F.lit("")).alias("role"),
            text_or_empty().alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    roles = sorted_turns.withColumn(
        "roles",
        F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"])),
    )

    def piece(turn: Column, i: Column) -> Column:
        """A turn opens a block unless the turn before has its role, and closes it likewise."""
        # The list of roles starts with a null, and arrays count from 1.
        before = F.try_element_at("roles", i + 1)
        after = F.try_element_at("roles", i + 3)
        same_before = (i > 0) & before.eqNullSafe(turn["role"])
        head = F.when(same_before, F.lit(SAME)).otherwise(
            F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(">"))
        )
        tail = F.when(after.eqNullSafe(turn["role"]), F.lit("")).otherwise(F.lit(CLOSE))
        body = escaped(turn["text"])
        return F.struct(
            F.concat(head, body, tail).alias("whole"),
            F.length(head).cast("long").alias("head"),
            F.length(body).cast("long").alias("body"),
            F.length(tail).cast("long").alias("tail"),
            (turn["role"] == learned_role).alias("learned"),
        )

    pieces = roles.select("conv_id", F.transform("turns", piece).alias("pieces"))
    mask = laid_out(
        F.col("pieces"),
        lambda p: p["head"] + p["body"] + p["tail"],
        lambda p, at: F.struct((at + p["head"]).alias("start"), p["body"].alias("length")),
        lambda p: p["learned"],
        "struct<start:bigint,length:bigint>",
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["whole"]), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text) with every original turn, parsed from ``formatted``."""
    blocks = F.split("formatted", CLOSE)
    closed = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    split_blocks = F.transform(
        closed,
        lambda b: F.struct(
            unescaped(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), ">", 1)).alias("role"),
            F.split(F.substr(b, F.locate(">", b) + 1), SAME).alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            split_blocks,
            lambda b: F.transform(
                b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text"))
            ),
        )
    )
    return formatted.withColumn("turns", turns)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the mask, in order."""
    parts = F.transform(
        mask,
        lambda m: unescaped(
            F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int"))
        ),
    )
    return F.array_join(parts, "")
