"""Chat formatting with prefix-target expansion, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings begin so: `<` before `|`, `s>`, `/s>`, `<SYS`, `</SYS`; `[` before `INST]`, `/INST]`.
CONTROL = r"\\|<(?=\||/?s>|<?/?SYS|</SYS)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    """`text` with a backslash after every backslash and after the first character of every control string."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit("$0\\\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of `turns` (conv_id, turn, role, text): conv_id, formatted, examples.

    `formatted` has each turn as <|turn|>role<|text|>text<|end|>, role and text escaped. A prefix of it is the context of
    an example, so `examples` (array of struct of example, prefix_end, loss_start, loss_end; characters counted from 0,
    ends exclusive) describes an example for every assistant turn without repeating its context: its text is the first
    prefix_end characters, of which loss_start to loss_end are to be learnt.

    Null roles and texts count as empty. Rows are in order of turn, then role, then text, nulls first; repeated rows are
    repeated turns. Rows with a null conv_id are one conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    fragment = F.concat(F.lit(TURN), escaped(role), F.lit(TEXT), escaped(text), F.lit(END))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("fragment", fragment)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "conv_id", "fragment", F.row_number().over(order).alias("at"), (F.col("role") == "assistant").alias("trained"),
        F.sum(F.length("fragment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.length(escaped(F.col("text"))).cast("long").alias("n"),
    )
    end = F.col("end") - len(END)
    example = F.when(F.col("trained"), F.struct(F.col("at").alias("example"), F.col("end").alias("prefix_end"), (end - F.col("n")).alias("loss_start"), end.alias("loss_end")))
    parts = F.array_sort(F.collect_list(F.struct("at", "fragment")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["fragment"]), "").alias("formatted"), F.array_sort(F.collect_list(example)).alias("examples"))


def expand(chats: DataFrame, *more: str) -> DataFrame:
    """One row for each example of format_chats(): conv_id, columns `more`, example, text (context and reply), loss_start, loss_end.

    Every assistant turn is an example with all turns before it as context. Contexts are written out, so a conversation
    takes space as the square of its turns; readers that can follow offsets may use `examples` itself. A conversation
    without an assistant turn has one row of nulls, as the columns `more` belong to it too.
    """
    rows = chats.select("conv_id", *more, "formatted", F.explode_outer("examples").alias("e"))
    return rows.select("conv_id", *more, "e.example", F.substring("formatted", F.lit(1), F.col("e.prefix_end").cast("int")).alias("text"), "e.loss_start", "e.loss_end")


def turns_of(formatted: Column) -> Column:
    """The turns (array of role, text) that `formatted` holds, parsed and unescaped."""
    pieces = F.split(formatted, F.lit(r"\Q" + TURN + r"\E"))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, F.lit(r"\Q" + TEXT + r"\E"))
        body = halves[1]
        text = F.substring(body, F.lit(1), F.length(body) - len(END))
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: turns read back from the formatted text, the loss from the examples of expand()."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.withColumn("turns", turns_of(F.col("formatted"))).select(
        "conv_id", "formatted", "examples", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = ["n_turns", "turns_sha256", "formatted_chars"]
    reply = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = expand(read, *whole).select("conv_id", *whole, "example", unescaped(reply).alias("reply"))
    # the examples of a conversation lie in one partition already
    rows = rows.groupBy("conv_id", *whole).agg(F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("r"))
    loss = F.array_join(F.transform("r", lambda x: x["reply"]), "")
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
