"""Chat formatting by prefix-target expansion: one example for each assistant turn, with all turns before it. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: TURN role TEXT text END. Texts and roles are escaped so that "<|" never stands in them.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def format_chats(df: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples of each conversation: conv_id, target (place of its last turn, from 1), formatted, loss_start, loss_chars.

    Every turn of `target_role` ends one example: all turns before it are context, and only its (escaped) text is under the loss
    mask: loss_chars code points of `formatted` from loss_start on (counted from 1). Turns after the last target form one more
    example with loss_chars 0, so the output holds every turn. Turns are ordered by turn, then role and text (repeated rows and
    ties stay, in that order); null roles and texts are empty texts, null turns come first, a null conv_id is a conversation
    of its own. An empty table gives none. Other columns, whatever their names, are ignored. A conversation's turns are one row, so a
    very long one, or a very long text, is held whole by one task; each of its examples is as long as what it holds.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    part = lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("said"), (t["role"] == target_role).alias("trained"))
    parts = chats.select("conv_id", F.transform("turns", part).alias("parts"))
    # an exploded row carries the conversation's text once, and the lengths of its parts
    size = lambda p, i: F.struct((i + 1).alias("target"), F.char_length(p["head"]).alias("head"), F.char_length(p["said"]).alias("said"), p["trained"].alias("trained"))
    laid = parts.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["said"], F.lit(END))), "").alias("all"), F.transform("parts", size).alias("sizes"))
    last = F.size("sizes")
    rows = laid.select("conv_id", "all", F.transform("sizes", lambda s: s["head"] + s["said"] + len(END)).alias("chars"), F.explode(F.filter("sizes", lambda s: s["trained"] | (s["target"] == last))).alias("s"))
    context = F.aggregate(F.slice("chars", F.lit(1), F.col("s.target") - 1), F.lit(0), lambda a, x: a + x)
    rows = rows.select("conv_id", "all", "s", context.alias("context"))
    return rows.select(
        "conv_id",
        F.col("s.target").alias("target"),
        F.substr("all", F.lit(1), F.col("context") + F.col("s.head") + F.col("s.said") + len(END)).alias("formatted"),
        (F.col("context") + F.col("s.head") + 1).alias("loss_start"),
        F.when(F.col("s.trained"), F.col("s.said")).otherwise(0).alias("loss_chars"),
        F.col("s.trained").alias("trained"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of an example as (role, text), read back from its characters."""
    cut = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(
        F.slice(cut, 1, F.size(cut) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns from the longest one, the texts under the loss masks in order."""
    mask = F.when(F.col("loss_chars") > 0, unescape(F.substr("formatted", "loss_start", "loss_chars"))).otherwise("")
    seen = examples.withColumn("masked", mask).groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "masked"))), lambda x: x["masked"]), "").alias("masked"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.count_if("trained").alias("n_examples"),
    )
    seen = seen.withColumn("turns", parse_turns(F.col("longest")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
