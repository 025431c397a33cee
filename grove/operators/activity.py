"""Adoptions, waterings and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars


def adopted(toggles: DataFrame) -> DataFrame:
    """Pairs (tree, user_id) that are adopted after all toggles: an odd number of them."""
    return toggles.groupBy("tree", "user_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("tree", "user_id")


def toggle(adoptions: DataFrame, tree: int, user: int) -> DataFrame:
    """One toggle on a stored set: there, it goes; else it comes."""
    one = adoptions.sparkSession.createDataFrame([(tree, user)], adoptions.select("tree", "user_id").schema)
    return adoptions.join(one, ["tree", "user_id"], "left_anti").select("tree", "user_id").unionByName(one.join(adoptions, ["tree", "user_id"], "left_anti"))


def with_species(adoptions: DataFrame, trees: DataFrame, default: str = "Unbekannt") -> DataFrame:
    """Adoptions with their tree's species; a missing or blank one gets the default. One join for what was a request a row."""
    return adoptions.join(trees, "tree", "left").withColumn("species", scalars.or_default(F.col("species"), default, blank_too=True))


def delete_own(waterings: DataFrame, ids: DataFrame, me: int) -> DataFrame:
    """Waterings without those of the given ids that are the user's own."""
    mine = waterings.filter(F.col("user_id") == me).join(ids, "id", "left_semi").select("id")
    return waterings.join(mine, "id", "left_anti")


def latest_first(waterings: DataFrame, key: str, value: int) -> DataFrame:
    return waterings.filter(F.col(key) == value).orderBy(F.desc("created_at"), "id")


def valid_watering(amount: Column, day: Column) -> Column:
    return amount.between(1, 100) & day.isNotNull()


def water_balance(waterings: DataFrame, required: float) -> DataFrame:
    """What each tree still lacks."""
    got = waterings.groupBy("tree").agg(F.sum("amount").alias("given"))
    return got.select("tree", "given", (F.lit(required).cast("decimal(22,2)") - F.col("given")).alias("lacking"))


MESSAGE = "type string, ai boolean, payload struct<message: string, type: string, image: string, buttons: array<struct<name: string, request: struct<type: string>>>>"


def flatten_messages(raw: Column) -> Column:
    """A JSON message as (text, type, buttons, from_ai); absent parts get their defaults."""
    m = F.from_json(raw, MESSAGE)
    names = F.transform(F.coalesce(m["payload"]["buttons"], F.from_json(F.lit("[]"), "array<struct<name: string, request: struct<type: string>>>")), lambda b: b["name"])
    return F.struct(F.coalesce(m["payload"]["message"], F.lit("")).alias("text"), F.coalesce(m["payload"]["type"], m["type"]).alias("type"), names.alias("buttons"), m["ai"].eqNullSafe(True).alias("from_ai"))


def shown_messages(messages: DataFrame, hidden: tuple[str, ...] = ("no-reply", "path")) -> DataFrame:
    return messages.filter(~F.coalesce(F.col("type"), F.lit("")).isin(*hidden))


def running_delay(messages: DataFrame, conversation: str, order: list[str], delay: str) -> DataFrame:
    """When each message shows: the delays of itself and of all before it in its conversation."""
    so_far = W.partitionBy(conversation).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("shown_after", F.sum(F.coalesce(delay, F.lit(0))).over(so_far))


def message_rows(kind: Column, text: Column, options: Column, image: Column) -> Column:
    """What a message shows: a text one row; a choice its heading and a row a button; a visual its text with the image; an end nothing."""
    row = lambda k, t, i: F.struct(F.lit(k).alias("shows"), t.alias("text"), i.alias("image"))
    none = F.lit(None).cast("string")
    return (
        F.when(kind == "text", F.array(row("text", text, none)))
        .when(kind == "choice", F.concat(F.array(row("text", text, none)), F.transform(options, lambda o: row("button", o, none))))
        .when(kind == "visual", F.array(row("visual", text, image)))
        .otherwise(F.slice(F.array(row("text", text, none)), 1, 0))
    )
