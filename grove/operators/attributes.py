"""Property configuration and entity-attribute-value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import strings as st
from .identity import first_rows


def is_json_string(text: str | Column, path: str) -> Column:
    """Whether the value at a top-level key is a JSON string (from_json would turn numbers into text)."""
    v = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def parse_config(rows: DataFrame) -> DataFrame:
    """Config rows (line, property_id, type, action, config, description, import) with their JSON columns read.

    A blank property id is left out and the last row of a repeated one wins; unknown actions mean keep. inline_* come from config
    and have defaults; import_skip, import_group and import_name from import. code tells a malformed row: invalid_inline_config
    for an inline row without a text target, invalid_import_config for an import that is neither blank, `skip` nor an object
    whose group and attribute_name, if present, are texts.
    """
    rows = first_rows(rows.filter("trim(property_id) <> ''"), ["property_id"], "line", last=True)
    action = F.when(st.trimmed(F.col("action")).isin("ignore", "inline"), st.trimmed(F.col("action"))).otherwise("keep")
    rows = rows.withColumn("action", action).withColumn("import", st.trimmed(F.col("import")))
    inline = F.col("action") == "inline"
    has_target = is_json_string("config", "$.target")
    json = lambda c, path: F.get_json_object(c, path)
    skip, blank = F.col("import") == "skip", F.col("import") == ""
    parsed = F.try_parse_json("import")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    text_or_none = lambda path: json("import", path).isNull() | is_json_string("import", path)
    bad_import = ~skip & ~blank & ~(is_object & text_or_none("$.group") & text_or_none("$.attribute_name"))
    return rows.select(
        "line", "property_id", "type", "action", "description",
        F.when(inline & has_target, json("config", "$.target")).alias("inline_target"),
        F.when(inline & has_target, F.coalesce(json("config", "$.source"), F.lit("rdfs:label"))).alias("inline_source"),
        F.when(inline & has_target, F.coalesce(json("config", "$.keep_source") == "true", F.lit(False))).alias("keep_source"),
        skip.alias("import_skip"),
        F.when(~skip & ~blank & ~bad_import, json("import", "$.group")).alias("import_group"),
        F.when(~skip & ~blank & ~bad_import, json("import", "$.attribute_name")).alias("import_name"),
        F.when(inline & ~has_target, "invalid_inline_config").when(bad_import, "invalid_import_config").alias("code"),
    )


def with_attribute_names(config: DataFrame) -> DataFrame:
    """Adds importable and attribute_name: the import's, else the inline target, else the slug of the description's label (which may be '')."""
    described = F.when(F.col("description") != "", st.slug(st.description_label(F.col("description"))))
    return config.withColumn("importable", ~F.col("import_skip") & (F.col("action") != "ignore")).withColumn("attribute_name", F.coalesce("import_name", "inline_target", described))


def attribute_defs(config: DataFrame, review: DataFrame) -> DataFrame:
    """Importable properties with a name that reviews use, by first appearance: property_id, attribute_name, type, vocabulary, first_line."""
    used = review.groupBy("property_id").agg(F.min("line").alias("first_line"))
    named = with_attribute_names(config).filter("importable and attribute_name is not null")
    return used.join(named, "property_id").select("property_id", "attribute_name", "type", scalars.vocabulary_type(F.col("type"), F.col("property_id")).alias("vocabulary"), "first_line")


def attribute_key_issues(defs: DataFrame) -> DataFrame:
    """Attribute names that several properties claim, with those properties by first appearance."""
    held = F.transform(F.sort_array(F.collect_list(F.struct("first_line", "property_id"))), lambda x: x["property_id"])
    return defs.groupBy("attribute_name").agg(held.alias("property_ids"), F.count("*").alias("n")).filter("n > 1").drop("n")


def datatype_warnings(defs: DataFrame) -> DataFrame:
    return defs.filter(~scalars.known_datatype(F.col("type"))).select("property_id", F.col("type").alias("datatype"))


def melt(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key and attribute, values as text; null values stay."""
    return wide.unpivot([key], [F.col(c).cast("string").alias(c) for c in columns], "attribute", "value")


def melt_joined(wide: DataFrame, key: str, columns: list[str], groups: DataFrame) -> DataFrame:
    """The melted rows with their own wide row and their attribute's group; groups must name an attribute once at most."""
    if not groups.groupBy("attribute").count().filter("count > 1").isEmpty():
        raise ValueError("an attribute has several groups")
    long = melt(wide, key, columns)
    return wide.join(long, key, "right").join(groups, "attribute", "left")


def explode_groups(catalogue: DataFrame, column: str = "groups") -> DataFrame:
    """group -> attribute -> description, a map of maps, as rows."""
    return catalogue.select(F.explode(column).alias("group_name", "attributes")).select("group_name", F.explode("attributes").alias("attribute", "description"))


def values_as_text(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per value: lists are exploded, booleans are lower case, nulls are left out; type tells what the column held."""
    kinds = dict(wide.dtypes)
    kind = {c: "string" if kinds[c].startswith("array") or kinds[c] == "string" else "boolean" if kinds[c] == "boolean" else "number" for c in columns}
    items = F.array(*[F.struct(F.lit(c).alias("attribute"), F.lit(kind[c]).alias("type"), (F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))).alias("many")) for c in columns])
    one = wide.select(key, F.explode(items).alias("v")).select(key, "v.attribute", "v.type", F.explode("v.many").alias("value"))
    return one.filter("value is not null")


def column_types(long: DataFrame, order: str) -> DataFrame:
    """Type of each attribute: that of its first value in order that is there; without any, string."""
    return long.groupBy("attribute").agg(F.coalesce(F.min_by(F.when(F.col("type").isNotNull(), F.col("type")), F.when(F.col("type").isNotNull(), F.col(order))), F.lit("string")).alias("type"))


def with_surrogates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A key column that depends on the natural key alone: no join, no counter, the same in every run."""
    return rows.withColumn(name, scalars.surrogate_key(*[F.col(k) for k in keys]))


def must_match(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses rows without a partner."""
    lost = rows.join(table, key, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"no {key} {lost[0][key]!r}")
    return rows.join(table, key)
