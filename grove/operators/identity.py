"""Identity of names: first-wins distinct rows, conflicts, merges, and the validation of a name-to-entity mapping.

Folds over ordered rows are windows over an explicit ordinal; keys are canonical names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import normalize, valid_entity_id


def canonical(c: str | Column = "botanic") -> Column:
    return normalize(F.col(c) if isinstance(c, str) else c)


def first_rows(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row a key: the first by order, or the last. The winner is a map-side combined aggregate, so a hot key is no hot task."""
    pick = (F.max_by if last else F.min_by)(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick.alias("r")).select("r.*")


def with_first(rows: DataFrame, key: str, order: str, **columns: str) -> DataFrame:
    """Rows with the named columns of the first row of their key; an aggregate joined back, which Spark can split when a key is hot."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(order, *columns.values()), F.col(order)).alias("__first"))
    out = rows.join(first, key)
    return out.select(*rows.columns, F.col(f"__first.{order}").alias("first_order"), *[F.col(f"__first.{c}").alias(name) for name, c in columns.items()])


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", canonical()).filter("key <> ''")


def distinct_species(rows: DataFrame, order: str = "pos") -> DataFrame:
    """First row of each canonical name; blank names are left out."""
    return first_rows(named(rows), ["key"], order)


def name_conflicts(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Later rows whose common name differs from their species' first one."""
    seen = with_first(named(rows), "key", order, kept_common="common")
    return seen.filter((F.col(order) > F.col("first_order")) & ~F.col("common").eqNullSafe(F.col("kept_common")))


def spelling_merges(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Pairs (kept, merged) of spellings that one canonical name brings together."""
    seen = with_first(named(rows), "key", order, kept="botanic")
    return seen.filter(F.col("botanic") != F.col("kept")).select("kept", F.col("botanic").alias("merged")).distinct()


def classify_mapping(rows: DataFrame) -> DataFrame:
    """Mapping rows (line, botanic, common, qid) with code: null for a target, else the reason, by the first that holds.

    blank_mapping_qid, invalid_qid, then for a name that a kept row has: duplicate_mapping when the entity is that row's,
    conflicting_mapping_qids otherwise; first_line and first_qid tell the kept row.
    """
    rows = rows.withColumn("key", canonical())
    blank, valid = F.coalesce(F.col("qid"), F.lit("")) == "", valid_entity_id(F.col("qid"))
    kept = rows.filter(valid & ~blank).groupBy("key").agg(F.min("line").alias("first_line"), F.min_by("qid", "line").alias("first_qid"))
    rows = rows.join(kept, "key", "left")
    code = F.when(blank, "blank_mapping_qid").when(~valid, "invalid_qid").when(F.col("line") == F.col("first_line"), None).when(F.col("qid") == F.col("first_qid"), "duplicate_mapping").otherwise("conflicting_mapping_qids")
    return rows.withColumn("code", code)


def mapping_targets(classified: DataFrame) -> DataFrame:
    return classified.filter("code is null").select("line", "botanic", "common", "qid", "key")


def mapping_warnings(classified: DataFrame) -> DataFrame:
    return classified.filter("code = 'blank_mapping_qid'").select("line", "botanic", "code")


def mapping_issues(classified: DataFrame) -> DataFrame:
    told = classified.filter("code is not null and code <> 'blank_mapping_qid'")
    again = F.col("code") != "invalid_qid"
    return told.select("line", "botanic", "qid", "code", F.when(again, F.col("first_line")).alias("first_line"), F.when(again, F.col("first_qid")).alias("first_qid"))


def mapping_entities(targets: DataFrame) -> DataFrame:
    """One representative an entity: its first target."""
    return first_rows(targets, ["qid"], "line")


class MappingRejected(ValueError):
    """A mapping with issues is rejected as a whole: `issues` is the frame of all of them, and the message lists every one."""

    def __init__(self, issues: DataFrame):
        self.issues = issues
        lines = issues.orderBy("line").toLocalIterator()
        super().__init__("\n".join(f"- {r.code}: line {r.line}, {r.botanic}, {r.qid}" for r in lines))


def build_mapping(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, entities, warnings), or MappingRejected with the issues."""
    classified = classify_mapping(rows)
    issues = mapping_issues(classified)
    if not issues.limit(1).isEmpty():
        raise MappingRejected(issues)
    targets = mapping_targets(classified)
    return targets, mapping_entities(targets), mapping_warnings(classified)


def issue_text(issues: DataFrame) -> DataFrame:
    return issues.select("line", F.format_string("- %s: line %d, %s", "code", "line", "botanic").alias("text"))


def match_species(species: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(species with their entity, species without, mapping rows without species), joined by canonical name."""
    keyed = species if "key" in species.columns else species.withColumn("key", canonical())
    ids = targets.select("key", "qid")
    return keyed.join(ids, "key"), keyed.join(ids, "key", "left_anti"), targets.join(keyed, "key", "left_anti")
