"""Import planning: review checks, classification of values, and summaries, all before anything is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.strings import valid_entity_id
from ..sources.scratch import stored
from ..sources.tables import rewrite_scope, upsert
from .attributes import attribute_defs, attribute_key_issues, datatype_warnings, with_attribute_names
from .identity import canonical, classify_mapping, distinct_species, mapping_issues, mapping_targets, match_species


def check_identity(review: DataFrame, targets: DataFrame) -> DataFrame:
    """Review rows with code: the first of invalid_qid, missing_mapping, mapping_review_qid_mismatch, mapping_review_name_mismatch that holds."""
    known = targets.select("key", F.col("qid").alias("mapping_qid"), F.col("common").alias("mapping_common"))
    rows = review.withColumn("key", canonical()).join(known, "key", "left")
    code = (
        F.when(~valid_entity_id(F.col("qid")), "invalid_qid")
        .when(F.col("mapping_qid").isNull(), "missing_mapping")
        .when(F.col("mapping_qid") != F.col("qid"), "mapping_review_qid_mismatch")
        .when(~F.col("mapping_common").eqNullSafe(F.col("common")), "mapping_review_name_mismatch")
    )
    return rows.withColumn("code", code)


def identity_warnings(checked: DataFrame) -> DataFrame:
    """Distinct warnings: missing_mapping by name, name mismatches with both names."""
    missing = checked.filter("code = 'missing_mapping'").select("code", "botanic", F.lit(None).cast("string").alias("mapping_common"), F.lit(None).cast("string").alias("common"))
    other = checked.filter("code = 'mapping_review_name_mismatch'").select("code", "botanic", "mapping_common", "common")
    return missing.unionByName(other).distinct()


def identity_issues(checked: DataFrame) -> DataFrame:
    """Issues that differ in more than their line, each with its first line."""
    rows = checked.filter("code in ('invalid_qid', 'mapping_review_qid_mismatch')")
    seen = F.when(F.col("code") == "mapping_review_qid_mismatch", F.col("mapping_qid")).alias("mapping_qid")
    return rows.groupBy("code", "botanic", "qid", seen).agg(F.min("line").alias("line"))


def attribute_drift(review: DataFrame, config: DataFrame) -> DataFrame:
    """Importable properties whose configured name differs from the review's; once a pair of names, with the first line."""
    named = with_attribute_names(config).filter("importable and attribute_name is not null").select("property_id", F.col("attribute_name").alias("configured"))
    off = review.join(named, "property_id").filter(F.col("configured") != F.col("attribute_name"))
    return off.groupBy("property_id", "configured", "attribute_name").agg(F.min("line").alias("line"))


def classify_values(review: DataFrame, config: DataFrame, targets: DataFrame, species: DataFrame) -> DataFrame:
    """Review rows with reason (null: accepted): missing_mapping, no_cadastre_tree_type, property_not_importable,
    missing_attribute_name, duplicate_value, in this order.

    Only accepted rows count for duplicates, so the last reason is a first-wins aggregate over rows without another one, joined
    back by line; a value that a third of all rows repeat is combined before it is shuffled.
    """
    named = with_attribute_names(config).select("property_id", "importable", F.col("attribute_name").alias("attribute"))
    rows = review.withColumn("key", canonical())
    rows = rows.join(targets.select("key").distinct().withColumn("mapped", F.lit(True)), "key", "left")
    rows = rows.join(species.select("key").distinct().withColumn("planted", F.lit(True)), "key", "left").join(named, "property_id", "left")
    reason = (
        F.when(F.col("mapped").isNull(), "missing_mapping").when(F.col("planted").isNull(), "no_cadastre_tree_type")
        .when(~F.coalesce("importable", F.lit(False)), "property_not_importable").when(F.col("attribute").isNull(), "missing_attribute_name")
    )
    # a table, as it is read for the first rows and for all rows
    rows = stored(rows.select("line", "botanic", "property_id", "value", "key", "attribute", reason.alias("reason")))
    first = rows.filter("reason is null").groupBy("key", "attribute", "value").agg(F.min("line").alias("line")).select("line", F.lit(True).alias("first"))
    rows = rows.join(first, "line", "left")
    again = F.when(F.col("reason").isNull() & F.col("first").isNull(), "duplicate_value").otherwise(F.col("reason"))
    return rows.select("line", "botanic", "property_id", "value", again.alias("reason"))


def skip_counts(classified: DataFrame) -> DataFrame:
    return classified.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


class Plan(Mapping):
    """Named frames, each made when it is first asked for. Those that others are made from are stored then, so that no two make them anew."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], shared: tuple[str, ...]):
        self._makers, self._shared, self._made = makers, shared, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            made = self._makers[name]()
            self._made[name] = stored(made) if name in self._shared else made
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def build(config: DataFrame, mapping: DataFrame, review: DataFrame, cadastre: DataFrame) -> Plan:
    """The whole plan; nothing runs until a frame of it is asked for, and no table of the import is written."""
    p = Plan(
        {
            "classified": lambda: classify_mapping(mapping), "targets": lambda: mapping_targets(p["classified"]), "species": lambda: distinct_species(cadastre),
            "matched": lambda: match_species(p["species"], p["targets"])[0], "unmatched_species": lambda: match_species(p["species"], p["targets"])[1],
            "unmatched_mapping": lambda: match_species(p["species"], p["targets"])[2],
            "mapping_issues": lambda: mapping_issues(p["classified"]), "mapping_warnings": lambda: p["classified"].filter("code = 'blank_mapping_qid'").select("code", "line"),
            "checked": lambda: check_identity(review, p["targets"]), "identity_issues": lambda: identity_issues(p["checked"]), "identity_warnings": lambda: identity_warnings(p["checked"]),
            "drift": lambda: attribute_drift(review, config), "attributes": lambda: attribute_defs(config, review), "key_issues": lambda: attribute_key_issues(p["attributes"]),
            "type_warnings": lambda: datatype_warnings(p["attributes"]), "values": lambda: classify_values(review, config, p["targets"], p["species"]),
        },
        ("classified", "targets", "species", "attributes", "values"),
    )
    return p


class PlanRejected(ValueError):
    """A plan with issues: `issues` is the frame of all of them; the message lists every one, by code."""

    def __init__(self, issues: DataFrame):
        self.issues = issues
        lines = issues.orderBy("code", "line", "subject").select(F.format_string("- %s: %s", "code", "text").alias("text")).toLocalIterator()
        super().__init__("\n".join(r.text for r in lines))


def issues(plan: Plan) -> DataFrame:
    """Every issue of a plan: those of the mapping, of the review's identities, of its attribute names and of attribute keys.

    code, line (the first one where several rows say the same), subject (what it is about) and text.
    """
    row = lambda df, code, line, subject, text: df.select(code.alias("code"), line.cast("long").alias("line"), subject.alias("subject"), text.alias("text"))
    code, line, say = F.col("code"), F.col("line"), lambda form, *c: F.format_string(form, *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    drift = plan["drift"].withColumn("code", F.lit("config_review_attribute_mismatch"))
    keys = plan["key_issues"].select(F.lit("duplicate_attribute_key").alias("code"), F.lit(None).alias("line"), "attribute_name", F.array_join("property_ids", ", ").alias("ids"))
    parts = [
        row(plan["mapping_issues"], code, line, F.col("botanic"), say("line %s, %s, %s", "line", "botanic", "qid")),
        row(plan["identity_issues"], code, line, F.col("botanic"), say("line %s, %s, %s", "line", "botanic", "qid")),
        row(drift, code, line, F.col("property_id"), say("line %s, %s, %s, %s", "line", "property_id", "configured", "attribute_name")),
        row(keys, code, line, F.col("attribute_name"), say("%s, %s", "attribute_name", "ids")),
    ]
    return reduce(DataFrame.unionByName, parts)


def gate(plan: Plan) -> Plan:
    """The plan, if it has no issue."""
    found = issues(plan)
    if not found.limit(1).isEmpty():
        raise PlanRejected(found)
    return plan


def outcome(plan: Plan, tree_types: DataFrame, attributes: DataFrame, values: DataFrame) -> dict[str, DataFrame]:
    """What the three tables hold once the plan is carried out; a dry run is to stop at the plan.

    tree_types (name_botanic, name, wikidata_id) and attributes (name, datatype, wikidata_id) are upserted by their first column. Of values
    (name_botanic, attribute, value) those of the plan's species and attributes are replaced by the plan's, those of others stay.
    """
    matched = plan["matched"].select("botanic", "qid")
    types = plan["species"].join(matched, "botanic", "left").select(F.col("botanic").alias("name_botanic"), F.col("common").alias("name"), F.col("qid").alias("wikidata_id"))
    defs = plan["attributes"].select(F.col("attribute_name").alias("name"), F.col("vocabulary").alias("datatype"), F.col("property_id").alias("wikidata_id"))
    accepted = plan["values"].filter("reason is null").withColumn("key", canonical())
    named = accepted.join(plan["species"].select("key", F.col("botanic").alias("name_botanic")), "key").join(plan["attributes"].select("property_id", F.col("attribute_name").alias("attribute")), "property_id")
    scopes = types.select("name_botanic"), defs.select(F.col("name").alias("attribute"))
    return {
        "tree_types": upsert(tree_types, types, ["name_botanic"]),
        "attributes": upsert(attributes, defs, ["name"]),
        "values": rewrite_scope(values, named.select("name_botanic", "attribute", "value"), *scopes),
    }


def run(plan: Plan, tables: dict[str, DataFrame], write: Callable[[str, DataFrame], None] | None = None, dry_run: bool = False) -> DataFrame:
    """The summary, with dry_run. Issues reject the plan in either mode; unless it is a dry run, each table's outcome is handed to `write`."""
    gate(plan)
    if not dry_run:
        for name, rows in outcome(plan, **tables).items():
            write(name, rows)
    return summary(plan).withColumn("dry_run", F.lit(dry_run))


def summary(plan: Plan) -> DataFrame:
    """One row of the seven counts."""
    values = plan["values"].groupBy(F.when(F.col("reason").isNull(), "n_values").otherwise("skipped_values").alias("name")).agg(F.count("*").alias("n"))
    for name, part in (("tree_types", "species"), ("matched", "matched"), ("unmatched_species", "unmatched_species"), ("unmatched_mapping", "unmatched_mapping"), ("attributes", "attributes")):
        values = values.unionByName(plan[part].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    names = ["n_values", "skipped_values", "tree_types", "matched", "unmatched_species", "unmatched_mapping", "attributes"]
    return values.agg(*[F.coalesce(F.sum(F.when(F.col("name") == x, F.col("n"))), F.lit(0)).alias(x) for x in names])


def warning_counts(plan: Plan) -> DataFrame:
    parts = [plan["mapping_warnings"].select("code"), plan["identity_warnings"].select("code"), plan["type_warnings"].select(F.lit("unknown_datatype").alias("code")), plan["unmatched_mapping"].select(F.lit("unmatched_mapping").alias("code"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("code").agg(F.count("*").alias("n"))


def species_details(plan: Plan) -> DataFrame:
    """Each species with its match and its counts of values and of skips by reason; counts go by the review's own spelling."""
    by = plan["values"].groupBy("botanic", "reason").agg(F.count("*").alias("n"))
    values = by.filter("reason is null").select("botanic", F.col("n").alias("value_count"))
    skips = by.filter("reason is not null").groupBy("botanic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("skips"))
    ids = plan["matched"].select("botanic", "qid")
    out = plan["species"].select("botanic").join(ids, "botanic", "left").join(values, "botanic", "left").join(skips, "botanic", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.select("botanic", F.when(F.col("qid").isNotNull(), "matched").otherwise("unmatched").alias("status"), "qid", F.coalesce("value_count", F.lit(0)).alias("value_count"), F.coalesce("skips", none).alias("skips"))


def attribute_details(plan: Plan) -> DataFrame:
    used = plan["values"].filter("reason is null").groupBy("property_id").agg(F.count("*").alias("value_count"))
    return plan["attributes"].select("property_id", "attribute_name", "vocabulary").join(used, "property_id", "left").withColumn("value_count", F.coalesce("value_count", F.lit(0)))


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Chunk number of each row in order, from 0, without bringing all rows to one task.

    Rows are numbered within ranges of their order, and the ranges by the sums of those before them: one row a range crosses over.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are sampled once: from here on each row's range stands in a table
    dealt = stored(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    local = dealt.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(order)))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(F.broadcast(before.select("__part", "__before")), "__part")  # one row a partition
    return out.withColumn("chunk", F.floor((F.col("__before") + F.col("__n") - 1) / size).cast("long")).drop("__part", "__n", "__before")


def _jumps(sizes: np.ndarray, budget: int, most: int) -> np.ndarray:
    """Where the next pack begins for a pack that begins at each place: a pack holds `most` ids and `budget` bytes at most, one id at least."""
    total = np.r_[0, np.cumsum(sizes)]
    return np.maximum(np.minimum(np.searchsorted(total, total[:-1] + budget, "right") - 1, np.arange(len(sizes)) + most), np.arange(len(sizes)) + 1)


def _outcomes(sizes: np.ndarray, budget: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """For a first pack that begins at each of the first `most` places: the packs that begin after it in the range, and the bytes and ids of the last."""
    n, jump = len(sizes), _jumps(sizes, budget, most)
    packs, last = np.zeros(n, np.int64), np.arange(n)
    for i in range(n - 1, -1, -1):
        if jump[i] < n:
            packs[i], last[i] = packs[jump[i]] + 1, last[jump[i]]
    behind = np.cumsum(sizes[::-1])[::-1]
    first = slice(0, most)
    return packs[first].tolist(), behind[last[first]].tolist(), (n - last[first]).tolist()


def _room(sizes: list[int], used: int, held: int, budget: int, most: int) -> int:
    """How many of the next ids go into a pack that holds so many bytes and ids already."""
    n = 0
    while n < len(sizes) and held and held < most and used + sizes[n] <= budget:
        used, held, n = used + sizes[n], held + 1, n + 1
    return n


def packs(ids: DataFrame, key: str, budget: int, most: int) -> DataFrame:
    """The distinct ids of column `key` as text, in order, with `pack`: from 0, each as full as `budget` bytes (ids percent-encoded, commas between
    them too) and `most` ids allow. Null ids, which no list can match, are left out; an id over the budget has a pack of its own.

    Greedy packing looks like one task's work. But where a range of the order has its first new pack, all that follows in it is settled; and
    that place is among its first `most` ids. So each range tells the outcome for each of these, the driver composes the outcomes (some hundred
    numbers a range), and the ranges number their packs side by side.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget += 3  # a comma for each id, so one too many
    rows = ids.select(F.col(key).cast("string").alias("id")).filter("id is not null").distinct().withColumn("n_bytes", F.octet_length(F.url_encode("id")) + 3)
    dealt = stored(rows.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    sized = dealt.groupBy("part")

    def tell(t: pa.Table) -> pa.Table:
        sizes = t.sort_by("id").column("n_bytes").to_numpy()
        n, used, held = _outcomes(sizes, budget, most)
        return pa.Table.from_pylist([{"part": t.column("part")[0].as_py(), "total": len(sizes), "sizes": sizes[:most].tolist(), "packs": n, "used": used, "held": held}], pa.schema([("part", pa.int32()), ("total", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("sizes", "packs", "used", "held")]]))

    told = sized.applyInArrow(tell, "part int, total long, sizes array<long>, packs array<long>, used array<long>, held array<long>").orderBy("part").collect()
    starts, number, used, held = {}, -1, 0, 0
    for r in told:
        room = _room(r.sizes, used, held, budget, most)
        starts[r.part] = (room, number)
        if room == r.total:  # all of it goes into the open pack
            used, held = used + sum(r.sizes[:room]), held + room
        else:
            number, used, held = number + 1 + r.packs[room], r.used[room], r.held[room]

    def give(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        room, number = starts[t.column("part")[0].as_py()]
        jump = _jumps(t.column("n_bytes").to_numpy(), budget, most)
        pack, at = np.full(t.num_rows, number, np.int64), room
        while at < t.num_rows:
            number += 1
            pack[at : jump[at]] = number
            at = jump[at]
        return pa.table({"id": t.column("id"), "n_bytes": t.column("n_bytes"), "pack": pa.array(pack)})

    return sized.applyInArrow(give, "id string, n_bytes int, pack long")


#: rows of either side that meet in one task (fixed values)
LEFT_BLOCK, RIGHT_BLOCK = 512, 256


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of left with every row of right, both stored tables. The pairs are many more than the rows, so they cross no shuffle: both sides are dealt
    into blocks, and a task makes the pairs of one block with another, so that its work stays the same however large the sides are."""
    n, m = left.count(), right.count()
    blocks = max(-(-n // LEFT_BLOCK), min(n, left.sparkSession.sparkContext.defaultParallelism), 1)
    return left.repartition(blocks).hint("shuffle_replicate_nl").crossJoin(right.repartition(max(-(-m // RIGHT_BLOCK), 1)))


def delete_requests(types: DataFrame, attributes: DataFrame, type_id: str, attribute_id: str, path: str, names: tuple[str, str], most_bytes: int = 7500, n_types: int = 100, n_attributes: int = 40) -> DataFrame:
    """The requests of a delete by both keys as (type_pack, attribute_pack, type_ids, attribute_ids, n_bytes, fits): every pack of types with every pack of
    attributes, one request each, as a scope is their product.

    A request's target is path?a=in.(ids)&b=in.(ids), percent-encoded, with `names` for a and b. Half of the bytes that most_bytes leaves is for either list, so that every
    request fits but those of an id that is itself too long: fits tells. Null ids are left out on both sides.
    """
    frame = len(path) + 1 + sum(len(f"{n}=in.%28%29") for n in names) + 1
    half = (most_bytes - frame) // 2

    def listed(df: DataFrame, key: str, most: int, name: str) -> DataFrame:
        own = packs(df, key, half, most).groupBy("pack").agg(F.sort_array(F.collect_list("id")).alias(f"{name}_ids"), (F.sum("n_bytes") - 3).alias(f"{name}_bytes"))
        return stored(own.withColumnRenamed("pack", f"{name}_pack"))

    left, right = listed(types, type_id, n_types, "type"), listed(attributes, attribute_id, n_attributes, "attribute")
    size = (F.col("type_bytes") + F.col("attribute_bytes") + frame).alias("n_bytes")
    return _pairs(left, right).select("type_pack", "attribute_pack", "type_ids", "attribute_ids", size, (size <= most_bytes).alias("fits"))


def chunk_pairs(types: DataFrame, attributes: DataFrame, type_id: str, attribute_id: str, n_types: int = 100, n_attributes: int = 40) -> DataFrame:
    """The requests of a delete by both keys: every chunk of types with every chunk of attributes, as type_chunk, attribute_chunk and the ids
    of each in order (at most n_types and n_attributes of them). Null ids, which no list can match, are left out on both sides. The chunks of both sides
    are stored while the frame is made; every pair is a request of its own."""

    def listed(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
        own = chunks(df.filter(F.col(key).isNotNull()).select(key).distinct(), key, size)
        return stored(own.groupBy(F.col("chunk").alias(f"{name}_chunk")).agg(F.sort_array(F.collect_list(key)).alias(f"{name}_ids")))

    return _pairs(listed(types, type_id, n_types, "type"), listed(attributes, attribute_id, n_attributes, "attribute"))
