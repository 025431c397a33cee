"""Queries of import planning and of writes, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import planner
from ..sources import tables as tab
from ..sources import versions
from ..sources.scratch import shared_path
from .adapters import frame, sql
from .fact_queries import CFG, config
from .identity_queries import IDS
from .string_queries import q_norm

Q, O = {}, {}


def plan(s, d):
    return planner.build(config(s, d), *[frame(s, d, v) for v in ("map", "rev", "cad")])


def of(name, *columns):
    return lambda s, d: plan(s, d)[name].select(*columns) if columns else plan(s, d)[name]


ALL = "cfg map rev cad"
CHECKED = f"""SELECT r.*, t.qid AS mapping_qid, t.common AS mapping_common, CASE WHEN NOT regexp_full_match(r.qid, 'Q[1-9][0-9]*') THEN 'invalid_qid' WHEN t.qid IS NULL THEN 'missing_mapping'
  WHEN t.qid <> r.qid THEN 'mapping_review_qid_mismatch' WHEN t.common IS DISTINCT FROM r.common THEN 'mapping_review_name_mismatch' END AS code FROM (SELECT *, {q_norm('botanic')} AS key FROM rev) r LEFT JOIN targets t USING (key)"""
DEFS = """SELECT property_id, attribute_name, type, CASE type WHEN 'Quantity' THEN 'number' WHEN 'Url' THEN 'url' WHEN 'GeoShape' THEN 'geoshape' WHEN 'CommonsMedia' THEN CASE WHEN property_id = 'P989' THEN 'audio' ELSE 'image' END ELSE 'string' END AS vocabulary, first_line
  FROM (SELECT property_id, min(line) AS first_line FROM rev GROUP BY 1) JOIN named USING (property_id) WHERE importable AND attribute_name IS NOT NULL"""
REASONED = f"""SELECT r.line, r.botanic, r.property_id, r.value, key, c.attribute_name AS attribute, CASE WHEN key NOT IN (SELECT key FROM targets) THEN 'missing_mapping' WHEN key NOT IN (SELECT key FROM species) THEN 'no_cadastre_tree_type'
  WHEN NOT coalesce(importable, false) THEN 'property_not_importable' WHEN c.attribute_name IS NULL THEN 'missing_attribute_name' END AS reason FROM (SELECT *, {q_norm('botanic')} AS key FROM rev) r LEFT JOIN named c USING (property_id)"""
VALUES = """SELECT line, botanic, property_id, value, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, key, attribute, value ORDER BY line) > 1 THEN 'duplicate_value' ELSE reason END AS reason FROM reasoned"""
WARN = "SELECT DISTINCT code, botanic, CASE WHEN code <> 'missing_mapping' THEN mapping_common END AS mapping_common, CASE WHEN code <> 'missing_mapping' THEN common END AS common FROM checked WHERE code IN ('missing_mapping', 'mapping_review_name_mismatch')"
P = CFG | IDS | {"checked": CHECKED, "defs": DEFS, "reasoned": REASONED, "vals": VALUES, "warned": WARN}


def has(key, body):
    O[key] = sql(ALL, body, **P)


Q["plan_identity"] = lambda s, d: planner.check_identity(frame(s, d, "rev"), plan(s, d)["targets"]).select("line", "code")
has("plan_identity", "SELECT line, code FROM checked")
Q["plan_identity_issues"] = of("identity_issues")
has("plan_identity_issues", "SELECT code, botanic, qid, CASE WHEN code <> 'invalid_qid' THEN mapping_qid END AS mapping_qid, min(line) AS line FROM checked WHERE code IN ('invalid_qid', 'mapping_review_qid_mismatch') GROUP BY 1, 2, 3, 4")
Q["plan_identity_warnings"] = of("identity_warnings")
has("plan_identity_warnings", "SELECT * FROM warned")
Q["plan_attr_drift"] = of("drift")
has("plan_attr_drift", "SELECT property_id, c.attribute_name AS configured, r.attribute_name, min(r.line) AS line FROM rev r JOIN named c USING (property_id) WHERE importable AND c.attribute_name <> r.attribute_name GROUP BY 1, 2, 3")
Q["plan_attr_defs"] = of("attributes")
has("plan_attr_defs", "SELECT * FROM defs")
Q["plan_key_issues"] = of("key_issues")
has("plan_key_issues", "SELECT attribute_name, list(property_id ORDER BY first_line) AS property_ids FROM defs GROUP BY 1 HAVING count(*) > 1")
Q["plan_type_warnings"] = of("type_warnings")
has("plan_type_warnings", "SELECT property_id, type AS datatype FROM defs WHERE type IN ('ExternalId', 'Other')")
Q["plan_values"] = lambda s, d: plan(s, d)["values"].filter("reason is null").drop("reason")
has("plan_values", "SELECT line, botanic, property_id, value FROM vals WHERE reason IS NULL")
Q["plan_skips"] = lambda s, d: plan(s, d)["values"].filter("reason is not null").select("line", "botanic", "property_id", "reason")
has("plan_skips", "SELECT line, botanic, property_id, reason FROM vals WHERE reason IS NOT NULL")
Q["plan_skip_counts"] = lambda s, d: planner.skip_counts(plan(s, d)["values"])
has("plan_skip_counts", "SELECT reason, count(*) AS n FROM vals WHERE reason IS NOT NULL GROUP BY 1")
Q["plan_summary"] = lambda s, d: planner.summary(plan(s, d))
has("plan_summary", """SELECT (SELECT count(*) FROM vals WHERE reason IS NULL) AS n_values, (SELECT count(*) FROM vals WHERE reason IS NOT NULL) AS skipped_values, (SELECT count(*) FROM species) AS tree_types,
  (SELECT count(*) FROM species WHERE key IN (SELECT key FROM targets)) AS matched, (SELECT count(*) FROM species WHERE key NOT IN (SELECT key FROM targets)) AS unmatched_species,
  (SELECT count(*) FROM targets WHERE key NOT IN (SELECT key FROM species)) AS unmatched_mapping, (SELECT count(*) FROM defs) AS attributes""")
Q["plan_warning_counts"] = lambda s, d: planner.warning_counts(plan(s, d))
has("plan_warning_counts", "SELECT code, count(*) AS n FROM (SELECT code FROM classified WHERE code = 'blank_mapping_qid' UNION ALL SELECT code FROM warned UNION ALL SELECT 'unknown_datatype' FROM defs WHERE type IN ('ExternalId', 'Other') UNION ALL SELECT 'unmatched_mapping' FROM targets WHERE key NOT IN (SELECT key FROM species)) GROUP BY 1")
Q["plan_details"] = lambda s, d: planner.species_details(plan(s, d)).select("botanic", "status", "qid", "value_count", F.array_join(F.transform(F.map_entries("skips"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("skips"))
has("plan_details", """SELECT s.botanic, CASE WHEN t.qid IS NULL THEN 'unmatched' ELSE 'matched' END AS status, t.qid, coalesce(v.n, 0) AS value_count, coalesce(k.skips, '') AS skips FROM species s LEFT JOIN targets t USING (key)
  LEFT JOIN (SELECT botanic, count(*) AS n FROM vals WHERE reason IS NULL GROUP BY 1) v ON v.botanic = s.botanic
  LEFT JOIN (SELECT botanic, string_agg(reason || '=' || n, ',' ORDER BY reason) AS skips FROM (SELECT botanic, reason, count(*) AS n FROM vals WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1) k ON k.botanic = s.botanic""")
Q["plan_attribute_details"] = lambda s, d: planner.attribute_details(plan(s, d))
has("plan_attribute_details", "SELECT property_id, attribute_name, vocabulary, coalesce(n, 0) AS value_count FROM defs LEFT JOIN (SELECT property_id, count(*) AS n FROM vals WHERE reason IS NULL GROUP BY 1) USING (property_id)")

Q["plan_gate"] = lambda s, d: planner.issues(plan(s, d)).select("code", "line", "subject")
has("plan_gate", """SELECT code, CAST(line AS BIGINT) AS line, botanic AS subject FROM classified WHERE code IS NOT NULL AND code <> 'blank_mapping_qid'
  UNION ALL SELECT code, min(line), botanic FROM checked WHERE code IN ('invalid_qid', 'mapping_review_qid_mismatch') GROUP BY code, botanic, qid, CASE WHEN code <> 'invalid_qid' THEN mapping_qid END
  UNION ALL SELECT 'config_review_attribute_mismatch', min(r.line), property_id FROM rev r JOIN named c USING (property_id) WHERE importable AND c.attribute_name <> r.attribute_name GROUP BY property_id, c.attribute_name, r.attribute_name
  UNION ALL SELECT 'duplicate_attribute_key', NULL, attribute_name FROM defs GROUP BY attribute_name HAVING count(*) > 1""")


def imported(s, d):
    """What a plan leaves in tables that hold other rows as well."""
    part = frame(s, d, "part")
    before = part.select(F.col("p_name").alias("name_botanic"), F.lit("old").alias("name"), F.lit(None).cast("string").alias("wikidata_id")).distinct()
    defs = part.select(F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("name"), F.lit("old").alias("datatype"), F.lit("P0").alias("wikidata_id")).distinct()
    held = part.select(F.col("p_name").alias("name_botanic"), F.concat(F.lit("t"), (F.col("p_size") % 9).cast("string")).alias("attribute"), F.col("p_brand").alias("value"))
    out = planner.outcome(plan(s, d), before, defs, held)
    return reduce(lambda a, b: a.unionByName(b), [out[t].toDF("a", "b", "c").withColumn("tab", F.lit(t)) for t in ("tree_types", "attributes", "values")])


Q["plan_import"] = imported
has("plan_import", """SELECT s.botanic AS a, s.common AS b, t.qid AS c, 'tree_types' AS tab FROM species s LEFT JOIN targets t USING (key)
  UNION ALL SELECT DISTINCT p_name, 'old', NULL, 'tree_types' FROM part WHERE p_name NOT IN (SELECT botanic FROM species)
  UNION ALL SELECT attribute_name, vocabulary, property_id, 'attributes' FROM defs
  UNION ALL SELECT DISTINCT 't' || p_size, 'old', 'P0', 'attributes' FROM part WHERE 't' || p_size NOT IN (SELECT attribute_name FROM defs)
  UNION ALL SELECT s.botanic, f.attribute_name, v.value, 'values' FROM vals v JOIN (SELECT line, key FROM reasoned) r USING (line) JOIN species s USING (key) JOIN defs f USING (property_id) WHERE v.reason IS NULL
  UNION ALL SELECT p_name, 't' || (p_size % 9), p_brand, 'values' FROM part WHERE NOT (p_name IN (SELECT botanic FROM species) AND 't' || (p_size % 9) IN (SELECT attribute_name FROM defs))""")

CUST = lambda s, d: frame(s, d, "customer")


def _new(s, d):
    """Suppliers' names as new customers, on keys of which half are known."""
    return frame(s, d, "supplier").select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("c_acctbal"))


NEW = "SELECT s_suppkey * 30 AS c_custkey, s_name AS c_name, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS c_acctbal FROM supplier"
Q["up_merge"] = lambda s, d: tab.upsert(CUST(s, d).select("c_custkey", "c_name", "c_acctbal"), _new(s, d), ["c_custkey"])
O["up_merge"] = sql("", "SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN c.c_name ELSE n.c_name END AS c_name, CASE WHEN n.c_custkey IS NULL THEN c.c_acctbal ELSE n.c_acctbal END AS c_acctbal FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey", n=NEW)
Q["up_partial"] = lambda s, d: tab.upsert(CUST(s, d), _new(s, d), ["c_custkey"], owned=["c_acctbal"])
O["up_partial"] = sql("", "SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, c.c_name, c.c_nationkey, CASE WHEN n.c_custkey IS NULL THEN c.c_acctbal ELSE n.c_acctbal END AS c_acctbal, c.c_mktsegment FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey", n=NEW)


def _rewrite(s, d, *scopes):
    old = frame(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    new = old.limit(0).unionByName(frame(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("o_orderkey"), F.lit(-1).cast("long").alias("o_custkey"), F.col("n_name").alias("o_orderpriority")))
    return tab.rewrite_scope(old, new, *scopes)


FRESH = "SELECT CAST(n_nationkey AS BIGINT) AS o_orderkey, CAST(-1 AS BIGINT) AS o_custkey, n_name AS o_orderpriority FROM nation"
Q["up_rewrite"] = lambda s, d: _rewrite(s, d, CUST(s, d).filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), s.createDataFrame([("5-LOW",), ("1-URGENT",)], "o_orderpriority string"))
O["up_rewrite"] = f"SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderpriority IN ('5-LOW', '1-URGENT')) UNION ALL {FRESH}"
Q["up_delete_types"] = lambda s, d: _rewrite(s, d, CUST(s, d).filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")))
O["up_delete_types"] = f"SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') UNION ALL {FRESH}"
Q["up_chunks"] = lambda s, d: planner.chunks(frame(s, d, "orders").select("o_orderkey"), "o_orderkey", 500)
O["up_chunks"] = "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS BIGINT) AS chunk FROM orders"
Q["up_chunk_pairs"] = lambda s, d: planner.chunk_pairs(CUST(s, d), frame(s, d, "supplier"), "c_custkey", "s_suppkey")
LISTED = "SELECT n // {n} AS {x}_chunk, list(k ORDER BY k) AS {x}_ids FROM (SELECT {k} AS k, row_number() OVER (ORDER BY {k}) - 1 AS n FROM {t}) GROUP BY 1"
O["up_chunk_pairs"] = f"SELECT * FROM ({LISTED.format(n=100, x='type', k='c_custkey', t='customer')}), ({LISTED.format(n=40, x='attribute', k='s_suppkey', t='supplier')})"


def _merged(s, d, times=1):
    """Customers as a stored table, with the new rows of a few keys merged in; how many buckets were rewritten each time."""
    path = shared_path(s)
    versions.create(CUST(s, d).select("c_custkey", "c_name", "c_acctbal"), path, ["c_custkey"], 32)
    few = _new(s, d).filter("c_custkey <= 90")
    return path, [versions.merge(few, path)[1] for _ in range(times)]


def _merge_report(s, d):
    path, rewritten = _merged(s, d, 2)
    return s.createDataFrame([(i, n <= 4, n > 0, versions.latest(s, path).version) for i, n in enumerate(rewritten)], "run int, few boolean, any boolean, version long")


FEW = NEW + " WHERE s_suppkey * 30 <= 90"
Q["up_stored_merge"] = lambda s, d: versions.read(s, _merged(s, d)[0])
O["up_stored_merge"] = O["up_merge"].replace(NEW, FEW)
Q["up_stored_rerun"] = _merge_report
O["up_stored_rerun"] = "SELECT CAST(range AS INTEGER) AS run, true AS few, range = 0 AS any, CAST(1 AS BIGINT) AS version FROM range(2)"


def _stored_rewrite(s, d):
    path = shared_path(s)
    orders = frame(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    versions.create(orders, path, ["o_custkey"], 32)
    fresh = frame(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("o_orderkey"), F.lit(-1).cast("long").alias("o_custkey"), F.col("n_name").alias("o_orderpriority"))
    versions.rewrite(fresh, [CUST(s, d).filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), s.createDataFrame([("5-LOW",), ("1-URGENT",)], "o_orderpriority string")], path)
    return versions.read(s, path)


Q["up_stored_rewrite"] = _stored_rewrite
O["up_stored_rewrite"] = O["up_rewrite"]
NULLED = "SELECT CASE WHEN c_custkey % 7 > 0 THEN c_custkey END AS c_custkey FROM customer"
Q["up_chunk_nulls"] = lambda s, d: planner.chunk_pairs(CUST(s, d).select(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey")).alias("c_custkey")), frame(s, d, "supplier").select(F.when(F.col("s_suppkey") <= 40, F.col("s_suppkey")).alias("s_suppkey")), "c_custkey", "s_suppkey")
O["up_chunk_nulls"] = f"SELECT * FROM ({LISTED.format(n=100, x='type', k='c_custkey', t='(SELECT * FROM (' + NULLED + ') WHERE c_custkey IS NOT NULL)')}), ({LISTED.format(n=40, x='attribute', k='s_suppkey', t='(SELECT s_suppkey FROM supplier WHERE s_suppkey <= 40)')})"
#: ids of uneven lengths, a few null
PACKED = {"type": ("customer", "c_custkey % 50 > 0", "c_mktsegment || repeat('é#', CAST(c_custkey % 9 AS INT)) || c_custkey", 100), "attribute": ("supplier", "s_suppkey % 20 > 0", "repeat('a,', CAST(s_suppkey % 60 AS INT)) || s_suppkey", 40)}
PATH, NAMES = "/rest/v1/tree_type_attribute_values", ("tree_type_uuid", "tree_type_attribute_uuid")


def _requests(s, d):
    sides = [frame(s, d, t).select(F.expr(f"CASE WHEN {keep} THEN {text} END").alias("x")) for t, keep, text, _ in PACKED.values()]
    return planner.delete_requests(*sides, "x", "x", PATH, NAMES)


def _packs_sql(name: str) -> str:
    """Packs of one side: each begins where the one before it is full."""
    table, keep, text, most = PACKED[name]
    frame_bytes = len(PATH) + 2 + sum(len(f"{n}=in.%28%29") for n in NAMES)
    return f"""{name}_i AS (SELECT x, b, row_number() OVER (ORDER BY encode(x)) AS n, sum(b) OVER (ORDER BY encode(x)) AS t FROM (SELECT DISTINCT {text} AS x, octet_length(encode(url_encode({text}))) + 3 AS b FROM {table} WHERE {keep})),
  {name}_c AS (SELECT CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS pack
    UNION ALL SELECT min(x.n), min(c.pack) + 1 FROM {name}_c c JOIN {name}_i a ON a.n = c.n JOIN {name}_i x ON x.n > c.n AND (x.t - a.t + a.b > {(7500 - frame_bytes) // 2 + 3} OR x.n >= c.n + {most}) HAVING min(x.n) IS NOT NULL),
  {name}_p AS (SELECT pack AS {name}_pack, list(x ORDER BY n) AS {name}_ids, sum(b) - 3 AS {name}_bytes FROM (SELECT i.*, (SELECT max(c.pack) FROM {name}_c c WHERE c.n <= i.n) AS pack FROM {name}_i i) GROUP BY pack)"""


Q["up_requests"] = _requests
O["up_requests"] = f"""WITH RECURSIVE {_packs_sql('type')}, {_packs_sql('attribute')}
  SELECT type_pack, attribute_pack, type_ids, attribute_ids, CAST(type_bytes + attribute_bytes + {len(PATH) + 2 + sum(len(f'{n}=in.%28%29') for n in NAMES)} AS BIGINT) AS n_bytes, true AS fits FROM type_p, attribute_p"""
Q["up_constraints"] = lambda s, d: tab.violations(frame(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"), "l_tax"), ["l_orderkey", "l_linenumber"], ["l_tax"], (frame(s, d, "supplier").filter("s_acctbal > 0").select("s_suppkey"), "s_suppkey"))
O["up_constraints"] = "SELECT 'unique' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'not_null:l_tax', count(*) FROM lineitem WHERE l_tax IS NULL UNION ALL SELECT 'reference:s_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"
Q["up_foreign_keys"] = lambda s, d: tab.set_null(tab.cascade(frame(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), CUST(s, d).filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey"), s.createDataFrame([("5-LOW",)], "o_orderpriority string"), "o_orderpriority")
O["up_foreign_keys"] = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"
