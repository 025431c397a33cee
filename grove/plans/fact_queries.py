"""Queries of configuration, attribute values and triples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attributes as att
from ..operators import triples as tri
from ..sources.scratch import stored
from .adapters import frame, sql
from .identity_queries import CLASSIFIED, TARGETS, targets
from .string_queries import q_label, q_slug

Q, O = {}, {}


def config(s, d):
    return att.parse_config(frame(s, d, "cfg"))


def named(s, d):
    return att.with_attribute_names(config(s, d))


PARSED = """SELECT line, property_id, type, CASE WHEN action IN ('ignore', 'inline') THEN action ELSE 'keep' END AS action, description,
  CASE WHEN action = 'inline' THEN config ->> 'target' END AS inline_target, CASE WHEN action = 'inline' THEN coalesce(config ->> 'source', 'rdfs:label') END AS inline_source,
  CASE WHEN action = 'inline' THEN coalesce((config ->> 'keep_source') = 'true', false) END AS keep_source, import = 'skip' AS import_skip,
  CASE WHEN import NOT IN ('', 'skip') THEN import ->> 'group' END AS import_group, CASE WHEN import NOT IN ('', 'skip') THEN import ->> 'attribute_name' END AS import_name, CAST(NULL AS VARCHAR) AS code FROM cfg"""
NAMED = f"SELECT *, NOT import_skip AND action <> 'ignore' AS importable, coalesce(import_name, inline_target, CASE WHEN description <> '' THEN {q_slug(q_label('description'))} END) AS attribute_name FROM parsed"
CFG = {"parsed": PARSED, "named": NAMED}
Q["cfg_parse"] = config
O["cfg_parse"] = sql("cfg", "SELECT * FROM parsed", **CFG)
Q["cfg_attribute_names"] = lambda s, d: named(s, d).select("property_id", "attribute_name")
O["cfg_attribute_names"] = sql("cfg", "SELECT property_id, attribute_name FROM named", **CFG)
Q["cfg_importable"] = lambda s, d: frame(s, d, "rev").select("property_id").distinct().join(named(s, d), "property_id", "left").select("property_id", F.coalesce("importable", F.lit(False)).alias("importable"))
O["cfg_importable"] = sql("cfg rev", "SELECT property_id, coalesce(importable, false) AS importable FROM (SELECT DISTINCT property_id FROM rev) LEFT JOIN named USING (property_id)", **CFG)

WIDE = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
Q["eav_melt"] = lambda s, d: att.melt(frame(s, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])
O["eav_melt"] = " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM part" for c in WIDE[:4])
Q["eav_wide_join"] = lambda s, d: att.melt_joined(frame(s, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", ["p_name", "p_brand"], s.createDataFrame([("p_name", "names")], "attribute string, group_name string"))
O["eav_wide_join"] = "SELECT attribute, p_partkey, p_name, p_brand, value, CASE WHEN attribute = 'p_name' THEN 'names' END AS group_name FROM (SELECT *, 'p_name' AS attribute, p_name AS value FROM part UNION ALL SELECT *, 'p_brand', p_brand FROM part)"
GROUPS = "SELECT p_brand AS g, p_type AS a, min(p_name) AS x FROM part GROUP BY 1, 2"


def nested(s, d):
    """One map of maps: brand to type to a description."""
    inner = frame(s, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("x"))
    maps = inner.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "x"))).alias("m"))
    return maps.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "m"))).alias("groups"))


Q["eav_groups"] = lambda s, d: att.explode_groups(nested(s, d))
O["eav_groups"] = f"SELECT g AS group_name, a AS attribute, x AS description FROM ({GROUPS})"


def wide(s, d):
    listed = F.when(F.col("p_size") % 4 > 0, F.split("p_name", " ")).alias("words")
    return frame(s, d, "part").select("p_partkey", "p_brand", listed, (F.col("p_size") > 20).alias("large"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"))


VALUES = """SELECT p_partkey, 'p_brand' AS attribute, 'string' AS type, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'words', 'string', unnest(string_split(p_name, ' ')) FROM part WHERE p_size % 4 > 0
  UNION ALL SELECT p_partkey, 'large', 'boolean', CAST(p_size > 20 AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'size', 'number', CAST(p_size AS VARCHAR) FROM part WHERE p_size % 3 > 0"""
Q["eav_values"] = lambda s, d: att.values_as_text(wide(s, d), "p_partkey", ["p_brand", "words", "large", "size"])
O["eav_values"] = VALUES
Q["eav_explode"] = lambda s, d: wide(s, d).select("p_partkey", F.posexplode("words").alias("i", "word"))
O["eav_explode"] = "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS i, string_split(p_name, ' ')[i] AS word FROM (SELECT *, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i FROM part WHERE p_size % 4 > 0)"
Q["eav_types"] = lambda s, d: att.column_types(att.values_as_text(wide(s, d), "p_partkey", ["p_brand", "words", "large", "size"]), "p_partkey")
O["eav_types"] = f"SELECT attribute, min(type) AS type FROM ({VALUES}) GROUP BY attribute"
Q["eav_surrogate_keys"] = lambda s, d: att.with_surrogates(frame(s, d, "part").select("p_name", "p_brand").distinct(), ["p_name", "p_brand"], "id")
O["eav_surrogate_keys"] = "SELECT DISTINCT p_name, p_brand, sha256(p_name || '|' || p_brand) AS id FROM part"
Q["eav_must_match"] = lambda s, d: att.must_match(frame(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), frame(s, d, "customer").select("c_custkey", "c_name"), "c_custkey")
O["eav_must_match"] = "SELECT c_custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"

WD, WDT, LABEL = tri.WD, tri.WDT, tri.LABEL
OWN = f"SELECT t.* FROM tri t WHERE s = '{WD}' || entity AND (p = '{LABEL}' OR (starts_with(p, '{WDT}') AND replace(p, '{WDT}', '') NOT IN (SELECT property_id FROM parsed WHERE action = 'ignore')))"


def q_pref(source, chain, keys="entity, s", predicate=LABEL):
    place = "CASE coalesce(o_lang, 'plain') " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(tri.CHAINS[chain])) + " END"
    return f"SELECT {keys}, o_value AS label, o_lang AS label_lang FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {place}, o_value) AS n FROM {source} WHERE p = '{predicate}' AND o_kind = 'literal' AND {place} IS NOT NULL) WHERE n = 1"


INLINED = f"""SELECT entity, s, p, o_kind, o_value, o_lang FROM joined WHERE NOT coalesce(hit AND NOT keep_source, false)
  UNION SELECT entity, s, '{tri.NS}' || inline_target, 'literal', label, label_lang FROM joined WHERE hit"""
JOINED = f"""SELECT o.*, c.inline_target, c.keep_source, l.label, l.label_lang, c.inline_target IS NOT NULL AND o.o_kind = 'iri' AND l.label IS NOT NULL AS hit
  FROM own o LEFT JOIN parsed c ON c.inline_target IS NOT NULL AND o.p = '{WDT}' || c.property_id LEFT JOIN pref l ON l.entity = o.entity AND l.s = o.o_value"""
CLOSED = f"SELECT * FROM inlined UNION SELECT t.* FROM tri t JOIN (SELECT DISTINCT entity, o_value FROM inlined WHERE o_kind = 'iri' AND starts_with(o_value, '{WD}')) l ON l.entity = t.entity AND l.o_value = t.s"
DONE = "SELECT * FROM closed WHERE o_lang IS NULL OR o_lang IN ('de', 'en')"
TRI = CFG | {"own": OWN, "pref": q_pref("tri", "inline"), "joined": JOINED, "inlined": INLINED, "closed": CLOSED, "done": DONE}


def raw(s, d):
    """The facts as a table, as an ingest leaves them; the view itself is a union of distinct rows that would run at each use."""
    return stored(frame(s, d, "tri"))


def own(s, d):
    return tri.main_facts(raw(s, d), config(s, d).filter("action = 'ignore'"))


def inlined(s, d):
    return tri.inline_labels(frame(s, d, "tri"), config(s, d))


def closed(s, d):
    return tri.closure(raw(s, d), config(s, d).filter("action = 'ignore'"))


def labels(s, d):
    facts = raw(s, d)
    export = tri.preferred_labels(facts, "export").select("entity", "s", F.col("label").alias("export_label"))
    return tri.preferred_labels(facts, "inline").join(export, ["entity", "s"], "left")


def exported(s, d):
    """Only what the mapping's targets export is processed: an entity's facts are told by its own graph. Targets are read twice, so they are stored."""
    wanted = stored(targets(s, d))
    return tri.export(wanted, tri.process(tri.of_entities(frame(s, d, "tri"), wanted), config(s, d)), named(s, d))


def processed(s, d):
    """Processed facts for who reads them once: what is not asked for need not be made."""
    return tri.process(raw(s, d), config(s, d))


Q["tri_main"] = own
O["tri_main"] = sql("cfg tri", "SELECT * FROM own", **CFG, own=OWN)
Q["tri_language"] = lambda s, d: tri.german_or_english(frame(s, d, "tri"))
O["tri_language"] = sql("tri", "SELECT * FROM tri WHERE o_lang IS NULL OR o_lang IN ('de', 'en')")
Q["tri_labels"] = labels
O["tri_labels"] = sql("tri", "SELECT a.*, b.label AS export_label FROM a LEFT JOIN b USING (entity, s)", a=q_pref("tri", "inline"), b=q_pref("tri", "export"))
Q["tri_inline"] = inlined
O["tri_inline"] = sql("cfg tri", "SELECT * FROM inlined", **TRI)
Q["tri_closure"] = closed
O["tri_closure"] = sql("cfg tri", CLOSED.replace("inlined", "own"), **CFG, own=OWN)
Q["tri_multilang"] = lambda s, d: tri.resolved_literals(raw(s, d).filter("o_kind = 'literal'"), ["entity", "s", "p"])
O["tri_multilang"] = sql("tri", "SELECT entity, s, p, o_kind, o_value, o_lang FROM (SELECT *, bool_or(coalesce(o_lang, '') = 'de') OVER (PARTITION BY entity, s, p) AS g FROM tri WHERE o_kind = 'literal') WHERE o_lang IS NULL OR o_lang = CASE WHEN g THEN 'de' ELSE 'en' END")
Q["tri_process"] = lambda s, d: tri.process(frame(s, d, "tri"), config(s, d))  # facts are read once, so they are not stored
O["tri_process"] = sql("cfg tri", "SELECT * FROM done", **TRI)
EXPORT = f"""SELECT t.line, t.qid, t.botanic, t.common, v.property_id, coalesce(v.attribute_name, '') AS attribute_name, v.value, v.group_name FROM targets t JOIN (
  SELECT entity, property_id, attribute_name, group_name, o_value AS value FROM mine JOIN props ON inline_target IS NOT NULL AND p = '{tri.NS}' || inline_target
  UNION ALL SELECT entity, property_id, attribute_name, group_name, CASE WHEN starts_with(o_value, '{WD}') THEN label ELSE o_value END FROM direct LEFT JOIN elabel USING (entity, o_value) WHERE o_kind = 'iri' AND (label IS NOT NULL OR NOT starts_with(o_value, '{WD}'))
  UNION ALL SELECT entity, property_id, attribute_name, group_name, o_value FROM (SELECT *, bool_or(coalesce(o_lang, '') = 'de') OVER (PARTITION BY entity, property_id) AS g FROM direct WHERE o_kind = 'literal') WHERE o_lang IS NULL OR o_lang = CASE WHEN g THEN 'de' ELSE 'en' END
  ) v ON v.entity = t.qid"""
EXP = TRI | {
    "props": "SELECT property_id, inline_target, attribute_name, coalesce(import_group, '') AS group_name FROM named WHERE importable",
    "mine": f"SELECT * FROM done WHERE s = '{WD}' || entity",
    "direct": f"SELECT mine.*, property_id, attribute_name, group_name FROM mine JOIN props ON inline_target IS NULL AND p = '{WDT}' || property_id",
    "elabel": f"SELECT entity, s AS o_value, label FROM ({q_pref('done', 'export')})",
    "classified": CLASSIFIED, "targets": TARGETS,
}
Q["tri_export"] = exported
O["tri_export"] = sql("cfg tri map", EXPORT, **EXP)


def vocabulary(s, d):
    """Descriptions of some properties, from the suppliers: a type, labels, texts."""
    return s.sql(VOCAB.format(t=f"parquet.`{d}/supplier.parquet`"))


VOCAB = f"""SELECT DISTINCT * FROM (
  SELECT '{WD}P' || CAST(s_suppkey % 90 AS STRING) AS s, '{tri.PROPERTY_TYPE}' AS p, 'iri' AS o_kind, '{tri.ONTOLOGY}' || CASE s_suppkey % 90 % 3 WHEN 0 THEN 'WikibaseItem' WHEN 1 THEN 'ExternalId' ELSE 'String' END AS o_value, CAST(NULL AS STRING) AS o_lang FROM {{t}} WHERE s_suppkey % 90 % 5 > 0
  UNION ALL SELECT '{WD}P' || CAST(s_suppkey % 90 AS STRING), '{LABEL}', 'literal', 'Große Höhe ' || CAST(s_suppkey % 90 AS STRING), CASE s_suppkey % 90 % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END FROM {{t}}
  UNION ALL SELECT '{WD}P' || CAST(s_suppkey % 90 AS STRING), '{tri.DESCRIPTION}', 'literal', 'text ' || CAST(s_suppkey % 90 AS STRING), CASE s_suppkey % 90 % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END FROM {{t}}
  UNION ALL SELECT 'http://elsewhere/' || CAST(s_suppkey % 90 AS STRING), '{LABEL}', 'literal', 'other', 'de' FROM {{t}})"""
META = f"""SELECT replace(s, '{WD}', '') AS property_id, coalesce(k.type, '') AS type, l.label, concat_ws(' – ', l.label, x.label) AS description
  FROM (SELECT DISTINCT s FROM voc WHERE starts_with(s, '{WD}')) LEFT JOIN (SELECT s, min(replace(o_value, '{tri.ONTOLOGY}', '')) AS type FROM voc WHERE p = '{tri.PROPERTY_TYPE}' GROUP BY s) k USING (s)
  LEFT JOIN ({q_pref('voc', 'metadata', 's')}) l USING (s) LEFT JOIN ({q_pref('voc', 'description', 's', tri.DESCRIPTION)}) x USING (s)"""
MET = {"voc": VOCAB.format(t="supplier"), "meta": META}
Q["tri_metadata"] = lambda s, d: tri.property_metadata(vocabulary(s, d))
O["tri_metadata"] = sql("", "SELECT * FROM meta", **MET)
Q["tri_new_properties"] = lambda s, d: tri.new_properties(raw(s, d), config(s, d), tri.property_metadata(vocabulary(s, d)))
O["tri_new_properties"] = sql("cfg tri", f"""SELECT property_id, coalesce(type, '') AS type, CASE WHEN type = 'WikibaseItem' THEN 'inline' ELSE '' END AS action,
  CASE WHEN type = 'WikibaseItem' THEN '{{"target": "' || coalesce({q_slug('label')}, lower(property_id)) || '", "keep_source": true}}' ELSE '' END AS config, coalesce(description, '') AS description, CASE WHEN type = 'ExternalId' THEN 'skip' ELSE '' END AS import
  FROM (SELECT DISTINCT replace(p, '{WDT}', '') AS property_id FROM tri WHERE starts_with(p, '{WDT}')) LEFT JOIN meta USING (property_id) WHERE property_id NOT IN (SELECT property_id FROM cfg)""", **MET)
Q["tri_vocab"] = lambda s, d: tri.vocabulary_iris(processed(s, d), config(s, d))
O["tri_vocab"] = sql("cfg tri", f"SELECT replace(p, '{WDT}', '{WD}') AS iri FROM done WHERE starts_with(p, '{WDT}') UNION SELECT '{WD}' || property_id FROM parsed WHERE inline_target IS NOT NULL UNION SELECT '{WD}' || inline_source FROM parsed WHERE regexp_full_match(inline_source, 'P\\d+')", **TRI)
Q["tri_vocab_labels"] = lambda s, d: tri.namespace_labels(processed(s, d), config(s, d))
O["tri_vocab_labels"] = sql("cfg tri", f"SELECT DISTINCT '{tri.NS}' || inline_target AS p, coalesce(nullif(description, ''), replace(inline_target, '_', ' ')) AS label FROM parsed WHERE '{tri.NS}' || inline_target IN (SELECT p FROM done)", **TRI)
