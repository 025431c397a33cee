"""Queries of identity and reconciliation, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators import identity as idn
from ..operators import matching as mat
from .adapters import frame, sql
from .string_queries import q_authors, q_binomial, q_cultivar, q_expand, q_no_hybrid, q_no_infra, q_norm, q_parens

Q, O = {}, {}

CLASSIFIED = f"""SELECT m.*, CASE WHEN qid = '' THEN 'blank_mapping_qid' WHEN NOT ok THEN 'invalid_qid' WHEN line = first_line THEN NULL WHEN qid = first_qid THEN 'duplicate_mapping' ELSE 'conflicting_mapping_qids' END AS code
  FROM (SELECT *, min(line) FILTER (ok) OVER (PARTITION BY key) AS first_line, arg_min(qid, line) FILTER (ok) OVER (PARTITION BY key) AS first_qid
        FROM (SELECT *, {q_norm('botanic')} AS key, regexp_full_match(qid, 'Q[1-9][0-9]*') AS ok FROM map)) m"""
SPECIES = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM (SELECT *, {q_norm('botanic')} AS key FROM cad) WHERE key <> '') WHERE n = 1"
FIRSTS = f"SELECT *, first_value(botanic) OVER w AS kept, first_value(common) OVER w AS kept_common, row_number() OVER w AS n FROM (SELECT *, {q_norm('botanic')} AS key FROM cad) WHERE key <> '' WINDOW w AS (PARTITION BY key ORDER BY pos)"
TARGETS = "SELECT line, botanic, common, qid, key FROM classified WHERE code IS NULL"
IDS = {"classified": CLASSIFIED, "targets": TARGETS, "species": SPECIES}


def classified(s, d):
    return idn.classify_mapping(frame(s, d, "map"))


def species(s, d):
    return idn.distinct_species(frame(s, d, "cad"))


def targets(s, d):
    return idn.mapping_targets(classified(s, d))


Q["map_targets"] = targets
O["map_targets"] = sql("map", "SELECT * FROM targets", classified=CLASSIFIED, targets=TARGETS)
Q["map_issues"] = lambda s, d: idn.mapping_issues(classified(s, d))
ISSUES = "SELECT line, botanic, qid, code, CASE WHEN code <> 'invalid_qid' THEN first_line END AS first_line, CASE WHEN code <> 'invalid_qid' THEN first_qid END AS first_qid FROM classified WHERE code <> 'blank_mapping_qid'"
O["map_issues"] = sql("map", ISSUES, classified=CLASSIFIED)
Q["map_issue_text"] = lambda s, d: idn.issue_text(idn.mapping_issues(classified(s, d)))
O["map_issue_text"] = sql("map", f"SELECT line, printf('- %s: line %d, %s', code, line, botanic) AS text FROM ({ISSUES})", classified=CLASSIFIED)
Q["map_warnings"] = lambda s, d: idn.mapping_warnings(classified(s, d))
O["map_warnings"] = sql("map", "SELECT line, botanic, code FROM classified WHERE code = 'blank_mapping_qid'", classified=CLASSIFIED)
Q["map_warning_groups"] = lambda s, d: idn.mapping_warnings(classified(s, d)).groupBy("code").agg(idn.F.count("*").alias("n"), idn.F.min("line").alias("first_line"))
O["map_warning_groups"] = sql("map", "SELECT code, count(*) AS n, min(line) AS first_line FROM classified WHERE code = 'blank_mapping_qid' GROUP BY code", classified=CLASSIFIED)
Q["map_entities"] = lambda s, d: idn.mapping_entities(targets(s, d))
O["map_entities"] = sql("map", "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY line) AS n FROM targets) WHERE n = 1", classified=CLASSIFIED, targets=TARGETS)


def gated(s, d):
    """What building gives for the mapping as it is, and for it without the lines that have issues: all issues and nothing else, or its parts."""
    given = frame(s, d, "map")
    out = []
    for name, rows in (("given", given), ("mended", given.join(idn.mapping_issues(classified(s, d)).select("line"), "line", "left_anti").select(*given.columns))):
        try:
            parts = dict(zip(("target", "entity", "warning"), idn.build_mapping(rows), strict=True))
        except idn.MappingRejected as rejected:
            parts = {"issue": rejected.issues}
        out += [part.select(idn.F.lit(name).alias("mapping"), idn.F.lit(kind).alias("kind"), "line") for kind, part in parts.items()]
    return reduce(DataFrame.unionByName, out)


Q["map_gate"] = gated
BUILT = """SELECT 'target' AS kind, line FROM targets UNION ALL SELECT 'entity', min(line) FROM targets GROUP BY qid UNION ALL SELECT 'warning', line FROM classified WHERE code = 'blank_mapping_qid'"""
O["map_gate"] = sql("map", """SELECT 'mended' AS mapping, kind, line FROM built UNION ALL SELECT 'given', kind, line FROM built WHERE NOT EXISTS (SELECT 1 FROM issues)
  UNION ALL SELECT 'given', 'issue', line FROM issues""", classified=CLASSIFIED, targets=TARGETS, issues=ISSUES, built=BUILT)
Q["cad_species"] = species
O["cad_species"] = sql("cad", "SELECT * FROM species", species=SPECIES)
Q["cad_conflicts"] = lambda s, d: idn.name_conflicts(frame(s, d, "cad")).select("pos", "key", "common", "kept_common")
O["cad_conflicts"] = sql("cad", f"SELECT pos, key, common, kept_common FROM ({FIRSTS}) WHERE n > 1 AND common <> kept_common")
Q["cad_merges"] = lambda s, d: idn.spelling_merges(frame(s, d, "cad"))
O["cad_merges"] = sql("cad", f"SELECT DISTINCT kept, botanic AS merged FROM ({FIRSTS}) WHERE botanic <> kept")
Q["cad_matched"] = lambda s, d: idn.match_species(species(s, d), targets(s, d))[0].select("pos", "key", "qid")
O["cad_matched"] = sql("map cad", "SELECT pos, key, t.qid FROM species JOIN targets t USING (key)", **IDS)
Q["cad_unmatched"] = lambda s, d: idn.match_species(species(s, d), targets(s, d))[1].select("pos", "key")
O["cad_unmatched"] = sql("map cad", "SELECT pos, key FROM species WHERE key NOT IN (SELECT key FROM targets)", **IDS)
Q["map_unmatched"] = lambda s, d: idn.match_species(species(s, d), targets(s, d))[2].select("line", "key")
O["map_unmatched"] = sql("map cad", "SELECT line, key FROM targets WHERE key NOT IN (SELECT key FROM species)", **IDS)

LOOKUPS = {
    "exact": "SELECT botanic AS k, arg_max(qid, pos) AS qid, arg_max(botanic, pos) AS name FROM ref GROUP BY 1",
    "normed": f"SELECT {q_norm('botanic')} AS k, arg_min(qid, pos) AS qid, arg_min(botanic, pos) AS name FROM ref GROUP BY 1",
    "plain": f"SELECT {q_no_hybrid('botanic')} AS k, arg_min(qid, pos) AS qid, arg_min(botanic, pos) AS name FROM ref GROUP BY 1",
    "entry": "SELECT botanic AS k, arg_min(target, pos) AS target FROM syn GROUP BY 1",
    "b": f"SELECT *, {q_authors('botanic')} AS bare FROM ext",
    "b2": f"SELECT *, {q_norm('bare')} AS k3, {q_no_hybrid('bare')} AS k4, {q_norm(q_no_infra('bare'))} AS k5, {q_no_infra('bare')} AS f3, {q_cultivar('botanic')} AS f4 FROM b",
    "sy": "SELECT b2.*, coalesce(s1.target, s2.target, s3.target, s4.target) AS target FROM b2 LEFT JOIN entry s1 ON s1.k = botanic LEFT JOIN entry s2 ON s2.k = bare LEFT JOIN entry s3 ON s3.k = f3 LEFT JOIN entry s4 ON s4.k = f4",
    "sy1": f"SELECT *, {q_authors('target')} AS t_bare FROM sy",
    "sy2": f"SELECT *, {q_norm('t_bare')} AS t3, {q_no_hybrid('t_bare')} AS t4 FROM sy1",
    "br": rf"SELECT pos, i, {q_expand('g[i]', 'genus')} AS full_name FROM (SELECT *, unnest(generate_series(1, len(g))) AS i FROM (SELECT pos, regexp_split_to_array(botanic, '\s+')[1] AS genus, {q_parens('botanic')} AS g FROM ext WHERE contains(botanic, '(')))",
    "br1": f"SELECT pos, i, {q_authors('full_name')} AS c FROM br",
    "br2": f"SELECT *, {q_authors('c')} AS cb FROM br1 WHERE {q_binomial('c')}",
    "br3": f"SELECT *, {q_norm('cb')} AS c3, {q_no_hybrid('cb')} AS c4 FROM br2",
    "br4": "SELECT pos, arg_min(c, i) AS c, arg_min(qid, i) AS qid FROM (SELECT pos, i, c, CASE WHEN e.k IS NOT NULL THEN e.qid WHEN n.k IS NOT NULL THEN n.qid ELSE h.qid END AS qid FROM br3 LEFT JOIN exact e ON e.k = c LEFT JOIN normed n ON n.k = c3 LEFT JOIN plain h ON h.k = c4 WHERE coalesce(e.k, n.k, h.k) IS NOT NULL) GROUP BY pos",
    "hand": "SELECT botanic AS k, max(qid) AS qid FROM man GROUP BY 1",
    "matches": """SELECT x.pos, x.botanic, x.strain,
      CASE WHEN coalesce(x.qid, '') <> '' THEN 'existing' WHEN e1.k IS NOT NULL THEN 'exact' WHEN e2.k IS NOT NULL THEN 'author_stripped' WHEN n3.k IS NOT NULL THEN 'normalized' WHEN h4.k IS NOT NULL THEN 'hybrid_agnostic'
           WHEN n5.k IS NOT NULL THEN 'infraspecific_stripped' WHEN coalesce(te.k, tn.k, th.k) IS NOT NULL THEN 'synonym' WHEN br4.pos IS NOT NULL THEN 'parenthetical_synonym' WHEN hand.k IS NOT NULL THEN 'manual' END AS level,
      CASE WHEN coalesce(x.qid, '') <> '' THEN x.qid WHEN e1.k IS NOT NULL THEN e1.qid WHEN e2.k IS NOT NULL THEN e2.qid WHEN n3.k IS NOT NULL THEN n3.qid WHEN h4.k IS NOT NULL THEN h4.qid
           WHEN n5.k IS NOT NULL THEN n5.qid WHEN te.k IS NOT NULL THEN te.qid WHEN tn.k IS NOT NULL THEN tn.qid WHEN th.k IS NOT NULL THEN th.qid WHEN br4.pos IS NOT NULL THEN br4.qid ELSE hand.qid END AS match_qid,
      CASE WHEN coalesce(x.qid, '') <> '' THEN x.ref_botanic WHEN e1.k IS NOT NULL THEN e1.name WHEN e2.k IS NOT NULL THEN e2.name WHEN n3.k IS NOT NULL THEN n3.name WHEN h4.k IS NOT NULL THEN h4.name
           WHEN n5.k IS NOT NULL THEN n5.name WHEN coalesce(te.k, tn.k, th.k) IS NOT NULL THEN x.target WHEN br4.pos IS NOT NULL THEN br4.c END AS match_botanic
      FROM sy2 x LEFT JOIN exact e1 ON e1.k = x.botanic LEFT JOIN exact e2 ON e2.k = x.bare AND x.bare <> x.botanic LEFT JOIN normed n3 ON n3.k = x.k3 LEFT JOIN plain h4 ON h4.k = x.k4 LEFT JOIN normed n5 ON n5.k = x.k5
      LEFT JOIN exact te ON te.k = x.target LEFT JOIN normed tn ON tn.k = x.t3 LEFT JOIN plain th ON th.k = x.t4 LEFT JOIN br4 ON br4.pos = x.pos LEFT JOIN hand ON hand.k = x.botanic""",
}
ORDER = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(mat.LEVELS))


def matches(s, d):
    return mat.reconcile(*[frame(s, d, v) for v in ("ext", "ref", "syn", "man")])


Q["rec_matches"] = matches
O["rec_matches"] = sql("ext ref syn man", "SELECT * FROM matches", **LOOKUPS)
Q["rec_levels"] = lambda s, d: mat.level_report(matches(s, d))
O["rec_levels"] = sql("ext ref syn man", f"SELECT level, count(*) AS n, CASE level {ORDER} END AS place FROM matches WHERE level IS NOT NULL GROUP BY level", **LOOKUPS)
Q["rec_unmatched"] = lambda s, d: mat.unmatched(matches(s, d))
O["rec_unmatched"] = sql("ext ref syn man", "SELECT pos, botanic || CASE WHEN coalesce(strain, '') <> '' THEN ' [' || strain || ']' ELSE '' END AS label FROM matches WHERE level IS NULL", **LOOKUPS)
Q["rec_writeback"] = lambda s, d: mat.write_back(frame(s, d, "ext"), matches(s, d))
O["rec_writeback"] = sql("ext ref syn man", """SELECT x.pos, x.botanic, x.strain, coalesce(f.match_qid, x.qid) AS qid, coalesce(nullif(x.ref_botanic, ''), f.match_botanic, '') AS ref_botanic
  FROM ext x LEFT JOIN (SELECT botanic, coalesce(strain, '') AS strain, max(pos) AS pos FROM matches WHERE level IS NOT NULL GROUP BY 1, 2) l ON l.botanic = x.botanic AND l.strain = coalesce(x.strain, '')
  LEFT JOIN matches f ON f.pos = l.pos""", **LOOKUPS)
