"""Queries of the name and label functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import strings as st
from .adapters import frame, sql

Q, O = {}, {}


def q_quotes(x):
    return f"translate({x}, 'ʽ‘’`', '''''''''')"


def q_trim(x):
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def q_squeeze(x):
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def q_norm(x):
    return f"replace({q_squeeze(q_trim(f'lower({q_quotes(x)})'))}, ' ssp. ', ' subsp. ')"


def q_no_hybrid(x):
    bare = rf"string_split({q_squeeze(rf"regexp_replace({q_norm(x)}, '×\s*', '', 'g')")}, ' ')"
    return q_trim(f"array_to_string(list_filter({bare}, lambda t, i: NOT (t = 'x' AND i > 1 AND i < len({bare}))), ' ')")


def q_cultivar(x):
    return q_trim(rf"regexp_replace(regexp_replace(regexp_replace({q_quotes(x)}, '\s+''.*''$', '', 'g'), '(?i)\s+aggregat$', '', 'g'), '(?i)\s+(f\.|var\.)\s+\S+', '', 'g')")


def q_no_infra(x):
    return q_trim(rf"regexp_replace({x}, '(?i)\s+(subsp\.|ssp\.|var\.|f\.)\s+\S+', '', 'g')")


def q_tokens(x):
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def q_authors(x):
    pre = rf"regexp_replace({x}, '(\w)\(', '\1 (', 'g')"
    t = q_tokens(pre)
    h = f"(CASE WHEN len({t}) >= 3 AND {t}[2] IN ('×', 'x') THEN 3 ELSE 2 END)"
    rest = f"""list_reduce(list_transform({t}[{h} + 1:], lambda t: {{'k': [t], 'm': CAST(NULL AS VARCHAR)}}),
      lambda a, e: CASE WHEN a.m IS NOT NULL THEN {{'k': list_concat(a.k, [a.m, e.k[1]]), 'm': CAST(NULL AS VARCHAR)}}
        WHEN e.k[1] IN ('subsp.', 'ssp.', 'var.', 'f.', '×', 'x') THEN {{'k': a.k, 'm': e.k[1]}} ELSE a END, {{'k': CAST([] AS VARCHAR[]), 'm': CAST(NULL AS VARCHAR)}}).k"""
    return f"CASE WHEN len({t}) < 2 THEN {pre} ELSE array_to_string(list_concat({t}[1:{h}], {rest}), ' ') END"


def q_parens(x):
    state = lambda d, t, o: f"{{'d': {d}, 't': {t}, 'o': {o}}}"
    return f"""list_reduce(list_transform(string_split({x}, ''), lambda c: {state('CAST(0 AS INTEGER)', 'c', 'CAST([] AS VARCHAR[])')}),
      lambda a, e: CASE WHEN e.t = '(' THEN {state('a.d + 1', "CASE WHEN a.d = 0 THEN '' ELSE a.t || e.t END", 'a.o')}
        WHEN e.t = ')' AND a.d = 1 THEN {state('CAST(0 AS INTEGER)', "''", 'list_append(a.o, a.t)')}
        WHEN e.t = ')' AND a.d > 1 THEN {state('a.d - 1', 'a.t || e.t', 'a.o')}
        WHEN a.d > 0 THEN {state('a.d', 'a.t || e.t', 'a.o')} ELSE a END, {state('CAST(0 AS INTEGER)', "''", 'CAST([] AS VARCHAR[])')}).o"""


def q_expand(p, genus):
    return rf"CASE WHEN regexp_matches({p}, '^[A-Z]\.\s*') THEN {genus} || ' ' || regexp_replace({p}, '^[A-Z]\.\s*', '') ELSE {p} END"


def q_binomial(x):
    t = q_tokens(x)
    return f"coalesce(regexp_matches({t}[1], '^[A-Z][a-zA-ZäöüÄÖÜß]+$') AND regexp_matches({t}[2], '^([a-zäöüß]+|×|x)$'), false)"


def q_slug(x):
    spelled = f"replace(replace(replace(replace(lower({x}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
    return rf"regexp_replace(regexp_replace(regexp_replace({spelled}, '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '_', 'g'), '^_+|_+$', '', 'g')"


def q_label(x):
    return q_trim(f"string_split({x}, ' – ')[1]")


def of(view, columns):
    return lambda s, d: frame(s, d, view).select(*columns())


Q["str_normalize"] = of("cad", lambda: ["pos", st.normalize(F.col("botanic")).alias("canonical")])
O["str_normalize"] = sql("cad", f"SELECT pos, {q_norm('botanic')} AS canonical FROM cad")
Q["str_quotes"] = of("cad", lambda: ["pos", st.normalize_quotes(F.concat("botanic", F.lit("‘’ʽ`"))).alias("quoted")])
O["str_quotes"] = sql("cad", f"SELECT pos, {q_quotes("botanic || '‘’ʽ`'")} AS quoted FROM cad")
Q["str_remove_hybrid"] = of("ext", lambda: ["pos", st.remove_hybrid(F.col("botanic")).alias("bare")])
O["str_remove_hybrid"] = sql("ext", f"SELECT pos, {q_no_hybrid('botanic')} AS bare FROM ext")
Q["str_strip_cultivar"] = of("cad", lambda: ["pos", st.strip_cultivar(F.concat("botanic", F.when(F.col("pos") % 5 == 0, " Aggregat").when(F.col("pos") % 5 == 1, " f. alba Hort.").otherwise(""))).alias("bare")])
O["str_strip_cultivar"] = sql("cad", f"SELECT pos, {q_cultivar("(botanic || CASE WHEN pos % 5 = 0 THEN ' Aggregat' WHEN pos % 5 = 1 THEN ' f. alba Hort.' ELSE '' END)")} AS bare FROM cad")
Q["str_drop_infraspecific"] = of("ext", lambda: ["pos", st.drop_infraspecific(F.col("botanic")).alias("bare")])
O["str_drop_infraspecific"] = sql("ext", f"SELECT pos, {q_no_infra('botanic')} AS bare FROM ext")
Q["str_strip_authors"] = of("ext", lambda: ["pos", st.strip_authors(F.col("botanic")).alias("bare")])
O["str_strip_authors"] = sql("ext", f"SELECT pos, {q_authors('botanic')} AS bare FROM ext")
Q["str_top_parens"] = of("ext", lambda: ["pos", st.top_level_parens(F.col("botanic")).alias("groups")])
O["str_top_parens"] = sql("ext", f"SELECT pos, {q_parens('botanic')} AS groups FROM ext")
Q["str_expand_genus"] = lambda s, d: frame(s, d, "ext").select("pos", F.posexplode(st.top_level_parens(F.col("botanic"))).alias("i", "g"), F.element_at(F.split("botanic", r"\s+"), 1).alias("genus")).select("pos", "i", st.expand_genus(F.col("g"), F.col("genus")).alias("full_name"))
O["str_expand_genus"] = sql("ext", rf"SELECT pos, CAST(i - 1 AS INTEGER) AS i, {q_expand('g[i]', 'genus')} AS full_name FROM (SELECT *, unnest(generate_series(1, len(g))) AS i FROM (SELECT pos, regexp_split_to_array(botanic, '\s+')[1] AS genus, {q_parens('botanic')} AS g FROM ext))")
Q["str_binomial"] = of("ext", lambda: ["pos", st.binomial_like(F.col("botanic")).alias("binomial")])
O["str_binomial"] = sql("ext", f"SELECT pos, {q_binomial('botanic')} AS binomial FROM ext")
Q["str_slug"] = of("cfg", lambda: ["property_id", st.slug(F.col("description")).alias("slug")])
O["str_slug"] = sql("cfg", f"SELECT property_id, {q_slug('description')} AS slug FROM cfg")
Q["str_label"] = of("cfg", lambda: ["property_id", st.description_label(F.col("description")).alias("label"), st.build_description(F.nullif("description", F.lit("")), F.nullif("type", F.lit("Url"))).alias("both"), st.humanize(F.lit("a_b_c")).alias("human")])
O["str_label"] = sql("cfg", f"SELECT property_id, {q_label('description')} AS label, concat_ws(' – ', nullif(description, ''), nullif(type, 'Url')) AS \"both\", replace('a_b_c', '_', ' ') AS human FROM cfg")
Q["str_qid_valid"] = of("map", lambda: ["line", "qid", st.valid_entity_id(F.col("qid")).alias("valid")])
O["str_qid_valid"] = sql("map", "SELECT line, qid, regexp_full_match(qid, 'Q[1-9][0-9]*') AS valid FROM map")
Q["str_value_type"] = lambda s, d: frame(s, d, "cfg").select("property_id", scalars.vocabulary_type(F.col("type"), F.col("property_id")).alias("vocabulary"), scalars.known_datatype(F.col("type")).alias("known"), scalars.value_type(F.col("line") % 4 == 0, F.col("line") % 4 == 1, F.col("line") % 2 == 0).alias("kind"), F.when(F.col("line") % 4 == 0, (F.col("line") > 9).cast("string")).when(F.col("line") % 4 == 1, F.array_join(F.array("type", "property_id"), ", ")).otherwise(F.col("line").cast("string")).alias("as_text"))
O["str_value_type"] = sql("cfg", """SELECT property_id, CASE type WHEN 'Quantity' THEN 'number' WHEN 'Url' THEN 'url' WHEN 'GeoShape' THEN 'geoshape' WHEN 'CommonsMedia' THEN CASE WHEN property_id = 'P989' THEN 'audio' ELSE 'image' END ELSE 'string' END AS vocabulary,
  type NOT IN ('ExternalId', 'Other') AS known, CASE line % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'string' WHEN 2 THEN 'number' ELSE 'string' END AS kind,
  CASE line % 4 WHEN 0 THEN CAST(line > 9 AS VARCHAR) WHEN 1 THEN type || ', ' || property_id ELSE CAST(line AS VARCHAR) END AS as_text FROM cfg""")
Q["str_tristate"] = lambda s, d: frame(s, d, "part").select("p_partkey", scalars_tri().alias("state"))
O["str_tristate"] = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS state FROM part"


def scalars_tri():
    text = F.when(F.col("p_partkey") % 3 == 0, "Ja").when(F.col("p_partkey") % 3 == 1, "Nein").otherwise("keine Information")
    return st.tri_state(text, "Ja", "Nein")


Q["str_split_list"] = lambda s, d: frame(s, d, "part").select("p_partkey", F.explode(F.split(F.concat_ws(", ", "p_name", "p_brand", "p_type"), ", ")).alias("item"))
O["str_split_list"] = "SELECT p_partkey, unnest(string_split(p_name || ', ' || p_brand || ', ' || p_type, ', ')) AS item FROM part"
Q["str_list_punct"] = lambda s, d: frame(s, d, "part").select("p_partkey", st.list_without_brackets(F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_brand", F.lit("']")), 12).alias("bare"), F.element_at(F.split(F.replace(F.concat(F.lit("http://h/640/"), "p_brand", F.lit(".jpg")), F.lit("/640/"), F.lit("/1024/")), "/"), -1).alias("file"), F.replace(F.concat(F.lit("Sorte: "), "p_name"), F.lit("Sorte: ")).alias("strain"))
O["str_list_punct"] = "SELECT p_partkey, substr(p_name || ', ' || p_brand, 1, 12) AS bare, p_brand || '.jpg' AS file, p_name AS strain FROM part"
Q["str_iri_ids"] = lambda s, d: frame(s, d, "tri").select("p").distinct().select("p", st.local_id(F.col("p"), "http://www.wikidata.org/prop/direct/").alias("id"), st.swap_prefix(F.col("p"), "http://www.wikidata.org/prop/direct/", "http://www.wikidata.org/entity/").alias("described"))
O["str_iri_ids"] = sql("tri", "SELECT DISTINCT p, replace(p, 'http://www.wikidata.org/prop/direct/', '') AS id, replace(p, 'http://www.wikidata.org/prop/direct/', 'http://www.wikidata.org/entity/') AS described FROM tri")
Q["csv_escape"] = lambda s, d: frame(s, d, "documents").select("doc_id", st.csv_field(F.col("text")).alias("field"))
O["csv_escape"] = "SELECT doc_id, CASE WHEN contains(text, ';') OR contains(text, '\"') OR contains(text, chr(10)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM documents"
Q["up_request_bytes"] = lambda s, d: frame(s, d, "customer").select("c_custkey", st.request_bytes("/rest/v1/values", name=F.col("c_name"), segment=F.concat("c_mktsegment", F.lit(" é,"))).cast("long").alias("n_bytes"))
O["up_request_bytes"] = "SELECT c_custkey, CAST(octet_length(encode('/rest/v1/values?name=' || replace(c_name, '#', '%23') || '&segment=' || c_mktsegment || '+%C3%A9%2C')) AS BIGINT) AS n_bytes FROM customer"

Q["str_paths"] = lambda s, d: frame(s, d, "part").select(
    "p_partkey",
    st.without(F.concat(F.lit(" Sorte: "), "p_name", F.lit(" ")), "Sorte: ").alias("strain"),
    st.rewritten(F.concat(F.lit("img/640/"), "p_brand", F.lit("/a.jpg")), "/640/", "/1024/").alias("large"),
    st.base_name(F.concat(F.lit("img/640/"), "p_brand", F.lit(".jpg"))).alias("file"),
    st.base_name(F.col("p_type")).alias("bare"),
)
O["str_paths"] = "SELECT p_partkey, p_name AS strain, 'img/1024/' || p_brand || '/a.jpg' AS large, p_brand || '.jpg' AS file, string_split(p_type, '/')[-1] AS bare FROM part"
