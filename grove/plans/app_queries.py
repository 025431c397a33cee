"""Queries of activity, messages, sources, sinks and plain relations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import activity as act
from ..operators import geo
from ..operators import relations as rel
from ..sources import delimited, geojson, markup
from ..sources.scratch import shared_path, stored
from ..streaming import activity as live
from .adapters import frame, sql

Q, O = {}, {}
t = frame

ADOPTED = "SELECT tree, user_id FROM adopt GROUP BY 1, 2 HAVING count(*) % 2 = 1"
Q["act_toggle"] = lambda s, d: act.adopted(t(s, d, "adopt"))
O["act_toggle"] = sql("adopt", ADOPTED)
Q["act_toggle_one"] = lambda s, d: act.toggle(act.toggle(act.adopted(t(s, d, "adopt")), 3, -5), 7, 11)
O["act_toggle_one"] = sql("adopt", "SELECT * FROM a WHERE NOT (tree = 7 AND user_id = 11) UNION ALL SELECT 3, -5 UNION ALL SELECT 7, 11 WHERE NOT EXISTS (SELECT 1 FROM a WHERE tree = 7 AND user_id = 11)", a=ADOPTED)
TREES = "SELECT p_partkey AS tree, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS species FROM part WHERE p_partkey % 5 > 0"


def trees(s, d):
    return t(s, d, "part").filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("tree"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_name")).alias("species"))


Q["act_adopted"] = lambda s, d: act.with_species(act.adopted(t(s, d, "adopt")), trees(s, d))
O["act_adopted"] = sql("adopt", f"SELECT tree, user_id, coalesce(nullif(species, ''), 'Unbekannt') AS species FROM ({ADOPTED}) LEFT JOIN ({TREES}) USING (tree)")
Q["act_owner_delete"] = lambda s, d: act.delete_own(t(s, d, "wat"), t(s, d, "wat").filter("amount < 10").select("id"), 7)
O["act_owner_delete"] = sql("wat", "SELECT * FROM wat WHERE NOT coalesce(amount < 10 AND user_id = 7, false)")
Q["act_by_tree"] = lambda s, d: act.latest_first(t(s, d, "wat"), "tree", 8)
O["act_by_tree"] = sql("wat", "SELECT * FROM wat WHERE tree = 8")
Q["act_by_user"] = lambda s, d: act.latest_first(t(s, d, "wat"), "user_id", 7).join(trees(s, d), "tree", "left")
O["act_by_user"] = sql("wat", f"SELECT wat.*, species FROM wat LEFT JOIN ({TREES}) USING (tree) WHERE user_id = 7")
Q["act_labels"] = lambda s, d: t(s, d, "wat").select("id", scalars.viewer_label(F.col("user_id"), F.lit(7)).alias("who"))
O["act_labels"] = sql("wat", "SELECT id, CASE WHEN user_id = 7 THEN 'Du' ELSE 'anonym' END AS who FROM wat")
Q["act_classes"] = lambda s, d: t(s, d, "wat").select("id", scalars.amount_class(F.col("amount")).alias("class"))
O["act_classes"] = sql("wat", "SELECT id, CASE WHEN amount >= 40 THEN 'flood' WHEN amount >= 20 THEN 'bucket' WHEN amount >= 5 THEN 'can' ELSE 'drop' END AS class FROM wat")
Q["act_validate"] = lambda s, d: t(s, d, "wat").filter(act.valid_watering(F.col("amount"), F.col("watered_on"))).select("id", "amount")
O["act_validate"] = sql("wat", "SELECT id, amount FROM wat WHERE amount BETWEEN 1 AND 100")
Q["act_date"] = lambda s, d: t(s, d, "wat").select("id", scalars.german_date(F.col("watered_on")).alias("day"))
O["act_date"] = sql("wat", "SELECT id, strftime(watered_on, '%d.%m.%Y') AS day FROM wat")
Q["act_default_date"] = lambda s, d: t(s, d, "wat").select("id", F.coalesce(F.when(F.col("id") % 2 == 0, F.col("watered_on")), F.lit("2025-07-12").cast("date")).alias("day"))
O["act_default_date"] = sql("wat", "SELECT id, CASE WHEN id % 2 = 0 THEN watered_on ELSE DATE '2025-07-12' END AS day FROM wat")
Q["act_percent"] = lambda s, d: t(s, d, "part").select("p_partkey", F.round(scalars.clamped_percent(F.col("p_size").cast("double") - 5, 39), 6).alias("height"), F.round(scalars.clamped_percent(F.col("p_retailprice") / 5, 297), 6).alias("girth"))
O["act_percent"] = "SELECT p_partkey, round(least(100.0e0, greatest(0.0e0, (p_size - 5.0e0) / 39.0e0 * 100)), 6) AS height, round(least(100.0e0, greatest(0.0e0, p_retailprice / 5 / 297.0e0 * 100)), 6) AS girth FROM part"
Q["act_balance"] = lambda s, d: act.water_balance(t(s, d, "wat"), 500.0)
O["act_balance"] = sql("wat", "SELECT tree, sum(amount) AS given, 500.00 - sum(amount) AS lacking FROM wat GROUP BY tree")
Q["act_hidden"] = lambda s, d: t(s, d, "part").select("p_partkey", scalars.hidden_by_filter(F.array(F.lit("red widget"), F.lit("small ring")), F.col("p_name")).alias("hidden"))
O["act_hidden"] = "SELECT p_partkey, p_name NOT IN ('red widget', 'small ring') AS hidden FROM part"
Q["retry_backoff"] = lambda s, d: s.range(12).select("id", scalars.retry_delay_ms(F.col("id")).alias("ms"))
O["retry_backoff"] = "SELECT range AS id, CAST(least(30000, 1000 * power(2, range)) AS BIGINT) AS ms FROM range(12)"

KIND = {0: "text", 1: "no-reply", 2: "choice", 3: "visual"}


def chat(s, d):
    """Conversations as JSON messages."""
    k = F.col("turn") % 4
    kind = F.coalesce(*[F.when(k == i, n) for i, n in KIND.items()])
    buttons = F.when(k == 2, F.array(F.struct(F.col("role").alias("name"), F.struct(F.lit("text").alias("type")).alias("request"))))
    payload = F.struct(F.when(k != 3, F.col("text")).alias("message"), F.when(k % 2 == 0, kind).alias("type"), buttons.alias("buttons"))
    return t(s, d, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.concat(F.lit("outer-"), kind).alias("type"), F.when(k > 0, k == 1).alias("ai"), payload.alias("payload"))).alias("raw"))


Q["msg_flatten"] = lambda s, d: act.shown_messages(chat(s, d).select("conv_id", "turn", act.flatten_messages(F.col("raw")).alias("m")).select("conv_id", "turn", "m.*"), ("no-reply", "outer-no-reply")).select("conv_id", "turn", "text", "type", F.array_join("buttons", ",").alias("buttons"), "from_ai")
O["msg_flatten"] = "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text, CASE turn % 4 WHEN 0 THEN 'text' WHEN 2 THEN 'choice' WHEN 3 THEN 'outer-visual' END AS type, CASE WHEN turn % 4 = 2 THEN role ELSE '' END AS buttons, turn % 4 = 1 AS from_ai FROM conversations WHERE turn % 4 <> 1"
Q["msg_json"] = lambda s, d: t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
O["msg_json"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"
Q["msg_running_delay"] = lambda s, d: act.running_delay(t(s, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 > 0, F.char_length("text").cast("long")).alias("delay")), "conv_id", ["turn"], "delay").select("conv_id", "turn", "shown_after")
O["msg_running_delay"] = "SELECT conv_id, turn, CAST(sum(CASE WHEN turn % 3 > 0 THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shown_after FROM conversations"
Q["msg_switch"] = lambda s, d: t(s, d, "conversations").select("conv_id", "turn", F.posexplode(act.message_rows(F.element_at(F.array(*[F.lit(x) for x in ("text", "choice", "visual", "end")]), (F.col("turn") % 4 + 1).cast("int")), F.col("text"), F.array("role", F.lit("back")), F.concat(F.lit("img-"), "role"))).alias("i", "m")).select("conv_id", "turn", "i", "m.*")
O["msg_switch"] = """SELECT conv_id, turn, 0 AS i, CASE WHEN turn % 4 = 2 THEN 'visual' ELSE 'text' END AS shows, text, CASE WHEN turn % 4 = 2 THEN 'img-' || role END AS image FROM conversations WHERE turn % 4 < 3
  UNION ALL SELECT conv_id, turn, 1, 'button', role, NULL FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id, turn, 2, 'button', 'back', NULL FROM conversations WHERE turn % 4 = 1"""
Q["html_headings"] = lambda s, d: t(s, d, "pages").select("page_id", F.posexplode(markup.headings(F.col("html"))).alias("i", "heading"))
O["html_headings"] = "SELECT page_id, CAST(i - 1 AS INTEGER) AS i, trim(regexp_replace(h[i], '<[^>]*>', '', 'g')) AS heading FROM (SELECT page_id, h, unnest(generate_series(1, len(h))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages))"
Q["html_items"] = lambda s, d: t(s, d, "pages").select("page_id", F.posexplode(markup.items(F.col("html"))).alias("i", "item"))
O["html_items"] = O["html_headings"].replace("<h1[^>]*>", "<li[^>]*>").replace("</h1>", "</li>").replace("heading", "item")


def tagged(s, d):
    """Pages with a table of their own below an h4, to scrape."""
    cell = lambda i, c: F.concat(F.lit(f'<tr><td title="{i} '), c, F.lit('">'), c, F.lit(f" {i}</td></tr>"))
    key = (F.col("page_id") % 7).cast("string")
    return t(s, d, "pages").select("page_id", F.concat("html", F.lit("<table><tr><td>loose</td></tr></table><h4>Group "), key, F.lit("</h4><table>"), cell("a", key), cell("b", key), F.lit("<tr><td>plain &amp; bare</td></tr></table>")).alias("html"))


Q["html_tables"] = lambda s, d: markup.table_attributes(tagged(s, d), "page_id")
CELLS = """SELECT page_id, CAST(i AS INTEGER) AS pos, 'Group ' || page_id % 7 AS group_name, CASE i WHEN 0 THEN page_id % 7 || ' a' WHEN 1 THEN page_id % 7 || ' b' ELSE 'plain & bare' END AS attribute,
  CASE i WHEN 0 THEN 'a ' || page_id % 7 WHEN 1 THEN 'b ' || page_id % 7 END AS description FROM pages, (SELECT range AS i FROM range(3))"""
O["html_tables"] = CELLS
Q["html_descriptions"] = lambda s, d: markup.first_descriptions(markup.table_attributes(tagged(s, d), "page_id"), "page_id")
O["html_descriptions"] = f"SELECT attribute, arg_min(description, page_id) AS description, arg_min(group_name, page_id) AS group_name FROM ({CELLS}) WHERE description IS NOT NULL GROUP BY attribute"


def collections(s, d):
    """A GeoJSON collection a species, from points."""
    props = F.struct(F.col("id").alias("Standort_N"), F.col("species").alias("Baumart_bo"), (F.col("id") % 2 == 0).alias("gefaellt"), (F.col("lng") * 2).alias("Kronendurc"))
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.when(F.col("id") % 10 > 0, F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))).alias("geometry"))
    return t(s, d, "pts").groupBy("species").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.sort_array(F.collect_list(F.struct("id", feature.alias("f"))))["f"].alias("features"))).alias("value"))


def geo_file(s, d):
    path = shared_path(s)
    collections(s, d).select("value").write.text(path, lineSep="\n")
    return path


Q["src_geojson"] = lambda s, d: geojson.feature_rows(collections(s, d).select(geojson.parse_collections(F.col("value")).alias("c")).select("c.features")).select("pos", F.col("site_number").alias("id"), "botanic", "felled", F.round("crown_diameter", 6).alias("crown"), "lng", "lat", F.col("wkt").isNotNull().alias("placed"))
O["src_geojson"] = sql("pts", "SELECT CAST(row_number() OVER (PARTITION BY species ORDER BY id) - 1 AS INTEGER) AS pos, id, species AS botanic, id % 2 = 0 AS felled, round(lng * 2, 6) AS crown, CASE WHEN id % 10 > 0 THEN lng END AS lng, CASE WHEN id % 10 > 0 THEN lat END AS lat, id % 10 > 0 AS placed FROM pts")
Q["src_geojson_errors"] = lambda s, d: t(s, d, "part").select("p_partkey", geojson.parse_collections(F.when(F.col("p_partkey") % 3 == 0, F.lit("{broken")).when(F.col("p_partkey") % 3 == 1, F.lit('{"features": 3}')).otherwise(F.lit('{"features": []}'))).alias("c")).select("p_partkey", "c.code")
O["src_geojson_errors"] = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'missing_features' END AS code FROM part"


def _csv(s, d, columns, sep, header, view="map", names=()):
    """The view written as delimited files, to be scanned again."""
    path = shared_path(s)
    rows = t(s, d, view).select(*columns)
    rows = rows.toDF(*names) if names else rows
    rows.write.option("header", header).option("sep", sep).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


Q["src_mapping_csv"] = lambda s, d: delimited.scan_mapping(s, _csv(s, d, ["botanic", "common", "qid"], ",", True, names=delimited.MAPPING)).drop("line")
O["src_mapping_csv"] = sql("map", r"SELECT regexp_replace(botanic, '^\s+|\s+$', '', 'g') AS baumart_bo, common AS baumart_de, qid AS wikidata_id FROM map")


def review_file(s, d):
    path = shared_path(s)
    rows = t(s, d, "rev").select(F.col("qid").alias("wikidata_id"), F.col("botanic").alias("baumart_bo"), F.col("common").alias("baumart_de"), "property_id", "attribute_name", F.concat(F.lit(' "'), "value", F.lit(';\n" ')).alias("value"), F.lit("g").alias("group"))
    delimited.write_review(rows, path, order=["baumart_bo", "property_id", "value"])
    return path


Q["src_review_csv"] = lambda s, d: delimited.scan_review(s, review_file(s, d)).drop("line")
REVIEW = "SELECT qid AS wikidata_id, botanic AS baumart_bo, common AS baumart_de, property_id, attribute_name, ' \"' || value || ';' || chr(10) || '\" ' AS value, 'g' AS \"group\" FROM rev"
O["src_review_csv"] = sql("rev", REVIEW)
Q["src_config_csv"] = lambda s, d: delimited.scan_config(s, _csv(s, d, delimited.CONFIG, ";", True, "cfg")).drop("line")
O["src_config_csv"] = sql("cfg", "SELECT property_id, type, action, config, description, import FROM cfg")
Q["src_ragged_csv"] = lambda s, d: delimited.scan(s, _ragged(s, d), ["a", "b", "c", "d"], header=False, ragged=True).select("a", "b", "c", "d")
O["src_ragged_csv"] = "SELECT CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS b, CASE WHEN p_partkey % 4 > 1 THEN p_brand ELSE '' END AS c, CASE WHEN p_partkey % 4 > 2 THEN p_type ELSE '' END AS d FROM part"


def _ragged(s, d):
    path = shared_path(s)
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type")
    t(s, d, "part").select(F.array_join(F.slice(cells, F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")), ",").alias("value")).write.text(path)
    return path


Q["src_optional_csv"] = lambda s, d: delimited.scan_optional(s, shared_path(s) + "/nothing", ["name_botanic", "baumart_bo"]).unionByName(delimited.scan_optional(s, _csv(s, d, ["botanic", "target"], ",", True, "syn", ["name_botanic", "baumart_bo"]), ["name_botanic", "baumart_bo"])).drop("line")
O["src_optional_csv"] = sql("syn", "SELECT botanic AS name_botanic, target AS baumart_bo FROM syn")
Q["src_json_document"] = lambda s, d: t(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string, int>")).alias("key", "value"))
O["src_json_document"] = "SELECT event_id, 'k' AS \"key\", CAST(json_extract_string(props, '$.k') AS INTEGER) AS \"value\" FROM events"
Q["src_full_scan"] = lambda s, d: t(s, d, "orders")
O["src_full_scan"] = "SELECT * FROM orders"
Q["src_turtle"] = lambda s, d: markup.scan_turtle(markup.turtle_lines(t(s, d, "tri")).groupBy("entity").agg(F.concat_ws("\n", F.collect_list("line")).alias("text")))
O["src_turtle"] = sql("tri", "SELECT * FROM tri")
Q["src_missing_graphs"] = lambda s, d: markup.missing_graphs(t(s, d, "map").select("qid").distinct(), t(s, d, "tri").filter("entity <> 'Q57'"))
O["src_missing_graphs"] = sql("map tri", "SELECT DISTINCT qid FROM map WHERE qid NOT IN (SELECT entity FROM tri WHERE entity <> 'Q57')")


def _segments(s, d):
    path = shared_path(s)
    index = geojson.write_segments(t(s, d, "pts"), path, ["id", "species"])
    return geojson.read_segments(s, path, index.filter("n_points > 0")).select("cell_x", "cell_y", F.col("properties.id").cast("long").alias("id"), F.col("properties.species").alias("species"), "lng", "lat")


from .geo_queries import GRID  # noqa: E402

Q["sink_segments"] = _segments
O["sink_segments"] = sql("pts", "SELECT cell_x, cell_y, id, species, lng, lat FROM grid JOIN pts ON lng BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y", grid=GRID)
Q["sink_review_csv"] = lambda s, d: s.read.option("header", True).option("sep", ";").option("escape", '"').option("multiLine", True).csv(review_file(s, d))
O["sink_review_csv"] = sql("rev", REVIEW)


def _table(s, d):
    path = shared_path(s)
    half = t(s, d, "orders").select("o_orderkey", "o_orderpriority")
    half.filter("o_orderkey % 2 = 0").write.mode("overwrite").parquet(path)
    half.filter("o_orderkey % 2 = 1").write.mode("append").parquet(path)
    return s.read.parquet(path)


Q["sink_table"] = _table
O["sink_table"] = "SELECT o_orderkey, o_orderpriority FROM orders"


def _json(s, d):
    path = shared_path(s)
    rows = t(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.struct("p_brand", "p_size").alias("more"))
    rows.write.json(path)
    return s.read.schema(rows.schema).json(path).select("p_partkey", F.array_join("words", " ").alias("p_name"), "more.p_brand", "more.p_size")


Q["sink_json"] = _json
O["sink_json"] = "SELECT p_partkey, p_name, p_brand, p_size FROM part"

Q["prj_optional"] = lambda s, d: rel.optional_columns(t(s, d, "part"), {"p_partkey": "id", "p_crown": "crown", "p_name": "name"})
O["prj_optional"] = "SELECT p_partkey AS id, p_name AS name FROM part"
Q["flt_equal"] = lambda s, d: t(s, d, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
O["flt_equal"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
Q["flt_in_pairs"] = lambda s, d: rel.within(t(s, d, "orders"), o_orderstatus=["F", "O"], o_orderpriority=["5-LOW", "1-URGENT"]).select("o_orderkey")
O["flt_in_pairs"] = "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('5-LOW', '1-URGENT')"
Q["flt_toggle"] = lambda s, d: t(s, d, "part").select("p_partkey", F.array_join(scalars.toggled(F.split("p_name", " "), F.lit("red")), " ").alias("toggled"))
O["flt_toggle"] = "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'red'), ' ') ELSE p_name || ' red' END AS toggled FROM part"
Q["flt_prefix"] = lambda s, d: t(s, d, "customer").filter(F.startswith("c_mktsegment", F.lit("MACH"))).select("c_custkey")
O["flt_prefix"] = "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'MACH')"
Q["set_distinct"] = lambda s, d: t(s, d, "part").select("p_name", "p_type").distinct()
O["set_distinct"] = "SELECT DISTINCT p_name, p_type FROM part"
Q["set_union_distinct"] = lambda s, d: rel.union_distinct(t(s, d, "part").select(F.col("p_brand").alias("x")), t(s, d, "orders").select(F.col("o_orderpriority").alias("x")), t(s, d, "part").select(F.col("p_type").alias("x")))
O["set_union_distinct"] = "SELECT p_brand AS x FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT p_type FROM part"
Q["set_difference"] = lambda s, d: rel.difference(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")))
O["set_difference"] = "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders"


def _cache(s, d):
    parts = rel.split_cached(t(s, d, "orders").select(F.col("o_custkey").alias("k")), t(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), t(s, d, "orders").select(F.col("o_custkey").alias("k")), "k")
    return rel.sorted_concat(parts, "what")


Q["cache_split"] = _cache
O["cache_split"] = sql("", "SELECT k, CASE WHEN k IN (SELECT k FROM c) THEN 'read' ELSE 'fetch' END AS what FROM w UNION ALL SELECT k, 'stale' FROM c WHERE k NOT IN (SELECT k FROM w)", w="SELECT DISTINCT o_custkey AS k FROM orders", c="SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
Q["lim_targets"] = lambda s, d: t(s, d, "map").orderBy("line").limit(100).select("line", "botanic")
O["lim_targets"] = sql("map", "SELECT line, botanic FROM map ORDER BY line LIMIT 100")
Q["cat_sorted_distinct"] = lambda s, d: rel.repeats(rel.sorted_concat({"a": t(s, d, "part").select("p_name", "p_brand"), "b": t(s, d, "part").select("p_name", "p_brand")}))
O["cat_sorted_distinct"] = "SELECT CAST(2 * count(*) AS BIGINT) AS n_rows, 2 * count(DISTINCT (p_name, p_brand)) AS n_distinct FROM part"


def _stream(s, d, kind):
    """The events of a kind as a file stream."""
    path = f"{d}/events.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path if d.endswith("/") else f"{d}/events.parque[t]").filter(F.col("event_type") == kind)


Q["stream_toggle"] = lambda s, d: live.run_adopted(_stream(s, d, "click").select((F.col("event_id") % 40).alias("tree"), "user_id"), s)
O["stream_toggle"] = sql("adopt", ADOPTED)
Q["stream_windows"] = lambda s, d: live.run_windows(_stream(s, d, "purchase").select((F.col("event_id") % 200).alias("tree"), F.col("value").cast("decimal(12,2)").alias("amount"), F.col("ts").alias("created_at")), s)


def gridded(s, d):
    """Pages with tables: two that count, an empty one between them, and one with a table in a cell."""
    key = F.col("page_id").cast("string")
    text = F.concat(F.lit("<p>x<table><tr><th>Typ</th><td> a &amp; "), key, F.lit("</td></tr><tr><td>b</td></tr></table><table></table><table><tr><td>c<table><tr><td>in "), key, F.lit("</td></tr></table></td></tr></table>"))
    return t(s, d, "pages").select("page_id", "url", text.alias("html"))


Q["html_named_tables"] = lambda s, d: markup.named_tables(gridded(s, d), "page_id", "url").select("page_id", "category", "row", F.array_join("cells", "|").alias("cells"), "source")
O["html_named_tables"] = """SELECT page_id, category, CAST(r AS INTEGER) AS row, cells, url AS source FROM pages, (SELECT 'Klimabedingungen' AS category, 0 AS r UNION ALL SELECT 'Klimabedingungen', 1
  UNION ALL SELECT 'Bodenbedingungen', 0 UNION ALL SELECT 'Natürliche Verbreitung', 0) x, LATERAL (SELECT CASE WHEN category = 'Klimabedingungen' AND r = 0 THEN 'Typ|a & ' || page_id WHEN r = 1 THEN 'b' WHEN category = 'Bodenbedingungen' THEN 'c' ELSE 'in ' || page_id END AS cells) y"""


def plane_collections(s, d):
    """A collection a part, in metres of zone 32 but for every fourth, which is in degrees, and every ninth, in an unknown system."""
    system = F.when(F.col("p_partkey") % 9 == 0, "EPSG:31468").when(F.col("p_partkey") % 4 == 0, "urn:ogc:def:crs:OGC:1.3:CRS84").otherwise("urn:ogc:def:crs:EPSG::25832")
    plane = [F.lit(400000.0) + F.col("p_partkey") * 9.5, F.lit(5700000.0) + F.col("p_size") * 1000.25]
    xy = [F.when(F.col("p_partkey") % 4 == 0, v).otherwise(c).cast("string") for v, c in zip((8.5, 52.25), plane, strict=True)]
    text = F.concat(F.lit('{"crs": {"type": "name", "properties": {"name": "'), system, F.lit('"}}, "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": ['), xy[0], F.lit(", "), xy[1], F.lit("]}}]}"))
    # a small file is one task's, but its texts are dear to parse; stored, as a filter would be moved to where one task parses all
    parts = t(s, d, "part").select("p_partkey", "p_size").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    return stored(parts.select("p_partkey", geojson.parse_collections(text).alias("c")))


Q["src_geojson_crs"] = lambda s, d: geojson.feature_rows(plane_collections(s, d).filter("c.code is null").select("p_partkey", "c.features", "c.utm_zone")).select("p_partkey", F.round("lng", 8).alias("lng"), F.round("lat", 8).alias("lat"))
Q["src_geojson_crs_errors"] = lambda s, d: plane_collections(s, d).select("p_partkey", F.col("c.code").alias("code"))
O["src_geojson_crs_errors"] = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'unknown_crs' END AS code FROM part"


def _utm_sql() -> str:
    radius, plane, sphere = geo.utm_series()
    up = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(plane, 1))
    side = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(plane, 1))
    lat = "chi" + "".join(f" + {b!r} * sin({2 * j} * chi)" for j, b in enumerate(sphere, 1))
    k = geo.SCALE * radius
    return f"""WITH p AS (SELECT p_partkey, (400000e0 + p_partkey * 9.5e0 - {geo.EASTING!r}) / {k!r} AS eta, (5700000e0 + p_size * 1000.25e0) / {k!r} AS xi FROM part WHERE p_partkey % 9 > 0),
  q AS (SELECT p_partkey, {up} AS up, {side} AS side FROM p), r AS (SELECT *, asin(sin(up) / cosh(side)) AS chi FROM q)
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 8.5e0 ELSE round(9 + degrees(atan2(sinh(side), cos(up))), 8) END AS lng, CASE WHEN p_partkey % 4 = 0 THEN 52.25e0 ELSE round(degrees({lat}), 8) END AS lat FROM r"""


O["src_geojson_crs"] = _utm_sql()
Q["src_existing"] = lambda s, d: rel.existing(t(s, d, "part").select("p_partkey", F.concat(F.lit("trees/"), "p_brand", F.lit("/"), "p_name").alias("path")), "path", t(s, d, "part").filter("p_size > 45").select(F.col("p_name").alias("name")))
O["src_existing"] = "SELECT p_partkey, 'trees/' || p_brand || '/' || p_name AS path, p_name IN (SELECT p_name FROM part WHERE p_size > 45) AS exists FROM part"
