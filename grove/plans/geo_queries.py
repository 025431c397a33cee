"""Spatial queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import geo, spatial
from ..sources.scratch import shared_path
from .adapters import CENTRE, frame, sql

LAT, LNG = CENTRE
METRES = "CAST(floor(6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)) + 0.5) AS BIGINT)"
HAV = "(SELECT *, power(sin(radians(lat - 52.0e0) / 2), 2) + cos(radians(52.0e0)) * cos(radians(lat)) * power(sin(radians(lng - 8.5e0) / 2), 2) AS a FROM pts)"
DIST = f"SELECT id, species, lng, lat, {METRES} AS metres FROM {HAV}"
GRID = """SELECT CAST(i.range AS INTEGER) AS cell_x, CAST(j.range AS INTEGER) AS cell_y, x0 + i.range * ((x1 - x0) / 10) AS min_x, x0 + (i.range + 1) * ((x1 - x0) / 10) AS max_x,
  y0 + j.range * ((y1 - y0) / 10) AS min_y, y0 + (j.range + 1) * ((y1 - y0) / 10) AS max_y
  FROM (SELECT min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pts), range(10) i, range(10) j"""
INDEX = """SELECT g.cell_x, g.cell_y, any_value(min_x) AS min_x, any_value(max_x) AS max_x, any_value(min_y) AS min_y, any_value(max_y) AS max_y, count(id) AS n_points,
  CASE WHEN count(id) > 0 THEN printf('segment_%02d_%02d.geojson', g.cell_x + 1, g.cell_y + 1) END AS file_name
  FROM grid g LEFT JOIN pts ON lng BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y GROUP BY g.cell_x, g.cell_y"""
VIEW = {"min_x": LNG - 0.004, "max_x": LNG + 0.006, "min_y": LAT - 0.01, "max_y": LAT + 0.002}
MEETS = "file_name IS NOT NULL AND min_x <= 8.506e0 AND max_x >= 8.496e0 AND min_y <= 52.002e0 AND max_y >= 51.99e0"
Q, O = {}, {}


def pts(s, d):
    return frame(s, d, "pts")


Q["geo_points"] = lambda s, d: pts(s, d).select("id", "species", "lat", "lng")
O["geo_points"] = sql("pts", "SELECT id, species, lat, lng FROM pts")
Q["geo_distance_m"] = lambda s, d: geo.with_distance(pts(s, d), LAT, LNG).select("id", "metres")
O["geo_distance_m"] = sql("pts", f"SELECT id, metres FROM ({DIST})")
Q["geo_nearest_ranked"] = lambda s, d: geo.nearest(pts(s, d), LAT, LNG, 1000).select("id", "metres")
O["geo_nearest_ranked"] = sql("pts", f"SELECT id, metres FROM ({DIST}) ORDER BY metres, id LIMIT 1000")
Q["geo_all_ranked"] = lambda s, d: geo.nearest(pts(s, d), LAT, LNG, None).select("id", "metres")
O["geo_all_ranked"] = sql("pts", f"SELECT id, metres FROM ({DIST}) ORDER BY metres, id")
Q["geo_bbox"] = lambda s, d: s.createDataFrame([(r, *geo.bounding_box(LAT, LNG, r).values()) for r in geo.RADII], "radius double, min_lat double, max_lat double, min_lng double, max_lng double")
O["geo_bbox"] = "SELECT r AS radius, 52.0e0 - r AS min_lat, 52.0e0 + r AS max_lat, 8.5e0 - r AS min_lng, 8.5e0 + r AS max_lng FROM (SELECT unnest([0.0015e0, 0.005e0, 0.01e0]) AS r)"
def _functions(s, d):
    geo.register_functions(s, pts(s, d), {"uuid": "id", "tree_type_german": "species", "lat": "lat", "long": "lng"})
    return s


Q["geo_sql_nearby"] = lambda s, d: _functions(s, d).sql(f"SELECT uuid, tree_type_german, lat, long, CAST(floor(dist_meters + 0.5) AS BIGINT) AS metres FROM nearby_trees({LAT}D, {LNG}D) WHERE lat > 51.99D")
O["geo_sql_nearby"] = sql("pts", f"SELECT id AS uuid, species AS tree_type_german, lat, lng AS long, metres FROM ({DIST}) WHERE lat > 51.99e0")
#: ten views around the centre, joined by a call for each of their rows
BOXES = "SELECT CAST(id AS INT) AS view, 51.9D + id / 100 AS low, 8.4D + id / 50 AS west FROM range(10)"
Q["geo_sql_views"] = lambda s, d: _functions(s, d).sql(f"SELECT view, uuid FROM ({BOXES}) v, LATERAL trees_in_view(v.low, v.west, v.low + 0.05D, v.west + 0.04D)")
O["geo_sql_views"] = sql("pts", "SELECT view, id AS uuid FROM (SELECT CAST(range AS INTEGER) AS view, 51.9e0 + range / 100 AS low, 8.4e0 + range / 50 AS west FROM range(10)) v JOIN pts ON lat BETWEEN low AND low + 0.05e0 AND lng BETWEEN west AND west + 0.04e0")
Q["geo_viewport_points"] = lambda s, d: geo.viewport(pts(s, d), LAT - 0.005, LNG - 0.005, LAT + 0.005, LNG + 0.005)
O["geo_viewport_points"] = sql("pts", "SELECT * FROM pts WHERE lat BETWEEN 52.0e0 - 0.005e0 AND 52.0e0 + 0.005e0 AND lng BETWEEN 8.5e0 - 0.005e0 AND 8.5e0 + 0.005e0")
Q["geo_species_filter"] = lambda s, d: geo.of_species(pts(s, d), ["3", "7"]).select("id", "species")
O["geo_species_filter"] = sql("pts", "SELECT id, species FROM pts WHERE species IN ('3', '7')")
Q["geo_range_filter"] = lambda s, d: frame(s, d, "part").filter(F.col("p_size").between(10, 20) & F.col("p_retailprice").between(900.0, 1500.0))
O["geo_range_filter"] = "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1500"
Q["geo_grid_index"] = lambda s, d: geo.grid_index(pts(s, d))
O["geo_grid_index"] = sql("pts", f"SELECT * FROM ({INDEX})", grid=GRID)
Q["geo_grid_members"] = lambda s, d: geo.grid_members(pts(s, d)).select("id", "cell_x", "cell_y")
O["geo_grid_members"] = sql("pts", "SELECT id, cell_x, cell_y FROM grid JOIN pts ON lng BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y", grid=GRID)
Q["geo_viewport_cells"] = lambda s, d: geo.matching_cells(geo.grid_index(pts(s, d)), **VIEW).select("cell_x", "cell_y", "file_name")
O["geo_viewport_cells"] = sql("pts", f"SELECT cell_x, cell_y, file_name FROM ({INDEX}) WHERE {MEETS}", grid=GRID)


def _incremental(s, d):
    index = geo.grid_index(pts(s, d))
    loaded = geo.matching_cells(index, LNG - 0.004, LNG, LAT - 0.01, LAT).select("file_name")
    return geo.unloaded_cells(geo.matching_cells(index, **VIEW), loaded).select("cell_x", "cell_y", "file_name")


Q["geo_incremental_cells"] = _incremental
O["geo_incremental_cells"] = sql("pts", f"SELECT cell_x, cell_y, file_name FROM ix WHERE {MEETS} AND file_name NOT IN (SELECT file_name FROM ix WHERE file_name IS NOT NULL AND min_x <= 8.5e0 AND max_x >= 8.496e0 AND min_y <= 52e0 AND max_y >= 51.99e0)", grid=GRID, ix=INDEX)
Q["geo_expanding_top5"] = lambda s, d: geo.expanding_search(pts(s, d), LAT, LNG).select("id", "species", "metres")
EXPAND = f"""SELECT *, CASE WHEN lat BETWEEN 52e0 - 0.0015e0 AND 52e0 + 0.0015e0 AND lng BETWEEN 8.5e0 - 0.0015e0 AND 8.5e0 + 0.0015e0 THEN 0
  WHEN lat BETWEEN 52e0 - 0.005e0 AND 52e0 + 0.005e0 AND lng BETWEEN 8.5e0 - 0.005e0 AND 8.5e0 + 0.005e0 THEN 1
  WHEN lat BETWEEN 52e0 - 0.01e0 AND 52e0 + 0.01e0 AND lng BETWEEN 8.5e0 - 0.01e0 AND 8.5e0 + 0.01e0 THEN 2 END AS ring FROM ({DIST})"""
O["geo_expanding_top5"] = sql("pts", "SELECT id, species, metres FROM r WHERE ring = (SELECT min(ring) FROM r) ORDER BY metres, id LIMIT 5", r=EXPAND)
Q["geo_expanding_species"] = lambda s, d: geo.expanding_search(pts(s, d), LAT, LNG, ["1", "8"]).select("id", "species", "metres")
O["geo_expanding_species"] = sql("pts", "SELECT id, species, metres FROM r WHERE species IN ('1', '8') AND ring = (SELECT min(ring) FROM r WHERE species IN ('1', '8')) ORDER BY metres, id LIMIT 5", r=EXPAND)
#: every 50th point, moved a little, as a place to search from
PLACES = "SELECT id AS place, lat + 0.004e0 AS at_lat, lng - 0.003e0 AS at_lng FROM pts WHERE id % 50 = 0"
MET = """SELECT place, id, CAST(floor(6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)) + 0.5) AS BIGINT) AS metres, CASE WHEN lat BETWEEN at_lat - 0.0015e0 AND at_lat + 0.0015e0 AND lng BETWEEN at_lng - 0.0015e0 AND at_lng + 0.0015e0 THEN 0
  WHEN lat BETWEEN at_lat - 0.005e0 AND at_lat + 0.005e0 AND lng BETWEEN at_lng - 0.005e0 AND at_lng + 0.005e0 THEN 1 ELSE 2 END AS ring
  FROM (SELECT *, power(sin(radians(lat - at_lat) / 2), 2) + cos(radians(at_lat)) * cos(radians(lat)) * power(sin(radians(lng - at_lng) / 2), 2) AS a
    FROM places JOIN pts ON lat BETWEEN at_lat - 0.01e0 AND at_lat + 0.01e0 AND lng BETWEEN at_lng - 0.01e0 AND at_lng + 0.01e0)"""
Q["geo_expanding_places"] = lambda s, d: geo.expanding_search_all(pts(s, d), pts(s, d).filter("id % 50 = 0").select(F.col("id").alias("place"), (F.col("lat") + 0.004).alias("lat"), (F.col("lng") - 0.003).alias("lng")))
O["geo_expanding_places"] = sql("pts", """SELECT place, id, metres, CAST(rank AS INTEGER) AS rank FROM (SELECT place, id, metres, row_number() OVER (PARTITION BY place ORDER BY metres, id) AS rank
  FROM (SELECT *, min(ring) OVER (PARTITION BY place) AS first FROM met) WHERE ring = first) WHERE rank <= 5""", places=PLACES, met=MET)

def _stored(s, d):
    path = shared_path(s)
    spatial.write_points(pts(s, d), path)
    return spatial.StoredPoints(s, path)


Q["geo_stored_nearest"] = lambda s, d: _stored(s, d).nearest(LAT, LNG, 1000).rows.select("id", "metres")
O["geo_stored_nearest"] = sql("pts", f"SELECT id, metres FROM ({DIST}) ORDER BY metres, id LIMIT 1000")
Q["geo_stored_view"] = lambda s, d: _stored(s, d).view(LAT - 0.005, LNG - 0.005, LAT + 0.005, LNG + 0.005).rows
O["geo_stored_view"] = O["geo_viewport_points"]


def _boxes(s, d):
    """A view around every 50th point."""
    at = pts(s, d).filter("id % 50 = 0")
    return at.select(F.col("id").alias("box"), (F.col("lat") - 0.004).alias("min_lat"), (F.col("lng") - 0.003).alias("min_lng"), (F.col("lat") + 0.002).alias("max_lat"), (F.col("lng") + 0.005).alias("max_lng"))


Q["geo_box_members"] = lambda s, d: spatial.box_members(pts(s, d), _boxes(s, d))
MEMBERS = """SELECT box, id FROM (SELECT id AS box, lat - 0.004e0 AS min_lat, lng - 0.003e0 AS min_lng, lat + 0.002e0 AS max_lat, lng + 0.005e0 AS max_lng FROM pts WHERE id % 50 = 0)
  JOIN pts ON lat BETWEEN min_lat AND max_lat AND lng BETWEEN min_lng AND max_lng"""
O["geo_box_members"] = sql("pts", MEMBERS)
Q["geo_box_counts"] = lambda s, d: spatial.box_counts(pts(s, d), _boxes(s, d))
O["geo_box_counts"] = sql("pts", "SELECT p.id AS box, count(m.id) AS n FROM pts p LEFT JOIN m ON m.box = p.id WHERE p.id % 50 = 0 GROUP BY p.id", m=MEMBERS)
Q["geo_describe"] = lambda s, d: geo.describe(pts(s, d), ["lng", "lat"])
O["geo_describe"] = sql("pts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS most FROM pts" for c in ("lng", "lat")))
Q["geo_smallest5"] = lambda s, d: pts(s, d).orderBy("lat", "id").limit(5).select("id", "lat")
O["geo_smallest5"] = sql("pts", "SELECT id, lat FROM pts ORDER BY lat, id LIMIT 5")
Q["geo_positive"] = lambda s, d: pts(s, d).select("id", (F.col("lng") - LNG).alias("x"), (F.col("lat") - LAT).alias("y")).filter("x > 0 and y > 0")
O["geo_positive"] = sql("pts", "SELECT id, lng - 8.5e0 AS x, lat - 52.0e0 AS y FROM pts WHERE lng - 8.5e0 > 0 AND lat - 52.0e0 > 0")
Q["geo_cluster_size"] = lambda s, d: geo.grid_index(pts(s, d)).select("cell_x", "cell_y", "n_points", scalars.cluster_size(F.col("n_points") * 30).alias("icon"))
O["geo_cluster_size"] = sql("pts", f"SELECT cell_x, cell_y, n_points, CASE WHEN n_points * 30 > 1000 THEN 100 WHEN n_points * 30 > 500 THEN 50 WHEN n_points * 30 > 100 THEN 10 ELSE 20 END AS icon FROM ({INDEX})", grid=GRID)
Q["species_share"] = lambda s, d: geo.species_share(frame(s, d, "part"), "p_name")
O["species_share"] = "SELECT p_name, count(*) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_name"
Q["species_top30"] = lambda s, d: geo.top_species(frame(s, d, "part"), 30, "p_name")
O["species_top30"] = "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 30"
Q["group_examples"] = lambda s, d: geo.group_examples(frame(s, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey")
O["group_examples"] = "SELECT * FROM (SELECT p_partkey, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS INTEGER) AS nth, count(*) OVER (PARTITION BY p_type) AS group_size FROM part) WHERE nth <= 3"
