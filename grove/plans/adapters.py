"""Small views that bind the operators to the driver's tables, in SQL that Spark and DuckDB read alike.

@name stands for a table, [#k] for the k-th array item (from 0), @range(n) for the numbers below n as id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CENTRE = (52.0, 8.5)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["pts"] = ((), """
  SELECT vec_id AS id, CAST(label AS STRING) AS species, 8.5e0 + CAST(embedding[#0] AS DOUBLE) / 10e0 AS lng, 52.0e0 + CAST(embedding[#1] AS DOUBLE) / 10e0 AS lat
  FROM @embeddings""")

VIEWS["cad"] = ((), """
  SELECT p_partkey AS pos, CASE p_partkey % 8
      WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ') WHEN 2 THEN p_name || ' `Nana`' WHEN 3 THEN p_name || ' ssp. minor'
      WHEN 4 THEN ' ' || p_name || ' ' WHEN 5 THEN p_name || ' subsp. minor' WHEN 6 THEN CASE WHEN p_partkey % 16 = 6 THEN '  ' ELSE p_name END
      ELSE p_name || ' ' || p_brand END AS botanic,
    CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'common' END AS common
  FROM @part""")

VIEWS["map"] = ((), """
  SELECT p_partkey + 2 AS line, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ssp. minor' WHEN 2 THEN p_name || ' ' || p_brand ELSE p_name END AS botanic,
    CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE 'common' END AS common,
    CASE WHEN p_partkey % 50 = 7 THEN '' WHEN p_partkey % 50 = 8 THEN 'Q0' WHEN p_partkey % 50 = 9 THEN 'Q012' ELSE 'Q' || CAST(1 + (length(p_name) * 7 + p_partkey % 3) AS STRING) END AS qid
  FROM @part""")

VIEWS["names"] = ((), """
  SELECT p_partkey AS pos, p_size AS size, p_brand AS brand,
    upper(substr(p_name, 1, 1)) || substr(p_name, 2, strpos_(p_name) - 2) || chr(97 + CAST(replace(p_brand, 'Brand#', '') AS INT) % 5) AS genus,
    substr(p_name, strpos_(p_name) + 1) || chr(97 + CAST(replace(p_brand, 'Brand#', '') AS INT) % 7) AS epithet
  FROM @part""")

VIEWS["ref"] = (("names",), """
  SELECT pos, CASE size % 5 WHEN 0 THEN genus || ' ' || epithet WHEN 1 THEN genus || ' × ' || epithet WHEN 2 THEN genus || ' ' || epithet || ' subsp. minor'
      WHEN 3 THEN upper(genus) || '  ' || epithet ELSE genus || ' ' || epithet || ' ' || brand END AS botanic,
    'common ' || genus AS common, CASE WHEN pos % 9 = 0 THEN '' ELSE 'Q' || CAST(pos + 1 AS STRING) END AS qid
  FROM names""")

VIEWS["ext"] = (("names",), """
  SELECT pos, CASE size % 12 WHEN 0 THEN genus || ' ' || epithet WHEN 1 THEN genus || ' ' || epithet || ' L.' WHEN 2 THEN genus || ' ' || upper(epithet) || ' Mill.'
      WHEN 3 THEN genus || ' x ' || epithet || ' Hort.' WHEN 4 THEN genus || ' ' || epithet || ' L. ssp. minor (Ten.) de Jong' WHEN 5 THEN genus || ' ' || epithet || ' var. nana Miq.'
      WHEN 6 THEN 'Xenia alba (' || genus || ' ' || epithet || ' Mill. (syn)) Ait. (X. rara L.) stray)' WHEN 7 THEN 'Syn ' || epithet || ' Thunb.' WHEN 8 THEN 'Man ' || epithet
      WHEN 9 THEN genus || ' ' || epithet || '(L.) Moench f.' WHEN 10 THEN genus || '(' || upper(substr(genus, 1, 1)) || '. ' || epithet || ') open (x' ELSE genus END AS botanic,
    CASE WHEN pos % 7 = 0 THEN '' ELSE brand END AS strain, CASE WHEN pos % 11 = 0 THEN 'Q9' WHEN pos % 11 = 1 THEN '' ELSE NULL END AS qid,
    CASE WHEN pos % 13 = 0 THEN 'kept ' || genus ELSE '' END AS ref_botanic
  FROM names""")

VIEWS["syn"] = (("names",), """
  SELECT min(pos) AS pos, 'Syn ' || epithet AS botanic, CASE WHEN length(epithet) % 2 = 0 THEN min(genus || ' ' || epithet) ELSE 'Nowhere at all' END AS target
  FROM names GROUP BY epithet""")

VIEWS["man"] = (("names",), "SELECT 'Man ' || epithet AS botanic, 'Q' || CAST(700000 + min(pos) AS STRING) AS qid FROM names GROUP BY epithet")

VIEWS["cfg"] = ((), """
  SELECT CAST(id + 2 AS BIGINT) AS line, 'P' || CAST(id AS STRING) AS property_id,
    CASE id % 8 WHEN 0 THEN 'WikibaseItem' WHEN 1 THEN 'String' WHEN 2 THEN 'Quantity' WHEN 3 THEN 'Url' WHEN 4 THEN 'CommonsMedia' WHEN 5 THEN 'ExternalId' WHEN 6 THEN 'GeoShape' ELSE 'Other' END AS type,
    CASE WHEN id % 8 = 0 THEN 'inline' WHEN id % 11 = 3 THEN 'ignore' ELSE '' END AS action,
    CASE WHEN id % 8 = 0 THEN '{"target": "t' || CAST(id % 24 AS STRING) || '"' || CASE WHEN id % 16 = 0 THEN ', "keep_source": true' ELSE '' END || CASE WHEN id % 24 = 8 THEN ', "source": "P7"' ELSE '' END || '}' ELSE '' END AS config,
    CASE WHEN id % 6 = 5 THEN '' WHEN id % 6 = 4 THEN '!!' ELSE 'Größe der Ähre ' || CAST(id AS STRING) || ' – long text' END AS description,
    CASE WHEN id % 7 = 1 THEN 'skip' WHEN id % 7 = 2 THEN '{"group": "g' || CAST(id % 3 AS STRING) || '"}' WHEN id % 7 = 4 THEN '{"group": "g1", "attribute_name": "named_' || CAST(id % 5 AS STRING) || '"}' ELSE '' END AS import
  FROM @range(60)""")

VIEWS["rev"] = ((), """
  SELECT l_orderkey * 10000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line,
    CASE WHEN l_suppkey % 13 = 0 THEN 'unknown tree' WHEN l_partkey % 6 = 0 THEN upper(p_name) WHEN l_partkey % 6 = 1 THEN p_name || ' subsp. minor' ELSE p_name END AS botanic,
    CASE WHEN l_partkey % 4 = 0 THEN p_type ELSE 'common' END AS common,
    CASE WHEN l_suppkey % 17 = 3 THEN 'Q0x' ELSE 'Q' || CAST(1 + (length(p_name) * 7 + l_partkey % 3) AS STRING) END AS qid,
    'P' || CAST((l_partkey + l_linenumber) % 70 AS STRING) AS property_id,
    CASE WHEN l_linenumber % 3 = 0 THEN 't' || CAST((l_partkey + l_linenumber) % 70 % 24 AS STRING) ELSE 'other' END AS attribute_name,
    l_returnflag || l_linestatus || CAST(l_quantity AS STRING) AS value
  FROM @lineitem JOIN @part ON l_partkey = p_partkey""")

VIEWS["tri"] = ((), """
  SELECT 'Q' || CAST(p_partkey AS STRING) AS entity, 'http://www.wikidata.org/entity/Q' || CAST(p_partkey AS STRING) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, 'literal' AS o_kind,
    p_name || ' ' || l AS o_value, CASE WHEN l = 'plain' THEN CAST(NULL AS STRING) ELSE l END AS o_lang
  FROM @part, (SELECT 'de' AS l UNION ALL SELECT 'en' UNION ALL SELECT 'fr' UNION ALL SELECT 'plain') x
  UNION ALL SELECT 'Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/entity/Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/prop/direct/P' || CAST(p_size AS STRING), 'literal', p_type || ' ' || l, l
  FROM @part, (SELECT 'de' AS l UNION ALL SELECT 'en' UNION ALL SELECT 'fr') x WHERE l <> 'de' OR p_size % 3 > 0
  UNION ALL SELECT 'Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/entity/Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/prop/direct/P' || CAST(p_size % 60 + 1 AS STRING), 'literal', p_brand, CAST(NULL AS STRING) FROM @part
  UNION ALL SELECT 'Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/entity/Q' || CAST(p_partkey AS STRING), 'http://schema.org/about', 'iri', 'http://example.org/' || p_type, CAST(NULL AS STRING) FROM @part
  UNION ALL SELECT 'Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/entity/Q' || CAST(p_partkey AS STRING), 'http://www.wikidata.org/prop/direct/P' || CAST(p_size % 8 * 8 AS STRING), 'iri', 'http://commons.example.org/' || p_brand, CAST(NULL AS STRING) FROM @part
  UNION ALL SELECT 'Q' || CAST(l_partkey AS STRING), 'http://www.wikidata.org/entity/Q' || CAST(l_partkey AS STRING), 'http://www.wikidata.org/prop/direct/P' || CAST(l_suppkey % 62 AS STRING), 'iri', 'http://www.wikidata.org/entity/Q9000' || CAST(l_suppkey AS STRING), CAST(NULL AS STRING) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM @lineitem) y
  UNION ALL SELECT 'Q' || CAST(l_partkey AS STRING), 'http://www.wikidata.org/entity/Q9000' || CAST(l_suppkey AS STRING), 'http://www.w3.org/2000/01/rdf-schema#label', 'literal', 'supplier ' || CAST(l_suppkey AS STRING) || ' ' || l, CASE WHEN l = 'plain' THEN CAST(NULL AS STRING) ELSE l END
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM @lineitem) y, (SELECT 'de' AS l UNION ALL SELECT 'en' UNION ALL SELECT 'fr' UNION ALL SELECT 'plain') x WHERE (l = 'de' AND l_suppkey % 3 = 0) OR (l = 'en' AND l_suppkey % 4 > 0) OR (l = 'fr') OR (l = 'plain' AND l_suppkey % 5 = 0)""")

VIEWS["wat"] = ((), """
  SELECT event_id AS id, event_id % 200 AS tree, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id, CAST(value AS DECIMAL(12,2)) AS amount, CAST(ts AS DATE) AS watered_on, ts AS created_at
  FROM @events WHERE event_type = 'purchase'""")

VIEWS["adopt"] = ((), "SELECT event_id AS id, event_id % 40 AS tree, user_id, ts FROM @events WHERE event_type = 'click'")


def _text(name: str, table: str, array_base: int, spark: bool) -> str:
    body = VIEWS[name][1]
    body = re.sub(r"\[#(\d+)\]", lambda m: f"[{int(m[1]) + array_base}]", body)
    body = body.replace("@range(60)", "range(60)" if spark else "(SELECT range AS id FROM range(60)) r")
    body = re.sub(r"strpos_\((\w+)\)", r"instr(\1, ' ')", body)
    return re.sub(r"@(\w+)", lambda m: table.format(m[1]), body)


def chain(names: tuple[str, ...]) -> list[str]:
    """The views and those they need, in order."""
    out: list[str] = []
    for n in names:
        for x in (*chain(VIEWS[n][0]), n):
            if x not in out:
                out.append(x)
    return out


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; a name that is no view is a table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = chain(VIEWS[name][0])
    table = "parquet.`" + sf_dir + "/{}.parquet`"
    first = ", ".join(f"{n} AS ({_text(n, table, 0, True)})" for n in needs)
    return spark.sql((f"WITH {first} " if first else "") + _text(name, table, 0, True))


def sql(views: str, body: str, **ctes: str) -> str:
    """DuckDB SQL: the named views and further ones before the query."""
    names = chain(tuple(views.split()))
    parts = [f"{n} AS ({_text(n, '{}', 1, False)})" for n in names] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body
