"""Reconciliation of names against a reference by a cascade of eight levels; the first hit decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as st
from ..sources.scratch import stored
from .identity import first_rows

#: order of the levels in reports (fixed values)
LEVELS = ["existing", "exact", "author_stripped", "normalized", "hybrid_agnostic", "infraspecific_stripped", "synonym", "parenthetical_synonym", "manual"]


def lookups(ref: DataFrame) -> DataFrame:
    """Reference rows by kind and key: exact names (the last row wins), normalized and hybrid-free ones (the first wins); blank ids stay in."""
    hit = F.struct(F.col("qid"), F.col("botanic").alias("name")).alias("hit")
    kinds = [("exact", F.col("botanic"), -F.col("pos")), ("normalized", st.normalize(F.col("botanic")), F.col("pos")), ("no_hybrid", st.remove_hybrid(F.col("botanic")), F.col("pos"))]
    keys = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key"), order.alias("order")) for kind, key, order in kinds])).alias("k")
    return ref.select(hit, keys).groupBy("k.kind", "k.key").agg(F.min_by("hit", "k.order").alias("hit"))


def key_of(order: int | Column, kind: str, level: str, key: Column, name: Column | None = None) -> Column:
    """One way to look a name up; `name` is what a hit reports instead of the reference's own spelling."""
    order = F.lit(order) if isinstance(order, int) else order
    name = F.lit(None) if name is None else name
    return F.struct(order.cast("int").alias("order"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), key.alias("key"), name.cast("string").alias("as_name"))


def resolving_keys(order: int | Column, level: str, name: Column) -> list[Column]:
    """Exact, then author-free normalized, then author-free hybrid-free."""
    bare = st.strip_authors(name)
    keys = {"exact": name, "normalized": st.normalize(bare), "no_hybrid": st.remove_hybrid(bare)}
    return [key_of(order + i, kind, level, key, name) for i, (kind, key) in enumerate(keys.items())]


def resolved_synonyms(synonyms: DataFrame, table: DataFrame) -> DataFrame:
    """The first entry of each synonym with what its target resolves to (null: nowhere), as lookups of kind synonym."""
    entry = first_rows(synonyms, ["botanic"], "pos").select("botanic", "target")
    tries = entry.select("botanic", "target", F.explode(F.array(*resolving_keys(0, "synonym", F.col("target")))).alias("t")).select("botanic", "target", "t.*")
    found = tries.join(table, ["kind", "key"], "left").groupBy("botanic", "target").agg(F.min_by(F.col("hit.qid"), F.when(F.col("hit").isNotNull(), F.col("order"))).alias("qid"), F.max(F.col("hit").isNotNull()).alias("there"))
    hit = F.when(F.col("there"), F.struct("qid", F.col("target").alias("name")))
    return found.select(F.lit("synonym").alias("kind"), F.col("botanic").alias("key"), hit.alias("hit"))


def reconcile(ext: DataFrame, ref: DataFrame, synonyms: DataFrame, manual: DataFrame) -> DataFrame:
    """Each row of ext (pos, botanic, strain, qid, ref_botanic) with level (null: no match), match_qid and match_botanic.

    A row with an id keeps it. The synonym level looks at the name, its author-free, infraspecific-free and cultivar-free forms:
    the first with an entry decides, even if that entry's target is found nowhere. The bracket level tries its candidates until
    one resolves. Levels depend on the name alone, so distinct names are looked up, all their keys in one join; the least
    order that hits is one aggregate.
    """
    name = F.col("botanic")
    table = stored(lookups(ref))  # read for the synonyms' targets and for the names
    by_hand = manual.groupBy(F.col("botanic").alias("key")).agg(F.max("qid").alias("q")).select(F.lit("manual").alias("kind"), "key", F.struct(F.col("q").alias("qid"), F.lit(None).cast("string").alias("name")).alias("hit"))
    everything = table.unionByName(resolved_synonyms(synonyms, table)).unionByName(by_hand)
    names = stored(ext.select("botanic").distinct().withColumn("bare", st.strip_authors(name)))  # many keys are made of the bare name
    bare = F.col("bare")
    forms = [name, bare, st.drop_infraspecific(bare), st.strip_cultivar(name)]
    fixed = [
        key_of(1, "exact", "exact", name), key_of(2, "exact", "author_stripped", F.when(bare != name, bare)), key_of(3, "normalized", "normalized", st.normalize(bare)),
        key_of(4, "no_hybrid", "hybrid_agnostic", st.remove_hybrid(bare)), key_of(5, "normalized", "infraspecific_stripped", st.normalize(st.drop_infraspecific(bare))),
        *[key_of(6 + i, "synonym", "synonym", f) for i, f in enumerate(forms)], key_of(2**30, "manual", "manual", name),
    ]
    keys = names.select("botanic", F.explode(F.array(*fixed)).alias("t")).select("botanic", "t.*").unionByName(bracket_keys(names))
    hits = keys.join(everything, ["kind", "key"])
    found = F.struct("order", "level", F.col("hit.qid").alias("qid"), F.coalesce("as_name", F.col("hit.name")).alias("name"))
    synonym = F.col("kind") == "synonym"
    best = hits.groupBy("botanic").agg(F.min(F.when(~synonym, found)).alias("plain"), F.min_by(F.when(F.col("hit").isNotNull(), found), F.when(synonym, F.col("order"))).alias("syn"))
    pick = F.when(F.col("syn").isNotNull() & (F.col("plain").isNull() | (F.col("syn.order") < F.col("plain.order"))), F.col("syn")).otherwise(F.col("plain"))
    out = ext.join(best.select("botanic", pick.alias("m")), "botanic", "left")
    has_id = F.coalesce(F.col("qid"), F.lit("")) != ""
    choose = lambda own, other: F.when(has_id, own).otherwise(other)
    return out.select("pos", "botanic", "strain", choose(F.lit("existing"), F.col("m.level")).alias("level"), choose(F.col("qid"), F.col("m.qid")).alias("match_qid"), choose(F.col("ref_botanic"), F.col("m.name")).alias("match_botanic"))


def bracket_keys(names: DataFrame) -> DataFrame:
    """Keys of the bracket level: each binomial-like candidate by its three lookups, in order."""
    genus = F.element_at(F.split("botanic", r"\s+", 2), 1)
    groups = names.filter(F.contains("botanic", F.lit("("))).select("botanic", genus.alias("genus"), F.posexplode(st.top_level_parens(F.col("botanic"))).alias("i", "g"))
    candidates = groups.select("botanic", "i", st.strip_authors(st.expand_genus(F.col("g"), F.col("genus"))).alias("candidate")).filter(st.binomial_like(F.col("candidate")))
    return candidates.select("botanic", F.explode(F.array(*resolving_keys(100 + 3 * F.col("i"), "parenthetical_synonym", F.col("candidate")))).alias("t")).select("botanic", "t.*")


def level_report(matches: DataFrame) -> DataFrame:
    """Matches a level, with the level's place in the report."""
    place = F.coalesce(*[F.when(F.col("level") == x, i) for i, x in enumerate(LEVELS)])
    return matches.filter("level is not null").groupBy("level").agg(F.count("*").alias("n")).withColumn("place", place)


def unmatched(matches: DataFrame) -> DataFrame:
    label = F.when(F.coalesce("strain", F.lit("")) != "", F.concat("botanic", F.lit(" ["), "strain", F.lit("]"))).otherwise(F.col("botanic"))
    return matches.filter("level is null").select("pos", label.alias("label"))


def write_back(ext: DataFrame, matches: DataFrame) -> DataFrame:
    """ext with the ids found: the last match of (botanic, strain) wins; a reference name that is there stays."""
    found = first_rows(matches.filter("level is not null").withColumn("strain", F.coalesce("strain", F.lit(""))), ["botanic", "strain"], "pos", last=True)
    found = found.select("botanic", F.col("strain").alias("__strain"), "match_qid", "match_botanic")
    rows = ext.withColumn("__strain", F.coalesce("strain", F.lit(""))).join(found, ["botanic", "__strain"], "left")
    return rows.select("pos", "botanic", "strain", F.coalesce("match_qid", "qid").alias("qid"), F.coalesce(F.nullif("ref_botanic", F.lit("")), "match_botanic", F.lit("")).alias("ref_botanic"))
