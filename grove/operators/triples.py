"""Facts as rows: entity, s, p, o_kind (iri or literal), o_value, o_lang. A graph is a set, so results are distinct.

Everything happens within an entity's own graph, so joins go by (entity, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as st

WD = "http://www.wikidata.org/entity/"
WDT = "http://www.wikidata.org/prop/direct/"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DESCRIPTION = "http://schema.org/description"
PROPERTY_TYPE = "http://wikiba.se/ontology#propertyType"
ONTOLOGY = "http://wikiba.se/ontology#"
NS = "http://grove.example/ns#"
COLUMNS = ["entity", "s", "p", "o_kind", "o_value", "o_lang"]
#: label preference of inlining, of the export, of property metadata and of descriptions; plain is an untagged literal (fixed values)
CHAINS = {"inline": ["de", "en"], "export": ["de", "plain", "en"], "metadata": ["de", "plain", "en"], "description": ["de", "en"]}


def subject() -> Column:
    return F.concat(F.lit(WD), "entity")


def property_id() -> Column:
    return st.local_id(F.col("p"), WDT)


def main_facts(raw: DataFrame, ignored: DataFrame) -> DataFrame:
    """Labels and direct properties of each entity itself, without ignored properties."""
    own = raw.filter(F.col("s") == subject()).filter((F.col("p") == LABEL) | F.startswith("p", F.lit(WDT)))
    return own.withColumn("property_id", property_id()).join(ignored.select("property_id"), "property_id", "left_anti").select(*COLUMNS)


def place_in(chain: str) -> Column:
    """Place of a literal's language in the chain; null if it has none."""
    lang = F.coalesce("o_lang", F.lit("plain"))
    return F.coalesce(*[F.when(lang == x, i) for i, x in enumerate(CHAINS[chain])])


def is_label(chain: str, predicate: str = LABEL) -> Column:
    return (F.col("p") == predicate) & (F.col("o_kind") == "literal") & place_in(chain).isNotNull()


def ranked_label(chain: str) -> Column:
    """A label behind its language's place in the chain, so that the least text is the preferred one; null for other facts."""
    return F.when(is_label(chain), F.concat(place_in(chain).cast("string"), "o_value"))


def label_of(ranked: str) -> Column:
    return F.substr(F.col(ranked), F.lit(2))


def language_of(ranked: str, chain: str) -> Column:
    return F.coalesce(*[F.when(F.startswith(ranked, F.lit(str(i))), x) for i, x in enumerate(CHAINS[chain]) if x != "plain"])


def preferred_labels(raw: DataFrame, chain: str, predicate: str = LABEL, keys: tuple[str, ...] = ("entity", "s")) -> DataFrame:
    """(keys, label, label_lang): the literal whose language comes first in the chain; of several, the least text.

    One aggregate: the least (place in the chain, text) is combined before the shuffle.
    """
    labels = raw.filter(is_label(chain, predicate)).withColumn("place", place_in(chain))
    best = labels.groupBy(*keys).agg(F.min(F.struct("place", "o_value", "o_lang")).alias("b"))
    return best.select(*keys, F.col("b.o_value").alias("label"), F.col("b.o_lang").alias("label_lang"))


#: what an entity's graph makes of a fact: of another subject; the entity's own; of these, one that points to an entity; one whose property is
#: inlined and leaves nothing, or stays beside its label
OTHER, OWN, LINK, INLINED, INLINED_KEPT = range(5)


def told_by_graphs(raw: DataFrame, config: DataFrame) -> DataFrame:
    """raw, each fact once, with what its entity's graph tells of it: role (as above), inline_target of the property, ranked (the label for inlining of
    the fact's node), met (a link that inlining leaves points to that node) and itself (one points to the entity).

    A fact's node is what a link points to, else the subject. So facts are dealt by entity once, and windows over a node's facts stand for
    the joins of links with labels and of facts with links. Until then rows are kept short, as they are copied often: node stands for s or o_value.
    """
    rules = config.select("property_id", (F.col("action") == "ignore").alias("ignored"), "inline_target", "keep_source")
    own = F.coalesce(F.col("s") == subject(), F.lit(False))
    facts = raw.withColumn("property_id", F.when(own & F.startswith("p", F.lit(WDT)), property_id())).join(rules, "property_id", "left")
    mine = own & ((F.col("p") == LABEL) | (F.col("property_id").isNotNull() & ~F.coalesce("ignored", F.lit(False))))
    entity, iri = F.startswith("o_value", F.lit(WD)), F.col("o_kind") == "iri"
    role = F.when(mine & iri & F.col("inline_target").isNotNull(), F.when(F.col("keep_source"), INLINED_KEPT).otherwise(INLINED)).when(mine & iri & entity, LINK).when(mine, OWN).otherwise(OTHER)
    facts = facts.withColumn("role", role)
    link = F.col("role") >= LINK
    facts = facts.select("entity", F.when(link, F.col("o_value")).otherwise(F.col("s")).alias("node"), "role", F.when(link, F.col("inline_target")).alias("inline_target"), "p", "o_kind", F.when(~link, F.col("o_value")).alias("o_value"), "o_lang")
    node, graph = Window.partitionBy("entity", "node"), Window.partitionBy("entity")
    strength = F.when(link & F.startswith("node", F.lit(WD)), F.when(F.col("role") == INLINED, 1).otherwise(2))  # 1: a link that a label takes the place of
    facts = facts.repartition("entity").withColumns({"ranked": F.min(F.when(F.col("node").isNotNull(), ranked_label("inline"))).over(node), "strength": F.max(strength).over(node)})
    facts = facts.withColumn("met", F.coalesce((F.col("strength") == 2) | ((F.col("strength") == 1) & F.col("ranked").isNull()), F.lit(False)))
    facts = facts.withColumn("itself", F.coalesce(F.max(F.when(F.col("node") == subject(), F.col("met"))).over(graph), F.lit(False)))
    back = {"s": F.when(link, subject()).otherwise(F.col("node")), "o_value": F.when(link, F.col("node")).otherwise(F.col("o_value"))}
    return facts.select(*[back[c].alias(c) if c in back else c for c in COLUMNS], "role", "inline_target", "ranked", "met", "itself")


NAMED = f"(role >= {INLINED} and ranked is not null)"
DROPPED = f"(role = {INLINED} and ranked is not null)"


def with_inlined(told: DataFrame, kept: str) -> DataFrame:
    """Facts that are kept, and the labels of inlined links as facts of their own. Two links may have the same one: of such facts, and only these, one is taken."""
    new = F.expr(f"case when {kept} and {NAMED} then array(false, true) when {kept} then array(false) when {NAMED} then array(true) end")
    rows = told.withColumn("new", F.explode(new))
    made = {"p": F.concat(F.lit(NS), "inline_target"), "o_kind": F.lit("literal"), "o_value": label_of("ranked"), "o_lang": language_of("ranked", "inline")}
    rows = rows.select(*[F.when(F.col("new"), made[c]).otherwise(F.col(c)).alias(c) if c in made else c for c in COLUMNS])
    rows = rows.withColumn("same", F.when(F.startswith("p", F.lit(NS)), F.struct(*COLUMNS[1:])))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("entity", "same").orderBy("s"))).filter("same is null or n = 1").select(*COLUMNS)


def inline_labels(raw: DataFrame, config: DataFrame) -> DataFrame:
    """Own facts; for inlined properties, the object's label as a fact of its own; the link goes unless it is kept or has no label."""
    told = told_by_graphs(raw.filter((F.col("s") == subject()) | is_label("inline")), config).filter(f"role <> {OTHER}")
    return with_inlined(told, f"not {DROPPED}")


def links_to_entities(kept: DataFrame) -> DataFrame:
    return kept.filter((F.col("o_kind") == "iri") & F.startswith("o_value", F.lit(WD))).select("entity", F.col("o_value").alias("s"))


def with_secondary(kept: DataFrame, raw: DataFrame) -> DataFrame:
    """Adds all raw facts of entities that kept facts point to: one hop."""
    return kept.unionByName(raw.join(links_to_entities(kept), ["entity", "s"], "left_semi").select(*COLUMNS)).distinct()


def closure(raw: DataFrame, ignored: DataFrame) -> DataFrame:
    """main_facts with all raw facts of entities that they point to, as with_secondary gives them. raw is a set and main_facts a part of it, so that only
    the other part is looked up, and nothing needs to be made distinct."""
    kept = main_facts(raw, ignored)
    told = raw.join(ignored.select("property_id", F.lit(True).alias("ignored")).distinct(), property_id() == F.col("property_id"), "left")
    mine = (F.col("s") == subject()) & ((F.col("p") == LABEL) | (F.startswith("p", F.lit(WDT)) & F.col("ignored").isNull()))
    others = told.filter(~F.coalesce(mine, F.lit(False))).select(*COLUMNS)
    return kept.unionByName(others.join(links_to_entities(kept), ["entity", "s"], "left_semi").select(*COLUMNS))


def german_or_english(facts: DataFrame) -> DataFrame:
    return facts.filter("o_lang is null or o_lang in ('de', 'en')")


def process(raw: DataFrame, config: DataFrame) -> DataFrame:
    """Own facts, inlined, with what they point to, in German, English or no language; in this order.

    raw is a set, so a fact can only come twice where an entity points to itself. Such a one brings in its facts that are not among its own
    ones and the links that inlining dropped; what others point to is never an own fact. So nothing needs to be made distinct here.
    Literals in other languages tell nothing and go first; links in other languages still point to something.
    """
    told = told_by_graphs(raw.filter("o_lang is null or o_lang in ('de', 'en') or o_kind = 'iri'"), config)
    return german_or_english(with_inlined(told, f"(case when role = {OTHER} then met else itself or not {DROPPED} end)"))


def resolved_literals(literals: DataFrame, keys: list[str]) -> DataFrame:
    """Of tagged literals all German ones, else all English ones; untagged ones always. The choice is an aggregate joined back."""
    german = literals.filter("o_lang = 'de'").select(*keys).distinct().withColumn("german", F.lit(True))
    rows = literals.join(german, keys, "left")
    return rows.filter(F.col("o_lang").isNull() | (F.col("o_lang") == F.when(F.col("german"), "de").otherwise("en"))).drop("german")


def of_entities(facts: DataFrame, entities: DataFrame, key: str = "qid") -> DataFrame:
    """Facts of entities that a table names."""
    return facts.join(entities.select(F.col(key).alias("entity")).distinct(), "entity", "left_semi")


def export(targets: DataFrame, facts: DataFrame, config: DataFrame) -> DataFrame:
    """Flat rows (line, qid, botanic, common, property_id, attribute_name, value, group_name) of each target's importable facts.

    Inlined properties are read from their own facts; the others directly, where links to entities give the label (without one
    nothing) and other links their address. Several targets of an entity each get all its values. Of tagged literals of a property
    all German ones count, else all English ones; untagged ones always. Links meet labels, and literals those of their property, in one window.
    """
    props = config.filter("importable").select("property_id", "inline_target", "attribute_name", F.coalesce("import_group", F.lit("")).alias("group_name"))
    predicate = F.when(F.col("inline_target").isNotNull(), F.concat(F.lit(NS), "inline_target")).otherwise(F.concat(F.lit(WDT), "property_id"))
    uses = props.groupBy(predicate.alias("p")).agg(F.collect_list(F.struct("property_id", "attribute_name", "group_name")).alias("uses"))
    rows = facts.join(uses, "p", "left").withColumn("used", F.coalesce((F.col("s") == subject()) & F.col("uses").isNotNull(), F.lit(False)))
    direct = F.col("used") & F.startswith("p", F.lit(WDT))
    rows = rows.withColumns({"link": F.coalesce(direct & (F.col("o_kind") == "iri"), F.lit(False)), "literal": F.coalesce(direct & (F.col("o_kind") == "literal"), F.lit(False)), "inlined": ~direct & F.col("used")})
    rows = rows.filter(F.col("inlined") | F.col("link") | F.col("literal") | is_label("export"))
    rows = rows.withColumn("node", F.when(F.col("link"), F.col("o_value")).when(F.col("literal"), F.col("p")).otherwise(F.col("s")))
    node = Window.partitionBy("entity", "node")
    rows = rows.withColumns({"ranked": F.min(F.when(F.col("s").isNotNull(), ranked_label("export"))).over(node), "german": F.max(F.col("literal") & F.coalesce(F.col("o_lang") == "de", F.lit(False))).over(node)})
    value = F.when(F.col("link") & F.startswith("o_value", F.lit(WD)), label_of("ranked")).otherwise(F.col("o_value"))
    told = F.col("o_lang").isNull() | (F.col("o_lang") == F.when(F.col("german"), "de").otherwise("en"))
    rows = rows.withColumn("value", value).filter(F.col("inlined") | (F.col("link") & F.col("value").isNotNull()) | (F.col("literal") & told))
    values = rows.select("entity", "value", F.explode("uses").alias("use")).select("entity", "value", "use.*")
    out = targets.join(values, targets["qid"] == values["entity"])
    return out.select("line", "qid", "botanic", "common", "property_id", F.coalesce("attribute_name", F.lit("")).alias("attribute_name"), "value", "group_name")


def new_properties(facts: DataFrame, config: DataFrame, metadata: DataFrame) -> DataFrame:
    """Direct properties that the configuration lacks, with the defaults that their type suggests."""
    used = facts.filter(F.startswith("p", F.lit(WDT))).select(property_id().alias("property_id")).distinct()
    rows = used.join(config.select("property_id"), "property_id", "left_anti").join(metadata, "property_id", "left")
    item = F.col("type") == "WikibaseItem"
    target = F.coalesce(st.slug(F.col("label")), F.lower("property_id"))
    return rows.select(
        "property_id", F.coalesce("type", F.lit("")).alias("type"), F.when(item, "inline").otherwise("").alias("action"),
        F.when(item, F.concat(F.lit('{"target": "'), target, F.lit('", "keep_source": true}'))).otherwise("").alias("config"),
        F.coalesce("description", F.lit("")).alias("description"), F.when(F.col("type") == "ExternalId", "skip").otherwise("").alias("import"),
    )


def vocabulary_iris(facts: DataFrame, config: DataFrame) -> DataFrame:
    """Properties that need a description: used ones, inlined ones and the sources of inlining."""
    used = facts.filter(F.startswith("p", F.lit(WDT))).select(st.swap_prefix(F.col("p"), WDT, WD).alias("iri"))
    inline = config.filter("inline_target is not null")
    own = inline.select(F.concat(F.lit(WD), "property_id").alias("iri"))
    source = F.when(F.startswith("inline_source", F.lit(WDT)), st.swap_prefix(F.col("inline_source"), WDT, WD)).when(F.col("inline_source").rlike(r"^P\d+\z"), F.concat(F.lit(WD), "inline_source"))
    return used.unionByName(own).unionByName(inline.select(source.alias("iri")).filter("iri is not null")).distinct()


def namespace_labels(facts: DataFrame, config: DataFrame) -> DataFrame:
    """Label of each namespace predicate that facts use: the property's description, else its target in words."""
    used = facts.filter(F.startswith("p", F.lit(NS))).select("p").distinct()
    inline = config.filter("inline_target is not null").select(F.concat(F.lit(NS), "inline_target").alias("p"), F.coalesce(F.nullif("description", F.lit("")), st.humanize(F.col("inline_target"))).alias("label"))
    return inline.join(used, "p", "left_semi").distinct()


def property_metadata(vocabulary: DataFrame) -> DataFrame:
    """type, label and description of each described property, pivoted from facts (s, p, o_kind, o_value, o_lang)."""
    rows = vocabulary.filter(F.startswith("s", F.lit(WD)))
    kinds = rows.filter((F.col("p") == PROPERTY_TYPE) & (F.col("o_kind") == "iri")).groupBy("s").agg(F.min(st.local_id(F.col("o_value"), ONTOLOGY)).alias("type"))
    out = rows.select("s").distinct().join(kinds, "s", "left")
    out = out.join(preferred_labels(rows, "metadata", keys=("s",)).select("s", "label"), "s", "left")
    out = out.join(preferred_labels(rows, "description", DESCRIPTION, keys=("s",)).select("s", F.col("label").alias("about")), "s", "left")
    return out.select(st.local_id(F.col("s"), WD).alias("property_id"), F.coalesce("type", F.lit("")).alias("type"), "label", st.build_description(F.col("label"), F.col("about")).alias("description"))
