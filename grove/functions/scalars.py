"""Small value functions: vocabularies, classes, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: datatype to value vocabulary; media are images but for the audio property (fixed values)
VOCABULARY = {"WikibaseItem": "string", "String": "string", "Quantity": "number", "Url": "url", "GeoShape": "geoshape"}
KNOWN_DATATYPES = [*VOCABULARY, "CommonsMedia"]
AUDIO_PROPERTIES = ["P989"]


def vocabulary_type(datatype: Column, property_id: Column) -> Column:
    out = F.when(datatype == "CommonsMedia", F.when(property_id.isin(*AUDIO_PROPERTIES), "audio").otherwise("image"))
    for known, word in VOCABULARY.items():
        out = out.when(datatype == known, word)
    return out.otherwise("string")


def known_datatype(datatype: Column) -> Column:
    return F.coalesce(datatype.isin(*KNOWN_DATATYPES), F.lit(False))


def value_type(is_bool: Column, is_list: Column, is_number: Column) -> Column:
    """Booleans are tested before numbers."""
    return F.when(is_bool, "boolean").when(is_list, "string").when(is_number, "number").otherwise("string")


def clamped_percent(value: Column, most: float) -> Column:
    """value as a share of most, kept within 0 and 100; null stays null."""
    return F.when(value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), value / F.lit(float(most)) * 100)))


def amount_class(amount: Column) -> Column:
    return F.when(amount >= 40, "flood").when(amount >= 20, "bucket").when(amount >= 5, "can").otherwise("drop")


def cluster_size(count: Column) -> Column:
    """Icon size of a marker cluster."""
    return F.when(count > 1000, 100).when(count > 500, 50).when(count > 100, 10).otherwise(20)


def viewer_label(user: Column, me: Column) -> Column:
    return F.when(user.isNotNull() & (user == me), "Du").otherwise("anonym")


def german_date(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy")


def retry_delay_ms(attempt: Column) -> Column:
    return F.least(F.lit(30000).cast("long"), (F.pow(F.lit(2.0), attempt) * 1000).cast("long"))


def surrogate_key(*parts: Column) -> Column:
    """A key that depends on the natural key alone, so it is the same in every run."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]), 256)


def or_default(c: Column, default: str, blank_too: bool = False) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")) if blank_too else c, F.lit(default))


def toggled(values: Column, value: Column) -> Column:
    """The list without the value if it is in there, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def hidden_by_filter(selected: Column, species: Column) -> Column:
    """An empty selection hides nothing."""
    return (F.size(selected) > 0) & ~F.coalesce(F.array_contains(selected, species), F.lit(False))
