"""Scientific-name and label functions, Column to Column; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: quote characters that count as an apostrophe (fixed values)
QUOTES = "ʽ‘’`"
#: tokens after which an epithet follows (fixed values)
MARKERS = ["subsp.", "ssp.", "var.", "f.", "×", "x"]
#: what a hybrid sign, a cultivar, an aggregate, a rank with its epithet, an abbreviated genus and the two words of a binomial look like (fixed values)
CROSS, LONE_X = r"×\s*", r"(?<=\S)\s+x\s+(?=\S)"
CULTIVAR, AGGREGATE, VARIETY = r"\s+'.*'$", r"(?i)\s+aggregat$", r"(?i)\s+(f\.|var\.)\s+\S+"
RANK = r"(?i)\s+(subsp\.|ssp\.|var\.|f\.)\s+\S+"
ABBREVIATED = r"^[A-Z]\.\s*"
GENUS, EPITHET = "^[A-Z][a-zA-ZäöüÄÖÜß]+$", "^([a-zäöüß]+|×|x)$"
SPACE = r"\p{IsWhite_Space}"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim removes U+0020 only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def normalize_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES, "'" * len(QUOTES))


def normalize(c: Column) -> Column:
    """The identity of a name: quotes, case, white space and the notation of subspecies made alike, in this order."""
    return F.replace(collapsed(trimmed(F.lower(normalize_quotes(c)))), F.lit(" ssp. "), F.lit(" subsp. "))


def remove_hybrid(c: Column) -> Column:
    bare = F.regexp_replace(normalize(c), CROSS, "")
    return trimmed(collapsed(F.regexp_replace(bare, LONE_X, " ")))


def strip_cultivar(c: Column) -> Column:
    bare = F.regexp_replace(normalize_quotes(c), CULTIVAR, "")
    bare = F.regexp_replace(bare, AGGREGATE, "")
    return trimmed(F.regexp_replace(bare, VARIETY, ""))


def drop_infraspecific(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, RANK, ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def strip_authors(c: Column) -> Column:
    """Genus, species and marked epithets; a marker takes the next token, whatever it is, and a lone last one goes.

    A name of fewer than two tokens comes back unchanged, but for the space that is set before a bracket after a word.
    """
    spaced = F.regexp_replace(c, r"(\w)\(", "$1 (")
    parts = tokens(spaced)
    head = F.when((F.size(parts) >= 3) & F.get(parts, F.lit(1)).isin("×", "x"), 3).otherwise(2)
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("marker"))

    def step(acc: Column, token: Column) -> Column:
        took = F.struct(F.array_append(F.array_append(acc["kept"], acc["marker"]), token).alias("kept"), F.lit(None).cast("string").alias("marker"))
        marked = F.struct(acc["kept"].alias("kept"), token.alias("marker"))
        return F.when(acc["marker"].isNotNull(), took).when(token.isin(*MARKERS), marked).otherwise(acc)

    rest = F.aggregate(F.slice(parts, head + 1, F.greatest(F.size(parts) - head, F.lit(0))), empty, step, lambda a: a["kept"])
    return F.when(F.size(parts) < 2, spaced).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), head), rest), " "))


def top_level_parens(c: Column) -> Column:
    """Contents of the outermost brackets in order, inner ones kept; unclosed and stray brackets are left out."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, ch: Column) -> Column:
        grown = F.concat(a["text"], ch)
        state = lambda depth, text, out: F.struct(depth.alias("depth"), text.alias("text"), out.alias("out"))
        return (
            F.when(ch == "(", state(a["depth"] + 1, F.when(a["depth"] == 0, "").otherwise(grown), a["out"]))
            .when((ch == ")") & (a["depth"] == 1), state(F.lit(0), F.lit(""), F.array_append(a["out"], a["text"])))
            .when((ch == ")") & (a["depth"] > 1), state(a["depth"] - 1, grown, a["out"]))
            .when(a["depth"] > 0, state(a["depth"], grown, a["out"]))
            .otherwise(a)
        )

    return F.aggregate(F.split(c, ""), start, step, lambda a: a["out"])


def expand_genus(bracket: Column, genus: Column) -> Column:
    """`A. alba` with genus Abies: `Abies alba`."""
    return F.when(bracket.rlike(ABBREVIATED), F.concat(genus, F.lit(" "), F.regexp_replace(bracket, ABBREVIATED, ""))).otherwise(bracket)


def binomial_like(c: Column) -> Column:
    parts = tokens(c)
    both = F.get(parts, F.lit(0)).rlike(GENUS) & F.get(parts, F.lit(1)).rlike(EPITHET)
    return F.coalesce(both, F.lit(False))


def slug(c: Column) -> Column:
    """Lower-case ASCII identifier of a label; German letters are spelled out."""
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(F.lower(c) if letter == "ä" else c, F.lit(letter), F.lit(spelled))
    bare = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\s-]", ""), r"[\s-]+", "_")
    return F.regexp_replace(bare, "^_+|_+$", "")


def description_label(c: Column) -> Column:
    return trimmed(F.substring_index(c, " – ", 1))


def build_description(label: Column, description: Column) -> Column:
    return F.concat_ws(" – ", label, description)


def humanize(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def valid_entity_id(c: Column) -> Column:
    """Q and a whole number without leading zeros; null is not valid."""
    return F.coalesce(c.rlike(r"^Q[1-9][0-9]*\z"), F.lit(False))


def local_id(iri: Column, prefix: str) -> Column:
    """What follows the prefix of an IRI; an IRI without it comes back as it is."""
    return F.when(F.startswith(iri, F.lit(prefix)), F.substr(iri, F.lit(len(prefix) + 1))).otherwise(iri)


def swap_prefix(iri: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(iri, F.lit(old)), F.concat(F.lit(new), F.substr(iri, F.lit(len(old) + 1)))).otherwise(iri)


def csv_field(c: Column, sep: str = ";") -> Column:
    """Quoted only where the separator, a quote or a line break stands in it; quotes inside are doubled."""
    return F.when(c.rlike(f'[{sep}"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def list_without_brackets(c: Column, most: int | None = None) -> Column:
    bare = F.translate(c, "[]'", "")
    return bare if most is None else F.substring(bare, 1, most)


def tri_state(c: Column, yes: str, no: str) -> Column:
    """yes, no and anything else as true, false and null."""
    return F.when(c == yes, True).when(c == no, False)


def request_bytes(base: str, **params: Column) -> Column:
    """Bytes of a request target whose parameters are percent-encoded (a space as +)."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()]
    return F.octet_length(F.concat(F.lit(base + "?"), F.concat_ws("&", *parts)))


def without(c: Column, text: str) -> Column:
    """A value without a piece of text that labels it, trimmed."""
    return trimmed(F.replace(trimmed(c), F.lit(text)))


def rewritten(url: Column, old: str, new: str) -> Column:
    """A path with one of its parts in place of another."""
    return F.replace(url, F.lit(old), F.lit(new))


def base_name(path: Column) -> Column:
    """What stands behind the last slash."""
    return F.substring_index(path, "/", -1)
