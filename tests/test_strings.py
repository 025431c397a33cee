"""One case per naming rule, on single rows."""

import random

import pytest
from pyspark.sql import functions as F

from grove.functions import scalars
from grove.functions import strings as st


def values(spark, fn, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


CASES = {
    "normalize_quotes": (st.normalize_quotes, {"a ‘b’": "a 'b'", "`c`": "'c'", "ʽd": "'d", "e'": "e'"}),
    "normalize": (st.normalize, {"  Acer\t CAMPESTRE ": "acer campestre", " Tilia ssp. x ": "tilia subsp. x", "Rosa ssp.": "rosa ssp.", "Ulmus `Nana`": "ulmus 'nana'", "": "", None: None}),
    "remove_hybrid": (st.remove_hybrid, {"Tilia × Europaea": "tilia europaea", "×Sorbopyrus auricularis": "sorbopyrus auricularis", "Acer x freemanii": "acer freemanii", "x acer": "x acer", "Taxus x": "taxus x", "Salix alexa": "salix alexa"}),
    "strip_cultivar": (st.strip_cultivar, {"Acer rubrum ‘Red Sunset’": "Acer rubrum", "Rubus Aggregat": "Rubus", "Rosa canina f. alba": "Rosa canina", "Pinus VAR. nana x": "Pinus x", "Quercus robur": "Quercus robur"}),
    "strip_authors": (
        st.strip_authors,
        {
            "Ulmus glabra Huds.": "Ulmus glabra", "Pinus nigra J.F.Arnold subsp. laricio (Poir.) Maire": "Pinus nigra subsp. laricio", "Tilia × europaea L.": "Tilia × europaea", "Rosa": "Rosa", "Thuja plicata(Donn) D.Don": "Thuja plicata",
            "Salix alba var. subsp. tristis": "Salix alba var. subsp.", "Salix alba L. f.": "Salix alba", "Rosa x": "Rosa x", "Populus  x   canescens  Sm.": "Populus x canescens", "": "",
        },
    ),
    "top_level_parens": (st.top_level_parens, {"a (b) c (d (e))": ["b", "d (e)"], "(open": [], "x) (y)": ["y"], "()": [""], "none": []}),
    "drop_infraspecific": (st.drop_infraspecific, {"Acer a subsp. b": "Acer a", "Acer a SSP. b c": "Acer a c", "Acer a f. b var. d": "Acer a"}),
    "slug": (st.slug, {"Größe der Ähre": "groesse_der_aehre", " -- Höhe (max.) - m ": "hoehe_max_m", "!!": "", "Straße": "strasse"}),
    "description_label": (st.description_label, {"Höhe – in m – mehr": "Höhe", "kurz": "kurz", " a – b": "a"}),
    "valid_entity_id": (st.valid_entity_id, {"Q1": True, "Q0": False, "Q012": False, "Q12\n": False, "": False, "q1": False, None: False}),
    "binomial_like": (st.binomial_like, {"Acer alba L.": True, "Acer × alba": True, "acer alba": False, "Acer Alba": False, "A. alba": False, "Acer": False}),
    "csv_field": (st.csv_field, {"plain": "plain", "a;b": '"a;b"', 'say "x"': '"say ""x"""', "two\nlines": '"two\nlines"', "comma,": "comma,"}),
    "amounts": (lambda c: scalars.amount_class(c.cast("double")), {"40": "flood", "20": "bucket", "5": "can", "4.9": "drop"}),
    "percent": (lambda c: scalars.clamped_percent(c.cast("double"), 50), {"-3": 0.0, "25": 50.0, "80": 100.0, None: None}),
    "retry": (lambda c: scalars.retry_delay_ms(c.cast("int")), {"0": 1000, "3": 8000, "5": 30000, "40": 30000}),
    "default": (lambda c: scalars.or_default(c, "?", blank_too=True), {"": "?", None: "?", "x": "x"}),
    "sizes": (lambda c: scalars.cluster_size(c.cast("int")), {"1001": 100, "1000": 50, "501": 50, "101": 10, "100": 20}),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    fn, cases = CASES[name]
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_brackets_against_a_counter(spark):
    rng = random.Random(1)
    inputs = ["".join(rng.choice("ab() ") for _ in range(rng.randint(0, 14))) for _ in range(300)]

    def plain(text):
        depth, cur, out = 0, "", []
        for ch in text:
            if ch == "(":
                depth += 1
                cur = cur + ch if depth > 1 else ""
            elif ch == ")" and depth:
                depth -= 1
                if depth == 0:
                    out.append(cur)
                else:
                    cur += ch
            elif depth:
                cur += ch
        return out

    assert values(spark, st.top_level_parens, inputs) == [plain(t) for t in inputs]


def test_vocabulary_and_toggle(spark):
    df = spark.createDataFrame([("CommonsMedia", "P989"), ("CommonsMedia", "P18"), ("Quantity", "P1"), ("Odd", "P2")], "t string, p string")
    assert [r[0] for r in df.select(scalars.vocabulary_type(F.col("t"), F.col("p"))).collect()] == ["audio", "image", "number", "string"]
    lists = spark.createDataFrame([(["a", "b"],), (["b"],), ([],)], "x array<string>")
    assert [r[0] for r in lists.select(scalars.toggled(F.col("x"), F.lit("a"))).collect()] == [["b"], ["b", "a"], ["a"]]
    assert [r[0] for r in lists.select(scalars.hidden_by_filter(F.col("x"), F.lit("a"))).collect()] == [False, True, False]
