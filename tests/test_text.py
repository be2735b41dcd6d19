"""Text functions against the values of the fixtures."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import perturb as P
from lodestone.functions import text as T


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_norm(spark):
    texts = ["Black  ***  Cotton!!\tShirt", "ＡＢＣ", "①", None, "", "Café — Ω"]
    got = values(spark, T.norm(F.col("t")), [(t,) for t in texts])
    assert got[:3] == ["black cotton shirt", "abc", "1"]
    assert got[3:] == ["", "", "café ω"]
    assert got[1] == unicodedata.normalize("NFKC", texts[1]).lower()


def test_norm_plain_keeps_markers(spark):
    assert values(spark, T.norm_plain(F.col("t")), [("A key requirement is: X;  Y!",)]) == ["a key requirement is: x; y"]


def test_product_text(spark):
    schema = "title string, categories array<string>, features array<string>, details array<struct<k:string,v:string>>, store string, description array<string>"
    names = ["title", "categories", "features", "details", "store", "description"]
    rows = [("Red  Hat!", ["Hats", "Wool"], ["warm"], [("Size", "M"), ("Fit", None)], "Ｓhop", ["é" * 1000]), ("Hat", None, [], None, None, ["soft", "felt"])]
    df = spark.createDataFrame(rows, schema)
    whole = "red hat red hat hats wool hats wool warm size m fit none shop " + "é" * 1000
    for cap, column in ((900, T.product_text(*map(F.col, names))), (512, T.product_text(*map(F.col, names), cap=T.EMBEDDED_LENGTH))):
        assert [r[0] for r in df.select(column).collect()] == [whole[:cap], "hat hat soft felt"]


def test_flatten(spark):
    df = spark.createDataFrame([(["a", "b"], [("k", "v"), ("x", "y")], 3.5)], "l array<string>, e array<struct<k:string,v:string>>, s double")
    row = df.select(T.flatten(F.col("l"), "list").alias("l"), T.flatten(F.col("e"), "entries").alias("e"), T.flatten(F.col("s"), "scalar").alias("s")).first()
    assert tuple(row) == ("a b", "k v x y", "3.5")


def test_clean_constraint(spark):
    assert values(spark, T.clean_constraint(F.col("t")), [("  -- Machine   washable... ",), ("x" * 300,), (" -;,. ",)]) == ["Machine washable", "x" * 180, ""]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["Clothing, Shoes & Jewelry", "Women", "Shoes", "Walking"], "Shoes Walking"),
        (["Clothing"], "clothing item"),
        (None, "clothing item"),
        (["Men"], "Men"),
    ],
)
def test_coarse_category(spark, given, want):
    df = spark.createDataFrame([(given,)], "c array<string>")
    # the root "Clothing, Shoes & Jewelry" is cut at its comma, and "Shoes & Jewelry" stays
    assert df.select(T.coarse_category(F.col("c"))).first()[0] == want


def test_marked_constraints(spark):
    said = lambda m: values(spark, T.marked_constraints(T.norm_plain(F.col("t"))), [(m,)])[0]
    assert said("For that, what matters is: cotton; color: black.") == ["cotton", "color: black"]
    assert said("I'm looking for Shoes. A key requirement is: leather.") == ["leather"]
    assert said("I'm looking for Shoes, but I'm still exploring.") == ["shoes"]


def test_content_terms(spark):
    assert values(spark, T.content_terms(F.col("t")), [("the black black a shirt 42 x",)]) == [["black", "shirt", "42"]]


def test_compose_query(spark):
    df = spark.createDataFrame([("Accessories Belts", ["leather", "LEATHER", "Buckle closure"], "f"), (None, [], "f"), (None, [" ", "x"], "f")], "c string, l array<string>, f string")
    assert [r[0] for r in df.select(T.compose_query(F.col("c"), F.col("l"), F.col("f"))).collect()] == ["Accessories Belts leather Buckle closure", "f", "x"]


def test_messages_query(spark):
    df = spark.createDataFrame([("Shoes", ["I'm looking for Shoes, but I'm still exploring.", "For that, what matters is: leather; color: black."])], "c string, m array<string>")
    assert df.select(T.messages_query(F.col("c"), F.col("m"))).first()[0] == "Shoes leather color: black"


def test_category_phrase(spark):
    texts = [
        "I'm looking for Shoes Walking. A key requirement is: leather.",
        "I'm looking for Women Dresses, but I'm still exploring.",
        "I'm looking for Watches Wrist Watches. something old",
        "What else?",
        "I'm looking for St. John's Bay shirts. old",
    ]
    assert values(spark, T.category_phrase(F.col("t")), [(t,) for t in texts]) == ["Shoes Walking", "Women Dresses", "Watches Wrist Watches", None, "St"]


def test_classifier(spark):
    texts = ["budget around $40", "budget $40, cotton", "cotton", "color: brown", "wide width", "slim fit", "for hiking", "machine washable", "workout", "under 30"]
    want = ["budget", "budget", "material", "color", "size", "style", "use_case", "feature", "use_case", "budget"]
    assert values(spark, T.classify_constraint(F.col("t")), [(t,) for t in texts]) == want


def test_scenario(spark):
    rows = [
        ("I'm looking for X. A key requirement is: y.", 1, "unknown", "buying"),
        ("I'm looking for X, but I'm still exploring.", 1, "unknown", "browsing_or_boundary"),
        ("I'm looking for X. old", 1, "unknown", "intent_override"),
        ("I don't have a preference for color; please use your judgment.", 2, "browsing_or_boundary", "boundary"),
        ("For that, what matters is: x.", 2, "browsing_or_boundary", "browsing"),
        ("anything", 3, "buying", "buying"),
        ("Actually, ignore my earlier preference. What I need is: wool.", 3, "buying", "intent_override"),
    ]
    df = spark.createDataFrame(rows, "m string, t int, c string, w string")
    for r in df.select("w", T.route_scenario(F.col("m"), F.col("t"), F.col("c")).alias("g")).collect():
        assert r["g"] == r["w"]


def test_dialog_constraints(spark):
    def said(message, scenario="buying", turn=2):
        df = spark.createDataFrame([(message,)], "m string")
        return [tuple(x) for x in df.select(T.dialog_constraints(F.col("m"), F.lit(scenario), F.lit(turn))).first()[0]]

    assert said("For that, what matters is: cotton; color: black.") == [("cotton", "customer_reply"), ("color: black", "customer_reply")]
    assert said("What I need is: budget around $29.99.") == [("budget around $29", "override_new")]
    assert said("I'm looking for X. old one", "intent_override", 1) == [("old one", "override_initial")]
    assert said("hello") == []


def test_exact_constraints_and_budget(spark):
    got = values(spark, T.exact_constraints(F.col("t")), [("What I need is: budget around $29.99.",), ("plain",), ("For that, what matters is: a; b.",)])
    assert got == [["budget around $29.99"], ["plain"], ["a", "b"]]
    assert values(spark, T.parse_budget(F.col("t")), [("budget around $29.99",), ("budget around $1.2.3",), ("x",)]) == [29.99, None, None]
    assert values(spark, T.price_mentioned(F.col("t")), [("spend no more than 20",), ("x",)]) == ["20", None]


def test_titles(spark):
    key = T.title_key(F.col("t"))
    assert values(spark, key, [("Men's_Shirt (XL)",), (None,)]) == ["men s shirt xl", ""]
    variants = T.variant_tokens(T.title_tokens(key))
    assert values(spark, variants, [("Black Shirt Large 42mm",)]) == [["42mm", "black", "large"]]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]


def test_json_strings(spark):
    texts = ['["a", 1, "b"]', '```json\n{"constraints": ["x"]}\n```', "no", None, '{"other": 1}']
    assert values(spark, T.json_strings(F.col("t")), [(t,) for t in texts]) == [["a", "b"], ["x"], [], [], []]


def test_number_words(spark):
    got = values(spark, T.number_words(F.col("n")), [(0.0,), (19.0,), (42.0,), (300.0,), (999.0,), (29.99,), (1000.0,)], "n double")
    assert got == ["zero", "nineteen", "forty-two", "three hundred", "nine hundred ninety-nine", "29.99", "1000"]


def test_questions(spark):
    asked = spark.range(7).select(T.next_attribute(F.col("id"), "other_twice_rotate")).collect()
    assert [r[0] for r in asked] == ["other", "other", "feature", "material", "color", "style", "feature"]
    with pytest.raises(ValueError, match="policy"):
        T.next_attribute(F.col("id"), "no")


def test_finite_or(spark):
    assert values(spark, T.finite_or(F.col("t"), -1.0), [("2",), ("nan",), ("inf",), ("x",), (None,)]) == [2.0, -1.0, -1.0, -1.0, -1.0]


def test_explanation(spark):
    df = spark.createDataFrame([(["color: black", "Color: Black", "cotton", "wool"], 0.9), ([], 0.1), (["x" * 300], 0.5)], "c array<string>, p double")
    got = [r[0] for r in df.select(T.explanation(F.col("c"), F.col("p"))).collect()]
    assert got[0].startswith("Showing these because you mentioned black color and cotton. This looks like a strong match.")
    assert "still narrowing" in got[1] and len(got[2]) <= 240 and "…" in got[2]


def test_paraphrase(spark):
    m = "For that, what matters is: 95% Cotton, 5% Spandex; machine wash."
    df = spark.createDataFrame([(m,)], "m string")
    body = P.reworded_constraint(P.constraint_body(F.col("m")))
    say = [df.select(P.paraphrase(F.col("m"), body, level)).first()[0] for level in range(5)]
    assert say[0] == m and say == [df.select(P.paraphrase(F.col("m"), body, level)).first()[0] for level in range(5)]
    assert "mostly cotton with a small amount of spandex" in say[4]
    shown = df.select(P.replace_body(F.col("m"), F.lit("wool")), P.replace_body(F.col("m"), F.lit("wool"), F.lit("The important part is:")), P.replace_body(F.lit("none here."), F.lit("wool"))).first()
    assert tuple(shown) == ("For that, what matters is: wool.", "The important part is: wool.", "none here.")
    assert say[1].startswith("For that, what matters is: ") and say[2].startswith(tuple(P.MARKER_FORMS)) and say[3].startswith(P.SUITS)
    changed = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(P.constraint_changed(F.col("a"), F.col("b"))).first()[0]
    assert not changed(m, say[1]) and changed(m, say[4]) and not changed("hello", "other")
    assert values(spark, P.reworded_constraint(F.col("t")), [("cotton",), ("odd thing",), ("budget around $42",)]) == [
        "a breathable natural plant fibre", "it should offer this property in practical use: odd thing", "priced near forty-two dollars",
    ]


def test_index_tokens(spark):
    got = values(spark, T.index_tokens(F.col("t")), [("Café CRÈME, naïve-Øre ﬂ",), ("Straße ２３ Ⅷ",), ("日本語 x\u0301y",), (None,)])
    assert got == [["cafe", "creme", "naive", "øre", "ﬂ"], ["straße", "23", "ⅷ"], ["日本語", "xy"], []]
