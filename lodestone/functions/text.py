"""Text functions as Column expressions.

Everything is built from Spark's own functions, so that it stays in generated code; only
NFKC folding and case folding, which Spark lacks, are Arrow functions. Regular expressions
with (?U) see all of Unicode.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Word lists, phrases and patterns of the message templates.
BOILERPLATE = [
    "those options are not quite right yet ask me about one specific attribute",
    "actually ignore my earlier preference what i need is",
    "i don't have an additional preference for",
    "i dont have an additional preference for",
    "i don't have a preference for",
    "i dont have a preference for",
    "please use your judgment",
    "but i'm still exploring",
    "but im still exploring",
    "a key requirement is",
    "for that what matters is",
    "i'm looking for",
    "im looking for",
]
STOPWORDS = (
    "a an and are as at be but by for from i in is it me my of on or please some "
    "that the this to want with would you looking im still exploring key requirement matters need "
    "have preference dont about ask one specific attribute options not quite right yet actually "
    "ignore earlier judgment use your"
).split()
CANDIDATE_STOPWORDS = (
    "a about an and around be bit but for from i in is it me mostly my of on "
    "or please something that the this to want with would"
).split()
CLASSIFIER_MATERIALS = "cotton polyester nylon leather wool spandex silk rayon fabric".split()
EXACT_MATERIALS = (
    "cotton polyester nylon leather wool silk canvas denim spandex linen velvet fleece "
    "suede mesh cashmere rayon satin acrylic fabric"
).split()
TITLE_COLORS = "black white blue red pink green brown gray grey purple yellow orange navy beige gold silver".split()
TITLE_GENDERS = "men mens women womens boys girls unisex".split()
TITLE_SIZES = "xxs xs small medium large xl xxl xxxl".split()
ROOT_CATEGORIES = ["clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry"]
QUESTIONS = {
    "other": "I am refining the shortlist. What else should I consider?",
    "feature": "Which product feature matters most to you?",
    "material": "Do you have a material preference?",
    "color": "Do you have a color preference?",
    "style": "Is there a style or fit you prefer?",
    "size": "Do you have a size or width requirement?",
    "budget": "What budget should I work within?",
    "use_case": "What will you mainly use it for?",
}
MARKERS = ["a key requirement is:", r"for that,?\s*what matters is:", "what i need is:"]
OPENINGS = [
    r"(?is)^\s*I'm\s+looking\s+for\s+(.+?)\.\s+A\s+key\s+requirement\s+is:\s+.+?\.\s*$",
    r"(?is)^\s*I'm\s+looking\s+for\s+(.+?),\s+but\s+I'm\s+still\s+exploring\.\s*$",
    r"(?is)^\s*I'm\s+looking\s+for\s+(.+?)\.\s+.+?\s*$",
]
KEY_REQUIREMENT = r"(?i)\bA key requirement is:\s*(.+?)(?:\.\s*$|$)"
WHAT_MATTERS = r"(?i)\bFor that, what matters is:\s*(.+?)(?:\.\s*$|$)"
WHAT_I_NEED = r"(?i)\bWhat I need is:\s*([^\n.]+)"
WHAT_I_NEED_EXACT = r"(?i)\bWhat I need is:\s*(.+?)(?:\.\s*$|$)"
STILL_EXPLORING = r"(?i)\bstill exploring\b"
NO_PREFERENCE = r"(?i)\bI don't have a preference for\b"
NO_ADDITIONAL = r"(?i)\bI don't have an additional preference for\s+([a-z_]+)\b"
OVERRIDE = r"(?i)\b(?:ignore|forget)\s+(?:about\s+)?my\s+(?:earlier|previous|prior)\s+preference\b"
OLD_PREFERENCE = r"(?i)^I'm looking for .+?\.\s+(.+?)\s*$"
POSSIBLE_OVERRIDE = (
    r"(?i)\b(?:instead|scratch\s+that|reconsider|anymore)\b"
    r"|\b(?:ignore|forget)\s+(?:my|the|that|what|earlier|previous|prior)\b"
    r"|\b(?:replace|switch)\s+(?:my|the|from|to|out)\b"
    r"|\b(?:rather\s+than|no\s+longer|change(?:d)?\s+my\s+mind|on\s+second\s+thought|make\s+that)\b"
)
PRICE_LANGUAGE = r"(?i)(?:\bbudget\b|\bspend\b|\bcost\b|\bprice\b|\bunder\b|\bbelow\b|\$)[^\d]{0,24}\$?([0-9]+(?:\.[0-9]{1,2})?)"
BUDGET = r"(?i)budget\s+around\s+\$?([\d.]+)"
ATTRIBUTE_WORDS = {
    "color": "color|black|white|blue|red|pink|green",
    "size": "size|sizing|width|wide|narrow",
    "style": "department|style|fit|sleeve|neck",
    "use_case": "hiking|running|gym|winter|outdoor|work",
}
# End of the fixed values.

PUNCTUATION = " .,;:"
EDGES = " -;,.\t\n"
CONSTRAINT_LENGTH = 180
TERM_LIMIT = 24
#: Code points of a product's text, and of the text that is embedded.
PRODUCT_LENGTH, EMBEDDED_LENGTH = 900, 512


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form; Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def one_spaced(text: Column) -> Column:
    """Runs of white space become a space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_plain(text: Column) -> Column:
    """norm() without NFKC and for ASCII letters: what other engines can express as well."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_ \t\n\f\r$%.,:;'-]", " ")
    return F.lower(F.trim(F.regexp_replace(kept, r"[ \t\n\f\r]+", " ")))


def norm(text: Column) -> Column:
    """NFKC, decorative characters to spaces, single spaces, lower case. Null gives an empty string."""
    kept = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s$%.,:;'-]", " ")
    return F.lower(one_spaced(kept))


def _folding() -> tuple[str, str]:
    """Characters of the basic plane that are another one with a mark or in another form, and those they are; marks alone last, which go."""
    one, other, gone = [], [], []
    for i in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if not bare:
            gone.append(chr(i))
        elif len(bare) == 1 and bare != chr(i):
            one.append(chr(i))
            other.append(bare)
    return "".join(one + gone), "".join(other)


FOLDED_FROM, FOLDED_TO = _folding()


def fold_accents(text: Column) -> Column:
    """Letters without their marks, and compatibility forms as what they stand for, where that is a single character; the rest as it is."""
    return F.translate(text, FOLDED_FROM, FOLDED_TO)


def index_tokens(text: Column) -> Column:
    """The tokens of indexed text: runs of letters and digits of any script, in lower case and without marks."""
    return F.regexp_extract_all(F.lower(fold_accents(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def flatten_entries(entries: Column, separator: str = " ") -> Column:
    """Ordered (k, v) entries as one string each. A missing value shows as None, as an index of the original has it."""
    return F.transform(entries, lambda e: F.concat(e["k"], F.lit(separator), F.coalesce(e["v"], F.lit("None"))))


def flatten(value: Column, kind: str) -> Column:
    """A catalog field as one string. kind: scalar, list or entries. Null gives an empty string."""
    made = {"scalar": lambda: value.cast("string"), "list": lambda: F.array_join(value, " "), "entries": lambda: F.array_join(flatten_entries(value), " ")}[kind]()
    return F.coalesce(made, F.lit(""))


def product_text(title: Column, categories: Column, features: Column, details: Column, store: Column, description: Column, cap: int = PRODUCT_LENGTH, key=norm) -> Column:
    """The fields of a product as one normed text, the title and the categories twice, of at most cap code points."""
    kinds = (title, "scalar"), (categories, "list"), (features, "list"), (details, "entries"), (store, "scalar"), (description, "list")
    t, c, *rest = (key(flatten(value, kind)) for value, kind in kinds)
    return F.substring(one_spaced(F.concat_ws(" ", t, t, c, c, *rest)), 1, cap)


def clean_constraint(text: Column, limit: int = CONSTRAINT_LENGTH) -> Column:
    """Single spaces, no punctuation at the ends, at most limit code points."""
    return F.rtrim(F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(EDGES)), 1, limit))


def phrase_key(text: Column) -> Column:
    return F.lower(one_spaced(text))


def constraint_key(text: Column, exact: bool = False) -> Column:
    """Key for finding a constraint again: single spaces, bare ends, case folded (exact) or lower."""
    bare = F.trim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(EDGES))
    return casefold(bare) if exact else F.lower(bare)


def coarse_category(categories: Column) -> Column:
    """The last two parts of a product's categories that are no root, or a default."""
    parts = F.flatten(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.split(c, ",")))
    named = F.filter(F.transform(parts, one_spaced_ends), lambda p: (p != "") & ~F.array_contains(_strings(ROOT_CATEGORIES), F.lower(p)))
    last = F.slice(named, F.greatest(F.size(named) - 1, F.lit(1)), 2)
    return F.when(F.size(named) > 0, F.array_join(last, " ")).otherwise("clothing item")


def one_spaced_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_boilerplate(normed: Column) -> Column:
    """Without the phrases that every message has. Takes text that norm() made."""
    for phrase in BOILERPLATE:
        normed = F.replace(normed, F.lit(phrase), F.lit(" "))
    return F.trim(F.trim(F.regexp_replace(normed, r"(?U)\s+", " ")), F.lit(PUNCTUATION))


def marked_constraints(normed: Column) -> Column:
    """What stands after each kind of marker, cut at semicolons; without a marker the bare message."""
    found = []
    for marker in MARKERS:
        body = F.regexp_extract(normed, rf"{marker}\s*(.+)", 1)
        found.append(F.transform(F.split(body, ";"), lambda c: F.trim(c, F.lit(" .,;"))))
    chunks = F.filter(F.concat(*found), lambda c: c != "")
    return F.when(F.size(chunks) > 0, chunks).otherwise(F.array(strip_boilerplate(normed)))


def tokens(normed: Column) -> Column:
    return F.regexp_extract_all(normed, F.lit("([a-z0-9]+)"), 1)


def content_terms(normed: Column, limit: int = TERM_LIMIT) -> Column:
    """Distinct tokens of two letters or more that are no stop words, in order, the first limit of them."""
    kept = F.filter(tokens(normed), lambda t: (F.length(t) > 1) & ~F.array_contains(_strings(STOPWORDS), t))
    return F.slice(F.array_distinct(kept), 1, limit)


def phrase(normed: Column) -> Column:
    return F.array_join(tokens(normed), " ")


def distinct_by_key(values: Column, key=norm_plain) -> Column:
    """Values with an equal key only once, the first one; those with an empty key not at all."""
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), key(v).alias("k")))
    kept = F.filter(pairs, lambda p: F.coalesce(p["k"] != "", F.lit(False)))
    keys = F.transform(kept, lambda p: p["k"])
    return F.transform(F.filter(kept, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["v"])


def compose_query(category: Column, constraints: Column, fallback: Column) -> Column:
    """The category, then the constraints, without empty parts and repeats; or the fallback."""
    parts = F.concat(F.array(F.coalesce(category, F.lit(""))), F.coalesce(constraints, F.array().cast("array<string>")))
    query = F.array_join(distinct_by_key(F.transform(parts, one_spaced_ends)), " ")
    return F.when(query != "", query).otherwise(fallback)


def without_category(constraint: Column, category_key: Column) -> Column:
    """A constraint without the category it starts with, if that ends at a word's end."""
    rest = F.substring(constraint, F.length(category_key) + 1, 1 << 30)
    at_end = (rest == "") | F.substring(rest, 1, 1).isin(*" .,;:-")
    starts = (category_key != "") & constraint.startswith(category_key)
    return F.when(starts & at_end, F.trim(rest, F.lit(" .,;:-"))).otherwise(constraint)


def messages_query(category: Column, messages: Column) -> Column:
    """The query of a conversation: the category and all constraints its messages name."""
    key = norm_plain(F.coalesce(category, F.lit("")))
    named = F.flatten(F.transform(messages, lambda m: marked_constraints(norm_plain(m))))
    bare = F.filter(F.transform(named, lambda c: without_category(F.trim(c), key)), lambda c: c != "")
    return compose_query(category, bare, F.lit(""))


def category_phrase(message: Column) -> Column:
    """The category that an opening message names, or null."""
    tries = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in OPENINGS]
    return F.nullif(one_spaced(F.coalesce(*tries)), F.lit(""))


def classify_constraint(text: Column) -> Column:
    """The attribute a constraint is about. The order of the branches counts; words match inside words."""
    low = F.lower(text)
    out = F.when(low.contains("budget") | low.rlike(r"(?:\$|<=|under)\s*[0-9]"), "budget")
    out = out.when(low.rlike("|".join(CLASSIFIER_MATERIALS)), "material")
    for attribute, words in ATTRIBUTE_WORDS.items():
        out = out.when(low.rlike(words), attribute)
    return out.otherwise("feature")


def is_override(message: Column) -> Column:
    return message.rlike(OVERRIDE) | message.rlike(WHAT_I_NEED)


def maybe_override(message: Column) -> Column:
    return message.rlike(POSSIBLE_OVERRIDE)


def route_scenario(message: Column, turn: Column, current: Column) -> Column:
    """The scenario after a message, from its wording and the scenario before."""
    return (
        F.when(is_override(message), "intent_override")
        .when(message.rlike(KEY_REQUIREMENT), "buying")
        .when(message.rlike(STILL_EXPLORING), "browsing_or_boundary")
        .when((current == "browsing_or_boundary") & (turn >= 2), F.when(message.rlike(NO_PREFERENCE), "boundary").otherwise("browsing"))
        .when(current.isin("buying", "browsing", "boundary", "intent_override"), current)
        .when(turn == 1, "intent_override")
        .otherwise(current)
    )


def dialog_constraints(message: Column, scenario: Column, turn: Column) -> Column:
    """What a message asks for, as (text, source)."""
    message = one_spaced_ends(F.coalesce(message, F.lit("")))
    edges = F.lit(" -;,.")

    def one(pattern: str, source: str) -> Column:
        value = F.trim(F.regexp_extract(message, pattern, 1), edges)
        return F.when(value != "", F.array(F.struct(value.alias("text"), F.lit(source).alias("source"))))

    parts = F.filter(F.transform(F.split(F.regexp_extract(message, WHAT_MATTERS, 1), r";\s*"), lambda p: F.trim(p, edges)), lambda p: p != "")
    several = F.transform(parts, lambda p: F.struct(p.alias("text"), F.lit("customer_reply").alias("source")))
    opening = (turn == 1) & (scenario == "intent_override") & ~message.rlike(STILL_EXPLORING)
    none = F.array().cast("array<struct<text:string,source:string>>")
    return F.coalesce(
        F.when(message.rlike(KEY_REQUIREMENT), F.coalesce(one(KEY_REQUIREMENT, "key_requirement"), none))
        .when(message.rlike(WHAT_MATTERS), several)
        .when(message.rlike(WHAT_I_NEED), F.coalesce(one(WHAT_I_NEED, "override_new"), none))
        .when(opening & message.rlike(OLD_PREFERENCE), one(OLD_PREFERENCE, "override_initial")),
        none,
    )


def exact_constraints(message: Column) -> Column:
    """What the exact route reads from a message: the first marker's parts, or all of it."""

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(F.regexp_extract(message, pattern, 1), ";"), lambda c: clean_constraint(c)), lambda c: c != "")

    out = None
    for pattern in (KEY_REQUIREMENT, WHAT_I_NEED_EXACT, WHAT_MATTERS):
        out = F.when(message.rlike(pattern), parts(pattern)) if out is None else out.when(message.rlike(pattern), parts(pattern))
    whole = clean_constraint(message)
    return out.otherwise(F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))


def parse_budget(text: Column) -> Column:
    return F.regexp_extract(text, BUDGET, 1).try_cast("double")


def price_mentioned(text: Column) -> Column:
    """The amount after a word about prices, as it is written, or null."""
    return F.nullif(F.regexp_extract(text, PRICE_LANGUAGE, 1), F.lit(""))


def title_key(title: Column, unicode: bool = True) -> Column:
    """A title without punctuation and case."""
    if not unicode:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(casefold(nfkc(F.coalesce(title, F.lit("")))), r"(?U)[\W_]+", " "))


def title_tokens(key: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda t: t != "")))


def variant_tokens(token_set: Column) -> Column:
    """Tokens that tell variants of a product apart: colours, genders, sizes, and any with a digit."""
    known = _strings(TITLE_COLORS + TITLE_GENDERS + TITLE_SIZES)
    return F.array_sort(F.filter(token_set, lambda t: F.array_contains(known, t) | t.rlike("[0-9]")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def candidate_tokens(text: Column) -> Column:
    """Distinct lower-case tokens that are no stop words of candidate search."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)), _strings(CANDIDATE_STOPWORDS))


def json_strings(text: Column) -> Column:
    """The strings of a JSON list, or of the list under "constraints", also inside a code fence; else an empty list."""
    bare = one_spaced_ends(F.coalesce(text, F.lit("")))
    inside = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1), F.lit("")), bare)
    under = F.get_json_object(inside, "$.constraints")
    # elements stay JSON texts, so that only strings are taken
    listed = F.from_json(F.when(inside.startswith("["), inside).otherwise(under), "array<variant>")
    strings = F.filter(F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))), lambda s: s.isNotNull())
    return F.coalesce(strings, F.array().cast("array<string>"))


# Numbers in words.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# End of the fixed values.


def number_words(n: Column) -> Column:
    """Whole numbers from 0 to 999 in words; others as they are written."""
    ones, tens = _strings(ONES), _strings(["", "", *TENS])
    v = n.cast("int")

    def below_100(x: Column) -> Column:
        unit = F.when(x % 10 > 0, F.concat(F.lit("-"), F.get(ones, x % 10))).otherwise("")
        return F.when(x < 20, F.get(ones, x)).otherwise(F.concat(F.get(tens, F.floor(x / 10).cast("int")), unit))

    rest = F.when(v % 100 > 0, F.concat(F.lit(" "), below_100(v % 100))).otherwise("")
    words = F.when(v < 100, below_100(v)).otherwise(F.concat(F.get(ones, F.floor(v / 100).cast("int")), F.lit(" hundred"), rest))
    whole = (n == F.floor(n)) & (n >= 0) & (n < 1000)
    return F.when(whole, words).otherwise(F.regexp_replace(F.format_string("%.6f", n.cast("double")), r"\.?0+$", ""))


def question_prompt(attribute: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, attribute), F.lit(QUESTIONS["other"]))


def next_attribute(asked: Column, mode: str = "always_other") -> Column:
    """The attribute to ask for after asked questions."""
    if mode == "always_other":
        return F.lit("other")
    if mode != "other_twice_rotate":
        raise ValueError(f"unknown question policy {mode!r}")
    turn = _strings(["feature", "material", "color", "style"])
    return F.when(asked < 2, "other").otherwise(F.get(turn, F.pmod(asked - 2, F.lit(4)).cast("int")))


def price_text(price: Column) -> Column:
    return F.when(price.isNotNull(), F.format_string("$%.2f", price.cast("double"))).otherwise("price n/a")


def finite_or(value: Column, default: float) -> Column:
    """A number, or the default where the value is none, not finite or no number."""
    x = value.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(x)


# The sentences of an explanation, and the confidence at which each is said.
REASON = "Showing these because you mentioned "
NO_REASON = "I’m using what you’ve told me so far to narrow the shortlist."
STRONG = " This looks like a strong match."
NARROWING = " I’m still narrowing down — these span a few directions."
CLOSEST = " These are the closest matches so far."
OPEN_QUESTION = " What else matters most to you?"
SURE, UNSURE = 0.65, 0.25
# End of the fixed values.


def explanation(constraints: Column, confidence: Column, most: int = 240) -> Column:
    """Why these items: up to two constraints, a word on confidence, an open question."""

    def readable(c: Column) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), F.lit(" -;,."))
        label = F.lower(F.trim(F.substring_index(text, ":", 1)))
        value = F.trim(F.regexp_replace(text, "(?s)^[^:]*:", ""))
        is_color = text.contains(":") & (F.length(F.substring_index(text, ":", 1)) <= 20) & (label == "color") & (value != "")
        return F.when(is_color, F.concat(value, F.lit(" color"))).otherwise(text)

    reasons = F.slice(distinct_by_key(F.transform(constraints, readable), key=F.lower), 1, 2)
    why = F.when(
        F.size(reasons) > 0, F.concat(F.lit(REASON), F.array_join(reasons, " and "), F.lit("."))
    ).otherwise(NO_REASON)
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    status = (
        F.when(c >= SURE, STRONG)
        .when(c <= UNSURE, NARROWING)
        .otherwise(CLOSEST)
    )
    tail = F.concat(status, F.lit(OPEN_QUESTION))
    room = F.lit(most) - F.length(tail)
    cut = F.concat(F.rtrim(F.substring(why, F.lit(1), room - 1)), F.lit("…"))
    return F.concat(F.when(F.length(why) <= room, why).otherwise(cut), tail)
