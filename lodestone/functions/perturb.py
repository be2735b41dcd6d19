"""Deterministic rewording of messages, to test how robust retrieval is."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import number_words

# Markers, rewrites and their order.
MARKED = r"(?is)(a key requirement is:|for that,?\s*what matters is:|what i need is:)\s*(.+?)([.!?]*)$"
PERCENT_PAIR = r"(?i)\d+(?:\.\d+)?\s*%\s*([A-Za-z]+)\s*[,/&+ ]+\s*\d+(?:\.\d+)?\s*%\s*([A-Za-z]+)"
BUDGET_AROUND = r"(?i)\bbudget\s+around\s+\$(\d+(?:\.\d+)?)"
REWRITES = [
    (r"water[ -]?resistant", "able to handle light rain"),
    (r"waterproof", "able to keep water out"),
    (r"navy blue", "dark blue"),
    (r"color:\s*black", "in the darkest neutral shade"),
    (r"color:\s*white", "in a bright neutral shade"),
    (r"color:\s*blue", "in an azure shade"),
    (r"color:\s*red", "in a crimson shade"),
    (r"color:\s*pink", "in a rose shade"),
    (r"color:\s*green", "in a verdant shade"),
    (r"color:\s*brown", "in an earth-toned shade"),
    (r"color:\s*gr(?:a|e)y", "in a charcoal shade"),
    (r"color:\s*purple", "in a violet shade"),
    (r"color:\s*yellow", "in a sunny golden shade"),
    (r"100\s*%\s*leather", "made entirely from genuine hide"),
    (r"leather", "made from genuine hide"),
    (r"100\s*%\s*cotton", "made entirely from natural fibre"),
    (r"100\s*%\s*polyester", "made entirely from synthetic fibre"),
    (r"light[ -]?weight", "easy to carry without much weight"),
    (r"machine wash(?: only)?", "safe to clean in a washing machine"),
    (r"hand wash(?: only)?", "should be cleaned gently by hand"),
    (r"pull[ -]?on closure", "slips on without fasteners"),
    (r"zipper closure", "fastens with a zip"),
    (r"button closure", "fastens using buttons"),
    (r"rubber sole", "an outsole made from grippy elastic material"),
    (r"imported", "produced outside the domestic market"),
]
MATERIAL_WORDS = {
    "cotton": "a breathable natural plant fibre",
    "polyester": "a durable synthetic fibre",
    "nylon": "a strong lightweight synthetic fibre",
    "wool": "a warm natural fleece fibre",
    "spandex": "a stretchy elastic fibre",
    "rayon": "a soft regenerated cellulose fibre",
    "silk": "a smooth natural filament fibre",
    "fabric": "a soft woven textile",
}
OPENING_FORMS = ["Please help me find {}", "I'm hoping to get {}", "Could you show me {}"]
ENDINGS = [".", "!", "..."]
MARKER_FORMS = ["My main requirement is:", "The important part is:"]
SUITS = "What would suit me is"
PHRASES = [
    (r"(?i)Actually,\s*ignore my earlier preference\.\s*", "Please replace what I said before; "),
    (r"(?i)For that,\s*what matters is:\s*", "Another thing I care about is "),
]
# End of the fixed values.
SEED = "rewording"


def constraint_body(message: Column) -> Column:
    """What stands after a marker, without closing punctuation; null without a marker."""
    return F.nullif(F.trim(F.regexp_extract(message, MARKED, 2)), F.lit(""))


def replace_body(message: Column, body: Column, marker: Column | None = None) -> Column:
    """The message with another constraint after its marker, and another marker if one is given; closing punctuation stays. As it is without a marker."""
    found = F.regexp_extract(message, MARKED, 0)
    before = F.substring(message, F.lit(1), F.length(message) - F.length(found))
    kept = F.regexp_extract(message, MARKED, 1) if marker is None else marker
    new = F.concat(before, kept, F.lit(" "), body, F.regexp_extract(message, MARKED, 3))
    return F.when(found != "", new).otherwise(message)


def reworded_constraint(body: Column) -> Column:
    """A constraint in other words, by declarative rewrites in a fixed order."""
    pair = F.concat(F.lit("mostly "), F.lower(F.regexp_extract(body, PERCENT_PAIR, 1)), F.lit(" with a small amount of "), F.lower(F.regexp_extract(body, PERCENT_PAIR, 2)))
    # group references in the pair cannot occur: it holds letters only
    out = F.when(body.rlike(PERCENT_PAIR), F.regexp_replace(body, F.lit(PERCENT_PAIR), pair)).otherwise(body)
    amount = number_words(F.regexp_extract(out, BUDGET_AROUND, 1).try_cast("double"))
    near = F.concat(F.lit("priced near "), F.coalesce(amount, F.lit("")), F.lit(" dollars"))
    out = F.when(out.rlike(BUDGET_AROUND), F.regexp_replace(out, F.lit(BUDGET_AROUND), near)).otherwise(out)
    for pattern, words in REWRITES:
        out = F.regexp_replace(out, rf"(?i)\b{pattern}\b", words)
    table = F.create_map(*[F.lit(x) for pair_ in MATERIAL_WORDS.items() for x in pair_])
    alone = F.try_element_at(table, F.lower(F.trim(out, F.lit(" ."))))
    same = F.when(out == body, F.concat(F.lit("it should offer this property in practical use: "), F.trim(body))).otherwise(out)
    return F.coalesce(alone, same)


def constraint_changed(before: Column, after: Column) -> Column:
    """Whether the constraint itself is worded otherwise, not only what is around it."""
    a, b = constraint_body(before), constraint_body(after)
    return F.when(a.isNull(), False).when(b.isNotNull(), F.lower(a) != F.lower(b)).otherwise(~F.contains(F.lower(after), F.lower(a)))


def failure_reason(original: Column, perturbed: Column) -> Column:
    phrase = "ignore my earlier preference"
    lost = F.lower(original).contains(phrase) & ~F.lower(perturbed).contains(phrase)
    return (
        F.when(lost, "override phrase changed, so the agent's freshness reset may not be recognized")
        .when(constraint_changed(original, perturbed), "constraint wording changed, weakening exact-match and BM25 lexical overlap")
        .otherwise("surface/template wording changed, likely affecting category or constraint parsing")
    )


_MARKED, _OPENING = re.compile(MARKED), re.compile(r"(?s)^I'm looking for (?P<what>.+?[,.].*)$")


def _surface(text: str, draw: random.Random) -> str:
    """Level 1: another opening, another ending."""
    if opened := _OPENING.match(text):
        text = OPENING_FORMS[draw.randrange(len(OPENING_FORMS))].format(opened["what"])
    return text[:-1] + draw.choice(ENDINGS) if text.endswith(".") else text


def _marker(text: str, form: str) -> str:
    """form in the place of the message's marker."""
    if found := _MARKED.search(text):
        return f"{text[: found.start()]}{form} {found.group(2).strip()}{found.group(3)}"
    return text


def _another_marker(text: str, draw: random.Random) -> str:
    """Level 2: the surface, and another marker."""
    return _marker(_surface(text, draw), draw.choice(MARKER_FORMS))


def _no_marker(text: str, draw: random.Random) -> str:
    """Level 3: the surface, and nothing left that the templates are known by."""
    out = _marker(_surface(text, draw), SUITS)
    for pattern, words in PHRASES:
        out = re.sub(pattern, words, out)
    return out


def paraphrase(message: Column, reworded: Column, level: int, seed: str = SEED) -> Column:
    """The message at a level: 0 as it is, 1 to 3 worded otherwise around the constraint, 4 with the constraint itself in other words.

    Choices come from Python's generator, seeded by seed, level and message, so they are the same everywhere.
    reworded: reworded_constraint(constraint_body(message)).
    """
    if level not in range(5):
        raise ValueError(f"unsupported level {level}")
    if level == 0:
        return message
    around = {1: _surface, 2: _another_marker, 3: _no_marker, 4: _no_marker}[level]

    def one(text: str | None, other: str | None) -> str | None:
        if not text:
            return text
        out = around(text, random.Random("\0".join((seed, str(level), text))))
        marked = _MARKED.search(text)
        if level == 4 and marked:
            out = out.replace(marked.group(2).strip(), other)
        return " ".join(out.split())

    @pandas_udf(StringType())
    def apply(texts: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([one(t, o) for t, o in zip(texts, others, strict=True)], dtype=object)

    return apply(message, reworded)
