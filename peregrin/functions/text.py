"""Tokens, routing by keyword, and the scalar functions of data preparation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Word lists, rules and defaults that must be equal for equal results.
ARCHETYPE_WORDS = {
    "Culture Enthusiast": ["culture", "museum", "history", "art"],
    "Beach & Relax": ["beach", "relax", "chill"],
    "Budget Backpacker": ["budget", "cheap", "backpack"],
    "Luxury Traveler": ["luxury", "upscale", "high-end"],
    "Nightlife Seeker": ["nightlife", "bar", "club", "party"],
    "Nature & Adventure": ["nature", "adventure", "outdoor", "hike"],
    "Family Traveler": ["family", "kids", "children"],
}
CATEGORY_WORDS = ["museum", "landmark", "history", "religion", "nature", "food", "nightlife", "shopping", "culture", "beach"]
TRANSPORT_WORDS = ["near", "walk", "close to", "airport", "station", "transport", "hub"]
#: (key, value or None for any, category); the first that fits counts.
TAG_RULES = [
    ("natural", "beach", "beach"), ("amenity", "place_of_worship", "religion"), ("tourism", "museum", "museum"), ("tourism", "gallery", "museum"),
    ("amenity", "marketplace", "food"), ("amenity", "food_court", "food"), ("shop", "mall", "shopping"), ("shop", "department_store", "shopping"),
    ("amenity", "bar", "nightlife"), ("amenity", "nightclub", "nightlife"), ("amenity", "pub", "nightlife"), ("leisure", "park", "nature"),
    ("leisure", "garden", "nature"), ("amenity", "theatre", "culture"), ("amenity", "arts_centre", "culture"), ("tourism", "zoo", "culture"),
    ("tourism", "theme_park", "culture"), ("historic", "archaeological_site", "history"), ("historic", "ruins", "history"), ("historic", "memorial", "history"),
    ("historic", None, "landmark"), ("tourism", "viewpoint", "landmark"), ("tourism", "attraction", "landmark"),
]
#: category: (visit minutes, price level, opening hour, closing hour)
CATEGORY_DEFAULTS = {
    "museum": (120, 1, 9, 18), "landmark": (60, 1, 8, 20), "religion": (30, 0, 7, 19), "history": (60, 0, 8, 19), "culture": (90, 1, 9, 20),
    "shopping": (60, 1, 10, 20), "food": (60, 1, 10, 23), "nightlife": (120, 1, 18, 2), "nature": (90, 0, 0, 24), "beach": (150, 0, 0, 24),
}
TEMPLATES = {
    "museum": "A notable museum in ", "landmark": "A well-known landmark in ", "religion": "A historic place of worship in ", "history": "A historic site in ",
    "culture": "A cultural venue in ", "shopping": "A popular shopping spot in ", "food": "A well-regarded food destination in ",
    "nightlife": "A lively nightlife spot in ", "nature": "A green space in ", "beach": "A popular beach in ",
}
ANY_TEMPLATE = "A point of interest in "
DESCRIPTION_CHARS = 500


def tokenize(text: Column) -> Column:
    """Runs of a-z and apostrophes of the lower-cased text; accents split them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z']+"), F.lit(0))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring, inside other words too."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_match(text: Column, rules: dict[str, list[str]]) -> Column:
    """The first name one of whose words is in the text; null if none."""
    return F.coalesce(*(F.when(contains_any(text, words), F.lit(name)) for name, words in rules.items()))


def route_query(text: Column, archetype: Column) -> Column:
    """struct(archetype, category, near_transport) that a query asks for; a given archetype wins."""
    q = F.lower(F.coalesce(text, F.lit("")))
    return F.struct(
        F.coalesce(archetype, first_match(q, ARCHETYPE_WORDS)).alias("archetype"),
        first_match(q, {c: [c] for c in CATEGORY_WORDS}).alias("category"),
        contains_any(q, TRANSPORT_WORDS).alias("near_transport"),
    )


def _of(key: Column, values: dict) -> Column:
    """The value of a key, null if it has none; one constant map, so that key is computed once."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def classify_tags(tags: Column) -> Column:
    """Category of a map of tags by the first rule that fits; null if none does."""
    fits = lambda k, v: tags[k].isNotNull() if v is None else tags[k] == v
    return F.coalesce(*(F.when(fits(k, v), F.lit(c)) for k, v, c in TAG_RULES))


def normalize_qid(raw: Column) -> Column:
    """The first Q-number of a list parted by `;`, `,` or blanks; null if none."""
    parts = F.filter(F.split(raw, r"[;,\s]+"), lambda x: x.rlike("^Q[0-9]+$"))
    return F.get(parts, F.lit(0))


def opening_hours(raw: Column) -> Column:
    """struct(open, close) of the first H:MM-H:MM, minutes dropped; null if there is none within 0-24."""
    pattern = r"(\d{1,2}):\d{2}\s*-\s*(\d{1,2}):\d{2}"
    hour = lambda i: F.regexp_extract(raw, pattern, i).try_cast("int")
    a, b = hour(1), hour(2)
    return F.when(a.between(0, 24) & b.between(0, 24), F.struct(a.alias("open"), b.alias("close")))


def trim_description(text: Column, most: int = DESCRIPTION_CHARS) -> Column:
    """Whole sentences up to `most` characters, stopping at the first that would not fit; a long first sentence stays whole."""
    state = lambda s, done: F.struct(s.alias("s"), done.alias("done"))

    def add(acc, sentence):
        over = (F.length(acc["s"]) > 0) & (F.length(acc["s"]) + F.length(sentence) + 1 > most)
        stop = acc["done"] | over
        return state(F.when(stop, acc["s"]).otherwise(F.trim(F.concat(acc["s"], F.lit(" "), sentence))), stop)

    kept = F.aggregate(F.split(text, "(?<=[.!?]) "), state(F.lit(""), F.lit(False)), add)["s"]
    cut = F.regexp_extract(F.substring(text, 1, most), r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.when(kept != "", kept).otherwise(cut))


def describe(name: Column, city: Column, category: Column, known: Column) -> Column:
    """A sentence from a known description, with the city unless it names it; else the category's template."""
    article = F.when(F.lower(F.substring(known, 1, 1)).isin(*"aeiou"), F.lit("an")).otherwise(F.lit("a"))
    named = F.lower(F.replace(known, F.lit("İ"), F.lit("I"))).contains(F.lower(city))
    tail = F.when(named, F.lit(".")).otherwise(F.concat(F.lit(", in "), city, F.lit(".")))
    start = F.coalesce(_of(category, TEMPLATES), F.lit(ANY_TEMPLATE))
    return F.when(F.coalesce(F.length(known), F.lit(0)) > 0, F.concat(name, F.lit(" is "), article, F.lit(" "), known, tail)).otherwise(F.concat(start, city, F.lit(".")))


def category_default(category: Column, place: int) -> Column:
    return _of(category, {k: v[place] for k, v in CATEGORY_DEFAULTS.items()})


def price_from_fee(fee: Column, charge: Column, default: Column) -> Column:
    """struct(level, source): no fee is 0, a fee or a charge at least 1, else the category's default."""
    paid = (fee == "yes") | (F.coalesce(F.length(charge), F.lit(0)) > 0)
    level = F.when(fee == "no", F.lit(0)).when(paid, F.greatest(default, F.lit(1))).otherwise(default)
    source = F.when((fee == "no") | paid, F.lit("osm")).otherwise(F.lit("category_default"))
    return F.struct(level.alias("level"), source.alias("source"))


def clock(hour: Column) -> Column:
    """A fractional hour as HH:MM, half minutes to even, modulo a day."""
    minutes = F.bround(hour * F.lit(60.0), 0).cast("long")
    return F.concat(F.lpad(((F.floor(minutes / 60)) % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def document_text(name: Column, category: Column, city: Column, description: Column) -> Column:
    """A place as a document; a missing description is empty."""
    return F.concat(name, F.lit(" ("), category, F.lit(") in "), city, F.lit(": "), F.coalesce(description, F.lit("")))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def context_line(name: Column, category: Column, description: Column, reason: Column) -> Column:
    """A retrieved place as a line of context: `name (category): description [graph: reason]`."""
    return F.concat(name, F.lit(" ("), category, F.lit("): "), F.coalesce(description, F.lit("")), F.when(reason.isNotNull(), F.concat(F.lit(" [graph: "), reason, F.lit("]"))).otherwise(F.lit("")))


def dedent(text: Column) -> Column:
    """A template without the blanks that all its lines with text begin with, and without blank ends."""
    lines = F.split(text, "\n")
    deep = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    return F.regexp_replace(F.concat_ws("\n", F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(F.substring(x, F.coalesce(deep, F.lit(0)) + 1, F.length(x))))), r"^\s+|\s+$", "")
