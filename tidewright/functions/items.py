"""Item texts and metadata from catalogue columns, and histories of items, as column expressions.

An item is a struct with title, main_category, store, categories, features, description (arrays of
text), details (a JSON object as text), average_rating and rating_number; a null struct is an item
that the catalogue lacks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import compact, first_truthy, let, number, strip
from tidewright.operators.core import tail

#: Details that are shown, by label, with the spellings they are looked up by in order and their longest length.
DETAILS = [
    ("Artist", ("Artist",), 180),
    ("Composer", ("Composer",), 180),
    ("Label", ("Label", "Manufacturer"), 180),
    ("Original Release Date", ("Original Release Date",), 180),
    ("Genre", ("Genre",), 180),
    ("Style", ("Style",), 180),
    ("Format", ("Media Format", "Format"), 180),
    ("Run time", ("Run time", "Runtime"), 180),
    ("Number of discs", ("Number of discs", "Number Of Discs"), 60),
    ("Language", ("Language",), 120),
]
#: The sentence before a history, and categories' names in the plural and singular.
LISTED = ("This user's Amazon ", " interaction history over time is listed below.")
CATEGORIES = {"Video_Games": ("video games", "video game"), "CDs_and_Vinyl": ("CDs and vinyl", "CD or vinyl"), "Musical_Instruments": ("musical instruments", "musical instrument")}
RATING = r"(?i)\(([-+]?\d+(?:\.\d+)?)\s+stars?\)"


def text_list(values: Column, limit: int) -> Column:
    """The first texts of an array that aren't blank, white space collapsed, 500 characters each."""
    texts = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: compact(x, 500)), lambda x: x != "")
    return F.slice(texts, 1, limit)


def _labelled(label: str, x: Column) -> Column:
    """The label and the text; null for a blank text, so that joining leaves it out."""
    return F.concat(F.lit(label), F.nullif(x, F.lit("")))


def _listed(item: Column, categories: int, features: int, description: int) -> list[Column]:
    return [
        _labelled("Categories: ", F.array_join(text_list(item["categories"], categories), " > ")),
        _labelled("Features: ", F.array_join(text_list(item["features"], features), "; ")),
        _labelled("Description: ", F.array_join(text_list(item["description"], description), " ")),
    ]


def _whole(parts: list[Column], title: Column, limit: int, item: Column) -> Column:
    joined = F.concat_ws(" ", *parts)
    return F.when(item.isNull(), compact(title, limit)).otherwise(let(first_truthy(joined, title), lambda t: compact(t, limit)))


def item_text(item: Column, title: Column, limit: int) -> Column:
    """Title, category, store, categories, features and description; the title given where all are blank."""
    parts = [F.nullif(compact(item[c], 300), F.lit("")) for c in ("title", "main_category", "store")]
    return _whole([*parts, *_listed(item, 6, 8, 2)], title, limit, item)


def summary_text(item: Column, title: Column, summary: Column, limit: int) -> Column:
    """The labelled form with a summary in place of features and description."""
    parts = [
        F.nullif(compact(first_truthy(item["title"], title), 300), F.lit("")),
        _labelled("Main category: ", compact(item["main_category"], 160)),
        _labelled("Store/artist/format: ", compact(item["store"], 300)),
        _listed(item, 6, 8, 2)[0],
        _labelled("Summary: ", compact(summary)),
        _labelled("Details: ", details_text(item)),
    ]
    return _whole(parts, title, limit, item)


def proxy_text(item: Column) -> Column:
    """The form of the proxy evaluation: no labels, lists of eight, plain cuts."""
    cut = lambda x, n: F.nullif(F.left(compact(x), F.lit(n)), F.lit(""))
    many = lambda c: F.array_join(F.slice(F.coalesce(item[c], F.array().cast("array<string>")), 1, 8), " ", "None")
    return F.concat_ws(" ", cut(item["title"], 300), cut(item["main_category"], 200), cut(many("categories"), 400), cut(many("features"), 700), cut(many("description"), 900))


def details(item: Column) -> Column:
    """The shown details as an array of (key, value) in their order; anything but a JSON object has none."""

    def of(found: Column) -> Column:
        store = F.lower(compact(item["store"], 300))
        out = []
        for label, names, limit in DETAILS:
            value = first_truthy(*[compact(found[n], limit) for n in names])
            if label == "Format":
                value = F.when(~store.contains("format:"), value)
            out.append(F.struct(F.lit(label).alias("key"), value.alias("value")))
        return F.filter(F.array(*out), lambda d: d["value"].isNotNull())

    return let(F.from_json(item["details"], "map<string,string>"), of)


def details_text(item: Column) -> Column:
    return F.array_join(F.transform(details(item), lambda d: F.concat(d["key"], F.lit("="), d["value"])), "; ")


def stats_text(item: Column) -> Column:
    """Average rating and number of ratings; blank if both are missing or 0."""
    avg, n = item["average_rating"], item["rating_number"]
    both = F.concat_ws(", ", F.concat(F.lit("avg_rating="), avg.cast("string")), F.concat(F.lit("rating_count="), n.cast("string")))
    return F.when((F.coalesce(avg, F.lit(0)) == 0) & (F.coalesce(n, F.lit(0)) == 0), "").otherwise(both)


def metadata(item: Column, limit: int, mode: str = "compact", summary: Column | None = None) -> Column:
    """What stands beside an item of a history: `compact` (features, description, statistics) or `summary`."""
    categories, features, description = _listed(item, 4, 3, 1)
    middle = [_labelled("Summary: ", compact(summary if summary is not None else F.lit("")))] if mode == "summary" else [features, description]
    parts = [_labelled("Store/artist/format: ", compact(item["store"], 180)), categories, *middle, _labelled("Details: ", details_text(item))]
    if mode != "summary":
        parts.append(_labelled("Catalog stats: ", stats_text(item)))
    return F.when(item.isNull(), "").otherwise(let(F.concat_ws("; ", *parts), lambda t: compact(t, limit)))


def category_label(category: Column) -> Column:
    """In histories: underscores are blanks, And is and."""
    return F.replace(F.replace(category, F.lit("_"), F.lit(" ")), F.lit("And"), F.lit("and"))


def category_names(category: Column) -> Column:
    """In prompts: struct of plural and singular, by table, else the name without underscores and its last s."""
    readable = F.replace(F.coalesce(category, F.lit("")), F.lit("_"), F.lit(" "))
    plural, singular = F.when(readable == "", "items").otherwise(readable), F.when(readable == "", "item").otherwise(first_truthy(F.regexp_replace(readable, "s+$", ""), F.lit("item")))
    for name, (many, one) in CATEGORIES.items():
        plural, singular = F.when(category == name, many).otherwise(plural), F.when(category == name, one).otherwise(singular)
    return F.struct(plural.alias("plural"), singular.alias("singular"))


def history_text(category: Column, titles: Column, ratings: Column, last: int, beside: Column | None = None) -> Column:
    """The last entries of a history: one line, or numbered lines with the texts of `beside` (metadata by place).

    The lists are each cut to their last entries and then to the shortest of titles and ratings. An entry
    without a title is its rating; without either it is left out of one line and said to be missing in
    numbered ones.
    """
    cut = (lambda a: tail(a, last)) if last > 0 else (lambda a: a)
    t, r = cut(titles), cut(ratings)
    n = F.least(F.size(t), F.size(r))
    columns = [F.slice(t, F.lit(1), n).alias("title"), F.slice(r, F.lit(1), n).alias("rating")]
    if beside is not None:
        columns.append(F.slice(cut(beside), F.lit(1), n).alias("beside"))

    def entry(x: Column) -> Column:
        stars = F.coalesce(F.concat(F.lit(" ("), number(x["rating"]), F.lit(" stars)")), F.lit(""))
        title = compact(x["title"], 240)
        return F.when(title == "", F.ltrim(stars)).otherwise(F.concat(title, stars))

    head = F.concat(F.lit(LISTED[0]), category_label(category), F.lit(LISTED[1]))
    rows = F.arrays_zip(*columns)
    if beside is None:
        return F.concat(head, F.lit(" "), F.array_join(F.filter(F.transform(rows, entry), lambda e: e != ""), "; "), F.lit("."))
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), first_truthy(entry(x), F.lit("[missing title]")), F.coalesce(_labelled("; ", x["beside"]), F.lit("")))
    return strip(F.concat(head, F.lit("\n"), F.array_join(F.transform(rows, line), "\n")))


def ratings_in(text: Column) -> Column:
    """The ratings that a history's text gives, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RATING), F.lit(1)), lambda x: x.cast("double"))


def fitted_ratings(ratings: Column, n: Column, default: float) -> Column:
    """So many ratings: filled up with the default, or the last ones."""
    more = F.concat(ratings, F.array_repeat(F.lit(default), F.greatest(n - F.size(ratings), F.lit(0))))
    return F.slice(more, F.greatest(F.size(more) - n, F.lit(0)) + 1, n)


def checked_ratings(given: Column, text: Column, n: Column) -> Column:
    """The ratings given, else those in the text, else n nulls; another number of them than n raises."""
    found = F.coalesce(given, F.when(F.size(ratings_in(text)) > 0, ratings_in(text)), F.array_repeat(F.lit(None).cast("double"), n))
    return let(found, lambda r: F.when(F.size(r) == n, r).otherwise(F.raise_error(F.concat(F.lit("ratings don't fit a history: "), F.size(r).cast("string"), F.lit(" for "), n.cast("string"))).cast("array<double>")))


def query_source(text: Column, ids: Column, least: int, policy: str) -> Column:
    """`existing`, `rebuild` or null (neither can be): which history a query is made from."""
    existing, rebuild = F.size(ratings_in(text)) >= least, F.coalesce(F.size(ids), F.lit(0)) >= least
    if policy == "existing":
        return F.when(existing, "existing").when(rebuild, "rebuild")
    if policy == "rebuild":
        return F.when(rebuild, "rebuild")
    return F.when(rebuild, "rebuild").when(existing, "existing")
