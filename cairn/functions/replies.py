"""Replies of models and messages of services as Columns: what they say, or null where they say nothing usable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an error says when the input was too long.
OVERFLOWS = ("context_length_exceeded", "maximum context length", "context window", "too many tokens", "reduce the length", "exceeds the maximum")
# Keys under which a list of scores may stand, and shape of a pair in a reply that is no JSON.
SCORE_LISTS = ("scores", "results", "data", "items")
SCORE_PAIR = r'"?index"?\s*[:：]\s*(\d+)[^}\n]*?"?score"?\s*[:：]\s*(-?\d+(?:\.\d+)?)'
#: Labels that a model puts before a rewritten question.
REWRITE_LABEL = r"(?i)^(改写后?(的?问题)?|rewritten( question)?|question|output)\s*[:：]\s*"


def bounded(score: Column) -> Column:
    """A score between 0 and 10; higher ones are taken to be out of 100."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.when(score > 10, score / 10).otherwise(score))))


def scores(reply: Column, n: int) -> Column:
    """array<double> of ``n`` scores, null where the reply has none: from the list of a JSON object, whose items are
    numbers or objects with an index (or id, else their place) and a score (or relevance); else from pairs of words."""
    v = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    items = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in SCORE_LISTS))

    def read(x: Column, at: Column) -> Column:
        index = F.coalesce(F.try_variant_get(x, "$.index", "int"), F.try_variant_get(x, "$.id", "int"), at + 1)
        value = F.coalesce(F.try_variant_get(x, "$.score", "double"), F.try_variant_get(x, "$.relevance", "double"), F.try_variant_get(x, "$", "double"))
        return F.struct(index.alias("i"), value.alias("s"))

    listed = F.transform(items, read)
    index, value = (F.regexp_extract_all(reply, F.lit(SCORE_PAIR), F.lit(k)) for k in (1, 2))
    paired = F.zip_with(index, value, lambda i, s: F.struct(i.try_cast("int").alias("i"), s.try_cast("double").alias("s")))

    def usable(found: Column) -> Column:
        return F.filter(found, lambda x: x["i"].between(1, n) & x["s"].isNotNull())

    first = usable(listed)
    found = F.when(F.size(F.coalesce(first, F.array())) > 0, first).otherwise(usable(paired))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: bounded(F.try_element_at(F.filter(found, lambda x: x["i"] == i), F.lit(-1))["s"]))


def first_line(reply: Column, label: str = REWRITE_LABEL) -> Column:
    """The first line that says something, without a label before it and quotes around it; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), label, "")), "^[\"'“”‘’《》「」\\s]+|[\"'“”‘’《》「」\\s]+$", ""))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))


def sub_questions(reply: Column) -> Column:
    """The questions of a JSON list of strings, in a code fence or not; else all that stands in quotes; null if nothing does."""
    bare = F.regexp_replace(F.trim(reply), r"(?i)^```(json)?\s*|\s*```$", "")

    def said(x: Column) -> Column:
        return F.filter(F.transform(x, lambda q: F.trim(q)), lambda q: q != "")

    listed = said(F.from_json(bare, "array<string>"))
    quoted = said(F.regexp_extract_all(reply, F.lit('["“]([^"”]+)["”]'), F.lit(1)))
    return F.when(F.size(F.coalesce(listed, F.array())) > 0, listed).when(F.size(F.coalesce(quoted, F.array())) > 0, quoted)


def capped(items: Column, most: int) -> Column:
    """struct(kept, dropped): the first ``most`` items and how many more there were; none of null."""
    n = F.size(F.coalesce(items, F.array().cast("array<string>")))
    return F.struct(F.slice(items, 1, most).alias("kept"), F.greatest(n - most, F.lit(0)).alias("dropped"))


def arguments(text: Column) -> Column:
    """map<string,string> of a call's arguments given as a JSON object; null if they are none."""
    return F.from_json(text, "map<string,string>")


def is_overflow(message: Column, status: Column) -> Column:
    """Whether an error says that the input was too long: by its words, or a status of 400 about the length of tokens."""
    m = F.lower(message)
    words = F.lit(False)
    for x in OVERFLOWS:
        words = words | m.contains(x)
    return F.coalesce(words | ((status == 400) & m.contains("token") & m.rlike("length|limit|exceed")), F.lit(False))


def image_names(text: Column) -> Column:
    """array<string>: base names of the images that a Markdown text refers to, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1)), lambda p: F.element_at(F.split(p, "/"), -1))


def image_links(text: Column) -> Column:
    """The text with every image link cut to the image's base name."""
    return F.regexp_replace(text, r"!\[([^\]]*)\]\((?:[^)]*/)?([^)/]+)\)", r"![$1]($2)")


def is_scanned_page(text: Column, has_image: Column, least: int = 20) -> Column:
    """Whether a page is a scan: an image and less than ``least`` characters of text."""
    return F.coalesce((F.length(F.trim(F.coalesce(text, F.lit("")))) < least) & has_image, F.lit(False))


def says_something(question: Column) -> Column:
    """Whether a question has a letter, a digit or a Han character."""
    return F.coalesce(question.rlike("[\\u4e00-\\u9fffA-Za-z0-9]"), F.lit(False))


def request_id(raw: Column) -> Column:
    """An id given from outside if it is a safe one (1 to 64 letters, digits, dots, dashes, underscores), else null."""
    return F.when(raw.rlike(r"^[A-Za-z0-9._\-]{1,64}$"), raw)


def phone_masked(phone: Column) -> Column:
    """First three and last four characters, the rest masked; all of a shorter number or null."""
    return F.when(F.length(phone) >= 7, F.concat(F.left(phone, F.lit(3)), F.lit("****"), F.right(phone, F.lit(4)))).otherwise("***")


def route_label(route: Column, path: Column) -> Column:
    """The template of a route, so that labels stay few; ``unmatched`` where no route matched a path."""
    return F.coalesce(F.when(route != "", route), F.when(path.isNull(), "?"), F.lit("unmatched"))


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    """A limit given as text between ``low`` and ``high``; the default where it is no whole number."""
    n = value.try_cast("int")
    return F.when(n.isNull(), default).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high)))


def source_label(breadcrumb: Column, source: Column, page: Column) -> Column:
    """Where a block stands: its headings or else its file, with the page if it has one; empty if nothing is known."""
    place = F.trim(F.coalesce(F.when(breadcrumb != "", breadcrumb), source, F.lit("")))
    return F.when((place != "") & (page > 0), F.concat(place, F.lit(" (p."), page.cast("string"), F.lit(")"))).otherwise(place)
