"""Screening of texts and dialogue gates: ordered rules as Columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Particles and signs that carry no content.
PARTICLES = r"[它他她这那哪些么的呢吗吧啊呀哦嗯?？!！。，,、;；:：\s]+"


def any_of(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any of the patterns is found in a text; null for null."""
    return reduce(or_, (text.rlike(p) for p in patterns), F.when(text.isNotNull(), False))


def verdict(text: Column, terms: Iterable[str], planted: Iterable[str] = (), enabled: bool = True, screened: int | None = None) -> Column:
    """Category for which a text is refused, null if it is allowed (null, empty, or screening is off): ``blocklist`` if it
    holds one of the ``terms``, else ``prompt_injection`` if one of the ``planted`` patterns is found, which are to be
    given for documents only.

    The whole text is looked at, or as many characters as ``screened`` says.
    """
    if not enabled:
        return F.lit(None).cast("string")
    probe = text if screened is None else F.substring(text, 1, screened)
    blocked = reduce(or_, (probe.contains(t) for t in terms), F.lit(False))
    return F.when(blocked, "blocklist").when(any_of(probe, planted), "prompt_injection")


def checked(category: Column, failed: Column, fail_open: bool) -> Column:
    """The category after a provider's check that may have failed: then nothing is refused (``fail_open``) or all is."""
    return F.when(F.coalesce(failed, F.lit(False)), F.lit(None if fail_open else "unavailable").cast("string")).otherwise(category)


def first_refusals(parts: DataFrame, doc: str, order: str, category: Column) -> DataFrame:
    """(doc, first, category): documents with a refused part, and the first of them."""
    bad = parts.withColumn("category", category).filter("category is not null")
    return bad.groupBy(doc).agg(F.min(order).alias("first"), F.min_by("category", order).alias("category"))


def leans_on_history(question: Column, has_history: Column, refers: Iterable[str], short: int = 8) -> Column:
    """Whether a question needs what was said before: there is something, and it is short or refers to it."""
    q = F.trim(question)
    return F.coalesce((q != "") & has_history & ((F.length(q) <= short) | any_of(q, refers)), F.lit(False))


def accepts_rewrite(question: Column, candidate: Column, keep: float = 0.6) -> Column:
    """Whether a rewritten question may replace the question: not too long, all its codes and numbers kept,
    and at least ``keep`` of its different content characters."""
    fits = F.length(candidate) <= 3 * F.length(question) + 50
    codes = F.forall(F.regexp_extract_all(question, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.contains(F.lower(candidate), F.lower(t)))

    def content(s: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.regexp_replace(s, PARTICLES, ""), ""), lambda c: c != ""))

    src = content(question)
    kept = F.size(F.array_intersect(src, content(candidate)))
    return F.coalesce((candidate != "") & fits & codes & ((F.size(src) == 0) | (kept >= keep * F.size(src))), F.lit(False))


def asks_several(question: Column, joins: Iterable[str], long: int = 50) -> Column:
    """Whether a message may hold several questions: two question marks, a word that joins them, or its length."""
    marks = F.length(question) - F.length(F.regexp_replace(question, "[?？]", ""))
    return F.coalesce((marks >= 2) | any_of(question, joins) | (F.length(question) > long), F.lit(False))


def kind_by_rule(question: Column, rules: dict[str, str], greeting: str, idle: str) -> Column:
    """Kind of a message: that of the first pattern found; ``chitchat`` if nothing is left after a greeting or what is left
    matches ``idle``; null if neither."""
    q = F.trim(question)
    rest = F.trim(F.regexp_replace(q, greeting, ""))
    out = reduce(lambda c, x: c.when(q.rlike(x[1]), x[0]), rules.items(), F.when(F.lit(False), ""))
    return out.when((rest == "") | rest.rlike(idle), "chitchat")


def unsafe_reasons(name: Column) -> Column:
    """Why a file name is refused, in order; empty for a safe one."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    tests = {
        "empty": name.isNull() | (F.trim(name) == ""),
        "separator": name.rlike(r"[/\\]"),
        "colon": name.contains(":"),
        "edge": name.rlike(r"[. ]$"),
        "device": stem.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"),
        "character": name.rlike(r"[\x00-\x1f<>\"|?*]"),
        "length": F.octet_length(name) > 255,
    }
    return F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())


def upload_refusals(name: Column, size: Column, most: int = 50 * 1024 * 1024) -> Column:
    """Why an upload is refused: the reasons of its name, and ``size`` if it is empty, unknown or over ``most`` bytes."""
    return F.concat(unsafe_reasons(name), F.when(F.coalesce(size.between(1, most), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("size"))))
