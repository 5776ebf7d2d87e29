"""Mixing sources to target weights (problem 7).

Method: every text gets a hash-random key; within its source the texts are laid out by that key. A first
aggregation gives the tokens of each (source, key range), whose running sum places each range in the
source's prefix; texts of ranges that lie wholly inside the budget are taken, and only the one range that
the budget cuts is summed text by text. No window ever spans a whole source, so a source that holds a third
of all rows is spread over ``RANGES`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.bpe import TOKENIZER_DIR, count_tokens
from cairn.runtime import settle

#: Key ranges of each source; a range holds one 4096th of its source's texts.
RANGES = 4096


def sized_texts(documents: DataFrame, targets: DataFrame, seed: int = 17, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(source, doc_id, n_tokens, key): one row per distinct text of each source named in ``targets``.

    Copies of a text within a source count as that text once, under its smallest ``doc_id``. Null and
    empty texts, and rows of other or null sources, have nothing to give and are left out.
    """
    wanted = documents.join(targets.select("source").distinct(), "source", "left_semi")
    wanted = wanted.filter(F.length("text") > 0).withColumn("__copy", F.xxhash64("text")).withColumn("__copy2", F.xxhash64(F.lit(5), "text"))  # 128 bits
    counted = count_tokens(wanted, "text", ["source", "doc_id", "__copy", "__copy2"], directory)
    once = counted.groupBy("source", "__copy", "__copy2", "n_tokens").agg(F.min("doc_id").alias("doc_id"))
    return once.select("source", "doc_id", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("key"))


def budgets(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of ``targets``: its share of the total, what it has, and how often it is repeated.

    The total is ``total_tokens``, by default the tokens of all texts of these sources. A source's budget
    is its share of the total, at most ``max_repeats`` times what it has. ``whole`` full passes are taken,
    then texts in key order up to ``rest``; the text that crosses it is taken if that comes nearer to it. Repeated target rows count once; a null
    share or cap is 0. Without texts a source contributes nothing and is reported so.
    """
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    # One row per named source; the table of targets is the user's list of sources, not corpus data.
    t = goal.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    whole = F.sum("available").over(Window.partitionBy(F.lit(1))) if total_tokens is None else F.lit(total_tokens)
    t = t.withColumn("wanted", F.floor(F.coalesce("target_share", F.lit(0.0)) * whole).cast("bigint"))
    cap = F.coalesce(F.col("max_repeats"), F.lit(0)).cast("bigint") * F.col("available")
    t = t.withColumn("budget", F.least("wanted", cap))
    has = F.col("available") > 0
    return t.withColumn("whole", F.when(has, F.expr("budget div available")).otherwise(F.lit(0).cast("bigint"))).withColumn(
        "rest", F.when(has, F.expr("budget % available")).otherwise(F.lit(0).cast("bigint"))
    )


def draw(texts: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, copies): every text that is taken at least once, and how often."""
    ranged = texts.withColumn("range", F.shiftrightunsigned("key", 52).cast("int"))
    sums = ranged.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.withColumn("end", F.sum("in_range").over(upto)).withColumn("begin", F.col("end") - F.col("in_range"))
    placed = placed.join(plan.select("source", "whole", "rest"), "source")
    rows = ranged.join(placed, ["source", "range"])
    inside = F.when(F.col("end") <= F.col("rest"), 1).when(F.col("begin") >= F.col("rest"), 0)
    rows = rows.withColumn("extra", inside)
    cut = rows.filter(F.col("extra").isNull())
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("begin") + F.sum("n_tokens").over(order)) - F.col("n_tokens")
    cut = cut.withColumn("extra", (middle <= 2 * F.col("rest")).cast("int"))
    rows = rows.filter(F.col("extra").isNotNull()).unionByName(cut)
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return rows.select("source", "doc_id", "n_tokens", copies.alias("copies")).filter("copies > 0")


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per source of the plan: target and actual share, tokens, texts, rows drawn, and whether the
    target was within reach of ``max_repeats``."""
    got = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.sum("copies").alias("rows")
    )
    zero = F.lit(0).cast("bigint")
    t = plan.join(got, "source", "left").withColumns({c: F.coalesce(c, zero) for c in ("tokens", "texts", "rows")})
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    actual = F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0))
    return t.select(
        "source", "target_share", actual.alias("actual_share"), "tokens", "texts", "rows", "available", "budget", (F.col("budget") == F.col("wanted")).alias("in_reach")
    )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, directory: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """The drawn texts and the report of shares."""
    texts = settle(sized_texts(documents, targets, seed, directory))
    plan = budgets(texts, targets, total_tokens)
    drawn = draw(texts, plan)
    return drawn, shares(drawn, plan)
