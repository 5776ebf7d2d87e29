"""Retrieval quality: first relevant ranks, recall@k, reciprocal rank, and their groupings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.state import at_ranks
from cairn.runtime import settle

#: Cut-offs at which recall is reported.
CUTS = (1, 3, 5, 10, 20)


def base_name(path: Column) -> Column:
    """The last part of a path, in lower case."""
    return F.lower(F.element_at(F.split(path, r"[/\\\\]"), -1))


def answers(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, id): the chunks that answer a golden question: their file is its ``file`` or one of its ``also_files`` (by
    base name, letter case ignored) and their text holds its ``anchor``. No anchor: every chunk of the files answers;
    no file: none does.

    ``golden`` has (q_id, file, also_files, anchor), ``chunks`` (id, file, text). Chunks meet questions by file name;
    of a file's chunks only keys are passed on.
    """
    files = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("file"), F.coalesce("also_files", F.array().cast("array<string>")))), base_name))
    g = golden.select("q_id", "anchor", F.explode(files).alias("name"))
    c = chunks.select("id", "text", base_name(F.col("file")).alias("name"))
    return c.join(g, "name").filter(F.coalesce(F.contains("text", "anchor"), F.col("anchor").isNull())).select("q_id", "id").distinct()


def anchor_verdicts(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, verdict): ``ok`` if a chunk answers the golden question, else what is wrong with it: ``no file`` (none of
    its files has chunks) or ``no anchor`` (no chunk of them holds it)."""
    files = golden.withColumn("anchor", F.lit(None).cast("string"))
    found = answers(golden, chunks).select("q_id").distinct().withColumn("a", F.lit(1))
    known = answers(files, chunks).select("q_id").distinct().withColumn("f", F.lit(1))
    verdict = F.when(F.col("a") == 1, "ok").when(F.col("f") == 1, "no anchor").otherwise("no file")
    return golden.select("q_id").distinct().join(known, "q_id", "left").join(found, "q_id", "left").select("q_id", verdict.alias("verdict"))


def expectation_met(expect: Column, status: Column, chunks: Column, error: Column) -> Column:
    """Whether a file was taken in as expected: ``ok`` with chunks, ``empty`` without, ``fail`` with an error, ``reject``
    with none of these because it never came in (null status). Any other expectation is not met."""
    some = F.coalesce(chunks, F.lit(0)) > 0
    met = F.when(expect == "ok", (status == "ok") & some).when(expect == "empty", (status == "ok") & ~some)
    met = met.when(expect == "fail", (status == "failed") & error.isNotNull()).when(expect == "reject", status.isNull())
    return F.coalesce(met, F.lit(False))


def first_ranks(questions: DataFrame, truth: DataFrame, modes: dict[str, DataFrame]) -> DataFrame:
    """``questions`` once per mode, with ``positive`` (something is relevant) and ``rank`` of the first relevant
    row, null if it was missed. ``truth`` has (q_id, id), ``modes`` ranked lists of (q_id, id, rank)."""
    lists = reduce(DataFrame.unionByName, (df.select(F.lit(m).alias("mode"), "q_id", "id", "rank") for m, df in modes.items()))
    hits = lists.join(truth, ["q_id", "id"]).groupBy("mode", "q_id").agg(F.min("rank").alias("rank"))
    known = truth.select("q_id").distinct().withColumn("positive", F.lit(True))
    every = questions.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).join(known, "q_id", "left")
    return every.join(hits, ["mode", "q_id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


def _metrics() -> list[Column]:
    at = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r_at_{k}") for k in CUTS]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    return [F.count("*").alias("questions"), *at, mrr, F.sum(F.col("rank").isNull().cast("bigint")).alias("misses")]


def recall(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Recall and reciprocal rank over all positive questions of each group."""
    return ranks.filter("positive").groupBy(*by).agg(*_metrics())


def bucket(question: Column) -> Column:
    return F.when(F.length(question) <= 20, "short").when(F.length(question) <= 45, "medium").otherwise("long")


def recall_sets(ranks: DataFrame) -> DataFrame:
    """The same by mode and bucket, by mode, and in total, in one pass."""
    rows = ranks.filter("positive")
    return rows.groupingSets([[F.col("mode"), F.col("bucket")], [F.col("mode")], []], F.col("mode"), F.col("bucket")).agg(*_metrics())


def gain(by_mode: DataFrame, base: str, other: str) -> DataFrame:
    """(k, base, other, gain): recall of two modes side by side for each cut-off."""
    long = by_mode.select("mode", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r_at_{k}").alias("r")) for k in CUTS))))
    wide = long.groupBy("k").pivot("mode", [base, other]).agg(F.first("r"))
    return wide.select("k", base, other, F.round(F.col(other) - F.col(base), 6).alias("gain"))


def separation(best: DataFrame) -> DataFrame:
    """Least, most and upper median of the best scores of positive and of negative questions.

    ``best`` has (q_id, best, positive), one row per question. The median is found by rank, so no group is gathered.
    """
    b = settle(best.filter("best is not null").select("positive", "best"))
    n = b.groupBy("positive").agg(F.count("*").alias("questions"), F.min("best").alias("least"), F.max("best").alias("most"))
    middle = at_ranks(b, "positive", "best", n.select("positive", F.floor(F.col("questions") / 2).alias("index")))
    return n.join(middle.select("positive", F.col("best").alias("upper_median")), "positive")
