"""Ranked lists: top-k, fusion, diversity, expansion and packing, all per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.config import DEFAULT, Retrieval
from cairn.functions.text import WIDE_WEIGHT, estimated_tokens


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "q_id") -> DataFrame:
    """The first ``k`` rows of each question with their ``rank`` from 1; filters belong before this."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(lists: list[DataFrame], k: int = DEFAULT.rrf_k, top: int = DEFAULT.pool) -> DataFrame:
    """Reciprocal-rank fusion of lists of (q_id, id, rank): (q_id, id, rrf, rank). A list may be empty."""
    union = lists[0].select("q_id", "id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("q_id", "id", "rank"))
    fused = union.groupBy("q_id", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"))
    return top_k(fused, top, F.desc("rrf"), F.asc("id"))


def diverse(ranked: DataFrame, score: str, source: str, conf: Retrieval = DEFAULT) -> DataFrame:
    """Rows at or above the relative floor, at most ``per_source`` of a source, at most ``selected`` in all.

    The floor is off where the best score is not positive. A null source is a source of its own.
    """
    q = Window.partitionBy("q_id")
    best = F.max(score).over(q)
    kept = ranked.withColumn("best", best).filter((F.col("best") <= 0) | (F.col(score) >= conf.floor * F.col("best"))).drop("best", "rank")
    own = Window.partitionBy("q_id", source).orderBy(F.desc(score), F.asc("id"))
    kept = kept.withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= conf.per_source).drop("nth")
    return top_k(kept, conf.selected, F.desc(score), F.asc("id"))


def expand(ranked: DataFrame, parents: DataFrame, key: str, text: str, conf: Retrieval = DEFAULT) -> DataFrame:
    """The first row of each parent, at most ``parents`` of them, with the parent's text or else the row's own.

    ``parents`` has (key, parent_text), one row per key. Rows without a parent key are left out, as soon as
    any row has one.
    """
    first = top_k(ranked.filter(F.col(key).isNotNull()).withColumnRenamed("rank", "pos").withColumn("group", F.struct("q_id", key)), 1, F.asc("pos"), by="group").drop("group", "rank")
    some = top_k(first, conf.parents, F.asc("pos"))
    return some.join(parents, key, "left").withColumn("context", F.coalesce("parent_text", text)).drop("parent_text", "pos")


def pack_skipping(ranked: DataFrame, budget: int, size: str = "chars") -> DataFrame:
    """(q_id, id, rank, used): rows in rank order that still fit; one that does not is passed over.

    A question's list is short (it was cut before), so the fold runs over one array per question.
    """
    items = ranked.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("id"), F.col(size).cast("bigint").alias("size")))).alias("items"))
    kept_type = "array<struct<rank:int,id:string,used:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kept_type).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + x["size"]
        more = F.struct(used.alias("used"), F.concat(s["kept"], F.array(F.struct(x["rank"].alias("rank"), x["id"].alias("id"), used.alias("used")))).alias("kept"))
        return F.when(used <= budget, more).otherwise(s)

    packed = items.select("q_id", F.aggregate("items", start, step, lambda s: s["kept"]).alias("kept"))
    return packed.select("q_id", F.inline("kept"))


def pack_prefix(ranked: DataFrame, budget: int, text: str = "context") -> DataFrame:
    """(q_id, id, rank, tokens, used): rows in rank order up to the first that does not fit, then none."""
    sized = ranked.withColumn("tokens", estimated_tokens(F.col(text)))
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget).select("q_id", "id", "rank", "tokens", "used")


def pack_whole(ranked: DataFrame, budget: int, text: str = "context") -> DataFrame:
    """(q_id, kept, total, truncated, used, notice): what a budget of tokens holds of each question's blocks.

    Blocks are taken in rank order up to the first that does not fit. If that is the first of all, its whole sentences
    that fit are taken, or as many characters as surely do. The notice says how much is missing, and is empty if
    nothing is. A budget of 0 or less holds nothing.
    """
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.select("q_id", "rank", F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("tokens", estimated_tokens(F.col("t")))
    sized = sized.withColumn("used", F.sum("tokens").over(w))
    fits = (F.col("used") <= budget) & F.lit(budget > 0)
    first = F.min_by(F.struct("t", "tokens"), "rank")
    g = sized.groupBy("q_id").agg(F.count("*").alias("total"), F.sum(fits.cast("int")).alias("kept"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("used"), first.alias("f"))
    cut = F.col("kept").eqNullSafe(0) & F.lit(budget > 0) & (F.length("f.t") > 0)
    g = g.withColumn("part", F.when(cut, sentences_within(F.col("f.t"), budget))).withColumn("truncated", F.coalesce(F.col("part") != "", F.lit(False)))
    g = g.withColumn("kept", F.when(F.col("truncated"), 1).otherwise(F.col("kept"))).withColumn("used", F.when(F.col("truncated"), estimated_tokens(F.col("part"))).otherwise(F.col("used")))
    less = F.col("total") - F.col("kept")
    notice = F.concat_ws("; ", F.format_string("%d of %d blocks", F.col("kept").cast("int"), F.col("total").cast("int")), F.when(less > 0, F.format_string("%d dropped", less.cast("int"))), F.when(F.col("truncated"), "1 cut"))
    return g.select("q_id", F.col("kept").cast("bigint").alias("kept"), "total", "truncated", "used", F.when((less > 0) | F.col("truncated"), notice).otherwise("").alias("notice"))


def sentences_within(text: Column, budget: int) -> Column:
    """The whole sentences at the beginning of a text that ``budget`` tokens hold; if the first does not fit, the
    characters that surely do."""
    said = F.regexp_extract_all(text, F.lit(r"(?s)[^。！？!?；;\n]*(?:[。！？!?；;\n]+|$)"), F.lit(0))
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["t"], x)
        full = s["full"] | (estimated_tokens(more) > budget)
        return F.struct(F.when(full, s["t"]).otherwise(more).alias("t"), full.alias("full"))

    whole = F.aggregate(said, start, step, lambda s: s["t"])
    return F.when(whole != "", whole).otherwise(F.substring(text, 1, max(0, budget * 10 // int(10 * WIDE_WEIGHT))))


def render(ranked: DataFrame, text: str = "context", label: str = "source") -> DataFrame:
    """(q_id, context): the numbered blocks of a question under their source labels, in rank order."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col(label), F.lit("-")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    parts = ranked.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("p"))
    return parts.select("q_id", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))
