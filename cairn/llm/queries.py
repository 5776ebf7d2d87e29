"""Registered queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import abuse, bpe, lines, lookalikes, mixing, neardup, pages, splitting
from cairn.runtime import settle, table


def _duplicates(spark: SparkSession, sf_dir: str, field: str) -> neardup.NearDuplicates:
    if field == "parents.text":
        return neardup.near_duplicates(table(spark, sf_dir, "parents"), "parent_id", "text", neardup.squeezed, neardup.BLOCKS)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_ref", "filename", neardup.stem, neardup.NAMES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks, and of file names, that are the same but for small changes."""
    parts = [neardup.record_pairs(_duplicates(spark, sf_dir, f)).select(F.lit(f).alias("field"), "key_a", "key_b") for f in ("parents.text", "documents.filename")]
    return parts[0].unionByName(parts[1])


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block and file name with its class and its number of links to different texts."""
    parts = [neardup.classes(_duplicates(spark, sf_dir, f)).select(F.lit(f).alias("field"), "key", "class_id", "links") for f in ("parents.text", "documents.filename")]
    return parts[0].unionByName(parts[1])


def _months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks with the month of their arrival told apart: all, those before the newest month, and that month's."""
    parents = table(spark, sf_dir, "parents")
    newest = parents.agg(F.max(F.date_trunc("month", "ingested_at"))).first()[0]
    is_new = F.coalesce(F.col("ingested_at") >= F.lit(newest), F.lit(False))
    return parents, parents.filter(~is_new), parents.filter(is_new)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the lines that are repeated within their file: the state of the earlier months, advanced by the newest."""
    _, earlier, newest = _months(spark, sf_dir)
    state = lines.advance(lines.advance(None, earlier).state, newest).state
    return state.marked.select(F.col("block").alias("parent_id"), F.explode("line_nos").alias("line_no"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with the repeated lines taken out: the blocks of earlier months as cleaned then, and made anew only
    where the newest month is concerned."""
    parents, earlier, newest = _months(spark, sf_dir)
    whole = parents.filter("parent_id is not null").select("parent_id", "doc_id", "text").dropDuplicates(["parent_id"])
    first = lines.advance(None, earlier)
    before = lines.removed(earlier.filter("parent_id is not null").select("parent_id", "doc_id", "text").dropDuplicates(["parent_id"]), first.state.marked)
    return lines.rebuilt(before, whole, lines.advance(first.state, newest))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.records(*(table(spark, sf_dir, t) for t in ("parents", "sections", "documents")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of every line of the scanned pages."""
    rows = _records(spark, sf_dir)
    return pages.noise(rows, pages.vocabulary(rows))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages as continuous paragraphs."""
    rows = _records(spark, sf_dir)
    return pages.repaired(rows, pages.vocabulary(rows))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized blocks."""
    return splitting.pieces(table(spark, sf_dir, "parents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that were cut."""
    return p4_pieces(spark, sf_dir).select("parent_id").distinct()


def _rewrites(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return lookalikes.corpus_rewrites((table(spark, sf_dir, "chat_requests"), "question"), (table(spark, sf_dir, "parents"), "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions, and of blocks, that read the same but are stored differently."""
    rules = _rewrites(spark, sf_dir)
    asked = lookalikes.reading_pairs(table(spark, sf_dir, "chat_requests"), "request_id", "question", rules)
    held = lookalikes.reading_pairs(table(spark, sf_dir, "parents"), "parent_id", "text", rules)
    return asked.select(F.lit("chat_requests.question").alias("field"), "key_a", "key_b").unionByName(held.select(F.lit("parents.text").alias("field"), "key_a", "key_b"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and block in its consistent form."""
    rules = _rewrites(spark, sf_dir)
    asked = lookalikes.canonical(table(spark, sf_dir, "chat_requests").select(F.col("request_id").alias("key"), "question"), "question", rules)
    held = lookalikes.canonical(table(spark, sf_dir, "parents").select(F.col("parent_id").alias("key"), "text"), "text", rules)
    return asked.select(F.lit("chat_requests.question").alias("field"), "key", "canonical").unionByName(held.select(F.lit("parents.text").alias("field"), "key", "canonical"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mix and how often each is taken."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents")
    return documents, abuse.scored(documents, abuse.fitted(documents, table(spark, sf_dir, "abuse_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with abusive, hateful or sexually explicit language."""
    return _scores(spark, sf_dir)[1].filter(F.col("score") >= abuse.CASE).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and evidence of every document."""
    return _scores(spark, sf_dir)[1]


def p8_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores of the labelled documents beside the share of them that is marked, by tenths of the score."""
    model = abuse.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"))
    return spark.createDataFrame(abuse.reliability(model), "score_from double, documents bigint, mean_score double, marked double")  # at most ten rows


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of such documents of every source."""
    return abuse.rates(*_scores(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_canonical": p5_canonical,
    "p6_ids": p6_ids,
    "p7_drawn": p7_drawn,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
    "p8_reliability": p8_reliability,
}

SQL = {
    "p4_found": """
        SELECT DISTINCT parent_id FROM parents
        WHERE coalesce(length(text), 0) + CASE WHEN breadcrumb IS NOT NULL AND breadcrumb <> '' THEN length(breadcrumb) + 1 ELSE 0 END > 1600
    """,
}
