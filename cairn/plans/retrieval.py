"""The retrieval plan from questions to a packed context; every step is lazy and keyed by ``q_id``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.config import DEFAULT, Retrieval
from cairn.functions.text import tokens
from cairn.operators import ranking, sparse
from cairn.runtime import settle, table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc_id, file, text): every block once; of rows that share an id one whole row is taken."""
    p = table(spark, sf_dir, "parents").filter("parent_id is not null")
    row = F.struct("doc_id", "text", F.col("source").alias("file"))
    return p.groupBy(F.col("parent_id").alias("id")).agg(F.min(row).alias("r")).select("id", "r.*")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the access columns of their document; blocks without document stay."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_ref").alias("doc_id"), "source", "status", "visibility", "tenant_id", "owner_id")
    return blocks(spark, sf_dir).join(d, "doc_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every request whose number is divisible by 20, with a question that has terms."""
    c = table(spark, sf_dir, "chat_requests").filter("try_cast(substr(request_id, 3) as bigint) % 20 = 0")
    c = c.select(F.col("request_id").alias("q_id"), "question", "tenant_id", "user_id").distinct()
    return with_terms(c)


def with_terms(asked: DataFrame, question: str = "question") -> DataFrame:
    return asked.withColumn("terms", tokens(F.col(question))).filter(F.size("terms") > 0)


def _audience() -> list[Column]:
    """Who may see a chunk: everybody, a tenant, or an owner; unpublished chunks and unknown values nobody."""
    shown, kind = F.coalesce(F.col("status") == "published", F.lit(False)), F.col("visibility")
    return [
        F.coalesce(shown & (kind == "public"), F.lit(False)).alias("public"),
        F.when(shown & (kind == "tenant"), F.col("tenant_id")).alias("tenant"),
        F.when(shown & (kind == "private"), F.col("owner_id")).alias("owner"),
    ]


@dataclass
class Pipeline:
    """Stages of one corpus and query set; each is a DataFrame."""

    chunks: DataFrame
    questions: DataFrame
    conf: Retrieval = DEFAULT

    def candidates(self, acl: bool = True, keep: int | None = None) -> DataFrame:
        """(q_id, id, score, overlap, doc_id, source): of every question the best chunks of either channel that its
        asker may see. Chunks are tokenised once; equal questions of one asker are searched once."""
        docs = settle(sparse.tokenized(self.chunks, "id", "text", "doc_id", "source", *_audience()))
        asker = [F.col("tenant_id"), F.col("user_id")] if acl else [F.lit(None).cast("string"), F.lit(None).cast("string")]
        asked = self.questions.select("q_id", "terms", asker[0].alias("tenant"), asker[1].alias("user"))
        asked = settle(asked.withColumn("gid", F.min("q_id").over(Window.partitionBy("terms", "tenant", "user"))))
        found = sparse.nearest(asked.filter("q_id = gid").select("gid", "terms", "tenant", "user"), docs, acl, keep or self.conf.channel_k, self.conf)
        return asked.select("q_id", "gid").join(found, "gid").drop("gid")

    def sparse(self, found: DataFrame) -> DataFrame:
        ranked = ranking.top_k(found, self.conf.channel_k, F.desc("score"), F.asc("id"))
        return ranked.filter(F.col("score") > 0)

    def overlap(self, found: DataFrame) -> DataFrame:
        """The second channel: stands in for a vector channel, which needs a model."""
        return ranking.top_k(found, self.conf.channel_k, F.desc("overlap"), F.asc("id"))

    def fused(self, found: DataFrame, k: int | None = None) -> DataFrame:
        return ranking.fuse([self.sparse(found), self.overlap(found)], k or self.conf.rrf_k, self.conf.pool)

    def reranked(self, found: DataFrame) -> DataFrame:
        """Fused rows with the stand-in relevance (10 times the overlap), best first."""
        rows = self.fused(found).drop("rank").join(found.select("q_id", "id", "overlap", "doc_id", "source"), ["q_id", "id"])
        rows = rows.withColumn("relevance", F.round(10 * F.col("overlap"), 6))
        return ranking.top_k(rows, self.conf.pool, F.desc("relevance"), F.asc("id"))

    def selected(self, found: DataFrame) -> DataFrame:
        return ranking.diverse(self.reranked(found), "relevance", "source", self.conf)

    def expanded(self, found: DataFrame, documents: DataFrame) -> DataFrame:
        """The first chunk of each document with the document's text, else the chunk's own."""
        rows = self.selected(found).join(self.chunks.select("id", "text"), "id")
        parents = documents.select(F.col("doc_ref").alias("doc_id"), F.col("text").alias("parent_text"))
        out = ranking.expand(rows, parents, "doc_id", "text", self.conf)
        return out.withColumn("chars", F.length("context").cast("bigint"))


def pipeline(spark: SparkSession, sf_dir: str, conf: Retrieval = DEFAULT) -> Pipeline:
    return Pipeline(chunks(spark, sf_dir), questions(spark, sf_dir), conf)
