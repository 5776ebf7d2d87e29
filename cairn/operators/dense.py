"""Dense retrieval: exact cosine top-k of a stated query set against all vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.ranking import top_k

#: Query vectors that one pass over the corpus answers, and rows that are compared together.
PASS, ROWS = 4096, 2048


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def first_per_query(q: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each query by score, then key."""
    order = np.lexsort((key, -score, q))
    begins = np.searchsorted(q[order], q[order], "left")
    return order[np.arange(len(order)) - begins < k]


def _search(q_keys: np.ndarray, q_vectors: np.ndarray, q_groups: np.ndarray | None, k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for big in batches:
            for begin in range(0, big.num_rows, ROWS):
                batch = big.slice(begin, ROWS)
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1))
                cos = np.round(q_vectors @ vectors.T, 6)
                cos[q_keys[:, None] == keys[None, :]] = -2
                if q_groups is not None:
                    cos[q_groups[:, None] != batch.column(2).to_numpy(zero_copy_only=False)[None, :]] = -2
                least = np.partition(cos, -k, axis=1)[:, -k] if cos.shape[1] > k else np.full(len(cos), -2.0)
                at, col = np.nonzero((cos >= least[:, None]) & (cos > -2))
                kept = [np.concatenate(x) for x in zip(kept, (at, cos[at, col], keys[col]), strict=True)]
                first = first_per_query(*kept, k)
                kept = [x[first] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(q_keys[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], ["q_id", "id", "score"])

    return run


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, within: str | None = None) -> DataFrame:
    """(q_id, id, score, rank): the ``k`` vectors of highest cosine for each query, itself left out; ties by key.

    Queries are sent to the corpus in blocks of ``PASS``; the corpus stays where it is, and each task passes on only
    the ``k`` best of each query. ``within`` names a bigint column that both have: only rows with the query's value
    are searched, as in a search of one document. Zero vectors have cosine 0; null and empty vectors take no part,
    nor do null values of ``within``. Vectors must all have one length.
    """
    ok = (F.col(key).isNotNull()) & (F.size(vector) > 0)
    columns = [F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")] + ([F.col(within).cast("bigint").alias("g")] if within else [])
    corpus, queries = (df.filter(ok & F.col(within).isNotNull() if within else ok).select(*columns) for df in (corpus, queries))
    n = max(1, -(-queries.count() // PASS))
    found = []
    for i in range(n):
        block = queries.filter(F.pmod(F.xxhash64("k"), F.lit(n)) == i).toArrow()  # about PASS vectors
        keys = block["k"].to_numpy()
        vectors = _unit(np.array(block["v"].to_pylist(), np.float64).reshape(len(keys), -1))
        groups = block["g"].to_numpy() if within else None
        found.append(corpus.mapInArrow(_search(keys, vectors, groups, k), "q_id bigint, id bigint, score double") if len(keys) else corpus.select("k", F.col("k").alias("id"), F.lit(0.0).alias("score")).limit(0).toDF("q_id", "id", "score"))
    return top_k(reduce(DataFrame.unionByName, found), k, F.desc("score"), F.asc("id"))


def label_margin(queries: DataFrame, examples: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(q_id, label, score, margin): the label of each query's nearest example, ties by label, and how much nearer it is
    than the nearest example of any other label (or than 0 if there is none). A query is no example of its own.

    Each task passes on one example of each label that it holds for each query.
    """
    ok = F.col(key).isNotNull() & (F.size(vector) > 0) & F.col(label).isNotNull()
    rows = examples.filter(ok).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"), F.col(label).cast("bigint").alias("g"))
    asked = queries.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))
    n = max(1, -(-asked.count() // PASS))
    found = []
    for i in range(n):
        block = asked.filter(F.pmod(F.xxhash64("k"), F.lit(n)) == i).toArrow()  # about PASS vectors
        keys = block["k"].to_numpy()
        found.append(rows.mapInArrow(_by_label(keys, _unit(np.array(block["v"].to_pylist(), np.float64).reshape(len(keys), -1))), "q_id bigint, label bigint, score double"))
    best = reduce(DataFrame.unionByName, found).groupBy("q_id", "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc("label"))
    ranked = best.withColumn("n", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.filter("n = 1").select("q_id", F.col("label").cast(examples.schema[label].dataType).alias("label"), "score", "margin")


def _by_label(q_keys: np.ndarray, q_vectors: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for big in batches:
            for begin in range(0, big.num_rows if len(q_keys) else 0, ROWS):
                batch = big.slice(begin, ROWS)
                keys, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                cos = np.round(q_vectors @ _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)).T, 6)
                cos[q_keys[:, None] == keys[None, :]] = -2
                for g in np.unique(labels).tolist():
                    best[g] = np.maximum(best.get(g, -2.0), cos[:, labels == g].max(1))
        for g, score in best.items():
            at = np.flatnonzero(score > -2)
            yield pa.RecordBatch.from_arrays([pa.array(q_keys[at]), pa.array(np.full(len(at), g)), pa.array(score[at])], ["q_id", "label", "score"])

    return run
