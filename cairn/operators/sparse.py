"""Sparse retrieval: BM25 (Okapi) statistics as aggregations, and search of a stated query set in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.config import DEFAULT, Retrieval
from cairn.functions.text import tokens
from cairn.runtime import settle

#: Questions that one pass over the rows answers; they are sent to the tasks with their terms' weights.
PASS = 20_000
#: Rows that are scored together.
ROWS = 2048
_FOUND = "gid string, id string, doc_id string, source string, score double, overlap double"


def tokenized(df: DataFrame, key: str, text: str, *more: str | Column) -> DataFrame:
    """(id, terms, len): each row's terms, in order and with repetitions; and any further columns."""
    return df.select(F.col(key).alias("id"), *more, tokens(F.col(text)).alias("terms")).withColumn("len", F.size("terms").cast("bigint"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf): rows that hold a term, and its occurrences. Rows are told apart by their first occurrence of a
    term, so that only partial counts are shuffled."""
    counts = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    every = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return docs.select(F.inline(F.concat(counts, every))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): each row's distinct terms are found within the row, so only partial counts are shuffled."""
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(frequencies: DataFrame, total: int, epsilon: float = DEFAULT.bm25_epsilon) -> DataFrame:
    """(term, idf) among ``total`` rows: negative values are replaced by ``epsilon`` times the mean over the vocabulary."""
    raw = frequencies.select("term", (F.log(F.lit(total) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    # the join is with a single row
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class Questions:
    """A block of questions: for each its group, asker, terms (numbers in ``terms``) and their weights."""

    gids: list[str]
    askers: list[tuple[str | None, str | None]]
    terms: pa.Array
    of: list[np.ndarray]
    weights: list[np.ndarray]
    acl: bool
    keep: int
    mean_len: float
    k: float
    b: float

    def postings(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first posting of each term, row, part of the score) of a batch of rows."""
        lists = batch.column("terms")
        n = np.diff(lists.offsets.to_numpy())
        code = pc.index_in(lists.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        key, tf = np.unique((code * len(n) + row)[code >= 0], return_counts=True)
        row = key % max(1, len(n))
        part = tf * (self.k + 1) / (tf + self.k * (1 - self.b + self.b * n[row] / self.mean_len))
        return np.searchsorted(key // max(1, len(n)), np.arange(len(self.terms) + 1)), row, part

    def seen_by(self, batch: pa.RecordBatch):  # noqa: ANN201
        """The function from an asker to the rows that they may see."""
        if not self.acl:
            return lambda asker: True  # noqa: ARG005
        public = batch.column("public").to_numpy(zero_copy_only=False).astype(bool)
        tenant, owner = (batch.column(c).to_pylist() for c in ("tenant", "owner"))
        codes: dict = {}
        tenant, owner = (np.array([-1 if x is None else codes.setdefault((i, x), len(codes)) for x in col]) for i, col in enumerate((tenant, owner)))
        known: dict = {}

        def rows(asker: tuple) -> np.ndarray:
            if asker not in known:
                known[asker] = public | (tenant == codes.get((0, asker[0]), -2)) | (owner == codes.get((1, asker[1]), -2))
            return known[asker]

        return rows


class _Best:
    """The first ``keep`` of a question by one channel, as sorted (-value, id, ...) of the rows seen so far."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, []

    @property
    def floor(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.keep else 0.0

    def add(self, value: np.ndarray, at: np.ndarray, describe) -> None:  # noqa: ANN001
        ok = np.flatnonzero(value >= self.floor)
        if len(ok) > self.keep:  # rows come in the order of their ids
            ok = ok[np.argsort(-value[ok], kind="stable")[: self.keep]]
        self.rows = sorted([*self.rows, *((-float(value[i]), *describe(int(at[i]))) for i in ok)])[: self.keep]


def _search(questions: Questions):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = questions
        best = [(_Best(q.keep), _Best(q.keep)) for _ in q.gids]
        for big in batches:
            big = big.sort_by("id")
            for begin in range(0, big.num_rows, ROWS):
                batch = pa.Table.from_batches([big.slice(begin, ROWS)]).combine_chunks().to_batches()[0]
                starts, row, part = q.postings(batch)
                most = np.zeros(len(q.terms))
                filled = np.flatnonzero(np.diff(starts))
                if len(filled):
                    most[filled] = np.maximum.reduceat(part, starts[filled])
                seen, name = q.seen_by(batch), [batch.column(c).to_pylist() for c in ("id", "doc_id", "source")]
                for i, (of, weight) in enumerate(zip(q.of, q.weights, strict=True)):
                    n = starts[of + 1] - starts[of]
                    by_score, by_overlap = best[i]
                    # no row of the batch can be among the first of either channel
                    if not n.any() or (weight @ most[of] < by_score.floor - 1e-6 and np.count_nonzero(n) / len(of) < by_overlap.floor - 1e-6):
                        continue
                    at = np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    hits = np.bincount(row[at], minlength=batch.num_rows)
                    score = np.bincount(row[at], part[at] * np.repeat(weight, n), minlength=batch.num_rows)
                    held = np.flatnonzero((hits > 0) & seen(q.askers[i]))
                    value, share = np.round(score[held], 6), np.round(hits[held] / len(of), 6)

                    def describe(j: int, value=value, share=share, held=held, name=name) -> tuple:  # noqa: ANN001
                        k = int(held[j])
                        return name[0][k], name[1][k], name[2][k], float(value[j]), float(share[j])

                    every = np.arange(len(held))
                    by_score.add(value, every, describe)
                    by_overlap.add(share, every, describe)
        rows = [(gid, *x) for gid, two in zip(q.gids, best, strict=True) for x in {r[1]: r[1:] for b in two for r in b.rows}.values()]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.string()] * 4 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["gid", "id", "doc_id", "source", "score", "overlap"])

    return run


def nearest(groups: DataFrame, docs: DataFrame, acl: bool, keep: int, conf: Retrieval = DEFAULT) -> DataFrame:
    """(gid, id, doc_id, source, score, overlap): for each question at least the ``keep`` rows of highest BM25 score and
    of highest overlap (share of the question's different terms), ties by id, among those that its asker may see.

    ``groups`` has (gid, terms, tenant, user), ``docs`` (id, doc_id, source, public, tenant, owner, terms, len), both
    settled. Statistics are those of all rows; a term that a question repeats counts as often. Questions are sent to
    the rows in blocks of ``PASS`` with the weights of their terms; a task keeps ``keep`` rows of each channel for each
    question, passes over rows that by the largest parts of their terms cannot be among them, and passes on no others.
    """
    total, mean_len = docs.agg(F.count("*"), F.avg("len")).first()
    weights = idf(settle(document_frequencies(docs)), total, conf.bm25_epsilon)
    n = max(1, -(-groups.count() // PASS))
    columns = ["id", "doc_id", "source", *(["public", "tenant", "owner"] if acl else []), "terms"]
    found = []
    for i in range(n):
        block = groups.filter(F.pmod(F.xxhash64("gid"), F.lit(n)) == i)
        rows = block.collect()  # about PASS questions
        wanted = block.select(F.explode("terms").alias("term")).distinct()
        weight = {r.term: r.idf for r in weights.join(wanted, "term", "left_semi").collect()}
        number = {t: j for j, t in enumerate(weight)}
        of, by = [], []
        for r in rows:
            counts = {t: r.terms.count(t) for t in dict.fromkeys(r.terms)}
            absent = len(number)  # a term that no row has
            of.append(np.array([number.get(t, absent) for t in counts], np.int64))
            by.append(np.array([weight.get(t, 0.0) * c for t, c in counts.items()]))
        terms = pa.array([*weight, "\n"], pa.string())
        asked = Questions([r.gid for r in rows], [(r.tenant, r.user) for r in rows], terms, of, by, acl, keep, mean_len or 1.0, conf.bm25_k1, conf.bm25_b)
        found.append(docs.select(*columns).mapInArrow(_search(asked), _FOUND))
    return reduce(DataFrame.unionByName, found)
