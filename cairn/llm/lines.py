"""Lines repeated across one source's documents (problem 2).

Method: tables of line counts per source are kept incrementally (``State``). ``advance`` takes a partition of new or
re-sent blocks as a delta: its lines are counted, what re-sent blocks counted before is taken back, the counts are
merged by summing, and of the sources that the delta touches the lines that crossed the threshold, either way, are
found by comparing the tables before and after. Only blocks that contain such a line, and those of the delta, are
rebuilt. ``save`` and ``load`` keep the tables between runs.

Counts are pre-aggregated before the shuffle and keyed by (source, line), so a source that holds a third of all rows
is spread over its lines; a hot line is summed from partial counts. Blocks go by their own ids; sources and lines by
64-bit hashes, and lines only within a source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.runtime import settle

#: A line is repeated if it stands in at least so many blocks and in at least this share of the source's.
MIN_BLOCKS, MIN_SHARE = 4, 0.15
_LEFT_OUT = re.compile(r"[\s0-9]+")


def line_form(line: str) -> str:
    """What is compared of a line: compatibility forms, letter case, white space and digits left out."""
    return _LEFT_OUT.sub("", unicodedata.normalize("NFKC", line).lower())


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def block_lines(blocks: DataFrame, source: str = "doc_id", block: str = "parent_id", text: str = "text") -> DataFrame:
    """(source, block, line, line_nos): each distinct countable line of each block, with the places where it stands.

    Blank lines and lines that begin with ``|`` do not count. Null source, block or text: no rows.
    """
    cols = blocks.select(blocks[source].alias("s"), blocks[block].alias("block"), blocks[text].alias("t"))
    cols = cols.filter("s is not null and block is not null and t is not null").select(F.xxhash64("s").alias("source"), F.col("block").cast("string"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in batches:
            if len(known) > 500_000:
                known.clear()
            source, block = (part.column(i).to_pylist() for i in range(2))
            out: tuple[list, ...] = ([], [], [], [])
            for i, text in enumerate(part.column(2).to_pylist()):
                places: dict[int, list[int]] = {}
                for no, line in enumerate(text.split("\n")):
                    if not line or line[0] == "|" or line.isspace():
                        continue
                    key = known.get(line)
                    if key is None:
                        key = known[line] = _hash(line_form(line))
                    places.setdefault(key, []).append(no)
                k = len(places)
                for c, v in zip(out, ([source[i]] * k, [block[i]] * k, places, places.values()), strict=True):
                    c.extend(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["source", "block", "line", "line_nos"])

    return cols.mapInArrow(run, "source bigint, block string, line bigint, line_nos array<int>")


def line_counts(lines: DataFrame) -> DataFrame:
    """(source, line, blocks): in how many blocks a line stands; ``lines`` has no block twice."""
    return lines.groupBy("source", "line").agg(F.count("*").alias("blocks"))


def block_ids(blocks: DataFrame, source: str = "doc_id", block: str = "parent_id") -> DataFrame:
    """(source, block): the different blocks that belong to a source."""
    ids = blocks.filter(blocks[source].isNotNull() & blocks[block].isNotNull())
    return ids.select(F.xxhash64(blocks[source]).alias("source"), blocks[block].cast("string").alias("block")).distinct()


def merge(state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The counts of a table and of a delta summed; what falls to 0 is left out."""
    return state.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


def repeated(counts: DataFrame, sizes: DataFrame, min_blocks: int = MIN_BLOCKS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, line) of the lines at or over both thresholds."""
    often = counts.filter(F.col("blocks") >= min_blocks)
    share = F.round(F.lit(min_share) * 10000).cast("bigint")  # whole numbers: no share is lost to rounding
    return often.join(sizes, "source").filter(F.col("blocks") * 10000 >= F.col("total") * share).select("source", "line")


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, line, crossed): lines newly over the thresholds (1) and lines no longer over them (-1)."""
    both = before.select("source", "line", F.lit(-1).alias("crossed")).unionByName(after.select("source", "line", F.lit(1).alias("crossed")))
    return both.groupBy("source", "line").agg(F.sum("crossed").alias("crossed")).filter("crossed <> 0")


@dataclass(frozen=True)
class State:
    """The tables that are kept: ``blocks`` (source, block), ``places`` (source, block, line, line_nos) of all countable
    lines, ``counts`` (source, line, blocks), ``hits`` (source, line) of the lines over the thresholds and ``marked``
    (block, line_nos), where those stand."""

    blocks: DataFrame
    places: DataFrame
    counts: DataFrame
    hits: DataFrame
    marked: DataFrame


@dataclass(frozen=True)
class Step:
    """What a delta brings: the new state, the lines that crossed (source, line, crossed) and the blocks (block) whose
    marked lines may differ from before, those of the delta among them."""

    state: State
    crossed: DataFrame
    rebuild: DataFrame


def advance(state: State | None, delta: DataFrame, source: str = "doc_id", block: str = "parent_id", text: str = "text") -> Step:
    """The state after the blocks of ``delta``; None is the state before any. A block that the state has already is
    replaced, whatever its text was; rows of one block within the delta are one block (that of the smallest text, then
    source; null is the smallest).

    Counts, hits and marks are cut off in the checkpoint folder; ``blocks`` and ``places`` are unions over what was cut
    off, so a state that is to be advanced often is to be saved.
    """
    cols = delta.select(delta[source].alias("source"), delta[block].cast("string").alias("block"), delta[text].alias("text")).filter("source is not null and block is not null")
    form = F.xxhash64("source", "text")
    ids = settle(cols.groupBy("block").agg(F.min(F.xxhash64("source")).alias("source"), (F.min(form) != F.max(form)).alias("differ")))
    if not ids.filter("differ").isEmpty():
        cols = cols.groupBy("block").agg(F.min(F.struct("text", "source")).alias("r")).select("block", "r.*")
        ids = settle(cols.select("block", F.xxhash64("source").alias("source")))
    found = settle(block_lines(cols, "source", "block", "text").dropDuplicates(["source", "block", "line"]))
    fresh = ids.select("source", "block")
    if state is None:
        counts = settle(line_counts(found))
        hits = settle(repeated(counts, fresh.groupBy("source").agg(F.count("*").alias("total"))))
        marked = settle(found.join(hits, ["source", "line"], "left_semi").select(*found.columns))
        return Step(State(fresh, found, counts, hits, marked), hits.withColumn("crossed", F.lit(1).cast("bigint")), fresh.select("block"))
    again = settle(state.blocks.join(fresh.select("block"), "block", "left_semi"))
    resent = again.select("block")
    kept, old = (state.places.join(resent, "block", how).select(*found.columns) for how in ("left_anti", "left_semi"))
    touched = fresh.select("source").unionByName(again.select("source")).distinct()
    change = line_counts(found).unionByName(line_counts(old).withColumn("blocks", -F.col("blocks")))
    counts = settle(merge(state.counts, change, ["source", "line"], "blocks"))
    blocks = state.blocks.join(resent, "block", "left_anti").unionByName(fresh)
    sizes = blocks.join(touched, "source", "left_semi").groupBy("source").agg(F.count("*").alias("total"))
    after = settle(repeated(counts.join(touched, "source", "left_semi"), sizes))
    crossed = settle(crossings(state.hits.join(touched, "source", "left_semi"), after))
    hits = state.hits.join(touched, "source", "left_anti").unionByName(after)
    gone = state.marked.join(resent, "block", "left_anti").join(crossed.filter("crossed < 0"), ["source", "line"], "left_anti")
    newly = kept.join(crossed.filter("crossed > 0"), ["source", "line"], "left_semi")
    own = found.join(after, ["source", "line"], "left_semi")
    marked = settle(gone.unionByName(newly).unionByName(own))
    rebuild = kept.join(crossed, ["source", "line"], "left_semi").select("block").unionByName(fresh.select("block")).distinct()
    return Step(State(blocks, kept.unionByName(found), counts, hits, marked), crossed, rebuild)


def save(state: State, path: str) -> None:
    """Write the tables below ``path``, a new folder of the shared file system."""
    for f in fields(state):
        getattr(state, f.name).write.mode("errorifexists").parquet(f"{path}/{f.name}")


def load(spark: SparkSession, path: str) -> State:
    return State(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(State)))


def removed(blocks: DataFrame, found: DataFrame, block: str = "parent_id", text: str = "text") -> DataFrame:
    """``blocks`` with the found lines taken out of the text, all else as it is; rows and columns stay.

    ``found`` has (block, line_nos). Blocks without such lines keep their text; null stays null.
    """
    nos = found.groupBy("block").agg(F.flatten(F.collect_list("line_nos")).alias("__nos"))
    rows = blocks.join(nos.withColumnRenamed("block", "__b"), F.col(block) == F.col("__b"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(F.col("__nos"), i)), "\n")
    return rows.withColumn(text, F.when(F.col("__nos").isNull(), F.col(text)).otherwise(kept)).drop("__b", "__nos")


def rebuilt(before: DataFrame, blocks: DataFrame, step: Step, block: str = "parent_id", text: str = "text") -> DataFrame:
    """The cleaned blocks after a step: those of ``before`` (cleaned earlier) that it does not concern as they are, and
    the others made anew from ``blocks``, the blocks as stored, no block twice."""
    names = step.rebuild.select(F.col("block").alias(block))
    anew = removed(blocks.join(names, block, "left_semi"), step.state.marked.join(step.rebuild, "block", "left_semi"), block, text)
    return before.join(names, block, "left_anti").unionByName(anew).select(*before.columns)
