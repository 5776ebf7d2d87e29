"""Sinks: reports, versioned snapshots, and metric exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report with its columns in sorted order and a header."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """A snapshot under its version; it counts only once it is complete, and is never changed in place."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame | None:
    """The snapshot of exactly this version, or None if there is none that is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={version}/_SUCCESS")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(f"{root}/version={version}") if fs.exists(path) else None


def replace_source(existing: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """``existing`` with the rows of every source of ``new`` replaced by those of ``new``; an empty ``new``
    deletes nothing."""
    kept = existing.join(new.select(source).distinct(), source, "left_anti").select(existing.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def exposition(counts: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(line): metric lines of a table of counts, to be written in order of ``line``."""
    parts = [F.concat(F.lit(f'{x}="'), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit('"')) for x in sorted(labels)]
    return counts.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")


def append_audit(rows: DataFrame, path: str, detail: str = "detail", most: int = 500) -> bool:
    """Append audit rows, each detail cut to ``most`` characters. A failure is reported by False and never raised, as what
    is audited must not fail because of it."""
    try:
        rows.withColumn(detail, F.left(F.col(detail), F.lit(most))).write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def miss_report(misses: DataFrame, *columns: str) -> DataFrame:
    """(line): a Markdown table of the missed questions, to be written in order of ``nth``."""
    cell = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\r\n]+", " ") for c in columns]
    body = misses.select(F.lit(2).alias("nth"), F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))
    head = misses.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "nth int, line string")
    return head.unionByName(body).orderBy("nth", "line").select("line")
