"""Writers: chunks by strategy, law files with a manifest, reports that are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, strategy: str, *, as_json: bool = False) -> None:
    """Payloads under path/strategy=..., Parquet or JSON lines."""
    out = chunks.withColumn("strategy", F.lit(strategy)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy")
    out.json(path) if as_json else out.parquet(path)


def write_laws(laws: DataFrame, path: str) -> DataFrame:
    """Normalised law records as JSON, a folder for each law, and the manifest (name, num_articles), written beside them."""
    laws.write.mode("errorifexists").partitionBy("name").json(f"{path}/laws")
    manifest = laws.select("name", F.size("articles").alias("num_articles"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def write_once(report: DataFrame, path: str) -> None:
    """A report of few rows; an error if it is there already."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def markdown_table(report: DataFrame, *columns: str, limit: int = 200) -> str:
    """A report of few rows as a Markdown table; an error if it has more than `limit`, as nothing is left out."""
    rows = report.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the report has more than {limit} rows")
    line = lambda xs: "| " + " | ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(columns), "|" + "---|" * len(columns), *(line(r) for r in rows)])


def write_or_check(report: DataFrame, path: str, *, check: bool) -> None:
    """Writes a report, or checks that the one that is there has just its rows."""
    if not check:
        report.write.mode("overwrite").parquet(path)
        return
    there = report.sparkSession.read.parquet(path).select(*report.columns)
    if not there.exceptAll(report).isEmpty() or not report.exceptAll(there).isEmpty():
        raise ValueError(f"what is at {path} isn't what would be written")
