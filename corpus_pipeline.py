"""A training corpus from `documents`: five stages, each a Spark job over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns where each
document's token ids stand in the files that it wrote. Stages carry rows along inside their scans and join texts only to
drop near copies. A stage's result is written before the next begins, so a lost executor repeats a part of one stage.

Defined results. Null or empty texts: not toxic unless the model says so of no text at all, near copies of nothing, clean, mixed as
documents of size 0, encoded as the end id. Null ids: rows like others, that come first in the token files. Repeated ids: each row
is judged by its own text. A null source is a source of its own. Columns beside those of documents are left out, whatever their
names. No documents: no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import decontaminate, jaccard, mixing, tokens, toxicity
from lexspan.llm.common import DOC_COLUMNS, bound_batches, materialize, scratch_path, table

_REST = [c for c in DOC_COLUMNS if c != "doc_id"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*DOC_COLUMNS), model, keep=_REST).where("predicted = 0").select(*DOC_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: of the smallest id, and among those of the smallest hash of the text. Rows are
    judged by their own texts, also where they repeat an id or have none; a row without an id stays only if none of its group has one."""
    # written, so that every reader sees the same row numbers
    rows = materialize(docs.select(*DOC_COLUMNS, F.monotonically_increasing_id().alias("_row")), "pipeline-rows")
    order = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "_row").alias("place"))
    groups = jaccard.jaccard_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    stays = groups.join(order, "_row").groupBy("component_id").agg(F.min("place")["_row"].alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*DOC_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    found = decontaminate.decontaminate(docs.select(*DOC_COLUMNS), table(spark, sf_dir, "benchmark"), keep=_REST)
    return found.where(~F.col("contaminated")).select(*DOC_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be none."""
    found = mixing.mix(docs.select(*DOC_COLUMNS))
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*DOC_COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files."""
    form = tokens.default_format()
    return tokens.read_tokens(tokens.write_tokens(docs, scratch_path(spark, "pipeline-tokens"), form), form)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage with documents going to Python workers in small batches: all stages run in the same executors, one after the other."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _bounded(drop_toxic)),
    ("ngram_jaccard", _bounded(drop_near_copies)),
    ("decontamination", _bounded(drop_contaminated)),
    ("mixing", _bounded(mix_sources)),
    ("token_ids", _bounded(token_ids)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the toxicity model; tests/llm compares the stages with plain readings of their rules.
ORACLE_SQL = None
