"""Exact neighbours by cosine from vectors stored by pivot, most of which a query never reads.

Angles keep the triangle inequality: a vector whose angle to a pivot lies between low and high is no nearer to a query, which has angle a
to that pivot, than max(a - high, low - a). Vectors are stored in cells: by the pivot that is nearest to them, by ring of their angle to it,
and beyond CELL vectors by a hash of their id. A query reads the cells of the best bounds until they have k vectors, which gives a floor;
cells whose bound stays below it are never read. What is read is multiplied cell by cell with the queries that read it.

Pivots are PIVOTS stored vectors, the first by a hash of their id: which they are changes what is read, never what is found.

Defined results. The rows of vectors.cosine_top_k. A vector of zeros, or one with a value that isn't finite, has cosine 0 to all. Ties go to
the smaller doc.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.operators.lexical import best, top_k
from lexspan.scratch import materialize

#: Stored vectors that are pivots; rings of half a turn; vectors in a cell and queries of a product, about; cells read first.
PIVOTS, RINGS, CELL, QUERIES, SEEDS = 32, 64, 1024, 2000, 4
#: Radians that rounding may take from an angle, scores that it may take from a product.
SLACK_ANGLE, SLACK = 1e-6, 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros where a row has no direction."""
    with np.errstate(all="ignore"):
        y = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return np.where(np.isfinite(y).all(axis=1)[:, None], y, 0.0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _angles(rows: DataFrame, key: str, pivots: np.ndarray, every: bool) -> DataFrame:
    """rows (key, vector) with pivot and angle: of the nearest pivot (-1 without a direction), or of every one."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _unit(_matrix(part["vector"]))
                angle = np.arccos(np.clip(x @ sent.value.T, -1, 1)) if len(sent.value) else np.zeros((len(x), 1))
                none = ~x.any(axis=1)
                if every:
                    n = angle.shape[1]
                    take = np.repeat(np.arange(len(x)), n)
                    yield pa.RecordBatch.from_arrays([part[key].take(pa.array(take)), pa.array(np.tile(np.arange(n), len(x))), pa.array(angle.ravel()), pa.array(none[take])], names=[key, "pivot", "angle", "none"])
                else:
                    near = angle.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in (key, "vector")), pa.array(np.where(none, -1, near)), pa.array(angle[np.arange(len(x)), near])], names=[key, "vector", "pivot", "angle"])

    kind = rows.schema[key].dataType.simpleString()
    made = f"{key} {kind}, pivot long, angle double, none boolean" if every else f"{key} {kind}, vector array<double>, pivot long, angle double"
    return rows.select(key, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, made)


@dataclass(frozen=True)
class PivotIndex:
    """vectors: doc, vector, cell. cells: cell, pivot, low, high (angles), n. pivots: place, vector."""

    vectors: DataFrame
    cells: DataFrame
    pivots: DataFrame

    @staticmethod
    def save(vectors: DataFrame, path: str, *, pivots: int = PIVOTS, rings: int = RINGS, cell: int = CELL) -> None:
        """vectors: doc, vector."""
        spark = vectors.sparkSession
        order = F.xxhash64("doc"), F.col("doc")
        chosen = vectors.where(F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: F.abs(x) < float("inf"))).orderBy(*order).limit(pivots)
        chosen.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("place"), F.col("vector").cast("array<double>").alias("vector")).write.parquet(f"{path}/pivots")  # PIVOTS rows
        held = [r.vector for r in spark.read.parquet(f"{path}/pivots").orderBy("place").collect()]
        ring = F.when(F.col("pivot") < 0, F.lit(0)).otherwise(F.floor(F.col("angle") * (rings / np.pi))).cast("long")
        placed = materialize(_angles(vectors, "doc", _unit(np.array(held)) if held else np.empty((0, 1)), False).withColumn("ring", ring), "pivot-angles")
        sizes = placed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / cell).cast("long").alias("parts"))
        parted = placed.join(sizes, ["pivot", "ring"]).withColumn("cell", F.concat_ws("-", "pivot", "ring", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("string")))
        parted.select("cell", "pivot", "angle", "doc", "vector").repartitionByRange("cell").sortWithinPartitions("cell").write.parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors")
        stored.groupBy("cell", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PivotIndex:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("vectors", "cells", "pivots")))

    def search(self, queries: DataFrame, k: int = 20, *, digits: int | None = None, seeds: int = SEEDS) -> DataFrame:
        """qid, doc, score, rank. queries: qid, vector, a stated set."""
        return self.searched(queries, k, digits=digits, seeds=seeds)[0]

    def searched(self, queries: DataFrame, k: int = 20, *, digits: int | None = None, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
        """search(), and for each query: vectors, and how many were read."""
        held = [r.vector for r in self.pivots.orderBy("place").collect()]
        angles = _angles(queries, "qid", _unit(np.array(held)) if held else np.empty((0, 1)), True)
        none = angles.select("qid", F.lit(-1).cast("long").alias("pivot"), F.lit(0.0).alias("angle"), "none").distinct()
        near = F.greatest(F.lit(0.0), F.col("angle") - F.col("high"), F.col("low") - F.col("angle")) - SLACK_ANGLE
        bound = F.when(F.col("none") | (F.col("pivot") < 0), 0.0).otherwise(F.cos(F.greatest(F.lit(0.0), near)))
        bounds = angles.unionByName(none).join(self.cells, "pivot").select("qid", "cell", "n", bound.alias("bound"))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "cell")
        ahead = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bounds = materialize(bounds.withColumn("seed", (ahead < k) | (F.row_number().over(order) <= seeds)), "pivot-bounds")
        first = materialize(self._scores(queries, bounds.where("seed"), k, digits), "pivot-scores")
        floors = top_k(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        unit = 0.0 if digits is None else 10.0**-digits
        more = bounds.where("NOT seed").join(floors, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK - unit)).drop("floor")
        more = materialize(more, "pivot-reads")
        found = top_k(first.unionByName(self._scores(queries, more, k, digits)), k)
        read = bounds.where("seed").unionByName(more).groupBy("qid").agg(F.sum("n").alias("read"))
        return found, bounds.groupBy("qid").agg(F.sum("n").alias("vectors")).join(read, "qid")

    def _scores(self, queries: DataFrame, reads: DataFrame, k: int, digits: int | None) -> DataFrame:
        """qid, doc, score: of each cell that a query reads its k best, and what ties with the k-th."""
        parts = max(1, -(-queries.count() // QUERIES))
        part = F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("part")
        asked = reads.select("qid", "cell").join(queries.select("qid", F.col("vector").cast("array<double>").alias("vector")), "qid").select("cell", part, "qid", "vector")
        wanted = asked.select(F.col("cell").alias("_cell"), F.col("part").alias("_part")).distinct()
        stored = self.vectors.join(wanted, F.col("cell") == F.col("_cell")).select(F.col("_cell").alias("cell"), F.col("_part").alias("part"), "doc", "vector")
        qid, doc = queries.schema["qid"].dataType, self.vectors.schema["doc"].dataType

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row, col, s = best(np.nan_to_num(_unit(_matrix(left["vector"])) @ _unit(_matrix(right["vector"])).T), k, digits)
            return pa.table([left["qid"].take(pa.array(row)), right["doc"].take(pa.array(col)), pa.array(s)], names=["qid", "doc", "score"])

        schema = T.StructType([T.StructField("qid", qid), T.StructField("doc", doc), T.StructField("score", T.DoubleType())])
        return asked.groupBy("cell", "part").cogroup(stored.groupBy("cell", "part")).applyInArrow(run, schema)
