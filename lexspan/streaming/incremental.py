"""An index that grows with a stream of documents: each micro-batch is cleaned, cut into chunks and appended.

A batch writes a folder of its own, named by the stream and the batch, so that a batch that is tried again overwrites itself and
nothing is rewritten. A document's rows carry its version and the file it came in; readers take the greatest of each document,
whatever order files or batches came in. compact() folds all batches into one.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexspan.functions.text import clean_text
from lexspan.operators.chunking import PROVENANCE, chunked

#: version: the greatest counts; without one, files count in the order of their paths.
DOCUMENT = "doc_id string, title string, text string, version long"


def units_of(docs: DataFrame) -> DataFrame:
    """One unit of each document (doc_id, title, text) that has text."""
    units = docs.select(F.lit(0).cast("long").alias("unit_idx"), "doc_id", F.col("title").alias("doc_title"), F.lit("").alias("article_no"), F.lit("").alias("chapter"), clean_text(F.col("text")).alias("text"), *(F.lit("").alias(c) for c in PROVENANCE))
    return units.where("text <> ''")


class ChunkIndex:
    def __init__(self, spark: SparkSession, root: str, strategy: str = "structure"):
        self.spark, self.root, self.strategy = spark, root, strategy

    def _batches(self) -> list[str]:
        """Folders of batches that were completed."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return sorted(f"{self.root}/{n}" for n in names if n.startswith("batch-") and fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The chunks of each document's latest version; None before the first batch."""
        folders = self._batches()
        return self._latest(self.spark.read.parquet(*folders)).where("chunk_id is not null").drop("_version", "_file") if folders else None

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("doc_id").orderBy(F.desc("_version"), F.desc("_file"))
        return rows.withColumn("_place", F.rank().over(order)).where("_place = 1").drop("_place").distinct()

    def merge(self, docs: DataFrame, batch: str | None = None) -> None:
        """Puts documents (doc_id, title, text and, if there are, version and _file) in: a later version of a document takes the place of all
        its chunks; one without text takes them away."""
        version = F.coalesce(F.col("version"), F.lit(0)).cast("long") if "version" in docs.columns else F.lit(0).cast("long")
        file = F.coalesce(F.col("_file"), F.lit("")) if "_file" in docs.columns else F.lit("")
        each = docs.select("doc_id", "title", "text", version.alias("_version"), file.alias("_file"))
        latest = each.groupBy("doc_id").agg(F.max(F.struct("_version", "_file", "title", "text")).alias("d")).select("doc_id", "d.*")
        made = chunked(units_of(latest), self.strategy).withColumnRenamed("doc_id", "_doc")
        rows = latest.select("doc_id", "_version", "_file").join(made, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
        rows.write.mode("overwrite").parquet(f"{self.root}/batch-{batch or uuid.uuid4().hex}")

    def compact(self) -> None:
        """Writes the latest rows of all batches as one batch and deletes those; readers that began before may have to begin again."""
        if not (folders := self._batches()):
            return
        self._latest(self.spark.read.parquet(*folders)).write.parquet(f"{self.root}/batch-{uuid.uuid4().hex}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for f in folders:
            fs.delete(path(f), True)

    def follow(self, folder: str, checkpoint: str) -> StreamingQuery:
        """Takes JSON lines of documents that appear in a folder, a file a batch, until all that is there is taken."""
        stream = self.spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", 1).json(folder).withColumn("_file", F.col("_metadata.file_path"))
        own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        started = stream.writeStream.foreachBatch(lambda df, n: self.merge(df, f"{own}-{n:012d}"))
        return started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
