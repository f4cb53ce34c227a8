"""Dense vectors: a deterministic stand-in embedder, exact cosine search in blocks, an embedding cache and a keyed store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexspan.functions.words import md5_heads
from lexspan.operators.checks import held
from lexspan.operators.lexical import CELLS, Best, token_parts, top_k

DIMENSIONS = 256
#: Query vectors in one block; each block goes to every executor and scans the store once.
BLOCK = 2000
#: Stored vectors that a task takes up at once.
STORED = 1 << 12
#: What makes ids and rows of a matrix of a task's batches.
Made = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.Array, np.ndarray]]]


def hashed_counts(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc, bucket, value: token counts summed into buckets by md5. A stand-in for a model's vectors."""
    bucket = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dimensions
    each = docs.select("doc", F.explode("tokens").alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n"))
    return each.groupBy("doc", bucket.alias("bucket")).agg(F.sum("n").alias("value"))


def dense(sparse: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc, vector of (doc, bucket, value)."""
    filled = F.map_from_entries(F.collect_list(F.struct("bucket", "value")))
    zero = F.lit(0).cast("double")
    return sparse.groupBy("doc").agg(filled.alias("m")).select("doc", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")).cast("double"), zero)).alias("vector"))


def hashed(batches: Iterator[pa.RecordBatch], dimensions: int = DIMENSIONS) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and rows of dense(hashed_counts()) of rows that have tokens, or a text with some."""
    for part, size, words in token_parts(batches, max(1, CELLS // dimensions)):
        words = words.dictionary_encode()
        bucket = md5_heads(words.dictionary) % dimensions
        made = np.bincount(np.repeat(np.arange(len(size)) * dimensions, size) + bucket[words.indices.to_numpy()], minlength=len(size) * dimensions).reshape(-1, dimensions)
        some = size > 0
        yield (part["doc"], made.astype(float)) if some.all() else (part["doc"].filter(pa.array(some)), made[some].astype(float))


def hashed_vectors(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc, vector: dense(hashed_counts(docs)) of documents (doc, tokens) that have tokens, made batch by batch without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, rows in hashed(batches, dimensions):
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1) * dimensions, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([doc, vector], names=["doc", "vector"])

    return docs.select("doc", "tokens").mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, vector array<double>")


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and rows of stored vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, STORED):
            b = batch.slice(at, STORED)
            yield b["doc"], b["vector"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, digits: int | None = None, block: int = BLOCK, made: Made = stored) -> DataFrame:
    """qid, doc, score, rank: each query's k nearest documents by cosine; no floor; ties go to the smaller doc.

    vectors: doc, vector; or doc and what `made` makes vectors of, in the task that compares them, so that they travel nowhere. queries: qid, vector, a stated set. Queries are sent in blocks of a bounded size; a task multiplies
    CELLS scores at a time and keeps k for each query, so what is shuffled is k rows for each task and query.
    """
    n = queries.count()
    vectors = vectors.select("doc", "vector") if made is stored else vectors
    parts = [_block(vectors, queries, n, i, block, k, digits, made) for i in range(max(1, -(-n // block)))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, k)


def _block(vectors: DataFrame, queries: DataFrame, n: int, i: int, block: int, k: int, digits: int | None, made: Made = stored) -> DataFrame:
    count = max(1, -(-n // block))
    own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == i) if count > 1 else queries
    rows = own.select("qid", F.col("vector").cast("array<double>").alias("v")).collect()
    kind, doc = queries.schema["qid"].dataType, vectors.schema["doc"].dataType
    own_type = to_arrow_type(kind)
    sent = vectors.sparkSession.sparkContext.broadcast(([r.qid for r in rows], np.array([r.v for r in rows], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        if not len(ids):
            return
        length, nearest = np.sqrt((q * q).sum(1)), Best(len(ids), k, digits)
        for docs, x in made(batches):
            for at in range(0, len(docs), step := max(1, CELLS // len(ids))):
                part = x[at : at + step]
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = q @ part.T
                    s /= length[:, None]
                    s /= np.sqrt((part * part).sum(1))[None, :]
                nearest.add(np.nan_to_num(s, copy=False), docs.slice(at, step))
        yield from nearest.rows(ids, own_type)

    return vectors.mapInArrow(run, f"qid {kind.simpleString()}, doc {doc.simpleString()}, score double")


def cache_misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys that the cache doesn't have."""
    return keys.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def encode(texts: DataFrame, cache: DataFrame, embed: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> tuple[DataFrame, DataFrame]:
    """(texts with their vectors, the cache with the new ones). Each text (key, text) that isn't cached is embedded once.

    embed maps Arrow batches of (key, text) to (key, vector).
    """
    fresh = texts.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "text")
    grown = keyed_upsert(cache, fresh.mapInArrow(embed, "key string, vector array<float>"), "key")
    return texts.join(grown, "key"), grown


def keyed_upsert(store: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """store with rows put in, those with a key that it has in place of the old ones. Two new rows of one key fail the job."""
    once = F.count("*").over(Window.partitionBy(*keys))
    new = held(rows.withColumn("_rows_of_key", once), {"one_row_a_key": F.col("_rows_of_key") == 1}, "upsert").drop("_rows_of_key")
    return store.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


class VectorStore:
    """Collections of vectors as Parquet: create once or recreate, upsert, scroll, count, and a switch to a checked candidate."""

    def __init__(self, spark: SparkSession, root: str, *, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root, read_only

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")

    def create(self, name: str, rows: DataFrame, dimensions: int) -> None:
        """A new collection; an error if there is one of the name, or a vector of another size."""
        self._writable()
        if not rows.where(F.size("vector") != dimensions).isEmpty():
            raise ValueError(f"vectors must have {dimensions} dimensions")
        rows.write.mode("errorifexists").parquet(self._path(name))

    def recreate(self, name: str, rows: DataFrame) -> None:
        self._writable()
        rows.write.mode("overwrite").parquet(self._path(name))

    def upsert(self, name: str, rows: DataFrame, to: str) -> None:
        """Writes the collection with rows merged by chunk_id as collection `to`."""
        self._writable()
        keyed_upsert(self.read(name), rows, "chunk_id").write.mode("errorifexists").parquet(self._path(to))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def scroll(self, name: str) -> DataFrame:
        """Payloads without their vectors, which aren't read."""
        return self.read(name).drop("vector")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def build_candidates(self, made: dict[str, DataFrame], expected: dict[str, int], dimensions: int) -> dict[str, int]:
        """Writes candidate collections after checking all of them: none exists, counts and sizes are as expected."""
        self._writable()
        for name, rows in made.items():
            found = rows.agg(F.count("*"), F.count(F.when(F.size("vector") != dimensions, 1)), F.count(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 1))).first()
            if found[0] != expected[name] or found[1] or found[2]:
                raise ValueError(f"candidate {name}: {found[0]} rows, {found[1]} of another size, {found[2]} without text")
        for name, rows in made.items():
            self.create(name, rows, dimensions)
        return {name: self.count(name) for name in made}
