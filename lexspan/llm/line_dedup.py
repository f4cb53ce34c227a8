"""Line dedup that can be taken back: sharded cuckoo filters in front of exact reference-count tables.

An index is a folder in the shared directory. Its reference table has a signed row for each distinct (key, document) of a
batch: +1 where documents were inserted, -1 where they were deleted; rows are only appended. Added up they give the exact
reference counts. A cuckoo filter for each shard of the keys holds the keys that two documents or more share. A scan of
texts asks the filters first, which leaves out nearly all lines that nobody shares; what passes is looked up in the exact
counts, so false positives drop nothing. Inserting adds the keys whose count came to two, deleting removes those whose
count fell below, and a deleted document gives its lines back to the next one that holds them.

Defined results. A null or empty text is one empty line. A null doc_id is one document, after all others. Rows with the
same doc_id are one document: a line they share with each other only isn't dropped, and each row keeps its own lines.
No documents: no rows. Only id, text and the columns in `keep` are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.common import arrow_schema, batch, carried, materialize, scratch_path, table, text_slices, tidy
from lexspan.llm.cuckoo import CuckooFilter

#: Code points a key has at least; shorter lines always stay.
SHORTEST = 10
SPACE = b" \t\n\v\f\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Keys in a shard, about.
SHARD_KEYS = 200_000
#: Filters of so many bytes together go to every executor. Larger ones stay where they are and the keys come to them, shard by shard.
FILTER_BYTES = 64 << 20
#: Tasks that a shard's keys are dealt to where keys come to filters.
SALTS = 8

RESULT = (T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()))


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < shortest or len(key) < 4 * shortest and len(key.decode()) < shortest:
        return None
    import xxhash

    return xxhash.xxh3_128_digest(key.translate(_LOWER))


def as_words(keys: Sequence[bytes]) -> np.ndarray:
    """The first 64 bits of each key, which a filter goes by."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0].astype(np.uint64)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _keys(docs: DataFrame, id_col: str, text_col: str, shortest: int, passes=None) -> DataFrame:
    """(key, doc_id) for each distinct key of each row; only keys that passes, if given, lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = passes() if passes else None
        for b in batches:
            keys, rows = [], []
            for i, raw in enumerate(text_slices(b["text"])):
                own = {k for x in raw.split(b"\n") if (k := line_key(x, shortest))}
                keys.extend(own)
                rows.extend([i] * len(own))
            if not keys:
                continue
            at = np.arange(len(keys)) if test is None else np.flatnonzero(test(as_words(keys)))
            ids = b["doc_id"].take(pa.array(np.array(rows, np.int64)[at]))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at.tolist()], pa.binary()), ids], names=["key", "doc_id"])

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(tidy(run), "key binary, doc_id long").distinct()


@dataclass(frozen=True)
class LineIndex:
    """A state of the index. insert() and delete() return the next one; the one before stays as it was."""

    spark: SparkSession
    refs: tuple[str, ...] = ()
    filters: str | None = None
    shards: int = 1
    shortest: int = SHORTEST

    def references(self) -> DataFrame:
        """(key, doc_id) of all documents in the index."""
        if not self.refs:
            return self.spark.createDataFrame([], "key binary, doc_id long")
        rows = self.spark.read.schema("key binary, doc_id long, sign int").parquet(*self.refs)
        if len(self.refs) == 1:
            return rows.select("key", "doc_id")
        return rows.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").select("key", "doc_id")

    def shared(self) -> DataFrame:
        """key, n_docs and first_doc of the keys that two documents or more hold."""
        return self.references().groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Adds documents that aren't in the index."""
        return self._signed(_keys(docs, id_col, text_col, self.shortest), 1)

    def delete(self, doc_ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
        """Takes documents out again, whatever batch they came with."""
        gone = doc_ids.select(F.col(id_col).cast("long").alias("gone")).distinct()
        mine = self.references()
        return self._signed(mine.join(gone, mine.doc_id.eqNullSafe(gone.gone), "left_semi"), -1)

    def _signed(self, rows: DataFrame, sign: int) -> LineIndex:
        path = scratch_path(self.spark, "line-refs")
        rows.withColumn("sign", F.lit(sign)).write.parquet(path)
        after = replace(self, refs=(*self.refs, path))
        if self.filters is None:
            return after._filtered(after.shared().select("key"))
        touched = self.spark.read.schema("key binary").parquet(path).distinct()
        now, before = after.shared().select("key"), self.shared().select("key")
        changed = touched.join(now, "key", "left_semi").join(before, "key", "left_anti").withColumn("up", F.lit(True))
        changed = changed.unionByName(touched.join(before, "key", "left_semi").join(now, "key", "left_anti").withColumn("up", F.lit(False)))
        return after._updated(materialize(changed, "line-changed"))

    def _filtered(self, keys: DataFrame) -> LineIndex:
        """Builds the filters anew; there are as many shards as the keys need."""
        keys = materialize(keys, "line-shared")
        shards = max(8, -(-keys.count() // SHARD_KEYS))
        path = scratch_path(self.spark, "line-filters")
        _built(keys, shards).write.parquet(path)
        return replace(self, filters=path, shards=shards)

    def _updated(self, changed: DataFrame) -> LineIndex:
        """Inserts into and deletes from the shards that have changed keys; a filter that would be full is made anew from the exact
        counts, with room for as many keys as it then has."""
        old = self.spark.read.parquet(self.filters)

        def alter(one: pa.Table, other: pa.Table) -> pa.Table:
            shard = (one if one.num_rows else other)["shard"][0].as_py()
            words, up = as_words(other["key"].to_pylist()) if other.num_rows else np.empty(0, np.uint64), np.array(other["up"].to_pylist(), bool)
            more, less = np.unique(words[up]), np.unique(words[~up])
            held = CuckooFilter.from_bytes(one["filter"][0].as_py()) if one.num_rows else CuckooFilter.sized(len(more))
            held.delete(less)
            full = not held.fits(len(more))
            if not full:
                held.insert(more)
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([None if full else held.to_bytes()], pa.binary())})

        both = old.groupBy("shard").cogroup(_sharded(changed, self.shards).groupBy("shard"))
        after = materialize(both.applyInArrow(alter, "shard int, filter binary"), "line-altered")
        full = after.where("filter is null").select("shard")
        path = scratch_path(self.spark, "line-filters")
        kept = after.where("filter is not null")
        if not full.isEmpty():
            kept = kept.unionByName(_built(self.shared().select("key"), self.shards, full))
        kept.write.parquet(path)
        return replace(self, filters=path)

    def _maybe_shared(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(key, doc_id) of the lines of docs that the filters let through."""
        filters, shards = self.spark.read.parquet(self.filters), self.shards
        if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > FILTER_BYTES:
            return _shipped(_keys(docs, id_col, text_col, self.shortest), filters, shards)
        sent = self.spark.sparkContext.broadcast({r.shard: r.filter for r in filters.toLocalIterator()})

        def make():
            held = {k: CuckooFilter.from_bytes(bytes(v)) for k, v in sent.value.items()}

            def test(words: np.ndarray) -> np.ndarray:
                shard, found = shard_of(words, shards), np.zeros(len(words), bool)
                for k in np.unique(shard).tolist():
                    if k in held:
                        own = shard == k
                        found[own] = held[k].contains(words[own])
                return found

            return test

        return _keys(docs, id_col, text_col, self.shortest, make)

    def resolve(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
        """id, `keep`, n_lines, n_dropped and kept (the text that stays) of each row of docs, which are in the index."""
        maybe = self._maybe_shared(docs, id_col, text_col)
        lost = maybe.join(self.shared(), "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        lost = lost.groupBy("doc_id").agg(F.collect_list("key").alias("_lost")).withColumnRenamed("doc_id", "_doc")
        fields = [docs.schema[id_col], *carried(docs, keep, [id_col, *(f.name for f in RESULT)]), *RESULT]
        schema, shortest = arrow_schema(fields), self.shortest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, gone, kept = [], [], []
                at, keys = _binary_lists(b["_lost"])
                for i, raw in enumerate(text_slices(b["_text"])):
                    lines, drop = raw.split(b"\n"), set(keys[at[i] : at[i + 1]])
                    stay = [x for x in lines if line_key(x, shortest) not in drop] if drop else lines
                    n.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode())
                yield batch([b["_id"], *(b[f"_k_{c}"] for c in keep), n, gone, kept], schema)

        texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_k_{c}") for c in keep))
        joined = texts.join(lost, F.col("_id").cast("long").eqNullSafe(F.col("_doc")), "left").drop("_doc")
        return joined.mapInArrow(tidy(run), T.StructType(fields))


def _built(keys: DataFrame, shards: int, only: DataFrame | None = None) -> DataFrame:
    """shard, filter of these keys, a shard a group; only of the shards in `only`, if given, numbers of which there are few."""

    def build(group: pa.Table) -> pa.Table:
        words = np.unique(as_words(group["key"].to_pylist()))
        made = CuckooFilter.sized(len(words))
        made.insert(words)
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    dealt = _sharded(keys, shards)
    if only is not None:
        dealt = dealt.join(only, "shard", "left_semi")
    return dealt.groupBy("shard").applyInArrow(build, "shard int, filter binary")


def _shipped(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """keys (key, doc_id) that their shards' filters let through. A shard's keys are dealt to SALTS tasks by document, so that a key of
    very many documents isn't one task; they stream past the filter, which comes first and is all that a task holds."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    left = _sharded(keys, shards).select("shard", salt.alias("salt"), "key", "doc_id", F.lit(None).cast("binary").alias("filter"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = filters.select("shard", salts.alias("salt"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), "filter")
    both = left.unionByName(right).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            shard, keys_, stay = b["shard"].to_numpy(), b["key"], np.zeros(b.num_rows, bool)
            place = shard.astype(np.int64) * SALTS + b["salt"].to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if place[lo] != at:
                    at, held = place[lo], None
                if (first := b["filter"][lo].as_py()) is not None:
                    held, lo = CuckooFilter.from_bytes(first), lo + 1  # noqa: PLW2901
                if held is not None and lo < hi:
                    stay[lo:hi] = held.contains(as_words(keys_.slice(lo, hi - lo).to_pylist()))
            yield b.select(["key", "doc_id"]).filter(pa.array(stay))

    return both.mapInArrow(tidy(run), "key binary, doc_id long")


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    """The shard that shard_of() gives: the upper half of the key's first eight bytes, little-endian."""
    byte = lambda i: F.conv(F.hex(F.substring("key", i, 1)), 16, 10).cast("long")
    upper = byte(5) + byte(6) * 256 + byte(7) * 65536 + byte(8) * 16777216
    return keys.withColumn("shard", (upper % F.lit(shards)).cast("int"))


def _binary_lists(column: pa.Array) -> tuple[list[int], list[bytes]]:
    n = np.array([x or 0 for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return [0, *np.cumsum(n).tolist()], column.flatten().to_pylist()


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = LineIndex(spark).insert(docs).resolve(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for op3_line_dedup.
ORACLE_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
     k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
     m AS (SELECT doc_id, i, line, s.key IS NOT NULL AND doc_id <> first_doc AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
