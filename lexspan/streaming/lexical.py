"""A lexical index under a stream of documents. Each batch appends signed rows: a new version of a document adds its length and its terms'
frequencies, and takes out those of the version that it replaces, so sums over batches are always those of the live
documents alone, and an old version that comes late changes nothing. Terms are kept by document and version, a row each, and count while
that version is live; versions are told apart by keys, and texts move once, if they are taken. fold() adds all batches up into one.

A batch is a folder of its own, whose last file says that it is complete; only complete batches count. One that is tried again is
made anew from what was there before it. There is one writer.

Defined results. A document's greatest version counts; of equal versions the text with the greater hash, a null one last. A null text
takes a document away, an empty one is a document without terms. Null versions are 0, null ids are one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import lexical
from lexspan.functions.text import word_tokens
from lexspan.scratch import materialize

#: Signed rows of live versions; versions' terms; signed sums of terms' document frequencies.
STATE = "doc {0}, version long, hash string, dl long, live boolean, sign int"
TERMS = "doc {0}, version long, hash string, terms array<string>, tfs array<int>, dl long"
COUNTS = "term string, df long"
#: A version's key without nulls.
KEYS = ("_at", "_null", "_number", "_text")


class LexicalStream:
    def __init__(self, spark: SparkSession, root: str, *, tokens=word_tokens, doc_type: str = "long"):
        self.spark, self.root, self.tokens, self.kind = spark, root, tokens, doc_type

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def batches(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        whole = {n for n in (s.getPath().getName() for s in fs.listStatus(path(self.root))) if fs.exists(path(f"{self.root}/{n}/counts/_SUCCESS"))}
        folded = [f"{self.root}/{n}/replaces" for n in whole if fs.exists(path(f"{self.root}/{n}/replaces"))]
        gone = {r.name for r in self.spark.read.schema("name string").json(folded).collect()} if folded else set()
        return sorted(whole - gone)

    def _read(self, part: str, schema: str, without: str | None = None) -> DataFrame:
        paths = [f"{self.root}/{n}/{part}" for n in self.batches() if n != without]
        schema = schema.format(self.kind)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, without: str | None = None) -> DataFrame:
        """doc, version, hash, dl, live: the version of each document that counts, those that took one away among them."""
        state = self._read("state", STATE, without)
        return state.groupBy("doc", "version", "hash", "dl", "live").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def merge(self, docs: DataFrame, batch: str | None = None) -> None:
        """docs: doc, text and, if there is one, version."""
        name = f"batch-{batch or uuid.uuid4().hex}"
        version = F.coalesce(F.col("version").cast("long"), F.lit(0).cast("long")) if "version" in docs.columns else F.lit(0).cast("long")
        hashed = F.when(F.col("text").isNull(), "").otherwise(F.sha2(F.encode(F.col("text"), "UTF-8"), 256)).alias("hash")
        each = docs.select(F.col("doc").cast(self.kind).alias("doc"), version.alias("version"), hashed, "text")
        best = each.groupBy("doc").agg(F.max(F.struct("version", "hash")).alias("d"))
        own = best.select("doc", "d.version", "d.hash", (F.col("d.hash") != "").alias("live"))
        old = self._live(name).select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("hash").alias("_hash"), F.col("dl").alias("_dl"), F.col("live").alias("_live"))
        both = own.join(old, F.col("doc").eqNullSafe(F.col("_doc")), "left").drop("_doc")
        later = F.col("_version").isNull() | (F.struct("version", "hash") > F.struct(F.col("_version").alias("version"), F.col("_hash").alias("hash")))
        taken = materialize(both.where(later), "stream-taken")
        at, live = f"{self.root}/{name}", taken.where("live")
        # of an empty batch no text is moved
        texts = self._of(each, live).dropDuplicates([*KEYS]) if not live.isEmpty() else each.limit(0)
        made = lexical.counted(texts.select("doc", "version", "hash", self.tokens(F.col("text")).alias("tokens")))
        self._write(made, f"{at}/terms")
        written = self.spark.read.schema(TERMS.format(self.kind)).parquet(f"{at}/terms")
        size = written.select(F.col("doc").alias("_doc"), F.col("dl").alias("_size"))
        rows = taken.join(size, F.col("doc").eqNullSafe(F.col("_doc")), "left").select("doc", "version", "hash", F.coalesce("_size", F.lit(0).cast("long")).alias("dl"), "live", F.lit(1).alias("sign"))
        replaced = taken.where(F.col("_version").isNotNull()).select("doc", F.col("_version").alias("version"), F.col("_hash").alias("hash"), F.col("_dl").alias("dl"), F.col("_live").alias("live"), F.lit(-1).alias("sign"))
        self._write(rows.unionByName(replaced), f"{at}/state")
        signed = written.select(F.explode("terms").alias("term"), F.lit(1).alias("sign"))
        if not (gone := replaced.where("live")).isEmpty():
            signed = signed.unionByName(self._of(self._read("terms", TERMS, name), gone).select(F.explode("terms").alias("term"), F.lit(-1).alias("sign")))
        self._write(signed.groupBy("term").agg(F.sum("sign").cast("long").alias("df")).where("df <> 0"), f"{at}/counts")

    @staticmethod
    def _of(rows: DataFrame, keys: DataFrame) -> DataFrame:
        """rows of these versions (doc, version, hash), with the columns KEYS."""
        keyed = lambda df: df.withColumns({"_at": F.coalesce(F.col("doc").cast("string"), F.lit("")), "_null": F.col("doc").isNull(), "_number": F.col("version"), "_text": F.col("hash")})
        return keyed(rows).join(keyed(keys).select(*KEYS), [*KEYS], "left_semi")

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)

    def _terms(self) -> DataFrame:
        """doc, version, hash, terms, tfs, dl of live documents."""
        return self._of(self._read("terms", TERMS), self._live().where("live")).drop(*KEYS)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, doc, tf, dl of live documents; only of these terms, if given."""
        each = self._terms().select("doc", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        each = each.select(F.col("x.terms").alias("term"), "doc", F.col("x.tfs").cast("long").alias("tf"), "dl")
        return each if terms is None else each.join(terms, "term", "left_semi")

    def frequencies(self) -> DataFrame:
        """term, df."""
        return self._read("counts", COUNTS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def stats(self) -> DataFrame:
        """One row: n_docs, avgdl; sums of signed rows, so that no document need be looked at."""
        signed = self._read("state", STATE).where("live").agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n_docs"), F.sum(F.col("sign") * F.col("dl")).alias("length"))
        return signed.select("n_docs", F.try_divide(F.col("length").cast("double"), F.col("n_docs")).alias("avgdl"))

    def search(self, queries: DataFrame, k: int = 20, *, digits: int | None = None) -> DataFrame:
        """lexical.bm25 over the live documents. queries: lexical.tokenized()."""
        wanted = lexical.query_terms(queries)
        return lexical.scored(self._terms(), self.frequencies(), self.stats(), wanted, k=k, digits=digits)

    def fold(self) -> None:
        """Writes the sums of all batches as one batch and deletes those; readers that began before may have to begin again."""
        if not (old := self.batches()):
            return
        at = f"{self.root}/batch-{uuid.uuid4().hex}"
        self._write(self._live().withColumn("sign", F.lit(1)), f"{at}/state")
        self._write(self._terms(), f"{at}/terms")
        self.spark.createDataFrame([(n,) for n in old], "name string").write.json(f"{at}/replaces")
        self._write(self.frequencies(), f"{at}/counts")  # from here on it counts, in place of the others
        fs, path = self._fs()
        for n in old:
            fs.delete(path(f"{self.root}/{n}"), True)
