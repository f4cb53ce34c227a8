"""Snapshots of a corpus and what changed between two of them: full outer joins on identities, changed fields unpivoted."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import DELETED, canonical_json_sha256, strip


META = ("nature", "url", "last_amended", "effective_date")


def law_snapshot(articles: DataFrame) -> DataFrame:
    """name, META, number of articles and a hash of the law with its articles in order. articles: name, pos, no, chapter, content, and
    META, the same in all rows of a law. Deleted and empty articles don't count.

    The hash is that of the compact JSON object, keys sorted. Articles come sorted by law and place and pass through the hash one after
    the other, so that a law is never held; articles at one place go by content, then number. A null name or field counts as ''.
    """
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit("")).alias(c)
    live = articles.where((strip(F.col("content")) != "") & ~strip(F.col("content")).rlike(DELETED))
    each = live.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", *META)), "pos", text("no"), text("chapter"), text("content"))
    dealt = each.repartition("name", *META).sortWithinPartitions("name", *META, "pos", "content", "no")
    schema = ", ".join(f"{c} string" for c in ("name", *META)) + ", num_articles long, content_sha256 string"
    names = ["name", *META, "num_articles", "content_sha256"]
    said = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law, n, digest = None, 0, hashlib.sha256()

        def ended() -> tuple:
            rest = said({"name": law[0], **dict(zip(META, law[1:], strict=True))})
            digest.update(f"],{rest[1:]}".encode())
            return (*law, n, digest.hexdigest())

        for b in batches:
            out = []
            columns = [b[c].to_pylist() for c in ("name", *META, "chapter", "content", "no")]
            for *own, chapter, content, no in zip(*columns, strict=True):
                if (own := tuple(own)) != law:
                    if law is not None:
                        out.append(ended())
                    law, n, digest = own, 0, hashlib.sha256(b'{"articles":[')
                digest.update((("," if n else "") + said({"chapter": chapter, "content": content, "no": no})).encode())
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if law is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in ended()], names=names)

    return dealt.mapInArrow(run, schema)


def snapshot_findings(published: DataFrame, header: DataFrame, articles: DataFrame, artifact: str = "snapshot") -> DataFrame:
    """artifact, subject, problem: what a published snapshot says that isn't so. published: law_snapshot()'s columns and pos (0 on).
    header: one row with snapshot_date, law_count, article_count. articles: as law_snapshot() takes them.

    Laws stand in the order of their names, each once, without gaps; dates are eight digits of a day there is, or empty; totals add up;
    numbers of articles and hashes are those of the articles; no law is missing or made up. A missing value is a finding."""
    found = lambda df, subject, *problems: df.select(F.lit(artifact).alias("artifact"), subject.cast("string").alias("subject"), F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))
    no = lambda ok, problem: F.when(~F.coalesce(ok, F.lit(False)), problem)
    day = lambda c: (F.col(c) == "") | (F.col(c).rlike(r"^\d{8}$") & F.expr(f"try_to_timestamp({c}, 'yyyyMMdd')").isNotNull())
    rows = found(published, F.col("name"), no(F.trim(F.col("name")) != "", "name"), *(no(day(c), c) for c in ("last_amended", "effective_date")), no(F.col("num_articles") >= 1, "num_articles"))
    after = published.select((F.col("pos") - 1).alias("pos"), F.col("name").alias("_next"))
    order = found(published.join(after, "pos").where(~(F.col("name") < F.col("_next"))), F.col("_next"), F.lit("order"))
    times = lambda c, problem: found(published.groupBy(c).count().where("count > 1"), F.col(c), F.lit(problem))
    totals = published.agg(F.count("*").alias("n"), F.sum("num_articles").alias("a"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    said = header.agg(F.count("*").alias("rows"), F.first("snapshot_date").alias("day"), F.first("law_count").alias("laws"), F.first("article_count").alias("arts"))
    sums = found(
        totals.crossJoin(F.broadcast(said)), F.lit(None), no(F.col("rows") == 1, "header"), no(F.col("day").rlike(r"^\d{4}-\d\d-\d\d$") & F.expr("try_to_date(day, 'yyyy-MM-dd')").isNotNull(), "snapshot_date"),
        no(F.col("laws") == F.col("n"), "law_count"), no(F.col("arts") == F.coalesce("a", F.lit(0)), "article_count"), no((F.col("n") == 0) | (F.col("low") == 0) & (F.col("high") == F.col("n") - 1), "places"),
    )  # fmt: skip  # both are one row
    made = law_snapshot(articles).select("name", F.col("num_articles").alias("_n"), F.col("content_sha256").alias("_h"))
    both = published.select("name", "num_articles", "content_sha256").withColumn("_said", F.lit(True)).join(made.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")), "full_outer")
    there, known = F.col("_name").isNotNull(), F.col("_said").isNotNull()
    hashes = found(both, F.coalesce("name", "_name"), F.when(~known, "missing"), F.when(~there, "made_up"), F.when(known & there, no(F.col("num_articles") == F.col("_n"), "articles")), F.when(known & there, no(F.col("content_sha256") == F.col("_h"), "hash")))
    return rows.unionByName(order).unionByName(times("name", "repeated")).unionByName(times("pos", "place")).unionByName(sums).unionByName(hashes)


def article_fingerprints(articles: DataFrame) -> DataFrame:
    """law, article, sha256."""
    live = articles.where((strip(F.col("content")) != "") & ~strip(F.col("content")).rlike(DELETED))
    digest = canonical_json_sha256(chapter=strip(F.col("chapter")), content=strip(F.col("content")), no=strip(F.col("no")))
    return live.select(F.col("name").alias("law"), strip(F.col("no")).alias("article"), digest.alias("sha256"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(wanted: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    return wanted.join(rows.select(*keys), list(keys), "left_anti")


def select_laws(laws: DataFrame, names: DataFrame) -> DataFrame:
    """Laws of these names that aren't abolished."""
    return laws.where("abolished = ''").join(names, "name", "left_semi")


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, kind (added, removed or the field), old, new: a row for each added or removed key and each changed field."""
    a = old.select(F.col(key).alias("_a"), *(F.col(f).cast("string").alias(f"_a_{f}") for f in fields))
    b = new.select(F.col(key).alias("_b"), *(F.col(f).cast("string").alias(f"_b_{f}") for f in fields))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    none = F.lit(None).cast("string")
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("old"), y.alias("new"))
    changed = F.filter(
        F.array(*(F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), row(f, F.col(f"_a_{f}"), F.col(f"_b_{f}"))) for f in fields)), lambda x: x.isNotNull()
    )
    found = F.when(F.col("_a").isNull(), F.array(row("added", none, none))).when(F.col("_b").isNull(), F.array(row("removed", none, none))).otherwise(changed)
    return both.select(F.coalesce("_a", "_b").alias(key), F.explode(found).alias("x")).select(key, "x.kind", "x.old", "x.new")


def change_summary(found: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """One row: total, subjects (distinct keys), and a count for each kind, zeros too."""
    return found.agg(F.count("*").alias("total_changes"), F.count_distinct(key).alias("subjects_changed"), *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))


def fingerprint_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], digest: str = "sha256") -> DataFrame:
    """keys, kind: added, removed, changed or unchanged."""
    a, b = old.select(*keys, F.col(digest).alias("_old")), new.select(*keys, F.col(digest).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("kind"))
