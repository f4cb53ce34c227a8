"""The versioned store, and published snapshots against the articles they stand for."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexspan.operators import audit, vectors
from lexspan.operators.store import LostRace, VersionedStore

ROWS = "chunk_id string, doc_id string, text string, last_amended string, effective_date string, vector array<float>"


def _rows(spark, *keys, text="t"):
    return spark.createDataFrame([(f"{k}#s0000", k, text, "20240101", "", [1.0, 2.0]) for k in keys], ROWS)


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_versions_upserts_and_rollback(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.version().number == 0 and store.versions() == []
    one = store.build({"a": _rows(spark, "x", "y"), "b": _rows(spark, "z")}, {"a": 2, "b": 1}, dimensions=2)
    two = store.upsert("a", _rows(spark, "y", "w", text="new"))
    three = store.upsert("a", _rows(spark, "w", text="newer"))
    assert (one.number, two.number, three.number) == (1, 2, 3)
    assert _texts(store.read("a")) == {"x": "t", "y": "new", "w": "newer"} and _texts(store.read("a", 1)) == {"x": "t", "y": "t"} and _texts(store.read("a", 2))["w"] == "new"
    assert _texts(store.read("b")) == {"z": "t"} and "vector" not in store.scroll("a").columns
    four = store.compact("a")
    assert len(four.collections["a"]) == 1 and _texts(store.read("a")) == _texts(store.read("a", 3))
    five = store.rollback(1)
    assert five.collections == one.collections and _texts(store.read("a")) == {"x": "t", "y": "t"} and _texts(store.read("a", 4))["w"] == "newer"
    assert VersionedStore(spark, str(tmp_path / "s")).version() == five
    with pytest.raises(ValueError, match="no version"):
        store.read("a", 9)
    with pytest.raises(ValueError, match="no collection"):
        store.read("c")


def test_a_lost_race_is_an_error(spark, tmp_path):
    a, b = (VersionedStore(spark, str(tmp_path / "s")) for _ in range(2))
    start = a.build({"a": _rows(spark, "x")}, {"a": 1}, dimensions=2)
    a.upsert("a", _rows(spark, "y"), parent=start)
    for late in (lambda: b.upsert("a", _rows(spark, "z"), parent=start), lambda: b.rollback(1, parent=start), lambda: b.compact("a", parent=start)):
        with pytest.raises(LostRace):
            late()
    assert set(_texts(b.read("a"))) == {"x", "y"} and b.version().number == 2


@pytest.mark.parametrize(
    "change",
    [
        lambda s: {"b": _rows(s, "x", "x")}, lambda s: {"b": _rows(s, "x")}, lambda s: {"b": _rows(s, "x", "y", text=" ")}, lambda s: {"b": _rows(s, "x", "y").withColumn("vector", F.array(F.lit(1.0)))},
        lambda s: {"b": _rows(s, "x", "y").withColumn("vector", F.lit(None).cast("array<float>"))}, lambda s: {"b": _rows(s, "x", "y").withColumn("doc_id", F.lit("q"))},
        lambda s: {"b": _rows(s, "x", "y").withColumn("last_amended", F.lit("20241301"))}, lambda s: {"b": _rows(s, "x", "y").withColumn("chunk_id", F.lit(None).cast("string"))},
    ],
)
def test_no_candidate_is_visible_unless_all_are_right(spark, tmp_path, change):
    store = VersionedStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.build({"a": _rows(spark, "x")} | change(spark), {"a": 1, "b": 2}, dimensions=2)
    assert store.versions() == []


def test_refusals(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.build({"a": _rows(spark, "x")}, {"a": 1}, dimensions=2)
    with pytest.raises(ValueError, match="there already"):
        store.build({"a": _rows(spark, "x")}, {"a": 1}, dimensions=2)
    with pytest.raises(ValueError, match="repeat"):
        store.upsert("a", _rows(spark, "y", "y"))
    with pytest.raises(PermissionError):
        VersionedStore(spark, str(tmp_path / "s"), read_only=True).upsert("a", _rows(spark, "y"))
    with pytest.raises(Exception, match="one_row_a_key"):
        vectors.keyed_upsert(_rows(spark, "x"), _rows(spark, "y", "y"), "chunk_id").count()
    assert _texts(vectors.keyed_upsert(_rows(spark, "x", "y"), _rows(spark, "y", text="n"), "chunk_id")) == {"x": "t", "y": "n"}


# --- snapshots ---

ARTICLES = "name string, pos int, no string, chapter string, content string, nature string, url string, last_amended string, effective_date string"


def _law(name, articles, amended="20240101"):
    return [(name, i, no, chapter, content, "法律", "u", amended, None) for i, (no, chapter, content) in enumerate(articles)]


def _digest(rows):
    arts = [{"chapter": (c or "").strip(), "content": t.strip(), "no": (n or "").strip()} for _, _, n, c, t, *_ in rows if t and t.strip() and t.strip() not in ("（刪除）", "(刪除)")]
    law = {"name": rows[0][0], "nature": "法律", "url": "u", "last_amended": rows[0][7], "effective_date": "", "articles": arts}
    return len(arts), hashlib.sha256(json.dumps(law, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_digests_of_laws_are_those_of_their_json(spark, monkeypatch):
    laws = [_law("甲", [("1", "", "內文。"), (None, "總則\x01\x1fx", 'a "b" \\ \n\t\x0b\x7f/é'), ("3", None, "（刪除）"), ("4", "c", " ")]), _law("乙", [(str(i), "c", f"text {i}") for i in range(3000)]), _law("丙", [("1", "c", "x")])]
    rows = [r for law in laws for r in law]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {r.name: (r.num_articles, r.content_sha256) for r in audit.law_snapshot(spark.createDataFrame(rows[::-1], ARTICLES).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {law[0][0]: _digest(law) for law in laws}
    assert audit.law_snapshot(spark.createDataFrame([], ARTICLES)).count() == 0


def test_snapshot_findings(spark):
    laws = [_law(n, [("1", "c", f"text {n}"), ("2", "c", "more")]) for n in "abcd"]
    articles = spark.createDataFrame([r for law in laws for r in law], ARTICLES)
    good = [(i, law[0][0], "20240101", "", *_digest(law)) for i, law in enumerate(laws)]
    kind = "pos int, name string, last_amended string, effective_date string, num_articles long, content_sha256 string"
    head = lambda *x: spark.createDataFrame([x], "snapshot_date string, law_count long, article_count long")
    found = lambda rows, h: sorted((str(r.subject), r.problem) for r in audit.snapshot_findings(spark.createDataFrame(rows, kind), h, articles).collect())
    assert found(good, head("2024-02-29", 4, 8)) == []
    assert found(good, head("2024-02-30", 5, 7)) == [("None", "article_count"), ("None", "law_count"), ("None", "snapshot_date")]
    assert found(good, spark.createDataFrame([], "snapshot_date string, law_count long, article_count long")) == [("None", "article_count"), ("None", "header"), ("None", "law_count"), ("None", "snapshot_date")]
    swapped = [(1, *good[0][1:]), (0, *good[1][1:]), *good[2:]]
    assert found(swapped, head("2024-01-01", 4, 8)) == [("a", "order")]
    bad = [good[0], (1, "b", "20241301", "2024", 3, good[1][5]), (1, "c", "20240101", "", 2, None), (4, "e", None, "", 0, "x")]
    want = [("1", "place"), ("None", "article_count"), ("None", "places"), ("b", "articles"), ("b", "effective_date"), ("b", "last_amended"), ("c", "hash"), ("d", "missing"), ("e", "last_amended"), ("e", "made_up"), ("e", "num_articles")]
    assert found(bad, head("2024-01-01", 4, 8)) == want
    assert ("a", "repeated") in found([good[0], *good], head("2024-01-01", 5, 10))
