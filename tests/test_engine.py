"""Operators on small fixtures with results worked out by hand."""

import io
import json
import re
import uuid
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexspan.functions import text as X
from lexspan.operators import accounting, answers, audit, checks, chunking, evaluation, lexical, retrieval, vectors
from lexspan.sources import readers, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("a\r\nb\rc", "a\nb\nc"), ("a\0b\x1fc\ufeff", "abc"), ("a 　\nb", "a\nb"), ("a\n\n\n\n\nb", "a\n\nb"), ("　 x \n", "x"), ("e\u0301", "é"), ("１２", "１２"), ("a\u2028b", "a\u2028b"), ("", ""), (None, None)],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, X.clean_text) == clean


def test_labels_and_identities(spark):
    assert one(spark, " 第  24　條 ", X.normalize_label) == "第 24 條"
    assert one(spark, "勞動基準法（舊）", X.normalize_name) == "勞動基準法"
    assert one(spark, "/home/me/a/b.md", X.public_source_path) == "b.md"
    assert one(spark, "a/../b.md", X.public_source_path) == "b.md"
    assert one(spark, "C:\\x\\y.md", X.public_source_path) == "y.md"
    assert one(spark, "docs/b.md", X.public_source_path) == "docs/b.md"
    assert one(spark, "d1#s0000", X.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "d1#s0000"))
    assert one(spark, "20240131", X.iso_date) == "2024-01-31"
    assert one(spark, "<think>a</think>b<think>c", X.without_thinking) == "b"
    assert one(spark, "x</think> y", X.without_thinking) == "y"
    label = lambda a: spark.createDataFrame([(a,)], "a array<string>").select(X.article_label(F.col("a")).alias("y")).first().y
    assert [label([]), label(["A"]), label(["A", "B", "C"])] == ["", "A", "A～C"]
    assert one(spark, "工資之給付 wage 42", X.han_tokens) == ["工資", "資之", "之給", "給付", "wage", "42"]


def units(spark, rows):
    """rows: doc, article, text."""
    made = [(i, d, "T", a, "", t, "p", "u", "", "") for i, (d, a, t) in enumerate(rows)]
    return spark.createDataFrame(made, "unit_idx long, doc_id string, doc_title string, article_no string, chapter string, text string, source_path string, source_url string, last_amended string, effective_date string")


def plain_sentences(text, limit):
    out, at = [], 0
    for i, c in enumerate(text):
        if c in "。！？；\n":
            out.append(text[at : i + 1])
            at = i + 1
    out = [p for p in [*out, text[at:]] if p]
    done = []
    for p in out:
        if not p.strip():
            if done:
                done[-1] += p
            continue
        done += [p[i : i + limit] for i in range(0, len(p), limit)]
    return done


@pytest.mark.parametrize("text", ["甲乙。丙丁！戊", "\n\n甲。\n \n乙", "長" * 25 + "。短。", "a" * 20, "", "。", "甲；\n\n乙" * 5])
def test_sentences(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(chunking.sentences(F.col("x"), 10).alias("y")).first().y
    assert got == plain_sentences(text, 10)


def test_structure_chunks(spark):
    long = "".join(f"第{i:03d}句話在這裡。" for i in range(60))
    rows = chunking.structure_chunks(units(spark, [("d", "A1", "短文。"), ("d", "A2", long), ("e", "", "x")]), max_chars=100).orderBy("doc_id", "seq").collect()
    assert [r.chunk_id for r in rows if r.doc_id == "d"] == [f"d#s{i:04d}" for i in range(len(rows) - 1)]
    assert "".join(r.content for r in rows if r.article_label == "A2") == long
    assert all(len(r.content) <= 100 for r in rows) and rows[0].text == "T A1\n短文。" and rows[-1].articles == []


def test_fixed_chunks(spark):
    rows = [("d", f"A{i}", "".join(f"{i}{j}" + "字" * 17 + "。" for j in range(5))) for i in range(8)]
    got = chunking.fixed_chunks(units(spark, rows), size=200, overlap=40).orderBy("seq").collect()
    whole = "".join(t for _, _, t in rows)
    assert got[0].content == whole[: len(got[0].content)] and whole.endswith(got[-1].content)
    for a, b in zip(got, got[1:], strict=False):  # each begins with the end of the one before, 40 characters or more
        shared = max(n for n in range(len(a.content) + 1) if b.content.startswith(a.content[len(a.content) - n :]))
        assert 40 <= shared <= 60 and len(b.content) <= 240
    assert got[0].articles == ["A0", "A1"] and got[0].article_label == "A0～A1"
    with pytest.raises(ValueError):
        chunking.fixed_chunks(units(spark, rows), size=40, overlap=40)


def test_bm25_by_hand(spark):
    import math

    docs = lexical.tokenized(spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "d"), (4, "e f")], "i int, t string"), "i", "t")
    asked = lexical.tokenized(spark.createDataFrame([(1, "b b zz"), (2, "zz"), (3, "c d")], "i int, t string"), "i", "t")
    got = {(r.qid, r.doc): (r.score, r["rank"]) for r in lexical.bm25(docs, asked, k=2).collect()}
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    assert got[1, 1][0] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    assert (2, 1) not in got and got[3, 3][1] == 1 and got[3, 2][1] == 2


def test_index_round_trip(spark, tmp_path):
    docs = lexical.tokenized(spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d")], "i int, t string"), "i", "t")
    lexical.LexicalIndex.save(docs, str(tmp_path / "i"))
    found = lexical.LexicalIndex.load(spark, str(tmp_path / "i")).search(lexical.tokenized(spark.createDataFrame([(9, "c")], "i int, t string"), "i", "t"))
    assert [r.doc for r in found.collect()] == [2]
    with pytest.raises(ValueError):
        lexical.LexicalIndex.save(lexical.tokenized(spark.createDataFrame([(1, "")], "i int, t string"), "i", "t"), str(tmp_path / "j"))


def test_fusion(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "qid int, doc string, rank int")
    got = retrieval.fuse([ranks([(1, "a", 1), (1, "b", 2)]), ranks([(1, "b", 1), (1, "c", 2), (2, "z", 1)])]).collect()
    by = {(r.qid, r.doc): (r.score, r["rank"]) for r in got}
    assert by[1, "b"][0] == pytest.approx(1 / 61 + 1 / 62) and by[1, "b"][1] == 1
    assert by[1, "a"][1] == 2 and by[1, "c"][1] == 3 and by[2, "z"][1] == 1
    tie = retrieval.fuse([ranks([(1, "x", 1)]), ranks([(1, "a", 1)])]).orderBy("rank").collect()
    assert [r.doc for r in tie] == ["x", "a"]
    assert retrieval.fuse([ranks([]), ranks([])]).count() == 0


def test_labour_rules(spark):
    ask = lambda q: one(spark, q, lambda c: retrieval.expanded(c))
    assert ask("老闆 在 假日 LINE群組 要我回訊") .endswith("出勤 加班")
    assert ask("老闆 在 假日") == "老闆 在 假日"
    assert ask("Unpaid Salary, can I Immediately Resign?").endswith("勞工得不經預告終止契約")
    assert ask("資遣費 新制 舊制 試算").endswith("六個月")


def test_gate_and_citations(spark):
    d = spark.createDataFrame([(0, None, ""), (3, 0.03, "見 [1]［2］[9][1]"), (3, 0.029, "x"), (2, -1.0, "[2]")], "n int, s double, t string")
    rows = d.select(answers.gate(F.col("n"), F.col("s"), 0.03, True).alias("g"), answers.gate(F.col("n"), F.col("s"), 0.03, False).alias("h"), answers.cited(F.col("t"), F.col("n")).alias("c")).collect()
    assert [r.g for r in rows] == ["no_hits", None, "threshold", "threshold"] and [r.h for r in rows] == ["no_hits", None, None, None]
    assert rows[1].c == [1, 2] and rows[3].c == [2]
    j = lambda raw: one(spark, raw, answers.judge_scores)
    assert tuple(j('```json\n{"faithfulness": 5, "relevancy": 4}\n```')) == (5, 4)
    assert j('{"faithfulness": 0, "relevancy": 4}') is None and j("none") is None and j('{"faithfulness": 6, "relevancy": 1}') is None


def test_answers_end_to_end(spark):
    import pyarrow as pa

    asked = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3"), (4, "q4")], "qid long, question string")
    hits = spark.createDataFrame([(1, 1, 0.9, "T", "A", "c1"), (1, 2, 0.5, "T", "B", "c2"), (2, 1, 0.01, "T", "A", "c"), (4, 1, 0.5, "T", "", "c")], "qid long, rank int, score double, doc_title string, article_label string, content string")

    def say(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["qid"], pa.array(["ok [2]" if q == 1 else answers.REFUSAL for q in b["qid"].to_pylist()])], names=["qid", "text"])

    rows = {r.qid: r for r in answers.answer(asked, hits, say, threshold=0.03, reranked=True).collect()}
    assert [rows[i].stage for i in (1, 2, 3, 4)] == [None, "threshold", "no_hits", "llm"] and rows[1].cited == [2]
    block = {r.qid: r.prompt for r in answers.prompts(asked, hits).collect()}
    assert block[1] == "[1] T A\nc1\n\n[2] T B\nc2\n\nq1" and block[3].startswith("(無檢索結果)") and block[4].startswith("[1] T\nc")


def test_metrics_on_empty_groups(spark):
    traces = spark.createDataFrame([(1, True, False, None, 2, 5, 4)], "qid long, answerable boolean, refused boolean, refusal_stage string, n_cited int, faithfulness int, relevancy int")
    r = evaluation.e2e_metrics(traces).first()
    assert r.false_refusal_rate == 0 and r.refusal_accuracy is None and r.direct_unanswerable_coverage is None and r.citation_parse_coverage == 1
    assert evaluation.e2e_metrics(traces.where("false")).first().false_refusal_rate == 0
    with pytest.raises(ValueError):
        evaluation.threshold_sweep(traces, [0.1, 0.1])


def test_pareto(spark):
    rows = [("s", True, 0.5), ("s", False, 0.01), ("s", False, 0.04), ("f", True, 0.5), ("f", False, 0.04)]
    sweep = evaluation.threshold_sweep(spark.createDataFrame(rows, "d string, answerable boolean, top_score double"), [0.0, 0.03, 0.05, 0.6], "d")
    assert [r.threshold for r in evaluation.pareto_better(sweep, "d", 0.03).collect()] == [0.05]


def test_costs_are_exact(spark):
    d = spark.createDataFrame([(1_234, 567), (89, 1)], "i long, o long").select(accounting.cost(F.col("i"), F.col("o"), "0.3", "2.5").alias("c"))
    assert d.agg(F.sum("c")).first()[0] == (Decimal(1323) * Decimal("0.3") + Decimal(568) * Decimal("2.5")) / 1_000_000


def test_running_budget(spark):
    rows = [("a", i, Decimal("0.1")) for i in range(6)]
    d = spark.createDataFrame(rows, "account string, seq long, cost decimal(34,13)").withColumn("max_cost", F.col("cost") * 2)
    got = accounting.running_budget(d, "0.5", cut=2).orderBy("seq").collect()
    assert [float(r.spent_before) for r in got] == pytest.approx([0, 0.1, 0.2, 0.3, 0.4, 0.5]) and [r.can_start for r in got] == [True, True, True, True, False, False]


def test_changes(spark):
    row = lambda rows: spark.createDataFrame(rows, "k string, a string, b int")
    got = audit.changes(row([("x", "1", 1), ("y", "1", 1), ("n", None, 1)]), row([("y", "2", 2), ("z", "1", 1), ("n", None, 1)]), "k", ["a", "b"])
    assert sorted((r.k, r.kind) for r in got.collect()) == [("x", "removed"), ("y", "a"), ("y", "b"), ("z", "added")]


def test_snapshot_hash_is_canonical_json(spark):
    import hashlib

    rows = [("L", 0, "1", "c", "text", "n", "u", "", ""), ("L", 1, "2", "", "（刪除）", "n", "u", "", "")]
    got = audit.law_snapshot(spark.createDataFrame(rows, "name string, pos int, no string, chapter string, content string, nature string, url string, last_amended string, effective_date string")).first()
    law = {"name": "L", "nature": "n", "url": "u", "last_amended": "", "effective_date": "", "articles": [{"no": "1", "chapter": "c", "content": "text"}]}
    assert got.num_articles == 1
    assert got.content_sha256 == hashlib.sha256(json.dumps(law, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_checks(spark):
    d = spark.createDataFrame([(1, "mail a@b.org"), (2, "x@users.noreply.github.com"), (3, "OPENAI_API_KEY = your_key"), (4, 'OPENAI_API_KEY="abc"'), (5, "/home/me/x"), (6, "sk-" + "a" * 24)], "k int, t string")
    got = sorted((r.k, r.category) for r in checks.privacy_scan(d, key="k", text="t").collect())
    assert got == [(1, "personal_identifier"), (4, "secret_assignment"), (5, "local_path"), (6, "provider_token")]
    with pytest.raises(ValueError):
        checks.require_none(checks.violations(d, {"small": F.col("k") < 3}, "k"))
    checks.require_none(checks.violations(d, {"small": F.col("k") < 30}, "k"))


LAW = {"name": "甲法", "nature": "法律", "url": "u", "last_amended": "20240101", "effective_date": "", "articles": [{"no": "第  1 條", "chapter": "", "content": "內文。"}, {"no": "第 2 條", "chapter": "總則", "content": "（刪除）"}]}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(LAW, ensure_ascii=False))
    (tmp_path / "manifest.json").write_text("{}")
    (tmp_path / "b.md").write_text("intro\n# 總則\n## 定義\ndef\n## 適用\nuse\n# 附則\nend\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.TXT").write_text(" body \n")
    (tmp_path / "d.bin").write_bytes(b"\0")
    got = sorted((r.doc_id, r.unit_idx, r.chapter, r.text) for r in readers.corpus(spark, str(tmp_path)).collect())
    assert got == [("b", 0, "", "intro"), ("b", 1, "總則 > 定義", "def"), ("b", 2, "總則 > 適用", "use"), ("b", 3, "附則", "end"), ("c", 0, "", "body"), ("甲法", 0, "", "內文。")]
    assert readers.load(spark, str(tmp_path / "a.json")).first().article_no == "第 1 條"
    with pytest.raises(ValueError):
        readers.load(spark, "x.docx")
    pages = readers.pdf_units(spark.createDataFrame([("/x/p.pdf", b"raw")], "path string, content binary"), lambda raw: ["one", " ", "three"])
    assert [(r.chapter, r.text) for r in pages.orderBy("unit_idx").collect()] == [("第 1 頁", "one"), ("第 3 頁", "three")]


@pytest.mark.parametrize("bad", [{"name": 1}, {"url": 2}, {"articles": [{"no": 1, "chapter": "", "content": "x"}]}, {"name": " "}])
def test_laws_of_wrong_types_fail(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(json.dumps(LAW | bad))
    with pytest.raises(Exception, match="not a law"):
        readers.laws(spark, str(tmp_path)).collect()


def test_zip_source(spark):
    xml = "<法規資料><法規><法規名稱>甲法</法規名稱><廢止註記/><法規內容><編章節>第一章</編章節><條文><條號>第 1 條</條號><條文內容>一</條文內容></條文><編章節>第二章</編章節><條文><條號>第 2 條</條號><條文內容>二</條文內容></條文></法規內容></法規></法規資料>"
    made = {}
    for name, members in {"ok": {"a.xml": xml, "b.xml": "<x/>"}, "no_xml": {"a.txt": "x"}, "entities": {"a.xml": '<!DOCTYPE x [<!ENTITY a "b">]>' + xml}}.items():
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, body in members.items():
                z.writestr(n, body)
        made[name] = out.getvalue()
    files = spark.createDataFrame([*made.items(), ("not_a_zip", b"xx")], "path string, content binary")
    assert all(r.path == r.status for r in readers.zip_status(files).collect())
    law = readers.zip_laws(readers.zip_nodes(files.where("path = 'ok'"))).first()
    assert law.name == "甲法" and [(a.no, a.chapter, a.content) for a in law.articles] == [("第 1 條", "第一章", "一"), ("第 2 條", "第二章", "二")]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [0.0, 1.0])], "chunk_id string, text string, vector array<float>")
    store = vectors.VectorStore(spark, str(tmp_path))
    assert store.build_candidates({"c1": rows}, {"c1": 2}, 2) == {"c1": 2}
    with pytest.raises(Exception):
        store.create("c1", rows, 2)
    with pytest.raises(ValueError):
        store.build_candidates({"c2": rows}, {"c2": 3}, 2)
    store.upsert("c1", spark.createDataFrame([("b", "u", [1.0, 1.0]), ("d", "t", [1.0, 1.0])], rows.schema), "c3")
    assert store.count("c3") == 3 and store.scroll("c3").columns == ["chunk_id", "text"]
    with pytest.raises(PermissionError):
        vectors.VectorStore(spark, str(tmp_path), read_only=True).recreate("c1", rows)


def test_search_in_blocks_and_zero_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, [0.0, 0.0])], "doc long, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "qid long, vector array<double>")
    whole = sorted(map(tuple, vectors.cosine_top_k(v, q, k=3, digits=6).collect()))
    assert whole == sorted(map(tuple, vectors.cosine_top_k(v, q, k=3, digits=6, block=2).collect())) and len(whole) == 15


def test_embedding_once(spark):
    import pyarrow as pa

    texts = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "key string, text string")
    cache = spark.createDataFrame([("k2", [2.0])], "key string, vector array<float>")

    def embed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([[1.0]] * b.num_rows, pa.list_(pa.float32()))], names=["key", "vector"])

    got, grown = vectors.encode(texts, cache, embed)
    assert sorted((r.key, r.vector[0]) for r in got.collect()) == [("k1", 1.0), ("k1", 1.0), ("k2", 2.0)] and grown.count() == 2


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("c", 0.5)], "chunk_id string, score double")
    sinks.write_chunks(d, str(tmp_path / "c"), "fixed")
    assert spark.read.parquet(str(tmp_path / "c")).first().strategy == "fixed"
    sinks.write_once(d, str(tmp_path / "r"))
    with pytest.raises(Exception):
        sinks.write_once(d, str(tmp_path / "r"))
    assert sinks.markdown_table(d, "chunk_id", "score") == "| chunk_id | score |\n|---|---|\n| c | 0.5000 |"


def test_stream_gives_the_batch_index(spark, tmp_path):
    from lexspan.streaming.incremental import ChunkIndex

    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate([[("a", "T", "one"), ("b", "T", "two")], [("b", "T", "two again"), ("c", "T", "three")]]):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "title", "text"), r, strict=True))) for r in rows))
    index = ChunkIndex(spark, str(tmp_path / "index"))
    index.follow(str(folder), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.doc_id, r.content) for r in index.read().collect()) == [("a", "one"), ("b", "two again"), ("c", "three")]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", [3, 7, 32])
def test_rerank_whatever_the_plan(spark, sf, adaptive, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        d, q = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as doc", "text"), spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as qid", "text as question")
        hits = retrieval.retrieve_grid(d, q, {"a": retrieval.RetrievalConfig(reranker=False, final=20), "b": retrieval.RetrievalConfig()})
        placed = {(r.qid, r.doc): r["rank"] for r in hits["a"].collect()}
        words = lambda s: set(re.findall("[a-z0-9]+", s.lower()))
        texts, asked = {r.doc: words(r.text or "") for r in d.collect()}, {r.qid: words(r.question) for r in q.collect()}
        want = []
        for i, w in asked.items():
            own = sorted((-round(len(w & texts[x]) / len(w), 6), n, x) for (k, x), n in placed.items() if k == i)
            want += [(i, x, -s, n + 1) for n, (s, _, x) in enumerate(own[:5])]
        assert len(placed) == 20 * len(asked) and sorted((r.qid, r.doc, r.score, r["rank"]) for r in hits["b"].collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chunks_of_both_strategies_are_retrieved(spark):
    units = spark.createDataFrame([(0, "d", "T", "A1", "", "red fox. " * 90, "", "", "", ""), (1, "d", "T", "A2", "", "blue whale", "", "", "", ""), (0, "e", "T", "A1", "", "green tree", "", "", "", "")], "unit_idx long, doc_id string, doc_title string, article_no string, chapter string, text string, source_path string, source_url string, last_amended string, effective_date string")
    asked = spark.createDataFrame([(1, "blue whale"), (2, "nothing here")], "qid int, question string")
    for strategy in ("structure", "fixed"):
        got = retrieval.retrieve_chunks(units, asked, retrieval.RetrievalConfig(strategy=strategy, mode="hybrid", threshold=0.5)).collect()
        assert next(r.doc_id for r in got if (r.qid, r["rank"]) == (1, 1)) == "d" and {r.stage for r in got if r.qid == 1} == {None} and {r.stage for r in got if r.qid == 2} == {"threshold"}


@pytest.mark.parametrize("late", [0, 1])
def test_stream_whatever_the_files_times(spark, tmp_path, late):
    import os

    from lexspan.streaming.incremental import ChunkIndex

    folder = tmp_path / "in"
    folder.mkdir()
    batches = [[("a", "T", "one", None), ("b", "T", "two", 2), (None, "T", "x", None)], [("b", "T", "two again", 3), ("c", "T", "three", None), ("a", "T", "", None), (None, "T", "y", None)], [("b", "T", "old", 1)]]
    for i, rows in enumerate(batches):
        f = folder / f"{i}.json"
        f.write_text("\n".join(json.dumps(dict(zip(("doc_id", "title", "text", "version"), r, strict=True))) for r in rows))
        os.utime(f, (1e9 + (i if late else -i), 1e9 + (i if late else -i)))
    index = ChunkIndex(spark, str(tmp_path / "index"))
    assert index.read() is None
    index.follow(str(folder), str(tmp_path / "ck")).awaitTermination()
    want = [(None, "y"), ("b", "two again"), ("c", "three")]
    seen = lambda: sorted(((r.doc_id, r.content) for r in index.read().collect()), key=str)
    assert seen() == sorted(want, key=str)
    index.compact()
    assert seen() == sorted(want, key=str) and len(index._batches()) == 1
    index.merge(spark.createDataFrame([("c", "T", "four", 1)], "doc_id string, title string, text string, version long"))
    assert ("c", "four") in seen() and ("c", "three") not in seen()


def test_index_answers_from_what_is_stored(spark, tmp_path):
    docs = lexical.tokenized(spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "c c d")], "i int, t string"), "i", "t")
    asked = lexical.tokenized(spark.createDataFrame([(9, "b c d"), (8, "zzz")], "i int, t string"), "i", "t")
    lexical.LexicalIndex.save(docs, str(tmp_path / "i"))
    found = lexical.LexicalIndex.load(spark, str(tmp_path / "i")).search(asked, 2)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [tuple(r) for r in lexical.bm25(docs, asked, k=2).orderBy("rank").collect()] and found.count() > 0


def test_reports_and_archives_lose_nothing(spark):
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(5), "id", limit=4)
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<法規></法規>" * 50)
    raw = bytearray(good.getvalue())
    locked = bytearray(raw)
    for sign, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(sign) + at] |= 1  # the flag of encryption
    body = raw.index(b"a.xml") + 5
    raw[body : body + 12] = b"\xff" * 12
    got = readers.zip_status(spark.createDataFrame([("broken", bytes(raw)), ("locked", bytes(locked)), ("ok", good.getvalue())], "path string, content binary")).collect()
    assert {r.path: r.status for r in got} == {"broken": "damaged", "locked": "damaged", "ok": "ok"}


def test_only_the_noreply_host_is_exempt(spark):
    d = spark.createDataFrame([(1, "x@users.noreply.github.com"), (2, "x@users.noreply.github.com.evil.org"), (3, "see x@users.noreply.github.com."), (4, "a@b.org")], "k int, t string")
    assert sorted(r.k for r in checks.privacy_scan(d, key="k", text="t").collect()) == [2, 4]


def test_a_malformed_law_fails_the_scan(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"name": "L", "articles": [{"no": 1, "chapter": "", "content": "c"}]}')
    with pytest.raises(Exception, match="not a law"):
        readers.corpus(spark, str(tmp_path)).collect()


def test_gold_of_short_questions(spark, tmp_path):
    from lexspan.plans import catalogue

    spark.createDataFrame([(1, "one two three four five six"), (2, "中文 問題 here"), (3, None), (4, "three")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "three four"), (2, "問題"), (3, "two three four five six"), (4, "three five")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted((r.qid, r.doc) for r in catalogue._gold(spark, str(tmp_path)).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_evidence_fails_closed(spark, tmp_path):
    from lexspan.operators import evidence

    rows = "qid string, answerable boolean, rank int, top_score double, elapsed_ms double"
    good, bad = [("a", True, 1, 0.5, 2.0)], [("b", True, 0, 0.5, 2.0), ("c", None, 1, float("nan"), float("inf")), (None, True, None, 1.5, -1.0)]
    assert [tuple(r) for r in evidence.private_trace(spark.createDataFrame(good, rows), 0.6).collect()] == [("a", True, 1, 0.5, True, 2.0)]
    for r in bad:
        with pytest.raises(Exception, match="trace breaks rule"):
            evidence.private_trace(spark.createDataFrame([r], rows), 0.6).collect()
    found = checks.violations(spark.createDataFrame(bad, rows), evidence.reliability_rules(), "qid").collect()
    assert sorted((str(r.qid), r.violation) for r in found) == [("None", "elapsed_ms"), ("None", "qid"), ("None", "top_score"), ("b", "rank"), ("c", "answerable"), ("c", "elapsed_ms"), ("c", "top_score")]
    texts = [(1, '{"qid":1}'), (2, "[1]"), (3, None), (4, '{"answerable":1,"cited_sources":["x",{"doc":1}],"elapsed_ms":1,"judge":{"relevancy":1},"q_type":1,"qid":1,"refusal_stage":1,"refused":1,"top_score":1}')]
    issues = evidence.field_issues(spark.createDataFrame(texts, "k int, j string"), "e2e", key="k", json="j").collect()
    own = lambda k: sorted(r.problem for r in issues if r.k == k)
    assert len(own(1)) == 8 and own(2) == own(3) == ["not_an_object"] and own(4) == ["judge_missing:faithfulness", "source_missing:article", "source_not_an_object"]
    call = spark.createDataFrame([("p", 10, 20)], "provider string, input_tokens int, output_tokens int")
    price = lambda p: spark.sql(f"select '{p}' as provider, cast(0.3 as decimal(12,6)) as input_price, cast(2.5 as decimal(12,6)) as output_price")
    assert accounting.priced(call, price("p")).first().cost == Decimal("0.000053")
    with pytest.raises(Exception, match="no price"):
        accounting.priced(call, price("q")).collect()
    a, b = (spark.createDataFrame([(x, "m", v)], "d string, metric string, value double") for x, v in (("x", 1.0), ("y", None)))
    assert sorted((r.d, r.problem) for r in evidence.mismatches(a, b, "d").collect()) == [("x", "missing"), ("y", "unpublished")] and evidence.mismatches(b, b, "d").isEmpty()
    sinks.write_or_check(a, str(tmp_path / "r"), check=False)
    sinks.write_or_check(a, str(tmp_path / "r"), check=True)
    with pytest.raises(ValueError):
        sinks.write_or_check(a.unionByName(a), str(tmp_path / "r"), check=True)


def test_case_scores(spark):
    from lexspan.operators import evidence

    cases = spark.createDataFrame(
        [("a", True, ["x", "y"], ["z"], ["r"], ["s"], False), ("b", True, ["x"], ["z"], [], [], False), ("c", False, [], ["z"], [], [], True), ("d", True, ["x"], [], [], [], False)],
        "qid string, answerable boolean, sources array<string>, prohibited array<string>, required_routes array<string>, prohibited_routes array<string>, expect_refusal boolean",
    )
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("b", "x", 6), ("b", "z", 2), ("c", "q", 1)], "qid string, source string, rank int")
    seen = spark.createDataFrame([("a", ["r"], False, 0.9), ("b", [], False, 0.9), ("c", [], True, 0.1)], "qid string, routes array<string>, threshold_refused boolean, top_score double")
    got = {r.qid: r for r in evidence.case_scores(cases, hits, seen).collect()}
    assert [got[k].passed for k in "abcd"] == [True, False, True, False] and (got["b"].n_found, got["b"].n_prohibited) == (0, 1)
    s = evidence.case_summary(evidence.case_scores(cases, hits, seen)).first()
    assert (s.total, s.source_recall_at_5, s.answerable_pass_rate, s.threshold_refusal_accuracy, s.passed) == (4, 0.5, 0.333333, 0.75, False)
