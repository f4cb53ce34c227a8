"""Chunks of a fixed size: the rows of a plain fold over each document's sentences, however documents are cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F
from test_engine import plain_sentences

from lexspan.operators import chunking, fixed

UNITS = "unit_idx long, doc_id string, doc_title string, article_no string, chapter string, text string, source_path string, source_url string, last_amended string, effective_date string"


def plain_chunks(units, size, overlap):
    """One document's chunks (seq, content, articles, chapter), one sentence after the other."""
    out, held, fresh = [], [], 0

    def emit():
        if body := "".join(s for s, _, _ in held).strip():
            out.append((len(out), body, list(dict.fromkeys(a for _, a, _ in held if a)), held[0][2]))

    for _, article, chapter, text in sorted(units):
        for s in plain_sentences(text, size):
            if fresh and sum(len(x) for x, _, _ in held) + len(s) > size:
                emit()
                tail, total = len(held), 0
                while tail and total < overlap:
                    tail -= 1
                    total += len(held[tail][0])
                held, fresh = held[tail:], 0
            held.append((s, article, chapter))
            fresh += 1
    if fresh:
        emit()
    return out


def _document(rng, n):
    """n units of sentences of all lengths, blank ones and very long ones among them."""
    text = lambda: "".join("".join(rng.choices("甲乙 ab", k=rng.choice([0, 1, 3, 10, 25]))) + rng.choice(["。", "！", "\n", "；", " " * rng.choice([1, 1, 90])]) for _ in range(rng.randint(0, 12)))
    return [(i, rng.choice(["", f"A{i}"]), f"c{i}", text()) for i in range(n)]


@pytest.mark.parametrize("size,overlap,block", [(20, 6, 40), (20, 0, 40), (50, 49, 100), (30, 10, 1 << 15), (7, 3, 14)])
def test_fixed_chunks_equal_a_plain_fold(spark, size, overlap, block):
    rng = random.Random(size)
    docs = {f"d{k}": _document(rng, rng.choice([0, 1, 3, 30])) for k in range(25)} | {None: _document(rng, 20), "long": _document(rng, 400), "wide": [(0, "A", "c", "x。" + " " * 500 + "y。z")], "blank": [(0, "A", "c", "  \n ")]}
    rows = [(i, d, "T", a, c, t, "p", "", "", "") for d, us in docs.items() for i, a, c, t in us]
    got = chunking.fixed_chunks_by_blocks(spark.createDataFrame(rows, UNITS).repartition(7), size=size, overlap=overlap, block=block).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.seq, r.content, r.articles, r.chapter))
        assert r.text == "T\n" + r.content and r.source_path == "p"
    want = {d: plain_chunks(us, size, overlap) for d, us in docs.items()}
    assert {d: sorted(x) for d, x in found.items()} == {d: x for d, x in want.items() if x}
    assert len(want["long"]) > 40


def test_a_document_of_a_million_sentences_is_cut_by_many_tasks(spark):
    n = 1_000_000
    units = spark.range(n // 100, numPartitions=8).select(
        F.col("id").alias("unit_idx"), F.lit("d").alias("doc_id"), F.lit("T").alias("doc_title"), F.lit("").alias("article_no"), F.lit("").alias("chapter"),
        F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lpad((F.col("id") * 100 + i).cast("string"), 7, "0"), F.repeat(F.lit("x"), ((F.col("id") + i) % 5).cast("int")), F.lit("。")))).alias("text"),
        *(F.lit("").alias(c) for c in chunking.PROVENANCE),
    )
    each = units.select("doc_id", "unit_idx", F.posexplode(chunking.sentences(F.col("text"), 400)).alias("part", "sentence"), "doc_title", "article_no", "chapter", *chunking.PROVENANCE)
    got = fixed.cut(each, size=400, overlap=80, carried=("chapter", *chunking.PROVENANCE)).select("seq", "content").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(got)))
    number = lambda s: int(s[:7])
    at = -1
    for r in got:
        parts = r.content.split("。")[:-1]
        numbers = [number(p) for p in parts]
        assert numbers == list(range(numbers[0], numbers[-1] + 1)) and numbers[-1] > at and len(r.content) <= 400
        assert numbers[0] == 0 or sum(len(p) + 1 for p in parts[: at - numbers[0] + 1]) >= 80 > sum(len(p) + 1 for p in parts[1 : at - numbers[0] + 1])
        at = numbers[-1]
    assert at == n - 1


def test_fixed_chunks_of_nothing(spark):
    assert chunking.fixed_chunks_by_blocks(spark.createDataFrame([], UNITS)).count() == 0
