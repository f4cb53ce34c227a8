"""Source divergence, BPE by forced boundaries, fill-in-middle: against plain readings of their rules, and on edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from test_llm import EDGES, clashing, docs, prose

from lexspan.llm import bpe, divergence, fim, html_extract, media, merges, mixing

# --- 11: source divergence ---


def _plain_audit(rows, min_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(lang or "", source or "", terms(t)) for t, lang, source in rows]
    out = []
    for lang in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == lang]
        kept = sorted(t for t in {t for x in own for t in x[2]} if sum(t in x[2] for x in own) >= min_docs)
        counts = {s: [sum(x[2].count(t) for x in own if x[1] == s) for t in kept] for s in {x[1] for x in own}}
        share = lambda c: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c]
        p, q = {s: share(c) for s, c in counts.items()}, share([sum(c) for c in zip(*counts.values(), strict=True)])
        for s in p:
            pair = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True))) for o in p if o != s]
            term = [(t, (a - b) ** 2 // b) for t, a, b, n in zip(kept, p[s], q, counts[s], strict=True) if n and a > b]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def _corpus(rng, n):
    words = ["".join(rng.choices("abé", k=rng.randint(1, 3))) for _ in range(40)] + ["Zz", "x1y", "中文", "ЖЖ"]
    rows = [(" ".join(rng.choices(words[: rng.randint(2, 44)], k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", "Z", None])) for _ in range(n)]
    return rows + [(None, "en", "a"), ("", "xx", "alone"), ("", "yy", "p"), (None, "yy", "q"), ("rare words", "zz", "p"), ("rare words", "zz", "q"), ("ab\0ab", "en", "b")] + [rows[0]] * 3


@pytest.mark.parametrize("settings", [{}, {"chunk": 3, "slab": 2, "block": 2}, {"chunk": 1, "slab": 1, "block": 1, "top": 3}, {"min_docs": 1, "chunk": 5}])
def test_divergence_equals_a_plain_audit(spark, settings):
    rows = _corpus(random.Random(5), 120)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = sorted(map(tuple, divergence.audit(df, **settings).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == _plain_audit(rows, settings.get("min_docs", 3), settings.get("top", 200))


def test_divergence_of_pieces_and_tasks_that_send_early(spark, monkeypatch):
    rng = random.Random(6)
    rows = _corpus(rng, 20) + [("Ab " * 400 + "é" * 90 + " ab", "en", "a")]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for p in divergence._pieces(b"ab " * 5 + b"x" * 20 + b" y") for w in p] == [b"ab"] * 5 + [b"x" * 20, b"y"]
    monkeypatch.setattr(divergence, "HELD", 3)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    kept = sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert kept == _plain_audit(rows, 3, 200)


def test_divergence_edges(spark):
    assert divergence.audit(docs(spark, []).limit(0)).count() == 0
    extra = clashing(docs(spark, EDGES))
    same = divergence.audit(extra.selectExpr("*", "1 AS term", "2 AS df", "3 AS block", "4 AS p", "5 AS v", "6 AS chunk"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, divergence.audit(docs(spark, EDGES)).collect()))


def test_shares_leave_no_bits_out(spark):
    cases = [(0, 1), (0, 7), (10**13, 3 * 10**13), (10**13 - 1, 10**13), (9_300_000_000, 9_300_000_001), (12345, 999_999_999_989)]
    want = [1 + 10**9 * (n + 1) // d for n, d in cases]
    assert divergence._shares(*(np.array(x, np.int64) for x in zip(*cases, strict=True))).tolist() == want
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, d long").select("i", divergence._share("n", "d").alias("p"))
    assert [r.p for r in df.orderBy("i").collect()] == want


# --- 12: BPE by forced boundaries ---

ODD = [
    "don't I'll we've x's !'s 's''t", "<|endoftext|>a<|startoftext|>B <|ENDOFTEXT|>", "ǅ İstanbul ΑΣ ς é ẛ̣", " a　b c\x1cd\x85e", "中文字" * 300, "1234567890 ½ ٣", "\0\0 a\0b",
    "🎉🎉👩‍👩‍👧", "ﬁ ﬀ Ⅷ ①", "́a ̈b", "a.b,c;d...!!!",
]


def _odd_texts(rng, n):
    made = ["".join(rng.choices("aeinst ,.'éßüñ<|>çŒ中文ª́١9\n\t-‍\U0001F600ΣςİK", k=rng.randint(1, 40))) for _ in range(n)]
    return [*EDGES, *ODD, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), "x" * 9000, "ab" * 4000, *made]


def test_bpe_equals_the_library(spark):
    texts = _odd_texts(random.Random(7), 400)
    form = bpe.default_format()
    df = docs(spark, texts)
    want = bpe.brute_force(list(enumerate(texts)), form)
    assert {r[0]: tuple(r[1:]) for r in bpe.digests(df, form).collect()} == want
    rows = bpe.decode(bpe.encode(clashing(df), form, keep=["source"]), form).collect()
    assert {r.doc_id: (len(r.ids), hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows} == want
    assert bpe.digests(docs(spark, []).limit(0), form).count() == 0


def test_bpe_of_a_vocabulary_without_word_ends(spark):
    import public_tokenizers

    texts = _odd_texts(random.Random(8), 200)
    form = bpe.Format(public_tokenizers.path("byte_bpe_50k.json"), end_id=None, by_word=False, lower_case=False)
    want = bpe.brute_force(list(enumerate(texts)), form)
    assert {r[0]: tuple(r[1:]) for r in bpe.digests(docs(spark, texts), form).collect()} == want


def test_cuts_are_certain():
    codec = bpe.Codec.of(bpe.default_format())
    letters = merges.byte_letters()
    for token in random.Random(9).sample(sorted(codec.model.get_vocab()), 3000):
        word = token.removesuffix("</w>")
        raw = np.array([letters.index(c) for c in word], np.uint8) if all(c in letters for c in word) else np.empty(0, np.uint8)
        last = np.zeros(len(raw), bool)
        last[-1:] = token.endswith("</w>")
        assert codec.merges.cuts(raw, last)[1:].sum() == 0, token
    raw = np.frombuffer("qzjxkqéß中".encode(), np.uint8)
    last = np.arange(len(raw)) == len(raw) - 1
    cut = codec.merges.cuts(raw, last)
    assert cut.sum() > 3
    parts = [x.tolist() for x in np.split(np.where(last, codec.merges.last[raw], codec.merges.inner[raw]), np.flatnonzero(cut)[1:])]
    whole = codec.merges.merge_one(np.where(last, codec.merges.last[raw], codec.merges.inner[raw]).tolist())[0]
    assert whole == [i for p in parts for i in codec.merges.merge_one(p)[0]]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_rounds_and_heap_agree(monkeypatch, rounds):
    texts = [t for t in _odd_texts(random.Random(10), 60) if t]
    form = bpe.default_format()
    want = bpe.Codec(form).whole(texts)
    monkeypatch.setattr(merges, "ROUNDS", rounds)
    assert bpe.Codec(form).whole(texts) == want


# --- 13: fill-in-middle ---


def _plain_fim(doc_id, text, form):
    text = text or ""
    units = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s:.)"}
    u = re.findall(units[form.unit], text)
    h = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(m in text for m in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.rate:
        return len(u), "plain", None, None, text, text
    kind = "spm" if h[3] % 100 < form.spm else "psm"
    out = form.prefix + pre + form.suffix + suf + form.middle + mid if kind == "psm" else form.suffix + suf + form.prefix + pre + form.middle + mid
    return len(u), kind, len(pre), len(mid), out, text


@pytest.mark.parametrize("form", [fim.Form(), fim.Form(unit="word", rate=60, spm=0), fim.Form(unit="char", spm=100, seed=0), fim.Form("<fim_prefix>", "<fim_suffix>", "<fim_middle>")])
def test_fim_equals_a_plain_reading(spark, form):
    rng = random.Random(11)
    texts = [*EDGES, "<P>", "a<S>\nb", "<fim_middle>", "<P\n<S<M", "x<\n>y\n\n\n", *("".join(rng.choices("ab \n<PSM>é中\t", k=rng.randint(0, 60))) for _ in range(150)), prose(rng, 3000) + "\n" + "é" * 70_000]
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in fim.restore(fim.transform(docs(spark, texts), form), form).collect()}
    want = {i: _plain_fim(i, t, form) for i, t in enumerate(texts)}
    assert got == want
    assert len({x[1] for x in got.values()}) == (2 if form.spm in (0, 100) else 3)


def test_fim_edges(spark):
    df = spark.createDataFrame([(None, "a\nb", 1), (None, "a\nb", 2), (5, None, 3), (5, "q\n", 4)], "doc_id long, text string, source int").selectExpr("*", "9 AS n", "8 AS output", "7 AS h1", "6 AS _0")
    rows = fim.restore(fim.transform(df, keep=["source", "_0"])).collect()
    assert sorted((r.source, r.n, r.form, r.output, r.restored, r._0) for r in rows) == sorted((s, *_plain_fim(d, t, fim.Form())[:2], *_plain_fim(d, t, fim.Form())[4:], 6) for d, t, s in ((None, "a\nb", 1), (None, "a\nb", 2), (5, None, 3), (5, "q\n", 4)))
    assert fim.transform(docs(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        fim.transform(df, keep=["output"])
    for marks in itertools.permutations(["<P>", "<P", "<M>"]):
        with pytest.raises(ValueError, match="sentinels"):
            fim.Form(*marks)
    with pytest.raises(ValueError, match="begins another"):
        fim.Form("<a<", "<b>", "<c>")


# --- 6: whole articles of hosts without <article> ---


def _host(spark, pages):
    rows = [(i, f"http://h.org/{i}", f"<html><body>{p}</body></html>") for i, p in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


STORY = [f"Story {i} " + "and so on and on, " * (20 + i) for i in range(6)]


@pytest.mark.parametrize(
    "page,lines",
    [
        ('<div class="post"><h1>T {i}</h1><div class="byline">By Jane Doe</div><div class="story"><p>{s}</p></div></div>', ["T {i}", "By Jane Doe", "{s}"]),
        ('<div class="post"><div class="story"><p>{s}</p></div><p><a href="/x">Read the original announcement</a></p></div>', ["{s}", "Read the original announcement"]),
        ('<div class="post"><div class="story"><p>{s}</p></div><p><a href="/x">Read original {i}</a></p></div>', ["{s}", "Read original {i}"]),
        ('<div class="post"><div class="kicker">Economy</div><div hidden>More of it {i}</div><div class="story"><p>{s}</p></div></div>', ["Economy", "More of it {i}", "{s}"]),
        ('<div class="post"><header><h1>Title {i}</h1></header><div class="story"><p>{s}</p><p>End {i}</p></div><p>Last {i}</p></div>', ["Title {i}", "{s}", "End {i}", "Last {i}"]),
        ('<div class="post"><h1>Cafe {i}</h1><div class="menu"><p>Soup of the day, bread {i}</p></div><p>{s}</p></div>', ["Cafe {i}", "Soup of the day, bread {i}", "{s}"]),
        ('<div class="top"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="post"><p>{s}</p><p>Source: wire</p></div><div class="bottom"><p>All rights reserved by us</p></div>', ["{s}", "Source: wire"]),
        ('<header><h1>The Site</h1></header><div class="menu"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="post"><h2>T {i}</h2><p>{s}</p></div><footer>f</footer>', ["T {i}", "{s}"]),
        ('<div class="page"><header><p>The Site</p></header><h2>T {i}</h2><p>{s}</p><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li><li><a href="/c">Shop</a></li></ul></div>', ["T {i}", "{s}"]),
        ('<div class="page"><header><p>Issue {i}</p></header><h2>T {i}</h2><p>{s}</p><ul><li><a href="/{i}">Part {i}</a></li><li>and more</li></ul></div>', ["Issue {i}", "T {i}", "{s}", "Part {i}", "and more"]),
    ],
)
def test_html_keeps_the_article_whole(spark, page, lines):
    fill = lambda t, i: t.replace("{i}", str(i)).replace("{s}", STORY[i])
    got = _host(spark, [fill(page, i) for i in range(6)])
    want = ["\n".join(" ".join(fill(x, i).split()) for x in lines) for i in range(6)]
    assert got == want


def test_html_leaves_out_what_the_host_confirms(spark):
    page = '<div class="page"><header><div class="brand"><p>The Site</p></div></header><h2>T {0}</h2><p>{1}</p><div class="links"><a href="/">Home page</a><div><a href="/b">Blog</a></div><div><a href="/c">Shop</a></div></div></div>'
    assert _host(spark, [page.format(i, STORY[i]) for i in range(6)]) == [f"T {i}\n{' '.join(STORY[i].split())}" for i in range(6)]


def test_html_repeated_pages(spark):
    page = '<div class="post"><h1>T</h1><div class="x">By Jane Doe</div><p>{}</p></div>'
    assert set(_host(spark, [page.format(STORY[0])] * 7)) == {"T\nBy Jane Doe\n" + " ".join(STORY[0].split())}


# --- 4, 9 ---


def test_tensors_keep_half_precision():
    rng = np.random.default_rng(1)
    rows, _ = media.log_mel(rng.normal(size=40_000).astype(np.float32), 6400.0)
    patches, spans = media.read_tensors(media.tensors(rows, 6400.0))
    got = patches.reshape(-1, media.MELS)[: len(rows)]
    assert np.abs(got - rows).max() <= 2.0**-10 * np.abs(rows).max() and len(spans) == len(patches)
    assert media.TENSOR.value_type == "halffloat"


def test_mixing_comes_near_every_target_on_a_heavy_tail(spark):
    rng = random.Random(12)
    rows = []
    for k, (source, n) in enumerate((("a", 3000), ("b", 9000), ("c", 6000), (None, 2000))):
        sizes = [min(4000, int(3 / (1 - rng.random()) ** 0.9)) for _ in range(n)]
        rows += [(k * 100_000 + i, "w " * s, "en", source, 0) for i, s in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)).groupBy("source").agg({"target": "max", "*": "count"}).collect()
    taken = {r.source: r.t for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).selectExpr("source", "copies * size AS x").groupBy("source").agg({"x": "sum"}).withColumnRenamed("sum(x)", "t").collect()}
    for r in got:
        assert abs(taken[r.source] - r["max(target)"]) < 0.01 * r["max(target)"], r.source


def test_words_put_together_from_parts():
    from lexspan.llm import tokens

    marks = ["", "!", "...", "(", '"', "&&&", ",!!", "'", "'s", "-", "×", "÷", "ª", "1", "́", "<|", "|>"]
    cores = ["a", "Queoi", "ÉÀÞß", "ñadoñ", "ÿ", "x×y", "İ", "中文", "é", "ΑΣ", "ŒUVRE", "z" * 300, "qzjx" * 40]
    texts = [f"{a}{c}{b} {c} {b}{a}" for a in marks for c in cores for b in marks]
    form = tokens.default_format()
    encoder = tokens.Encoder(form)
    want = [ids + encoder.end for ids in encoder.whole(texts)]
    assert list(encoder.encode([t.encode() for t in texts])) == want
    assert [list(tokens.Encoder(form).encode([t.encode()]))[0] for t in texts[::97]] == want[::97]


# --- edges of earlier operators ---


def test_pipeline_over_nothing_and_clashing_columns(spark, tmp_path, sf):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, docs_ in (("none", d.limit(0)), ("some", clashing(d.orderBy("doc_id").limit(40)).selectExpr("*", "1 AS _row", "2 AS copies", "3 AS rate", "4 AS _mix_size"))):
        docs_.write.parquet(str(tmp_path / name / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / name / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_toxicity_of_nothing_and_repeated_rows(spark, sf):
    from lexspan.llm import toxicity

    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(d, labels)
    assert toxicity.score(d.limit(0), model).count() == 0
    some = clashing(d.orderBy("doc_id").limit(12)).drop("score")
    twice = toxicity.score(some.unionByName(some), model).select("doc_id", "score").collect()
    assert len(twice) == 24 and len({(r.doc_id, r.score) for r in twice}) == 12


def test_licences_of_repeated_rows_and_very_long_texts(spark):
    from lexspan.llm import licenses

    template = next(iter(licenses.TEMPLATES.values()))
    d = docs(spark, [None, "", "word " * 30_000 + template, template] * 2).selectExpr("doc_id % 4 AS doc_id", "text", "lang", "source", "n_chars")
    rows = [str(r) for r in licenses.find_licenses(clashing(d)).collect()]
    assert len(rows) == 8 and all(rows.count(r) == 2 for r in rows) and len(set(rows)) == 4
