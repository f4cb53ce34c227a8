"""Dictionary segmentation: against exhaustive searches of all cuts and of all tags."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import lexical, segment


def _made(spark, words, **settings):
    return segment.segmenter(spark.createDataFrame(list(words.items()), "word string, count long"), **settings)


def _cuts(text):
    for marks in itertools.product([False, True], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)]
        yield [text[a:b] for a, b in itertools.pairwise(at)]


def test_paths_equal_an_exhaustive_search(spark):
    rng = random.Random(1)
    for _ in range(12):
        words = {"".join(rng.choices("abc中文", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        made, total = _made(spark, words, hidden=False), sum(words.values())
        texts = ["".join(rng.choices("abcd中文字", k=rng.randint(1, 9))) for _ in range(40)]
        allowed = [[c for c in _cuts(t) if all(len(p) == 1 or p in words for p in c)] for t in texts]
        want = [max(cs, key=lambda c: (sum(segment.weight(words.get(p, 1), total) for p in c), [len(p) for p in c])) for cs in allowed]
        assert made.paths(texts) == want


def test_shapes_equal_an_exhaustive_search():
    rng = random.Random(2)
    words = {"".join(rng.choices("甲乙丙丁", k=rng.randint(1, 4))): rng.randint(1, 30) for _ in range(30)}
    shapes = segment.Shapes.fit(words.items())
    follows = {0: (1, 2), 1: (1, 2), 2: (0, 3), 3: (0, 3)}
    for _ in range(60):
        text = "".join(rng.choices("甲乙丙丁戊", k=rng.randint(1, 6)))

        def score(tags, text=text):
            e = [shapes.emit.get(c, shapes.unseen)[g] for c, g in zip(text, tags, strict=True)]
            return shapes.start[tags[0]] + sum(e) + sum(shapes.step[a][b] for a, b in itertools.pairwise(tags))

        whole = [g for g in itertools.product(range(4), repeat=len(text)) if g[0] in (0, 3) and g[-1] in (2, 3) and all(b in follows[a] for a, b in itertools.pairwise(g))]
        assert score(shapes.tags(text)) == max(map(score, whole))
        assert "".join(shapes.cut(text)) == text


def test_terms_of_the_dictionary_stay_whole(spark):
    made = _made(spark, {"資遣費": 50, "加班費": 50, "勞工": 400, "婚假": 60, "計算": 200, "怎麼": 300, "可以": 500, "勞動基準法": 20, "的": 900, "勞動": 80})
    got = made.segment(["資遣費怎麼計算?", "勞工的婚假 ABC12 可以", None, "", "勞動基準法，勞動", "魑魅魍魎勞工"])
    assert got[0] == ["資遣費", "怎麼", "計算"] and got[1] == ["勞工", "婚假", "ABC12", "可以"] and got[2:4] == [[], []] and got[4] == ["勞動基準法", "勞動"]
    assert "".join(got[5][:-1]) == "魑魅魍魎" and got[5][-1] == "勞工"
    assert made.segment(["資遣費怎麼計算?"]) == got[:1]


def test_a_known_sequence_of_single_characters_stays_single(spark):
    made = _made(spark, {"a": 1000, "b": 1000, "ab": 1, "xyz": 5}, runs="[a-z]+", cut="[a-z]+")
    assert made.segment(["ab"]) == [["a", "b"]] and "".join(made.segment(["abq"])[0]) == "abq"


def test_long_runs_and_forgetting(spark, monkeypatch):
    monkeypatch.setattr(segment, "TOGETHER", 50)
    monkeypatch.setattr(segment, "REMEMBERED", 3)
    made = _made(spark, {"ab": 5, "abc": 2, "c": 9}, hidden=False, runs="[a-z]+", cut="[a-z]+")
    long = "abc" * 20_000
    for _ in range(3):
        out = made.segment([f"{long} ab c", "abab", "q ab abc cab"])
        assert "".join(out[0]) == long + "abc" and out[1] == ["ab", "ab"] and len(set(out[0])) < 4


@pytest.mark.parametrize("rows", [[], [("", 1)], [(None, 1)], [("a", 0)], [("a", 1), ("a", 2)], [("x" * 65, 1)], [("a\nb", 1)], [("a", None)]])
def test_dictionaries_that_are_refused(spark, rows):
    with pytest.raises(ValueError, match="a dictionary has words"):
        segment.segmenter(spark.createDataFrame(rows, "word string, count long"))


def test_a_dictionary_too_large_to_travel_is_refused(spark):
    with pytest.raises(ValueError, match="may travel"):
        _made(spark, {"abc": 1, "de": 2}, most_chars=4)


def test_bm25_takes_the_dictionary_as_its_tokenizer(spark):
    tokens = segment.dictionary_tokens(_made(spark, {"資遣費": 9, "計算": 9, "特別休假": 9}), spark)
    docs = spark.createDataFrame([(1, "資遣費計算"), (2, "特別休假計算"), (3, None), (4, "費資遣")], "id long, text string")
    queries = spark.createDataFrame([(7, "特別休假"), (8, "資遣費")], "id long, text string")
    got = lexical.bm25(lexical.tokenized(docs, "id", "text", tokens), lexical.tokenized(queries, "id", "text", tokens), k=5)
    assert sorted((r.qid, r.doc) for r in got.collect()) == [(7, 2), (8, 1)]
    assert docs.select(tokens(F.col("text")).alias("x")).where("size(x) = 0").count() == 1
