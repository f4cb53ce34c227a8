"""What Python workers keep from task to task, and how few words the token encoder has to learn."""

import random

import pyarrow as pa

from lexspan.llm import common, tokens


def test_a_task_of_another_kind_drops_what_is_remembered():
    rows = [pa.RecordBatch.from_pydict({"x": [1]})]
    common.remembered.clear()
    first = tokens.Encoder.of(tokens.default_format())
    assert list(common.tidy(lambda batches: batches, keep=tokens.Encoder.KEPT)(rows)) == rows
    assert tokens.Encoder.of(tokens.default_format()) is first
    assert list(common.tidy(lambda batches: batches)(rows)) == rows
    assert not common.remembered
    assert tokens.Encoder.of(tokens.default_format()) is not first


def test_words_with_marks_behind_them_are_learnt_once(monkeypatch):
    encoder = tokens.Encoder(tokens.default_format())
    learnt = []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learnt.extend(words), learn(words)))
    texts = ["Nébuleux, nébuleux. NÉBULEUX*** nébuleux;\tx1.5.\nxé,***", "", "nébuleux", ",", "a.", ". b", "7, x·, ×, ÷. it's, it'. rock'n'roll!! a,́ é, é, 中, ²!"]
    got = list(encoder.encode([x.encode() for x in texts]))
    assert got == [ids + encoder.end for ids in encoder.whole(texts)]
    assert not [w for w in learnt if w[:1].isalpha() and w.endswith((b",", b".", b"*", b";")) and w[-2:-1].isalpha()]
    assert {w for w in learnt if w.lower().startswith("nébuleux".encode())} <= {"nébuleux".encode(), "nÉbuleux".encode()}


def test_parted_texts_give_the_same_ids(monkeypatch):
    rng, encoder = random.Random(9), tokens.Encoder(tokens.default_format())
    letters = "aZé×÷ÞßıŁ中²7'.,;*<|>-_ \t\n\x0b ̸́ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["<|endoftext|>, a.", "a<|endoftext|>."]
    monkeypatch.setattr(tokens, "REMEMBERED", 1 << 18)
    got = [ids for i in range(0, len(texts), 50) for ids in encoder.encode([x.encode() for x in texts[i : i + 50]])]
    assert got == [ids + encoder.end for ids in encoder.whole(texts)]
    assert encoder.before and len(encoder.known) + len(encoder.before) < 2600
