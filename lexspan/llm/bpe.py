"""BPE encoding and decoding by forced-boundary splitting.

A merge makes a token of the vocabulary, so two neighbouring bytes that stand side by side in no token can't be merged across:
between them there is a certain cut, whatever the rest of the word. The cuts of a batch of new words are found with one table
lookup for each pair of bytes; the fragments between them are merged independently, all together, round by round (each round
merges every fragment's pair of lowest rank), and their ids are put together again. Where a tokenizer marks word ends, a pair at the end
of a word is judged by the tokens that end words, which makes more cuts. The tokenizers library supplies what stands before the
merges (normalisation, the cut into words); ids are those that it gives to the whole text, which tests compare.

Words met again are remembered as in token files, within a bound of bytes, so that most of a corpus is looked up.

Defined results. Null or empty text: no ids, the empty text. Repeated rows each give a row. Special tokens' strings in a text are the
special tokens. No documents: no rows. Columns named in `keep` are carried along; others, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexspan.llm.common import arrow_schema, batch, carried, runs, table, tidy, utf8
from lexspan.llm.merges import byte_letters
from lexspan.llm.tokens import CHUNK, TOGETHER, Encoder, Format

#: Ids that are hashed or decoded at once.
PART = 1 << 18


class Codec(Encoder):
    """Encoder whose new words are merged fragment by fragment; and decoding."""

    def __init__(self, form: Format):
        added = json.load(open(form.tokenizer, encoding="utf-8")).get("added_tokens", [])
        self.added = {t["content"]: t["id"] for t in added}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take in white space, stand alone or are normalised aren't supported")
        self.mark = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.letter = np.zeros(512, np.uint8)
        self.letter[[ord(c) for c in byte_letters()]] = np.arange(256)
        super().__init__(form)
        if self.merges is None:
            raise ValueError("not a byte-level BPE vocabulary")
        self.model.no_truncation()
        self.model.no_padding()
        n = self.model.get_vocab_size()
        self.number = [str(i).encode() for i in range(n)]
        self.piece = [(self.model.id_to_token(i) or "") for i in range(n)]
        decoder = type(self.model.decoder).__name__ if self.model.decoder else None
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {decoder} isn't supported")
        self.joined = " " if decoder is None else ""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.spelt = [p.encode() if decoder is None or any(c not in byte_of for c in p) else bytes(byte_of[c] for c in p) for p in self.piece]

    def letters(self, words: list[bytes]) -> list[bytes]:
        return self.words(words)

    def words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            out += self._some([w.decode() for w in words[i : i + TOGETHER]], apart=False)
        return out

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return self._some(list(texts), apart=True)

    def _some(self, texts: list[str], apart: bool) -> list[bytes]:
        """Ids of texts. Where no part crosses white space they are cut into parts together, else one by one."""
        owner, spans = [], []
        for i, t in enumerate(texts):
            for x in self._spans(t):
                owner.append(i)
                spans.append(x)
        normal = self.model.normalizer.normalize_str if self.model.normalizer else lambda s: s
        cut = self.model.pre_tokenizer.pre_tokenize_str
        special = [self.added.get(s) for s in spans]
        known = [i for i, s in enumerate(special) if s is None and spans[i]]
        clean = [normal(spans[i]) for i in known]
        if apart:
            parts = [(i, p) for i, t in zip(known, clean, strict=True) for p, _ in cut(t)]
        else:
            first = np.cumsum([0, *(len(t) + 1 for t in clean)])
            found = cut(" ".join(clean))
            at = np.searchsorted(first, [a for _, (a, _) in found], side="right") - 1
            parts = [(known[k], p) for k, (p, _) in zip(at.tolist(), found, strict=True)]
        size = np.array([len(p) for _, p in parts], np.int64)
        raw = self.letter[np.frombuffer("".join(p for _, p in parts).encode("utf-16-le"), np.uint16)]
        last = np.zeros(len(raw), bool)
        last[np.cumsum(size) - 1] = True
        got = self.merged(raw, last, np.repeat(np.array([i for i, _ in parts], np.int64), size), len(spans))
        out = [b""] * len(texts)
        for i, t in enumerate(owner):
            out[t] += got[i] if special[i] is None else np.array([special[i]], self.kind).tobytes()
        return out

    def _spans(self, text: str) -> Iterator[str]:
        """What lies between special tokens' strings, and these, in turn."""
        at = 0
        for m in self.mark.finditer(text):
            yield text[at : m.start()]
            yield m[0]
            at = m.end()
        yield text[at:]

    def _parts(self, ids: bytes, table: list[bytes], mark: bytes) -> Iterator[bytes]:
        """The entries of ids, joined by mark, some at a time."""
        got = np.frombuffer(ids, self.kind)
        for a in range(0, len(got), PART):
            yield (mark if a else b"") + mark.join(map(table.__getitem__, got[a : a + PART].tolist()))

    def decode(self, ids: bytes) -> str:
        return b"".join(self._parts(ids, self.spelt, self.joined.encode())).decode("utf-8", "replace")

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by blanks and of the decoded text."""
        decimal, text = hashlib.sha256(), hashlib.sha256()
        for p in self._parts(ids, self.number, b" "):
            decimal.update(p)
        if self.joined:
            for p in self._parts(ids, self.spelt, self.joined.encode()):
                text.update(p)
        else:  # bytes of one letter may lie in two parts
            text.update(self.decode(ids).encode())
        return len(ids) // self.kind.itemsize, decimal.hexdigest(), text.hexdigest()


def _over_texts(docs: DataFrame, form: Format, made: Sequence[T.StructField], give: Callable[[Codec, bytes], tuple], id_col: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *carried(docs, keep, [f.name for f in made]), *made]
    carries = len(fields) - len(made)
    wanted = docs.select(*(docs[f.name].alias(f"_{i}") for i, f in enumerate(fields[:carries])), docs[text_col].alias("text"))
    schema = arrow_schema(fields)

    @functools.partial(tidy, keep=Codec.KEPT)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(form)
        for b in batches:
            at, raw = utf8(b["text"])
            for i, j in runs(at, CHUNK):
                texts = [raw[x:y].tobytes() for x, y in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                rows = list(zip(*(give(codec, ids) for ids in codec.encode(texts)), strict=True))
                yield batch([*(b[f"_{k}"].slice(i, j - i) for k in range(carries)), *rows], schema)

    return wanted.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, form: Format, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The id, the columns to keep, and `ids`."""
    give = lambda codec, ids: (np.frombuffer(ids, codec.kind).astype(np.int32),)
    return _over_texts(docs, form, [T.StructField("ids", T.ArrayType(T.IntegerType()))], give, id_col, text_col, keep)


def digests(docs: DataFrame, form: Format, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The id, the columns to keep, n_tokens, ids_sha256 and decoded_sha256, without holding what is hashed."""
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _over_texts(docs, form, made, Codec.digests, id_col, text_col, keep)


def decode(encoded: DataFrame, form: Format, *, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded`; null ids are none."""
    fields = [*encoded.schema.fields, T.StructField("decoded", T.StringType())]
    schema = arrow_schema(fields)

    @functools.partial(tidy, keep=Codec.KEPT)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(form)
        for b in batches:
            texts = [codec.decode(x.values.to_numpy().astype(codec.kind).tobytes() if x.is_valid else b"") for x in b[ids_col]]
            yield batch([*b.columns, texts], schema)

    return encoded.mapInArrow(run, T.StructType(fields))


def default_format() -> Format:
    import public_tokenizers

    return Format(public_tokenizers.path("word_bpe_49k.json"), end_id=None)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_format())


def brute_force(docs: list[tuple[int, str | None]], form: Format) -> dict[int, tuple[int, str, str]]:
    """n_tokens, ids_sha256, decoded_sha256 by document, each whole text encoded and decoded by the library."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(form.tokenizer)
    model.no_truncation()
    model.no_padding()
    out = {}
    for d, t in docs:
        ids = model.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[d] = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False)))
    return out
