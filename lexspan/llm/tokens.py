"""Token-ID output: Arrow IPC files whose record batches hold fixed-size lists, so that any sequence of a file is found by
arithmetic and read without a copy, with a mask (a byte a token) that tells tokens from the padding of the last sequence.

Documents are dealt by ranges of their id and sorted, so that file k holds the ids that follow those of file k - 1. Each
task writes one file and a small index (doc_id, start, n_tokens) beside it, under a name that no other attempt has, and
returns one manifest row; only files with a manifest row are read, so a task may be tried again.

Defined results. Null or empty text: the end id alone. Null ids come first. Repeated ids: each row has its own tokens; ties go by
a hash of the text. No documents: no files, no rows. Only the id and text columns
are read; others, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import materialize, remembered, runs, scratch_path, table, tidy, utf8
from lexspan.llm.merges import Merges

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 64
#: Bytes of words and ids, with what a dictionary takes for each, that a Python worker remembers. When half of that is full it forgets
#: what it hasn't met since the half before, which most words of a corpus aren't.
REMEMBERED, EACH = 64 << 20, 160
#: New words that are encoded together; bytes of texts whose words are looked up together.
TOGETHER, CHUNK = 500, 1 << 20
#: Words of letters that are merged together.
MERGED = 10_000
MANIFEST = "part long, path string, n_docs long, n_tokens long"


@dataclass(frozen=True)
class Format:
    tokenizer: str
    #: What ends each document; None: nothing.
    end_id: int | None = 2
    sequence: int = SEQUENCE
    batch: int = BATCH
    #: The tokenizer drops white space and no token crosses it, so words can be encoded one by one and remembered.
    by_word: bool = True
    #: The tokenizer takes A-Z for a-z.
    lower_case: bool = True
    #: A run of ASCII punctuation but apostrophes at a side of a word of letters is a word of its own to the tokenizer.
    marks_apart: bool = True


_MARKS = rb"[!-&(-/:-@\[-`{-~]*"
#: Letters that are letters to every version of Unicode, and stay one letter each when they are made small.
_SURE = rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_LETTERS = re.compile(_SURE + rb"+")
#: The same by byte: marks; letters of one byte, and the second bytes of those of two; what ends a word, or a text among others.
_MARK, _LETTER, _SECOND, _PAST = (np.array([bool(re.fullmatch(r, bytes([b]))) for b in range(256)]) for r in (_MARKS, rb"[a-zA-Z]", rb"[\x80-\x96\x98-\xb6\xb8-\xbf]", rb"[\x09-\x0d \xff]"))
_MARK_BYTES = bytes(np.flatnonzero(_MARK).tolist())
_EDGED = re.compile(rb"(%s)(%s(?:[a-zA-Z\x80-\xff]*%s)?)(%s)" % (_MARKS, _SURE, _SURE, _MARKS))


def filesystem(uri: str):
    """pyarrow's file system for a path of Spark's, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Encoder:
    """Ids of texts as little-endian bytes of the narrowest width that holds the vocabulary.

    The tokenizer and the words it has encoded are kept for a process until a task without need of them begins, of words as many
    as REMEMBERED allows."""

    KEPT = "encoders"

    def __init__(self, form: Format):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.form = Tokenizer.from_file(form.tokenizer), form
        self.kind = np.dtype("<u2" if max(self.model.get_vocab_size(), (form.end_id or 0) + 1) <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0
        special = sorted((i, t.content) for i, t in self.model.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized))
        self.parting = (special[0][1], special[0][0]) if special else None
        #: Whether an id ends a word, for tokenizers that mark that.
        suffix, self.ends = getattr(self.model.model, "end_of_word_suffix", None), None
        if suffix:
            self.ends = np.zeros(self.model.get_vocab_size(), bool)
            self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith(suffix)]] = True
        self.merges = self._merges()
        self.stops = self.whole([",", "."])
        self.end = b"" if form.end_id is None else np.array([form.end_id], self.kind).tobytes()

    def _merges(self) -> Merges | None:
        """The vocabulary as arrays, if it is a byte-level BPE."""
        with open(self.form.tokenizer, encoding="utf-8") as f:
            made = json.load(f)
        cutters = made.get("pre_tokenizer") or {}
        kinds = {cutters.get("type"), *(x["type"] for x in cutters.get("pretokenizers", []))}
        return Merges(made["model"]) if made["model"].get("type") == "BPE" and "ByteLevel" in kinds else None

    def merged(self, raw: np.ndarray, last: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """Ids of n words. raw: their bytes; last: the byte ends one of the parts that a word is cut into; owner: each byte's word."""
        ids, at = self.merges.merge(raw, last)
        ends = np.cumsum(np.bincount(owner[at], minlength=n)) * self.kind.itemsize
        data = ids.astype(self.kind).tobytes()
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def sure_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of such letters alone as every version of Unicode knows, merged many at a time: no part of the tokenizer but its merges
        has anything to do with them."""
        out: list[bytes] = []
        for i in range(0, len(words), MERGED):
            part = words[i : i + MERGED]
            n = np.array([len(w) for w in part], np.int64)
            raw = np.frombuffer(b"".join(part), np.uint8)
            if self.form.lower_case:  # A to Z, and their like after the byte C3
                raw = raw + np.where((raw >= 65) & (raw <= 90) | np.append(False, raw[:-1] == 0xC3) & (raw < 0x9F), np.uint8(32), np.uint8(0))
            last = np.zeros(len(raw), bool)
            last[np.cumsum(n) - 1] = True
            out += self.merged(raw, last, np.repeat(np.arange(len(n)), n), len(n))
        return out

    @classmethod
    def of(cls, form: Format) -> Encoder:
        """One for each format and Python worker."""
        made = remembered.setdefault(cls.KEPT, {})
        if (cls, form) not in made:
            made[cls, form] = cls(form)
        return made[cls, form]

    def taken(self, words: Collection[bytes]) -> int:
        return sum(map(len, words)) + sum(map(len, map(self.known.__getitem__, words))) + EACH * len(words)

    def forget(self) -> None:
        """What is known goes to the words of before, which go but for those that were met again and so are among the known."""
        self.before, self.known, self.size = self.known, {}, 0

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(list(texts), add_special_tokens=False)]

    def letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word of letters alone. Many go in one text, with blanks between them. Each gives at least one id that ends a
        word; where there are more, as letters that are taken apart give, the words are encoded as others are."""
        n, out = self.kind.itemsize, []
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.model.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * n).tolist()
            if len(cut) != len(part):
                out += self.words(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Many words go in one text, with a special token between them to cut the ids at."""
        if self.parting is None:
            return self.whole([w.decode() for w in words])
        mark, number = self.parting
        out: list[bytes] = []
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self.model.encode_batch_fast([mark.join(w.decode() for w in p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cut = np.flatnonzero(ids == number)
            if len(cut) != len(part) - 1:  # a word has the special token in it
                out += self.whole([w.decode() for w in part])
                continue
            raw, n = ids.tobytes(), self.kind.itemsize
            ends = [*(cut * n).tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip([0, *(x + n for x in ends[:-1])], ends, strict=True)]
        return out

    def learn(self, words: set[bytes]) -> None:
        """Puts the ids of new words among the known ones. Letters with marks at their sides are put together from the ids of these,
        which most often are known."""
        known, apart = self.known, self.form.marks_apart
        plain = [w for w in words if w.isalpha()] if self.merges else []
        rest = words.difference(plain)
        new: set[bytes] = set()
        stopped, put = [], []  # words with a full stop or comma; words of more or other parts
        for w in rest:
            if apart and w[-1] in b",." and w[-2:-1].isalpha():
                stopped.append(w)
                if w[:-1] not in known and w[:-1] not in words:
                    new.add(w[:-1])
                continue
            m = _EDGED.fullmatch(w) if apart and (w[0] in _MARK_BYTES or w[-1] in _MARK_BYTES) and b"<|" not in w else None
            if m and (m[1] or m[3]) and m[2].decode().isalpha():
                put.append((w, parts := [x for x in m.groups() if x]))
                new.update([x for x in parts if x not in known and x not in words])
            else:
                new.add(w)
        letters, listed = [], []
        for w in new:
            (plain if self.merges and (w.isalpha() or _LETTERS.fullmatch(w)) else letters if self.ends is not None and w.decode().isalpha() else listed).append(w)
        known.update(zip(plain, self.sure_letters(plain), strict=True))
        known.update(zip(letters, self.letters(letters), strict=True))
        known.update(zip(listed, self.words(listed), strict=True))
        for w, parts in put:
            known[w] = b"".join([known[x] for x in parts])
        stops = dict(zip(b",.", self.stops, strict=True))
        for w in stopped:
            known[w] = known[w[:-1]] + stops[w[-1]]
        self.size += self.taken(plain) + self.taken(letters) + self.taken(listed) + self.taken(stopped) + self.taken([w for w, _ in put])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.form.by_word:
            yield from (x + self.end for x in self.whole([t.decode() for t in texts]))
            return
        # special tokens are found before letters are lowered, so a text that may have one is left as it is
        split = [t.lower().split() if self.form.lower_case and b"<|" not in t else t.split() for t in self.parted(texts)]
        if self.size > REMEMBERED // 2:
            self.forget()
        words = set().union(*split)
        # each distinct word is looked up once among all that is known; its repetitions in a small table of these texts
        own = dict(zip(words, map(self.known.get, words), strict=True))
        if missing := [w for w, ids in own.items() if ids is None]:
            met = {w: ids for w, ids in zip(missing, map(self.before.get, missing), strict=True) if ids is not None}
            self.known |= met
            self.size += self.taken(met)
            if new := set(missing).difference(met):
                self.learn(new)
            own |= {w: self.known[w] for w in missing}
        get = own.__getitem__
        for row in split:
            yield b"".join(map(get, row)) + self.end

    def parted(self, texts: list[bytes]) -> list[bytes]:
        """The texts with a blank before each run of marks that stands between a sure letter and white space, or the text's end.
        The tokenizer cuts there and drops the blank, and so fewer words are distinct."""
        raw = b"\xff".join([*texts, b""])  # a byte that no text has
        if not self.form.marks_apart or b"<|" in raw:
            return texts
        a = np.frombuffer(raw, np.uint8)
        mark = np.concatenate(([False], _MARK[a], [False]))
        edge = np.flatnonzero(mark[1:] != mark[:-1])
        first, past = edge[::2], edge[1::2]
        first, past = first[first > 0], past[first > 0]
        ok = _PAST[a[past]] & (_LETTER[a[first - 1]] | (_SECOND[a[first - 1]] & (a[first - 2] == 0xC3)))
        at = first[ok]
        out, kept = np.full(len(a) + len(at), 32, np.uint8), np.ones(len(a) + len(at), bool)
        kept[at + np.arange(len(at))] = False
        out[kept] = a
        return out.tobytes().split(b"\xff")[:-1]


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.uint8(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Fills sequences one after the other and writes a batch whenever it is full; only the last can be shorter."""

    def __init__(self, sink, kind: np.dtype, form: Format):
        self.schema, self.kind, self.form = sequence_schema(kind, form.sequence), kind, form
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest, self.full = bytearray(), form.sequence * form.batch * kind.itemsize

    def add(self, ids: bytes) -> None:
        self.rest += ids
        while len(self.rest) >= self.full:
            self._write(bytes(memoryview(self.rest)[: self.full]))
            del self.rest[: self.full]

    def _write(self, ids: bytes) -> None:
        got, length = np.frombuffer(ids, self.kind), self.form.sequence
        n = -(-len(got) // length)
        padded, mask = np.zeros(n * length, self.kind), np.zeros(n * length, np.uint8)
        padded[: len(got)], mask[: len(got)] = got, 1
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (padded, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.rest:
            self._write(bytes(self.rest))
        self.out.close()


class SequenceFile:
    """Random access to a written file. A local one is mapped into memory and nothing is copied but what crosses batches."""

    def __init__(self, uri: str, form: Format):
        system, path = filesystem(uri)
        self.source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.reader, self.form = pa.ipc.open_file(self.source), form
        self.at, self.held = -1, (np.empty(0), np.empty(0))

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k != self.at:
            b = self.reader.get_batch(k)
            self.at, self.held = k, tuple(b.column(c).flatten().to_numpy(zero_copy_only=True) for c in (0, 1))
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The i-th sequence and its mask: views of the file's bytes."""
        (tokens, mask), k, n = self._batch(i // self.form.batch), i % self.form.batch, self.form.sequence
        return tokens[k * n : (k + 1) * n], mask[k * n : (k + 1) * n].view(bool)

    def tokens(self, start: int, n: int) -> np.ndarray:
        full, parts = self.form.sequence * self.form.batch, []
        while n > 0:
            part = self._batch(start // full)[0][start % full :][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * self.form.batch + self.reader.get_batch(n - 1).num_rows

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, folder: str, form: Format, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into `folder`, which executors and driver share, and returns their manifest, itself written."""
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @functools.partial(tidy, keep=Encoder.KEPT)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        name, writer, ids, sizes, encoder = f"part-{part:06d}-{uuid.uuid4().hex}", None, [], [], Encoder.of(form)
        for b in batches:
            if writer is None and b.num_rows:
                system.create_dir(base, recursive=True)
                sink = system.open_output_stream(f"{base}/{name}.arrow")
                writer = SequenceWriter(sink, encoder.kind, form)
            at, raw = utf8(b["text"])
            for i, j in runs(at, CHUNK):
                for got in encoder.encode([raw[x:y].tobytes() for x, y in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]):
                    writer.add(got)
                    sizes.append(len(got) // encoder.kind.itemsize)
            ids.append(b["doc_id"])
        if writer is None:
            return
        writer.close()
        sink.close()
        n = np.array(sizes, np.int64)
        with system.open_output_stream(f"{base}/{name}.index") as side, pa.ipc.new_file(side, INDEX) as out:
            out.write_table(pa.table([pa.chunked_array(ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)], schema=INDEX))
        row = {"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(n)], "n_tokens": [int(n.sum())]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # rows of one id, or without any, are told apart by a hash of their texts, so that they needn't be one range
    dealt = wanted.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    return materialize(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, form: Format) -> DataFrame:
    """doc_id, start over all files, n_tokens and ids_crc32 of each document, from the files.

    The manifest has a row for each file, not for each document; the driver adds up its offsets.
    """
    spark, at, files = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((r.path, at))
        at += r.n_tokens

    @functools.partial(tidy, keep=Encoder.KEPT)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                system, plain = filesystem(f"{path}.index")
                with system.open_input_file(plain) as side:
                    index = pa.ipc.open_file(side).read_all().combine_chunks()
                held = SequenceFile(f"{path}.arrow", form)
                start, n = (index[c].to_numpy() for c in ("start", "n_tokens"))
                crc = [zlib.crc32(held.tokens(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                held.close()
                made = pa.table({"doc_id": index["doc_id"], "start": start + base, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})
                yield from made.to_batches(max_chunksize=20_000)

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_format() -> Format:
    import public_tokenizers

    return Format(public_tokenizers.path("word_bpe_49k.json"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = default_format()
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), form), form)


def brute_force(docs: list[tuple[int, str | None]], form: Format) -> dict[int, tuple[int, int, int]]:
    """(start, n_tokens, ids_crc32) by document, each whole text encoded by itself."""
    from tokenizers import Tokenizer

    model, at, out = Tokenizer.from_file(form.tokenizer), 0, {}
    for d, t in sorted(docs):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, form.end_id]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out
