"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark items scans each document once; hits
are mapped back to offsets in the original text.

The automaton's letters are words, numbered by the items' vocabulary. An item is cut into pieces of half a window, one after the
other: whatever window of the item a document holds, there is a whole piece in it. Where a piece is found, the words on its
two sides are compared with the item's; a common run of a window's length or more is a hit. So the automaton has about one node for
each benchmark word, not one for each letter of all windows. An item of a window's length or less is a pattern as a whole.

Defined results. Null or empty text: no words, nothing hit, clean. An item without words has no window. Repeated items
and repeated documents: each row is judged by itself, and items that share a window all count. An item without an id
hits words but isn't counted or listed. An empty benchmark leaves every document clean. Only the id and text columns
are read, and the columns named in `keep`; others, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.common import arrow_schema, batch, carried, materialize, table, text_slices, tidy

WINDOW = 13
#: A document is contaminated from one hit word in so many on.
ONE_IN = 20
#: Bytes of benchmark text in one automaton, which goes to every executor and takes about 20 times that there. A larger benchmark is
#: scanned in blocks.
BLOCK_BYTES = 4 << 20

#: A-Z to a-z; every other ASCII byte that isn't a letter or digit to a space; bytes from 128 on stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Key of a row where documents are scanned in blocks.
ROW = "row key"

RESULT = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


@dataclass
class Patterns:
    """Distinct items as word numbers, with the ids of each, and where each piece comes from: (item, place of its first word)."""

    width: int = WINDOW
    numbers: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)
    owners: list[list[str]] = field(default_factory=list)
    pieces: dict[tuple[int, ...], list[tuple[int, int]]] = field(default_factory=dict)

    def add(self, rows: Iterable[tuple[str | None, bytes]]) -> Patterns:
        known: dict[bytes, int] = {}
        half = (self.width + 1) // 2
        for item, raw in rows:
            if not (w := words(raw)):
                continue
            ids = np.array([self.numbers.setdefault(x, len(self.numbers) + 1) for x in w], np.int32)
            if (k := known.setdefault(ids.tobytes(), len(self.items))) == len(self.items):
                self.items.append(ids)
                self.owners.append([])
                size = half if len(ids) > self.width else len(ids)
                for at in range(0, len(ids) - size + 1, size):
                    self.pieces.setdefault(tuple(ids[at : at + size].tolist()), []).append((k, at))
            if item is not None:
                self.owners[k].append(item)
        return self

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in self.pieces.items():
            made.add_word(key, (len(key), places))
        if self.pieces:
            made.make_automaton()
        return made


def _char_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """The runs of hit words as half-open ranges of code points of the original text."""
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    is_word = np.concatenate(([False], np.frombuffer(raw.translate(_FOLD), np.uint8) != 32, [False]))
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edge[::2], edge[1::2]
    first = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    last = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
    return [(int(lead[starts[a]]), int(lead[ends[b]])) for a, b in zip(first, last, strict=True)]


def _run(text: np.ndarray, item: np.ndarray, at: int, place: int, size: int) -> tuple[int, int]:
    """The common run of text and item around `size` words that stand at `at` and `place`, as places in the text."""
    before, after = min(at, place), min(len(text) - at, len(item) - place)
    left = text[at - before : at] != item[place - before : place]
    right = text[at + size : at + after] != item[place + size : place + after]
    first = at - (before if not left.any() else int(np.argmax(left[::-1])))
    return first, at + size + (after - size if not right.any() else int(np.argmax(right)))


def scan(raw: bytes, patterns: Patterns, automaton) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, which of them are hit (None: none), ids of the items hit."""
    w = words(raw)
    if not w or not len(automaton):
        return len(w), None, set()
    get = patterns.numbers.get
    ids = tuple([get(x, 0) for x in w])
    hits = [(end - size + 1, size, places) for end, (size, places) in automaton.iter(ids)]
    if not hits:
        return len(w), None, set()
    text, change, found, done = np.array(ids, np.int32), np.zeros(len(w) + 1, np.int64), set(), set()
    for at, size, places in hits:
        for k, place in places:
            # a run is met once for each of its pieces
            if (k, at - place, at) in done:
                continue
            item = patterns.items[k]
            first, last = _run(text, item, at, place, size)
            done.update((k, at - place, x) for x in range(at, last, size))
            if last - first >= min(patterns.width, len(item)):
                change[first] += 1
                change[last] -= 1
                found.update(patterns.owners[k])
    hit = np.cumsum(change[:-1]) > 0
    return len(w), hit if hit.any() else None, found


def _scan_block(docs: DataFrame, patterns: Patterns, id_col: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    fields = [docs.schema[id_col], *carried(docs, keep, [id_col, *(f.name for f in RESULT)]), *RESULT]
    schema, sent = arrow_schema(fields), docs.sparkSession.sparkContext.broadcast(patterns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        automaton = patterns.automaton()
        for b in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for raw in text_slices(b[text_col]):
                n, hit, owners = scan(raw, patterns, automaton)
                n_words.append(n)
                n_hit.append(0 if hit is None else int(hit.sum()))
                items.append(sorted(owners))
                spans.append([] if hit is None else [{"start": x, "end": y} for x, y in _char_spans(raw, hit)])
            yield batch([b[id_col], *(b[c] for c in keep), n_words, n_hit, items, spans], schema)

    return docs.select(id_col, text_col, *(c for c in keep if c != text_col)).mapInArrow(run, T.StructType(fields))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", keep: Sequence[str] = (), width: int = WINDOW, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id, `keep`, n_words, n_hit, items (ids as strings, sorted), spans (code points) and contaminated of each document.

    The benchmark's size is measured first. Up to `block_bytes` one automaton serves all; beyond, the items are dealt
    into blocks of that size by hash, each block scans a copy of the documents with a key for each row, and the spans are
    merged by that key.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1

    def read(k: int) -> Patterns:
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        return Patterns(width).add((r.item, (r.text or "").encode()) for r in rows.toLocalIterator())

    if blocks == 1:
        found = _scan_block(docs, read(0), id_col, text_col, keep)
    else:
        carried(docs, keep, [id_col, *(f.name for f in RESULT)])  # before any work: clashes are errors
        only = docs.select(*(F.col(c).alias(f"_{c}") for c in dict.fromkeys([id_col, text_col, *keep])))
        keyed = materialize(only.withColumn(ROW, F.monotonically_increasing_id()), "keyed-docs")  # written: every scan sees the same keys
        found = _merged([_scan_block(keyed, read(k), ROW, f"_{text_col}", ()) for k in range(blocks)], keyed, docs, id_col, text_col, keep)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))


def _merged(parts: list[DataFrame], keyed: DataFrame, docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    """One row for each row of `keyed` (docs' columns with a leading "_", and ROW) out of one for each row and block."""
    spans = parts[0].select(ROW, "n_words", "items", "spans")
    for p in parts[1:]:
        spans = spans.unionByName(p.select(ROW, "n_words", "items", "spans"))
    joined = spans.groupBy(ROW).agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    both = keyed.join(joined, ROW)
    fields = [docs.schema[id_col], *carried(docs, keep, [id_col, *(f.name for f in RESULT)]), *RESULT]
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, spans = [], []
            for raw, own in zip(text_slices(b[f"_{text_col}"]), b["spans"].to_pylist(), strict=True):
                merged: list[dict[str, int]] = []
                for s in own or []:
                    if merged and not _has_word(raw, merged[-1]["end"], s["start"]):
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                text = raw.decode("utf-8", "replace")
                n_hit.append(sum(len(words(text[s["start"] : s["end"]].encode())) for s in merged))
                spans.append(merged)
            yield batch([b[f"_{id_col}"], *(b[f"_{c}"] for c in keep), b["n_words"], n_hit, b["items"], spans], schema)

    return both.mapInArrow(run, T.StructType(fields))


def _has_word(raw: bytes, a: int, b: int) -> bool:
    return a < b and bool(words(raw.decode("utf-8", "replace")[a:b].encode()))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = WINDOW) -> dict:
    """The contract word for word, for tests: (n_words, n_hit, sorted item ids, contaminated) by document."""
    import re

    lower = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    wins = [(i, w[k : k + width]) for i, t in items if (w := split(t)) for k in range(max(1, len(w) - width + 1))]
    out = {}
    for d, t in docs:
        w = split(t)
        hit, who = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    who.add(str(i))
        out[d] = (len(w), len(hit), sorted(who), bool(hit) and 20 * len(hit) >= len(w))
    return out


def items_digest(ids: Sequence[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


#: DuckDB SQL for op2_decontaminate.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     bw AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + 12), ' ') AS s FROM bw),
     sizes AS (SELECT DISTINCT n FROM win),
     dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
     hit AS (SELECT doc_id, k, win.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.s = array_to_string(list_slice(dw.w, k, k + dw.n - 1), ' ')),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
     own AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
             FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""
