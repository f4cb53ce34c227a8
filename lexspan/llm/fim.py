"""Fill-in-middle transformation: documents cut in three at unit borders and put together with sentinels, and taken apart again.

One Aho-Corasick automaton of the ASCII characters at which the class of a character can change (the line end; white space) and of
the sentinels goes over a text once. Its hits are the only places that are looked at: what lies between two of them gives its
units by arithmetic, so the k-th unit's end is a lookup among hits. The same automaton finds the sentinels of an output, from which
the text is rebuilt.

Units: `line` is a line with its end; `word` is a run of characters other than ASCII white space with the white space behind it,
white space that begins the text being a unit of its own; `char` is a code point. Where to cut and in which form follow from
numbers that Spark takes from a hash of a seed and the document's id, so reruns agree, and rows of one id are cut alike.

Defined results. Null text: ''. An empty text, and one with a sentinel in it, stays plain. A null id counts as ''. Repeated rows each
give a row. No documents: no rows. Columns named in `keep` are carried along; others, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.common import arrow_schema, batch, carried, table, tidy

WHITE = " \t\n\x0b\x0c\r"
#: Characters at which units can end.
EVENTS = {"line": "\n", "word": WHITE, "char": ""}


@dataclass(frozen=True)
class Form:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"
    seed: int = 7
    #: Percent of documents that are transformed, and of those in the order suffix, prefix, middle.
    rate: int = 100
    spm: int = 50

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        inner = any(m[0] in x[1:] for m in marks for x in marks) if all(marks) else True
        if self.unit not in EVENTS or inner or any(a.startswith(b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j) or set("".join(marks)) & set(WHITE):
            raise ValueError("units are line, word or char; sentinels hold no white space, none begins another, and a first character stands nowhere else in them")


class Scanner:
    """The automaton, and what its hits say."""

    def __init__(self, form: Form):
        import ahocorasick

        self.form, self.automaton = form, ahocorasick.Automaton()
        for c in EVENTS[form.unit]:
            self.automaton.add_word(c, 0)
        for m in (form.prefix, form.suffix, form.middle):
            self.automaton.add_word(m, len(m))
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The last place of each hit, and its sentinel's length (0: a character)."""
        found = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def ends(self, at: np.ndarray, length: int) -> np.ndarray | None:
        """Where units end, in order, from the places of unit characters; None: each place is an end."""
        if self.form.unit == "char":
            return None
        if self.form.unit == "word":  # white space ends a unit unless more of it follows
            at = at[np.flatnonzero(np.diff(at, append=-1) != 1)]
        at = at + 1
        return at if len(at) and at[-1] == length else np.append(at, length) if length else at

    def split(self, text: str, h1: int, h2: int) -> tuple[int, int, int, bool]:
        """Units, places of the two cuts, and whether a sentinel is in the text."""
        last, size = self.events(text)
        ends = self.ends(last[size == 0], len(text))
        n = len(text) if ends is None else len(ends)
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        places = cuts if ends is None else [int(ends[k - 1]) if k else 0 for k in cuts]
        return n, *places, bool((size > 0).any())

    def join(self, text: str, a: int, b: int, form: str) -> str:
        f = self.form
        if form == "plain":
            return text
        return f"{f.prefix}{text[:a]}{f.suffix}{text[b:]}{f.middle}{text[a:b]}" if form == "psm" else f"{f.suffix}{text[b:]}{f.prefix}{text[:a]}{f.middle}{text[a:b]}"

    def restore(self, output: str, form: str) -> str:
        if form == "plain":
            return output
        last, size = self.events(output)
        last, size = last[size > 0], size[size > 0]
        if len(last) != 3 or last[0] + 1 != size[0]:
            raise ValueError("an output that isn't plain has each sentinel once, one of them first")
        starts, ends = last + 1, [*(last - size + 1)[1:], len(output)]
        first, second, middle = (output[a:b] for a, b in zip(starts.tolist(), map(int, ends), strict=True))
        return first + middle + second if form == "psm" else second + middle + first


#: What transform() adds.
MADE = (
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
)


def numbers(id_col: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of `seed:id`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, form: Form = Form(), *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The id, the columns to keep, and MADE: number of units, plain, psm or spm, code points of prefix and middle (null if plain), output."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *carried(docs, keep, [f.name for f in MADE]), *MADE]
    h = numbers(F.col(id_col), form.seed)
    plain = h[2] % 100 >= form.rate
    wanted = docs.select(
        *(F.col(f.name).alias(f"_{i}") for i, f in enumerate(fields[: -len(MADE)])), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h[0].alias("h1"), h[1].alias("h2"),
        F.when(plain, "plain").when(h[3] % 100 < form.spm, "spm").otherwise("psm").alias("drawn"),
    )
    schema, carries = arrow_schema(fields), len(fields) - len(MADE)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(form)
        for b in batches:
            rows = []
            for text, h1, h2, drawn in zip(b["text"], *(b[c].to_pylist() for c in ("h1", "h2", "drawn")), strict=True):
                text = text.as_py()
                n, at, to, marked = scanner.split(text, h1, h2)
                kind = "plain" if marked or not text else drawn
                cut = (None, None) if kind == "plain" else (at, to - at)
                rows.append((n, kind, *cut, scanner.join(text, at, to, kind)))
            made = list(zip(*rows, strict=True)) if rows else [()] * len(MADE)
            yield batch([*(b[f"_{i}"] for i in range(carries)), *made], schema)

    return wanted.mapInArrow(run, T.StructType(fields))


def restore(made: DataFrame, form: Form = Form()) -> DataFrame:
    """transform()'s rows with `restored`, the text rebuilt from output and form alone."""
    fields = [*made.schema.fields, T.StructField("restored", T.StringType())]
    schema = arrow_schema(fields)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(form)
        for b in batches:
            texts = [scanner.restore(o.as_py(), k.as_py()) for o, k in zip(b["output"], b["form"], strict=True)]
            yield batch([*b.columns, texts], schema)

    return made.mapInArrow(run, T.StructType(fields))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore(transform(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


#: DuckDB SQL for op13_fim; what a text is restored to is the text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM d),
     c AS (SELECT *, len(lines) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS hs FROM l),
     p AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b FROM c),
     s AS (SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:n], '') AS suf,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain'
                       WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM s
"""
