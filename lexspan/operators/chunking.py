"""Units of documents into chunks: by structure, as projections and array folds, or of a fixed size with overlap (see
fixed.py).

Units have doc_id, unit_idx (their order in the document), doc_title, article_no, chapter, text and provenance.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import article_label, chunk_id, header, strip
from lexspan.operators import fixed
from lexspan.operators.lexical import TEXT, spans

PROVENANCE = ("source_path", "source_url", "last_amended", "effective_date")
MAX_CHARS, CHUNK_SIZE, OVERLAP = 1000, 400, 80


def sentences(text: Column, limit: int) -> Column:
    """Pieces that end after a sentence mark or line end. A blank piece goes with the one before, or is dropped if there is
    none; a longer piece than the limit is cut."""
    # not where only blanks follow up to a line end or the text's: those go with what is before; blanks that begin a text are a piece of their own
    pieces = F.split(text, r"(?<=[。！？；\n])(?!(?U:[^\S\n]*)(?:\n|\z))")
    glued = F.filter(pieces, lambda p: strip(p) != "")
    # what is glued on isn't cut: only a piece's own part counts
    own = lambda p: F.char_length(F.regexp_replace(p, r"(?<=[。！？；\n])(?U)\s+$", ""))
    cut = lambda p: F.when(own(p) <= limit, F.array(p)).otherwise(
        F.transform(F.sequence(F.lit(0), ((own(p) - 1) / limit).cast("int")), lambda i: F.when(i == ((own(p) - 1) / limit).cast("int"), F.substring(p, i * limit + 1, F.char_length(p))).otherwise(F.substring(p, i * limit + 1, F.lit(limit))))
    )
    return F.flatten(F.transform(glued, cut))


def packed(pieces: Column, limit: int) -> Column:
    """Pieces joined while they fit; stripped; empty ones dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    state = F.aggregate(
        pieces, start,
        lambda s, p: F.when(
            (s["open"] != "") & (F.char_length(s["open"]) + F.char_length(p) > limit),
            F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), p.alias("open")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["open"], p).alias("open"))),
        lambda s: F.concat(s["done"], F.array(s["open"])),
    )
    return F.filter(F.transform(state, strip), lambda p: p != "")


def structure_chunks(units: DataFrame, *, max_chars: int = MAX_CHARS) -> DataFrame:
    """A chunk for each unit; of a longer unit, for each pack of sentences. Sequence numbers run through the document."""
    parts = F.when(F.char_length("text") <= max_chars, F.array("text")).otherwise(packed(sentences(F.col("text"), max_chars), max_chars))
    each = units.select("*", F.posexplode(parts).alias("part", "content"))
    order = Window.partitionBy("doc_id").orderBy("unit_idx", "part")
    numbered = each.withColumn("seq", F.row_number().over(order) - 1)
    articles = F.when(F.col("article_no") != "", F.array("article_no")).otherwise(F.array().cast("array<string>"))
    return _chunks(numbered.withColumn("articles", articles), "s", header(F.col("doc_title"), F.col("chapter"), F.col("article_no")))


def _chunks(rows: DataFrame, kind: str, head: Column) -> DataFrame:
    return rows.select(
        chunk_id(F.col("doc_id"), kind, F.col("seq")).alias("chunk_id"), F.concat(head, F.lit("\n"), F.col("content")).alias("text"), "content",
        "doc_id", "doc_title", "articles", article_label(F.col("articles")).alias("article_label"), "chapter", "seq", *(c for c in PROVENANCE if c in rows.columns),
    )


def fixed_chunks_by_blocks(units: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP, block: int = fixed.BLOCK) -> DataFrame:
    """The rows of fixed_chunks() for documents of any length, each cut by many tasks (see fixed.py)."""
    each = units.select("doc_id", "unit_idx", "doc_title", "article_no", "chapter", *PROVENANCE, F.posexplode(sentences(F.col("text"), size)).alias("part", "sentence"))
    rows = fixed.cut(each, size=size, overlap=overlap, carried=("chapter", *PROVENANCE), block=block)
    return _chunks(rows, "f", F.col("doc_title"))


def fixed_chunks(units: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sentences of a document packed up to `size`; the next chunk begins with the last whole sentences of `overlap` or more.

    What a chunk takes depends on the one before, so a document is a fold; documents are dealt over the cluster, sorted, and
    each streams through its task with no more than a chunk of it held.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    each = units.select("doc_id", "unit_idx", "doc_title", "article_no", "chapter", *PROVENANCE, F.posexplode(sentences(F.col("text"), size)).alias("part", "sentence"))
    dealt = each.repartition("doc_id").sortWithinPartitions("doc_id", "unit_idx", "part")
    kind = units.schema["doc_id"].dataType.simpleString()
    made = "doc_id {0}, doc_title string, articles array<string>, chapter string, seq int, content string, {1}".format(kind, ", ".join(f"{c} string" for c in PROVENANCE))
    names = ["doc_id", "doc_title", "articles", "chapter", "seq", "content", *PROVENANCE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, title, seq, held, fresh = object(), "", 0, [], 0

        def made_of() -> dict | None:
            body = "".join(r.sentence for r in held).strip()
            if not body:
                return None
            articles = list(dict.fromkeys(r.article_no for r in held if r.article_no))
            return dict(zip(names, [doc, title, articles, held[0].chapter, seq, body, *(getattr(held[0], c) for c in PROVENANCE)], strict=True))

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.doc_id != doc:
                    if fresh and (row := made_of()):
                        out.append(row)
                    doc, title, seq, held, fresh = r.doc_id, r.doc_title, 0, [], 0
                elif fresh and sum(len(x.sentence) for x in held) + len(r.sentence) > size:
                    if row := made_of():
                        out.append(row)
                        seq += 1
                    tail, total = len(held), 0
                    while tail and total < overlap:
                        tail -= 1
                        total += len(held[tail].sentence)
                    held, fresh = held[tail:], 0
                held.append(r)
                fresh += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if fresh and (row := made_of()):
            yield pd.DataFrame([row], columns=names)

    rows = dealt.mapInPandas(run, made)
    return _chunks(rows, "f", F.col("doc_title"))


def chunked(units: DataFrame, strategy: str, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    if strategy == "structure":
        return structure_chunks(units)
    if strategy == "fixed":
        return fixed_chunks(units, size=size, overlap=overlap)
    raise ValueError(f"unknown chunking strategy: {strategy}")


#: White space as strip() sees it, and what sentences() looks for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = re.compile("[。！？；\n]")
_BREAK = re.compile(f"(?<=[。！？；\n])(?![{WHITE.replace(chr(10), '')}]*(?:\n|\\Z))")
_GLUED = re.compile(f"(?<=[。！？；\n])[{WHITE}]+\\Z")


def sentence_list(text: str, limit: int) -> list[str]:
    """sentences() of one text, as a task cuts them."""
    out = []
    for p in _BREAK.split(text) if _MARK.search(text) else [text]:
        if not p.strip(WHITE):
            continue
        glued = _GLUED.search(p) if p[-1] in WHITE else None
        last = (max(1, glued.start() if glued else len(p)) - 1) // limit
        out += [p[i * limit : (i + 1) * limit] for i in range(last)]
        out.append(p[last * limit :])
    return out


def packed_list(pieces: list[str], limit: int) -> list[str]:
    """packed() of pieces."""
    packs, size = [[]], 0
    for p in pieces:
        if size and size + len(p) > limit:
            packs.append([])
            size = 0
        packs[-1].append(p)
        size += len(p)
    return [s for pack in packs if (s := "".join(pack).strip(WHITE))]


def fixed_list(sentences: list[str], size: int, overlap: int) -> list[str]:
    """The contents of fixed_chunks() of a document's sentences."""
    out, held, total, fresh = [], [], 0, 0
    for s in sentences:
        if fresh and total + len(s) > size:
            out.append("".join(held))
            first, total = len(held), 0
            while first and total < overlap:
                first -= 1
                total += len(held[first])
            held, fresh = held[first:], 0
        held.append(s)
        total += len(s)
        fresh += 1
    if fresh:
        out.append("".join(held))
    return [s for x in out if (s := x.strip())]


def line_chunks(docs: DataFrame, strategy: str, head: Callable[[str | None, int], str], *, max_chars: int = MAX_CHARS, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, doc_id and text of the chunks of documents (doc_id, doc_title, text) whose lines are their units. A row is a whole document of an
    id of its own, so that it is cut where it is read, without a shuffle. head: what stands above a unit's chunks, of the title and the line's number."""
    if strategy not in ("structure", "fixed"):
        raise ValueError(f"unknown chunking strategy: {strategy}")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")

    def cut(title: str | None, text: str) -> list[str | None]:
        if strategy == "fixed":
            bodies = fixed_list([s for line in text.split("\n") for s in sentence_list(line, size)], size, overlap)
            return [None if title is None else f"{title}\n{b}" for b in bodies]
        out = []
        for i, line in enumerate(text.split("\n")):
            if line:
                above = head(title, i)
                out += [f"{above}\n{b}" for b in ([line] if len(line) <= max_chars else packed_list(sentence_list(line, max_chars), max_chars))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
            for lo, hi in spans(held, len(held), TEXT):
                ids, docs, texts = [], [], []
                for doc, title, text in zip(*(batch[c].slice(lo, hi - lo).to_pylist() for c in ("doc_id", "doc_title", "text")), strict=True):
                    made = cut(title, text or "")
                    name = f"{'null' if doc is None else doc}#{strategy[0]}"
                    ids += [f"{name}{i:04d}" for i in range(len(made))]
                    docs += [doc] * len(made)
                    texts += made
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, docs, texts)], names=["chunk_id", "doc_id", "text"])

    return docs.select("doc_id", "doc_title", "text").mapInArrow(run, "chunk_id string, doc_id string, text string")


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    n = F.char_length("content")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"))
