"""Chunks of a fixed size with overlap, of documents of any length, each cut by many tasks.

A chunk takes sentences while they fit, one new one at least; the next begins with the last sentences of the overlap. So a chunk is
told by its first new sentence f: it starts at the sentence in which the overlap before f begins, and ends before the sentence in which
the size is reached. Running lengths place every sentence of a document, and both are found by bisection of them.

Documents are dealt in order by ranges, and running lengths are added up task by task. Then each document is dealt into blocks of
BLOCK characters, with the sentences on their two sides that chunks of the block reach. A document's first block is cut at once. Every
other block says for each sentence where a chain of chunks that enters there leaves the block; pointers from block to block are
doubled until the entries that the document's beginning reaches are known, and then those blocks are cut.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.scratch import materialize

#: Characters of a document in a block.
BLOCK = 1 << 15
_DOC, _OWN = "doc_id", "_own"


def cut(sentences: DataFrame, *, size: int, overlap: int, carried: Sequence[str], block: int = BLOCK) -> DataFrame:
    """doc_id, doc_title, articles, seq, content, and the carried columns of each chunk's first sentence; chunks of blanks alone are left
    out. sentences: doc_id, unit_idx, part (their order), sentence, doc_title, article_no and the carried columns."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    block = max(block, 2 * size)
    placed = _placed(sentences)
    # a sentence longer than the size is followed by one that lies beyond it, wherever that is
    low, high = F.floor((F.col("_at") - F.greatest(F.lit(size), "_prev")) / block), F.floor((F.col("_at") + F.col("_len") - 1 + overlap) / block)
    # a block has the sentences that begin in it, and those around it that its chunks reach
    spread = placed.withColumn("_block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high))).withColumn(_OWN, F.col("_block") == F.floor(F.col("_at") / block))
    made = materialize(_dealt(spread).mapInArrow(_first(size, overlap, carried), _result(sentences, carried)), "fixed-chunks")
    chunks = made.where("_to IS NULL").drop("_to", "_from", "_n")
    # what follows are only documents of several blocks
    starts = made.where("_to IS NOT NULL AND _block = 0").select(_DOC, F.col("_to").alias("_from"), F.col("_n"))
    entries = made.where("_to IS NOT NULL AND _block > 0").select(_DOC, "_block", "_from", "_to")
    if starts.isEmpty():
        return chunks.drop("_block")
    reached = _reached(starts.select(_DOC, "_from"), entries)
    own = spread.where("_block > 0")
    rest = own.join(reached.select(F.col(_DOC).alias("_d"), F.col("_block").alias("_b"), F.col("_from").alias("_entry")), F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_b"))).drop("_d", "_b")
    later = materialize(_dealt(rest).mapInArrow(_later(size, overlap, carried), _result(sentences, carried)), "fixed-chunks")
    counts = starts.select(_DOC, F.lit(0).cast("long").alias("_block"), "_n").unionByName(later.where("_to IS NOT NULL").select(_DOC, "_block", "_n"))
    before = F.sum("_n").over(Window.partitionBy(_DOC).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col(_DOC).alias("_d"), F.col("_block").alias("_b"), before.alias("_base")).where("_b > 0")
    more = later.where("_to IS NULL").drop("_to", "_from", "_n").join(bases, F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_b")))
    return chunks.unionByName(more.withColumn("seq", (F.col("seq") + F.col("_base")).cast("int")).drop("_d", "_b", "_base")).drop("_block")


def _placed(sentences: DataFrame) -> DataFrame:
    """sentences with _i, their number in the document, _at, the characters before them, _len and _prev, the length of the one before."""
    ordered = sentences.withColumn("_len", F.char_length("sentence").cast("long")).repartitionByRange(_DOC, "unit_idx", "part").sortWithinPartitions(_DOC, "unit_idx", "part")
    long = [T.StructField(c, T.LongType()) for c in ("_task", "_i", "_at", "_prev")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, doc, i, at, last = TaskContext.get().partitionId(), object(), 0, 0, 0
        for b in batches:
            numbers, places, lengths = [], [], []
            for d, n in zip(b[_DOC].to_pylist(), b["_len"].to_pylist(), strict=True):
                if d != doc:
                    doc, i, at, last = d, 0, 0, 0
                numbers.append(i)
                places.append(at)
                lengths.append(last)
                i, at, last = i + 1, at + n, n
            more = [pa.repeat(pa.scalar(task, pa.int64()), b.num_rows), *(pa.array(x, pa.int64()) for x in (numbers, places, lengths))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(f.name for f in long)])

    rows = materialize(ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, *long])), "fixed-sentences")
    sums = rows.groupBy(_DOC, "_task").agg(F.count("*").alias("_n"), F.sum("_len").alias("_s"), F.max_by("_len", "_i").alias("_l"))
    earlier = Window.partitionBy(_DOC).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col(_DOC).alias("_d"), F.col("_task").alias("_t"), F.sum("_n").over(earlier).alias("_bn"), F.sum("_s").over(earlier).alias("_bs"), F.last("_l").over(earlier).alias("_bl")).where("_bn IS NOT NULL")
    # a task has one document at most that began in an earlier one: these are no more than there are tasks
    joined = rows.join(F.broadcast(bases), F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("_task") == F.col("_t")), "left")
    moved = {"_i": F.col("_i") + F.coalesce("_bn", F.lit(0)), "_at": F.col("_at") + F.coalesce("_bs", F.lit(0)), "_prev": F.when(F.col("_i") > 0, F.col("_prev")).otherwise(F.coalesce("_bl", "_prev"))}
    return joined.withColumns(moved).drop("_d", "_t", "_bn", "_bs", "_bl", "_task")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(_DOC, "_block").sortWithinPartitions(_DOC, "_block", "_i")


def _result(sentences: DataFrame, carried: Sequence[str]) -> T.StructType:
    long = lambda c: T.StructField(c, T.LongType())
    return T.StructType([
        sentences.schema[_DOC], long("_block"), T.StructField("doc_title", T.StringType()), T.StructField("articles", T.ArrayType(T.StringType())), T.StructField("seq", T.IntegerType()),
        T.StructField("content", T.StringType()), *(T.StructField(c, T.StringType()) for c in carried), long("_from"), long("_to"), long("_n"),
    ])


class Block:
    """The sentences of one document's block, and those around it."""

    def __init__(self, rows: pa.Table, size: int, overlap: int, carried: Sequence[str]):
        get = lambda c: rows[c].to_pylist()
        self.rows, self.size, self.overlap, self.carried = rows, size, overlap, carried
        self.i, self.at, self.len, own = get("_i"), get("_at"), get("_len"), get(_OWN)
        self.first = own.index(True) if True in own else len(own)
        self.end = len(own) - own[::-1].index(True) if True in own else self.first
        self.text, self.article = get("sentence"), get("article_no")

    def start(self, f: int) -> int:
        """The place here of the first sentence of the chunk whose first new one is at place f."""
        return f if not self.i[f] else max(0, bisect_right(self.at, max(0, self.at[f] - self.overlap)) - 1)

    def next(self, f: int) -> int:
        """The place here of the next chunk's first new sentence; the number of sentences at the document's end."""
        limit = self.at[self.start(f)] + self.size
        k = bisect_right(self.at, limit) - 1
        return max(f + 1, k + (limit >= self.at[k] + self.len[k]))

    def chunks(self, f: int) -> tuple[list[dict], int]:
        """The chunks of a chain that enters at place f, and where it leaves the block."""
        out = []
        while f < self.end:
            s, e = self.start(f), self.next(f)
            if body := "".join(self.text[s:e]).strip():
                articles = list(dict.fromkeys(a for a in self.article[s:e] if a))
                out.append({"articles": articles, "seq": len(out), "content": body} | {c: self.rows[c][s].as_py() for c in self.carried} | {"doc_title": self.rows["doc_title"][s].as_py()})
            f = e
        return out, f

    def exits(self) -> list[tuple[int, int]]:
        """(sentence, the first new sentence beyond the block, -1 if there is none) of the sentences at which chains can enter."""
        near = bisect_right(self.at, self.at[self.first] + 2 * self.size, self.first, self.end)
        to = np.empty(self.end, np.int64)
        for f in range(self.end - 1, self.first - 1, -1):
            n = self.next(f)
            to[f] = n if n >= self.end else to[n]
        return [(self.i[f], self.i[to[f]] if to[f] < len(self.i) else -1) for f in range(self.first, max(near, self.first + 1))]


def _blocks(batches: Iterator[pa.RecordBatch], size: int, overlap: int, carried: Sequence[str], more: str | None = None) -> Iterator[tuple]:
    """doc_id, block number, Block and the value of the column `more`, of rows that come in this order."""
    held: list[pa.RecordBatch] = []
    key = None

    def done():
        whole = pa.Table.from_batches(held)
        return *key, Block(whole, size, overlap, carried), whole[more][0].as_py() if more else None

    for b in batches:
        keys, at = list(zip(b[_DOC].to_pylist(), b["_block"].to_pylist(), strict=True)), 0
        for i, k in enumerate(keys):
            if held and k != key and i == 0:
                yield done()
                held.clear()
            elif i and k != keys[i - 1]:
                held.append(b.slice(at, i - at))
                yield done()
                held.clear()
                at = i
            key = k
        if keys:
            held.append(b.slice(at))
    if held:
        yield done()


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(b: pa.Schema, carried: Sequence[str]) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    return pa.schema([
        (_DOC, b.field(_DOC).type), ("_block", long), ("doc_title", text), ("articles", pa.list_(text)), ("seq", pa.int32()), ("content", text), *((c, text) for c in carried), ("_from", long), ("_to", long), ("_n", long)
    ])


def _emit(found: Iterator[tuple], carried: Sequence[str], turn) -> Iterator[pa.RecordBatch]:
    rows, schema = [], None
    for doc, number, block, more in found:
        schema = schema or _schema(block.rows.schema, carried)
        rows += [{_DOC: doc, "_block": number} | r for r in turn(number, block, more)]
        if len(rows) >= 2000:
            yield _table(rows, schema)
            rows = []
    if rows:
        yield _table(rows, schema)


def _first(size: int, overlap: int, carried: Sequence[str]):
    """Chunks of a document's first block and, if the document goes on, where to (_to) after how many (_n); for other blocks, _from and _to."""

    def turn(number: int, block: Block, _) -> list[dict]:
        if block.first == block.end:
            return []
        if number:
            return [{"_from": a, "_to": b} for a, b in block.exits()]
        chunks, out = block.chunks(block.first)
        return chunks + ([{"_to": block.i[out], "_n": len(chunks)}] if out < len(block.i) else [])

    return lambda batches: _emit(_blocks(batches, size, overlap, carried), carried, turn)


def _later(size: int, overlap: int, carried: Sequence[str]):
    """Chunks of a block from its entry on, and how many (_n)."""

    def turn(_, block: Block, entry: int) -> list[dict]:
        chunks, out = block.chunks(block.i.index(entry))
        return [*chunks, {"_to": out, "_n": len(chunks)}]

    return lambda batches: _emit(_blocks(batches, size, overlap, carried, "_entry"), carried, turn)


def _reached(starts: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, _block and _from of the entries that chains from `starts` come through. Each round doubles how far pointers reach."""
    jump = entries.select(_DOC, "_from", "_to")
    at = lambda df, *names: df.select(F.col(_DOC).alias("_d"), *(F.col(a).alias(b) for a, b in names))
    seen = materialize(starts.where("_from >= 0"), "fixed-reached")
    while True:
        step = at(jump, ("_from", "_f"), ("_to", "_next"))
        ahead = seen.join(step, F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("_from") == F.col("_f"))).select(_DOC, F.col("_next").alias("_from"))
        more = materialize(seen.unionByName(ahead).distinct(), "fixed-reached")
        same = more.count() == seen.count()
        seen = more
        if same:
            break
        jump = materialize(jump.join(step, F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("_to") == F.col("_f"))).select(_DOC, "_from", F.col("_next").alias("_to")), "fixed-jumps")
    own = at(seen, ("_from", "_f"))
    placed = entries.select(_DOC, "_block", "_from")
    return placed.join(own, F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("_from") == F.col("_f"))).drop("_d", "_f")
