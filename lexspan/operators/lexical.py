"""A lexical index as tables, and BM25 (Okapi) over whole batches of queries.

Only the terms that the queries have are counted by document; document frequencies, which the mean idf needs for all terms,
are counts of distinct terms that Spark adds up before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexspan.functions.text import word_tokens
from lexspan.functions.words import word_lists
from lexspan.scratch import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
FORMAT = "lexical-index-2"
#: Queries in a block; scores that a task holds at once; tokens, or pairs of a token and a query, that it takes up at once.
BLOCK, CELLS, EXPANDED = 2000, 1 << 20, 1 << 19
#: Bytes of text that a task takes up at once; terms whose counts it holds.
TEXT, TERMS = 1 << 21, 1 << 19


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """doc, tokens."""
    return docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("tokens"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl. docs: tokenized()."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequencies(df: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """term, df, idf. A term in more than half of the documents gets epsilon times the mean idf of all terms."""
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    scored = df.crossJoin(F.broadcast(stats.select("n_docs"))).withColumn("raw", raw)  # stats is one row
    mean = scored.agg(F.avg("raw").alias("mean"))
    return scored.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, doc, tf, dl; only of these terms, if given."""
    each = docs.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf of tokenized queries (doc is the qid)."""
    return queries.select(F.col("doc").alias("qid"), F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def token_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Parts of at most so many rows, how many tokens each row has, and all their tokens. Rows have tokens, or a text that is cut here."""
    for batch in batches:
        whole = "tokens" in batch.schema.names
        held = pc.fill_null(pc.list_value_length(batch["tokens"]) if whole else pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64)
        for lo, hi in spans(held, rows, EXPANDED if whole else TEXT):
            part = batch.slice(lo, hi - lo)
            yield part, *((held[lo:hi], part["tokens"].flatten()) if whole else word_lists(part["text"]))


def statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """document_frequencies() and corpus_stats() of docs (doc, tokens) or (doc, text), from one pass whose counts are written. Tasks add up
    what they count, TERMS terms at a time, so that no row for each document and term is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, docs, tokens = [], 0, 0, 0

        def added() -> pa.Table:
            return pa.Table.from_batches(held).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])

        def made(terms: pa.Table, docs: int | None = None, tokens: int | None = None) -> Iterator[pa.RecordBatch]:
            for b in terms.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([b["term"], b["df"], *(pa.array([x] * len(b), pa.int64()) for x in (docs, tokens))], names=["term", "df", "docs", "tokens"])

        for part, size, words in token_parts(batches, CELLS):
            docs, tokens = docs + len(part), tokens + int(size.sum())
            words = pc.cast(words, pa.string()).dictionary_encode()
            width = max(1, len(words.dictionary))
            pair = np.sort(np.repeat(np.arange(len(size)) * width, size) + words.indices.to_numpy())
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            held.append(pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(pair % width, minlength=len(words.dictionary)))], names=["term", "df"]))
            rows += len(words.dictionary)
            if rows > TERMS:
                held = added().to_batches()
                rows = sum(map(len, held))
                if rows > TERMS // 2:
                    yield from made(pa.Table.from_batches(held))
                    held, rows = [], 0
        if held:
            yield from made(added())
        yield from made(pa.table({"term": pa.array([None], pa.string()), "df": pa.array([None], pa.int64())}), docs, tokens)

    counts = docs.select("doc", "tokens" if "tokens" in docs.columns else "text").mapInArrow(run, "term string, df long, docs long, tokens long")
    known = materialize(counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "docs", "tokens"))), "statistics")
    whole = known.where("term IS NULL")
    stats = whole.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("tokens").cast("double"), F.sum("docs")).alias("avgdl"))
    return known.where("term IS NOT NULL").select("term", "df"), stats


def bm25(docs: DataFrame, queries: DataFrame, *, k: int = 20, k1: float = K1, b: float = B, epsilon: float = EPSILON, digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """qid, doc, score, rank of each query's k best documents of positive score; ties go to the smaller doc.

    docs: tokenized(), or doc and text, whose word_tokens() tasks then cut as they go; read twice, so that tokens that are costly to make are
    better written first. queries: a stated set, tokenized. Their terms' weights are sent in blocks of queries; a task scores batches of documents and keeps k for each query, so that
    what is shuffled is not a row for each document and query that share a term. digits: scores are rounded to so many before they are
    ranked, which makes ranks comparable between engines.
    """
    wanted = query_terms(queries)
    counts, stats = statistics(docs)
    known = inverse_frequencies(counts, stats, epsilon)
    weights = materialize(wanted.join(known, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")
    avgdl = stats.first().avgdl or 1.0
    kind = queries.schema["doc"].dataType
    parts = [_scored_block(docs, own, kind, avgdl, k, k1, b, digits) for own in in_blocks(weights, queries.count(), block)]
    return top_k(reduce(DataFrame.unionByName, parts), k)


class Block:
    """What a block of queries weighs (qid, term, weight), as it travels: of term t, queries and weights are at first[t] : first[t + 1]."""

    def __init__(self, weights: DataFrame):
        rows = weights.orderBy("term", "qid").collect()
        self.qids, self.terms = list(dict.fromkeys(r.qid for r in rows)), list(dict.fromkeys(r.term for r in rows))
        place = {q: i for i, q in enumerate(self.qids)}
        number = {x: i for i, x in enumerate(self.terms)}
        per = np.bincount([number[r.term] for r in rows], minlength=len(number)) if rows else np.empty(0, np.int64)
        self.query, self.weight = np.array([place[r.qid] for r in rows], np.int64), np.array([r.weight for r in rows], float)
        self.first = np.concatenate(([0], np.cumsum(per))).astype(np.int64)

    def matched(self, terms: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and place of those of the rows' terms (flat; row i has size[i]) that queries have."""
        found = pc.index_in(pc.cast(terms, pa.string()), value_set=pa.array(self.terms, pa.string()))
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return np.repeat(np.arange(len(size)), size)[at], found.drop_null().to_numpy().astype(np.int64), at

    def scores(self, n: int, row: np.ndarray, term: np.ndarray, share: np.ndarray, asked: np.ndarray | None = None, *, dense: bool = False) -> np.ndarray:
        """Of each query (row) and of n rows (column) the sum of weight * share; only where asked is true, if it is given. dense: terms of many
        queries go through a product of matrices, which may differ in the last bits from row to row."""
        out, per = np.zeros(len(self.qids) * n), self.first[term + 1] - self.first[term]
        if dense and (held := self._matrix()) is not None:
            place, matrix = held
            at = place[term]
            some = at >= 0
            shares = np.zeros((matrix.shape[1], n))
            shares[at[some], row[some]] = share[some]
            out = (matrix @ shares).reshape(-1)
            row, term, share, per = (x[~some] for x in (row, term, share, per))
        for lo, hi in spans(per, len(per), EXPANDED):
            r, s, m = row[lo:hi], share[lo:hi], per[lo:hi]
            j = np.repeat(self.first[term[lo:hi]] + m - np.cumsum(m), m) + np.arange(m.sum())
            r, s, q = np.repeat(r, m), np.repeat(s, m), self.query[j]
            if asked is not None:
                held = asked[q, r]
                r, s, q, j = r[held], s[held], q[held], j[held]
            out += np.bincount(q * n + r, self.weight[j] * s, len(out))
        return out.reshape(-1, n)

    def _matrix(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Of the terms that most queries have, as many as there are queries at most: each term's column, -1 without one, and the weights."""
        if not hasattr(self, "_made"):
            per, n = np.diff(self.first), len(self.qids)
            most = np.argsort(-per, kind="stable")[:n]
            most = most[per[most] >= max(8, n // 25)]
            place, matrix = np.full(len(per), -1), np.zeros((n, len(most)))
            for i, t in enumerate(most.tolist()):
                matrix[self.query[self.first[t] : self.first[t + 1]], i] = self.weight[self.first[t] : self.first[t + 1]]
            place[most] = np.arange(len(most))
            self._made = (place, matrix) if len(most) else None
        return self._made


def spans(size: np.ndarray, rows: int, items: int) -> Iterator[tuple[int, int]]:
    """Successive spans of at most so many rows and, unless a single row has more, items."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        before = ends[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(ends, before + items, side="right"))), lo + rows)
        yield lo, min(hi, len(size))
        lo = hi


class Best:
    """Each query's k best rows of all that a task sees, ties to the smaller doc, so that a task gives k a query whatever its batches are."""

    def __init__(self, n: int, k: int, digits: int | None, *, positive: bool = False):
        self.n, self.k, self.digits, self.positive = n, k, digits, positive
        self.floor, self.more = np.full(n, -np.inf), []
        self.count = 0

    def add(self, scores: np.ndarray, docs: pa.Array, asked: np.ndarray | None = None) -> None:
        """scores: a row for each query, a column for each of docs. Rounding comes after what can't be among the best is left out."""
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        least, new = self.floor.copy(), np.flatnonzero(np.isneginf(self.floor))
        if asked is None and scores.shape[1] > self.k and len(new):
            least[new] = np.partition(scores[new], -self.k, axis=1)[:, -self.k]
        least -= slack
        if self.positive:
            least = np.maximum(least, np.nextafter(0, 1))
        keep = scores >= least[:, None]
        if asked is not None:
            keep &= asked
        q, col = np.divmod(np.flatnonzero(keep), max(1, scores.shape[1]))
        s = scores[q, col]
        if self.digits is not None:
            s = np.round(s, self.digits) + 0.0
        if self.positive:
            q, col, s = q[s > 0], col[s > 0], s[s > 0]
        self.more.append((q, s, docs.take(pa.array(col))))
        self.count += len(q)
        if self.count > max(10_000, 2 * self.n * self.k) or len(new):
            self._cut()

    def _cut(self) -> None:
        if not self.more:
            return
        q, s = (np.concatenate([x[i] for x in self.more]) for i in (0, 1))
        table = pa.table({"q": q, "s": s, "doc": pa.chunked_array([x[2] for x in self.more])})
        order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("s", "descending"), ("doc", "ascending")], null_placement="at_start").to_numpy()
        sorted_q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(sorted_q, sorted_q) < self.k
        order = order[keep]
        q, s, doc = q[order], s[order], table["doc"].take(pa.array(order)).combine_chunks()
        full = np.flatnonzero(np.bincount(q, minlength=self.n) == self.k)
        self.floor[full] = s[np.searchsorted(q, full, side="right") - 1]
        self.more, self.count = [(q, s, doc)], 0

    def rows(self, qids: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self._cut()
        for q, s, doc in self.more:
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q.tolist()], kind), doc, pa.array(s)], names=["qid", "doc", "score"])


def best(scores: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of each row's k best, and whatever ties with the k-th."""
    if digits is not None:
        scores = np.round(scores, digits)
    keep = np.ones(scores.shape, bool)
    if scores.shape[1] > k:
        keep = scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(keep)
    return row, col, scores[row, col]


def counted(docs: DataFrame) -> DataFrame:
    """What docs have beside tokens, and of each row terms (distinct tokens), tfs and dl, made batch by batch without a shuffle."""
    others = [c for c in docs.columns if c != "tokens"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ["terms array<string>", "tfs array<int>", "dl bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy().astype(np.int64)
            for lo, hi in spans(sizes, len(sizes), EXPANDED):
                part, size = batch.slice(lo, hi - lo), sizes[lo:hi]
                words = pc.cast(part["tokens"].flatten(), pa.string()).dictionary_encode()
                width = max(1, len(words.dictionary))
                pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * width + words.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * width), pa.int32())
                made = [pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(pair % width))), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())), pa.array(size)]
                yield pa.RecordBatch.from_arrays([part[c] for c in others] + made, names=[*others, "terms", "tfs", "dl"])

    return docs.select(*others, "tokens").mapInArrow(run, schema)


def _scored_block(docs: DataFrame, weights: DataFrame, kind: T.DataType, avgdl: float, k: int, k1: float, b: float, digits: int | None) -> DataFrame:
    """docs: tokenized(), doc and text, or counted()."""
    sent, own_type = docs.sparkSession.sparkContext.broadcast(Block(weights)), to_arrow_type(kind)
    columns = next(c for c in (["tokens"], ["terms", "tfs", "dl"], ["text"]) if c[0] in docs.columns)

    def found(own: Block, batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """A part and the row, term, tf and dl of what it has of the queries' terms, by row and term."""
        if len(columns) == 1:
            for part, size, words in token_parts(batches, rows):
                row, term, _ = own.matched(words, size)
                pair, tf = np.unique(row * len(own.terms) + term, return_counts=True)
                row = pair // len(own.terms)
                yield part, row, pair % len(own.terms), tf, size[row]
            return
        for batch in batches:
            held = pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy().astype(np.int64)
            for lo, hi in spans(held, rows, EXPANDED):
                part, size = batch.slice(lo, hi - lo), held[lo:hi]
                row, term, at = own.matched(part["terms"].flatten(), size)
                order = np.lexsort((term, row))
                row, at = row[order], at[order]
                yield part, row, term[order], part["tfs"].flatten().to_numpy()[at], part["dl"].to_numpy()[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        nq = len(own.qids)
        if not nq:
            return
        best = Best(nq, k, digits, positive=True)
        for part, row, term, tf, dl in found(own, batches, max(1, CELLS // nq)):
            best.add(own.scores(len(part), row, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), dense=digits is not None), part["doc"])
        yield from best.rows(own.qids, own_type)

    return docs.select("doc", *columns).mapInArrow(run, f"qid {kind.simpleString()}, doc {docs.schema['doc'].dataType.simpleString()}, score double")


def in_blocks(weights: DataFrame, n: int, block: int = BLOCK) -> list[DataFrame]:
    """Weights of n queries, in parts of about `block` queries."""
    count = max(1, -(-n // block))
    return [weights.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == i) if count > 1 else weights for i in range(count)]


def scored(found: DataFrame, df: DataFrame, stats: DataFrame, wanted: DataFrame, *, k: int, k1: float = K1, b: float = B, epsilon: float = EPSILON, digits: int | None = None) -> DataFrame:
    """The same from postings() or counted() rows, document_frequencies(), corpus_stats() and query_terms(). Postings are put together by
    document, so that no row for each query, document and term is shuffled."""
    if "terms" not in found.columns:
        grouped = found.groupBy("doc").agg(F.collect_list(F.struct("term", "tf")).alias("x"), F.first("dl").alias("dl"))
        found = grouped.select("doc", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"), "dl")
    weights = materialize(wanted.join(inverse_frequencies(df, stats, epsilon), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")
    avgdl, n = stats.first().avgdl or 1.0, weights.select("qid").distinct().count()
    parts = [_scored_block(found, own, wanted.schema["qid"].dataType, avgdl, k, k1, b, digits) for own in in_blocks(weights, n)]
    return top_k(reduce(DataFrame.unionByName, parts), k)


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """Each query's k best by score; Spark cuts to k before and after the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *(ties or ("doc",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class LexicalIndex:
    """A written index: postings, document frequencies and corpus statistics, with a format that readers check."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame

    @staticmethod
    def save(docs: DataFrame, path: str) -> None:
        """docs: tokenized(). Refuses documents without any token-bearing text, as a search could never find them."""
        bad = docs.where(F.size("tokens") < 1)
        if docs.isEmpty() or not bad.isEmpty():
            raise ValueError("an index needs documents, and each of them text")
        postings(docs).sortWithinPartitions("term").write.parquet(f"{path}/postings")
        spark = docs.sparkSession
        written = spark.read.parquet(f"{path}/postings")
        written.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/frequencies")
        written.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/stats")
        spark.createDataFrame([(FORMAT,)], "format string").write.json(f"{path}/format")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        found = spark.read.schema("format string").json(f"{path}/format").first()
        if not found or found.format != FORMAT:
            raise ValueError("not a lexical index of this format")
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "frequencies", "stats")))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """bm25() of tokenized queries by what is stored; only the queries' terms are read of the postings' sorted files."""
        wanted = query_terms(queries)
        found = self.postings.join(wanted.select("term").distinct(), "term", "left_semi")
        return scored(found, self.frequencies, self.stats, wanted, k=k)
