"""Source divergence audit: how far the word distributions of a language's sources lie from each other and from the language's.

A group is a (lang, source). Each task counts terms and the documents that hold them, and Spark adds up what tasks send. Terms in
at least MIN_DOCS documents of a language are kept; they are dealt by hash to chunks of about CHUNK terms and numbered there, so a
group's counts become one packed sparse vector for each chunk. Groups are dealt to blocks, and each vector is sent to every tile
(block by block) that its group's block is part of. A tile goes through one slab of successive chunks, holds one chunk of its two
blocks at a time, and adds to its submatrix of pairs; terms that no group of the tile has count by arithmetic. Sums over slabs
are the divergences. No task holds a group, a vocabulary or all pairs.

Shares are whole numbers of PARTS and divergences whole numbers, so every result is exact whatever the order of additions.

Defined results. Null text, lang or source: ''. A text without terms leaves its group in place; a group without kept terms has the
shares of counts of 0. A language without kept terms: its pairs have value 0, no term rows. A language with one source: no
pairs. Repeated rows are separate documents. Ties of value go by the item's bytes. No documents: no rows. Other columns than text,
lang and source aren't read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.common import materialize, table, tidy, utf8

#: A term is kept if so many documents of its language have it.
MIN_DOCS = 3
PARTS = 1_000_000_000
#: Ranks of terms that are reported.
TOP = 200
#: Terms in a chunk, chunks in a slab, groups in a block.
CHUNK, SLAB, BLOCK = 2048, 16, 16
#: Distinct terms of groups that a task holds before it sends them on; bytes of a text that are split at once.
HELD, PIECE = 300_000, 1 << 20

#: A-Z to a-z; every other ASCII byte that isn't a letter to a space; bytes from 128 on stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, some at a time."""
    at = 0
    while at < len(raw):
        end = len(raw) if at + PIECE >= len(raw) else raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, df (documents) of each group; and a row with a null term for each group there is."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    wanted = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(text_col).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = pa.array([*n, None], pa.binary()).cast(pa.string())
                counts = [pa.array([*n.values(), 0], pa.int64()), pa.array([*map(df.__getitem__, n), 0], pa.int64())]
                whole = pa.table([pa.repeat(pa.scalar(lang), len(terms)), pa.repeat(pa.scalar(source), len(terms)), terms, *counts], schema=_COUNTS)
                yield from whole.to_batches(max_chunksize=50_000)
            held.clear()

        for b in batches:
            at, raw = utf8(b["text"])
            spans = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
            for lang, source, (i, j) in zip(b["lang"].to_pylist(), b["source"].to_pylist(), spans, strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                size -= len(n)
                for part in _pieces(raw[i:j].tobytes().translate(_FOLD)):
                    n.update(part)
                    own.update(part)
                df.update(own)
                size += len(n) + 1
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    found = wanted.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: str, whole: str) -> Column:
    """1 + floor(PARTS * (n + 1) / whole) by long division in three steps of 1000, none of which leaves 64 bits."""
    rest, digits = f"({n} + 1)", []
    for _ in range(3):
        digits.append(f"({rest} * 1000) div ({whole})")
        rest = f"(({rest} * 1000) % ({whole}))"
    return F.expr("1 + 1000000 * ({}) + 1000 * ({}) + ({})".format(*digits))


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    rest, digits = n + 1, np.zeros_like(n)
    for _ in range(3):
        part = rest * 1000
        q = part // whole
        digits, rest = digits * 1000 + q, part - q * whole
    return digits + 1


class Tile:
    """The submatrix of one tile over the chunks of one slab."""

    def __init__(self, key: tuple):
        self.key, self.groups, self.place, self.seen = key, [], {}, 0
        self.chunk: list[tuple[str, np.ndarray, np.ndarray]] = []
        self.value = None

    def head(self, source: str, block: int, n: int, v: int, terms: int) -> None:
        self.place[source] = len(self.groups)
        self.groups.append((source, block, n + v if v else 1))
        self.terms = terms

    def start(self) -> None:
        _, low, high, _ = self.key
        blocks = np.array([b for _, b, _ in self.groups])
        self.rows, self.cols = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        self.whole = np.array([d for _, _, d in self.groups], np.int64)
        self.none = _shares(np.zeros_like(self.whole), self.whole)
        self.value = np.zeros((len(self.groups), len(self.groups)), np.int64)

    def _add(self, p: np.ndarray, times: int = 1) -> None:
        """p: the groups' shares, a column for each term."""
        same = self.key[1] == self.key[2]
        for i in self.rows:
            gap = p[i] - p[self.cols]
            gap *= gap
            self.value[i, self.cols] += (gap // p[self.cols]).sum(axis=1) * times
            if not same:
                self.value[self.cols, i] += (gap // p[i]).sum(axis=1) * times

    def flush(self) -> None:
        """Ends a chunk."""
        if self.value is None:
            self.start()
        if self.chunk:
            terms, at = np.unique(np.concatenate([x for _, x, _ in self.chunk]), return_inverse=True)
            row = np.repeat([self.place[s] for s, _, _ in self.chunk], [len(x) for _, x, _ in self.chunk])
            p = np.repeat(self.none[:, None], len(terms), axis=1)
            p[row, at] = _shares(np.concatenate([n for _, _, n in self.chunk]), self.whole[row])
            self._add(p)
            self.seen += len(terms)
            self.chunk = []

    def result(self) -> pa.RecordBatch:
        self.flush()
        self._add(self.none[:, None], self.terms - self.seen)
        lang, low, high, _ = self.key
        pairs = [(i, j) for i in self.rows for j in self.cols if i != j]
        if low != high:
            pairs += [(j, i) for i, j in pairs]
        name = [s for s, _, _ in self.groups]
        made = {"lang": [lang] * len(pairs), "source": [name[i] for i, _ in pairs], "item": [name[j] for _, j in pairs], "value": [int(self.value[x]) for x in pairs]}
        return pa.RecordBatch.from_pydict(made, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


@tidy
def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of tile, slab, chunk; a slab's first rows, of chunk -1, are its groups."""
    tile, chunk = None, -1
    for b in batches:
        key = list(zip(*(b[c].to_pylist() for c in ("lang", "low", "high", "slab")), strict=True))
        heads = [b[c].to_pylist() for c in ("chunk", "source", "block", "group_n", "v", "terms")]
        idx, n = b["idx"], b["n"]
        for i, k in enumerate(key):
            if tile is None or k != tile.key:
                if tile is not None:
                    yield tile.result()
                tile, chunk = Tile(k), -1
            c, source, *head = (x[i] for x in heads)
            if c < 0:
                tile.head(source, *head)
                continue
            if c != chunk:
                tile.flush()
                chunk = c
            tile.chunk.append((source, idx[i].values.to_numpy(), n[i].values.to_numpy()))
    if tile is not None:
        yield tile.result()


class Audit:
    """The tables of an audit, each written once: groups, kept terms and the counts of kept terms."""

    def __init__(self, docs: DataFrame, *, min_docs: int = MIN_DOCS, chunk: int = CHUNK, slab: int = SLAB, block: int = BLOCK, **columns: str):
        self.slab, self.block = slab, block
        counts = materialize(term_counts(docs, **columns), "divergence-counts")
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= min_docs)
        kept = materialize(kept.select("lang", "term", "lang_n"), "divergence-terms")
        sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        named = counts.where("term IS NULL").select("lang", "source")
        langs = named.groupBy("lang").agg(F.count("*").alias("n_groups")).join(sizes, "lang", "left").na.fill(0, ["v", "lang_total"])
        #: A row for each language; so small that Spark itself, by its size, sends it to where rows are.
        self.langs = materialize(langs.withColumns({"chunks": F.ceil(F.col("v") / chunk), "blocks": F.ceil(F.col("n_groups") / block)}), "divergence-langs")
        place = Window.partitionBy("lang", "chunk").orderBy("term")
        numbered = kept.join(self.langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
        numbered = numbered.select("lang", "term", "lang_n", "v", "lang_total", "blocks", "chunk", (F.row_number().over(place) - 1).alias("idx"))
        #: lang, source, term, n with what belongs to the term and the language.
        self.counts = materialize(counts.where("term IS NOT NULL").drop("df").join(numbered, ["lang", "term"]), "divergence-kept")
        sums = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = named.join(sums, ["lang", "source"], "left").na.fill(0, ["group_n"]).join(self.langs, "lang")
        self.groups = materialize(groups.withColumn("block", self._block()), "divergence-groups")

    @staticmethod
    def _block() -> Column:
        return F.pmod(F.xxhash64("source"), F.col("blocks"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source), value."""
        slab = F.floor(F.col("chunk") / self.slab).alias("slab")
        packed = self.counts.groupBy("lang", "source", "chunk", "blocks").agg(F.collect_list(F.struct("idx", "n")).alias("x"))
        none = F.lit(0).cast("long")
        vectors = packed.select(
            "lang", "source", "blocks", self._block().alias("block"), slab, "chunk", none.alias("group_n"), none.alias("v"), none.alias("terms"), F.col("x.idx").alias("idx"), F.col("x.n").alias("n")
        )
        sizes = self.counts.select("lang", "term", slab).distinct().groupBy("lang", "slab").agg(F.count("*").alias("terms"))
        heads = self.groups.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("chunks") / self.slab) - 1, F.lit(0)))))
        heads = heads.join(sizes, ["lang", "slab"], "left").select(
            "lang", "source", "blocks", "block", "slab", F.lit(-1).cast("long").alias("chunk"), "group_n", "v", F.coalesce("terms", F.lit(0)).alias("terms"),
            F.array().cast("array<int>").alias("idx"), F.array().cast("array<long>").alias("n"),
        )
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        sent = heads.unionByName(vectors).select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        shape = F.col("blocks") * (F.col("blocks") + 1) / 2 * F.greatest(F.ceil(F.col("chunks") / self.slab), F.lit(1))
        tiles = int(self.langs.agg(F.sum(shape)).first()[0] or 1)
        tile = ("lang", "low", "high", "slab")
        dealt = sent.repartition(min(tiles, 20_000), *tile).sortWithinPartitions(*tile, "chunk", "source")
        found = dealt.select(*tile, "chunk", "source", "block", "group_n", "v", "terms", "idx", "n").mapInArrow(_tiles, "lang string, source string, item string, value long")
        return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (a term that the group has and has more of than its language), value."""
        own = self.counts.join(self.groups.select("lang", "source", "group_n"), ["lang", "source"])
        p, q = _share("n", "group_n + v"), _share("lang_n", "lang_total + v")
        shared = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return shared.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, *, top: int = TOP, **settings) -> DataFrame:
    """lang, source, part, item, value, rank: every other source by its divergence, and the terms that stand out, `top` at most."""
    made = Audit(docs, **settings)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part = lambda df, name: df.withColumn("part", F.lit(name)).withColumn("rank", F.row_number().over(order))
    both = part(made.pairs(), "pair").unionByName(part(made.terms(), "term").where(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op11_divergence.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     t AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
     l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
     gn AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(gn.total, 0) + l.v) AS p,
                  1 + (1000000000 * (k.lang_n + 1)::HUGEINT) // (l.total + l.v) AS q
           FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
     pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
     tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
     r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pr UNION ALL FROM tr))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
