"""Exact n-gram Jaccard self-join over whole documents, and the components of its links.

How it goes, every step a Spark job over all rows:

1. One pass makes each document's set of shingles, its size, a 128-bit signature of the set, a parity sketch of it, and
   counts of all shingles in a table of fixed size. Documents with the same signature are one class (its smallest id).
2. A second pass orders each set by (count, hash), rare first, and posts the prefix that a partner must meet. A task posts
   a set once, however many copies it sees. Postings travel packed, by shards of the shingles.
3. In a shard each shingle's index list is cut into blocks of like set sizes and, within them, goes by position: a probe
   skips blocks whose sizes can't match, and within a block all entries past the last position that leaves enough to share.
4. Answers by set relation: a list's first set in a block is its head, and at first each set meets heads only, a number of
   pairs in proportion to the postings. Heads' answers stand for sets that are much alike: where two sets are in one
   component nothing is left to answer, and where the overlaps with a common head bound the overlap of two other sets
   from above below what a link needs, the pair is settled without its sets. Only what remains is compared.
5. A pair's parity sketches bound the symmetric difference from below; pairs that may still link are verified on their
   full sets. No bound here is a guess, so no link is lost and none is made up.

Defined results. No words, or a null text: an empty set, linked with nothing. A null doc_id: a row of its own, with no
component, linked with nothing. Rows with the same doc_id are one node; each row's own set is compared and reported. No
documents: no rows. Only id and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.common import bound_batches, materialize, runs, table, tidy, utf8
from lexspan.llm.components import connected
from lexspan.llm.cuckoo import mix
from lexspan.llm.shingle import shingles

#: A link needs num * intersection >= ... : NUM of DEN of the union.
NUM, DEN = 3, 4
#: Counters of the count table, 4 bytes each, which stop at their greatest value; it goes to every worker and never grows. Where it
#: is small for the corpus, shingles of many documents still stand out of their counters' common level and are ordered last.
#: Tasks hand it on in so many blocks.
COUNT_BITS, COUNT_BLOCKS = 22, 256
#: A set that more than one in so many of all documents have is hot; there are never more hot sets than that.
HOT_SETS = 10_000
#: Postings in a shard, about.
SHARD_POSTINGS = 100_000
#: Bits of a parity sketch at most, and at least.
PARITY = (64, 1 << 14)
#: Texts of about so many bytes are hashed at a time; postings that a task holds before it hands them on.
CHUNK, FLUSH = 1 << 20, 1 << 18
#: Partners of one set in a group that is verified together.
PARTNERS = 256
#: Ids of sets to verify that may go to every executor.
SENT_IDS = 200_000
#: Sets of a list's largest component in one part; entries in a bundle of lists, about; pairs looked at together.
PART, BUNDLE, CELLS = 4096, 20_000, 1 << 18

POSTING = np.dtype([("token", "<u4"), ("doc", "<i8"), ("size", "<i4"), ("pos", "<i4")])
HEADS = [f"head{k}" for k in range(3)]
#: An index list's entry as it goes to be compared. rep and component are -1 in a head that isn't known to share anything.
ENTRY = np.dtype(
    [("token", "<i8"), ("rep", "<i8"), ("component", "<i8"), ("size", "<i4"), ("pos", "<i4"), ("block", "<i4"), ("part", "<i4"), ("parts", "<i4"), ("in_main", "<i4")]
    + [(f"{c}_rep", "<i8") for c in HEADS]
    + [(f"{c}_overlap", "<i4") for c in HEADS]
)


def needed(a, b):
    """Least overlap of linked sets of sizes a and b: the smallest o with DEN * o >= NUM * (a + b - o)."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def _pack(key: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """(key, k, rows): the rows of each key, a column after the other, since neighbours' ids and sizes are alike and pack well."""
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    own, first = np.unique(key, return_index=True)
    groups = np.split(rows, first[1:])
    data = [pa.compress(b"".join(x[c].tobytes() for c in x.dtype.names), "zstd", asbytes=True) for x in groups]
    sizes = [len(x) for x in groups]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=[name, "k", "rows"])


def _unpack(group: pa.Table, dtype: np.dtype) -> np.ndarray:
    parts = []
    for k, raw in zip(group["k"].to_pylist(), group["rows"].to_pylist(), strict=True):
        raw = pa.decompress(raw, k * dtype.itemsize, "zstd", asbytes=True)
        x, at = np.empty(k, dtype), 0
        for c in dtype.names:
            step = k * dtype[c].itemsize
            x[c] = np.frombuffer(raw[at : at + step], dtype[c])
            at += step
        parts.append(x)
    return np.concatenate(parts)


def _sets(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of each text that has words."""
    at, raw = utf8(b["text"])
    for i, j in runs(at, CHUNK):
        h, off = shingles(at[i : j + 1], raw)
        for k in range(j - i):
            if off[k + 1] > off[k]:
                yield i + k, np.unique(h[off[k] : off[k + 1]])


def parity(sorted_set: np.ndarray) -> bytes:
    """A bit for each bucket that holds an odd number of the set's shingles; as many buckets as shingles, about."""
    bits = min(max(1 << (len(sorted_set) - 1).bit_length(), PARITY[0]), PARITY[1])
    n = np.bincount((mix(sorted_set) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(n.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the sets' symmetric difference. The longer sketch is folded to the shorter one's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, sig, parity) and rows of counts (block, counts), told apart by block."""
    import xxhash

    blocks, size = COUNT_BLOCKS, 1 << COUNT_BITS

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        for b in batches:
            n, sig, par = [0] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for i, u in _sets(b):
                n[i], sig[i], par[i] = len(u), xxhash.xxh3_128_digest(u.tobytes()), parity(u)
                np.add.at(counts, (u >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.uint32(1))
            empty = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(par, pa.binary()), *empty], names=names)
        if counts.any():
            part = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in np.split(counts, blocks)]
            none = [pa.nulls(blocks, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(blocks), pa.int32()), pa.array(part, pa.binary())], names=names)

    names = ["doc_id", "n", "sig", "parity", "block", "counts"]
    return docs.mapInArrow(run, "doc_id long, n long, sig binary, parity binary, block int, counts binary")


def _counts(described: DataFrame) -> np.ndarray:
    """The count table: tasks' tables are added up block by block as they stream by. 2**COUNT_BITS counters, ever."""
    each, most = (1 << COUNT_BITS) // COUNT_BLOCKS, np.uint64(0xFFFFFFFF)

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b["block"].to_pylist(), b["counts"], strict=True):
                got = np.frombuffer(pa.decompress(raw.as_py(), each * 4, "zstd", asbytes=True), np.uint32).astype(np.uint64)
                total[k] = np.minimum(total[k] + got, most) if k in total else got
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.uint32).tobytes()], pa.binary())], names=["block", "counts"])

    rows = described.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros((COUNT_BLOCKS, each), np.uint32)
    for r in rows.toLocalIterator():
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def _postings(docs: DataFrame, counts: np.ndarray, shards: int) -> DataFrame:
    """(shard, k, rows): packed postings of each set's prefix, a set once for each task."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        count, seen, held, n_held = sent.value, set(), [], 0

        def packed() -> pa.RecordBatch:
            key, rows = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            return _pack(key, rows, "shard")

        for b in batches:
            ids = b["doc_id"].to_pylist()
            for i, u in _sets(b):
                if ids[i] is None or (sig := xxhash.xxh3_128_digest(u.tobytes())) in seen:
                    continue
                seen.add(sig)
                n = len(u)
                prefix = n - -(-NUM * n // DEN) + 1
                u = u[np.argsort(count[(u >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")[:prefix]]
                rows = np.empty(len(u), POSTING)
                rows["token"], rows["doc"], rows["size"], rows["pos"] = u & np.uint64(0xFFFFFFFF), ids[i], n, np.arange(len(u))
                held.append((((u >> np.uint64(32)) % np.uint64(shards)).astype(np.int32), rows))
                n_held += len(u)
                if n_held >= FLUSH:
                    yield packed()
                    n_held = 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "shard int, k int, rows binary")


LISTS = "token long, doc_id long, size int, pos int, block int, length int, " + ", ".join(f"{c} long" for c in HEADS)


def _lists(postings: DataFrame) -> DataFrame:
    """Index lists of two sets or more, each entry with the heads of the block below its own, its own and the one above.

    block: the size's power of DEN / NUM, so that sets that match are in one block or in neighbours. A block's head is the entry
    at the foremost position: rare first, that set has the fewest shingles that the others lack, as the original of a group of
    edited copies does. A head is null where sizes or positions rule the pair out.
    """

    def index(group: pa.Table) -> pa.Table:
        x = _unpack(group, POSTING)
        x = x[np.argsort(x["token"], kind="stable")]
        new = np.concatenate(([True], x["token"][1:] != x["token"][:-1]))
        length = np.diff(np.append(np.flatnonzero(new), len(x)))
        x, length = x[np.repeat(length > 1, length)], np.repeat(length, length)[np.repeat(length > 1, length)]
        block = np.floor(np.log(np.maximum(x["size"], 1)) / np.log(DEN / NUM)).astype(np.int64)
        order = np.lexsort((x["doc"], x["size"], x["pos"], block, x["token"]))
        x, block, length = x[order], block[order], length[order]
        token, size, pos, doc = (x[c].astype(np.int64) for c in ("token", "size", "pos", "doc"))
        key = token * 256 + block
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        heads = []
        for step in (-1, 0, 1):
            at = np.searchsorted(key[starts], key + step)
            at[at == len(starts)] = 0
            h = starts[at] if len(starts) else at
            fits = (key[h] == key + step) & (h != np.arange(len(key))) & (DEN * np.minimum(size, size[h]) >= NUM * np.maximum(size, size[h]))
            need = needed(size, size[h])
            fits &= (pos <= size - need) & (pos[h] <= size[h] - need)
            heads.append(pa.array(doc[h], mask=~fits))
        shard = group["shard"][0].as_py()
        return pa.Table.from_arrays([pa.array((shard << 32) + token), pa.array(doc), pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(length.astype(np.int32)), *heads], names=[c.split()[0] for c in LISTS.split(", ")])

    return postings.groupBy("shard").applyInArrow(index, LISTS)


def _may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) that sizes and parity sketches leave."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b["n_a"].to_numpy(), b["n_b"].to_numpy()
            most = x + y - 2 * needed(x, y)
            sketches = zip(b["p_a"].to_pylist(), b["p_b"].to_pylist(), most.tolist(), strict=True)
            ok = np.array([m >= 0 and least_difference(p, q) <= m for p, q, m in sketches], bool)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b"))
    sized = pairs.join(one, "a").join(two, "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of pairs, from their full sets. Pairs meet in groups of one a and some of its partners, and
    stream by sorted, so that no more than a's set and one partner's are held."""
    pairs = materialize(pairs, "jaccard-pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)  # their number is known; then texts needn't be shuffled

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, n_held = [], [], 0

            def packed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int64())), pa.array(held, pa.binary())], names=["id", "set"])

            for i, u in _sets(b):
                at.append(i)
                held.append(u.tobytes())
                n_held += len(u)
                if n_held >= FLUSH:
                    yield packed()
                    at, held, n_held = [], [], 0
            if at:
                yield packed()

    sets = materialize(docs.join(ids, "doc_id", "left_semi").mapInArrow(pack, "id long, set binary"), "jaccard-sets")
    many = pairs.groupBy("a").agg(F.count("*").alias("m"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / PARTNERS)).cast("int")).drop("m")
    left = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).withColumn("role", F.lit(0))
    right = salted.join(sets, F.col("b") == F.col("id")).select("a", "salt", "id", "set", F.lit(1).alias("role"))

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for b in batches:
            rows = []
            for a, salt, i, raw, role in zip(*(b[c].to_pylist() for c in ("a", "salt", "id")), b["set"], b["role"].to_pylist(), strict=True):
                if (a, salt) != at:
                    at, own = (a, salt), []
                u = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    own.append(u.copy())
                    continue
                for v in own:
                    k = np.searchsorted(v, u)
                    k[k == len(v)] = 0
                    rows.append((a, i, len(v), len(u), int((v[k] == u).sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n_a", "n_b", "overlap"])

    both = left.select("a", "salt", "id", "set", "role").unionByName(right)
    dealt = both.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return materialize(dealt.mapInArrow(meet, "a long, b long, n_a long, n_b long, overlap long"), "jaccard-overlaps")


def _links(overlaps: DataFrame) -> DataFrame:
    return overlaps.where(f"{DEN} * overlap >= {NUM} * (n_a + n_b - overlap)").select("a", "b")


FACTS = "doc_id long, own long, h long, rep long, value long"


def _facts(classes: DataFrame, nodes: DataFrame, answers: DataFrame, overlaps: DataFrame) -> DataFrame:
    """What is known of a document's set. Where h is the document itself: its representative and, as value, its component.
    Where h is a head that it met: the head's representative and, as value, their overlap. own: the document's representative."""
    comp = nodes.select(F.col("node").alias("rep"), "component")
    mine = classes.select("doc_id", "rep").distinct().join(comp, "rep", "left")
    mine = mine.select("doc_id", F.col("rep").alias("own"), F.col("doc_id").alias("h"), "rep", F.coalesce("component", "rep").alias("value"))
    seen = overlaps.select("a", "b", "overlap").union(overlaps.select("b", "a", "overlap")).distinct()
    met = answers.where("doc_id <> h").join(seen, ["a", "b"]).select("doc_id", F.col("b").alias("own"), "h", F.col("a").alias("rep"), F.col("overlap").alias("value"))
    return mine.unionByName(met)


def _main(lists: DataFrame, facts: DataFrame) -> DataFrame:
    """(token, main, parts): the largest component of each list of more than PART entries, and how many parts its sets make."""
    mine = facts.where("doc_id = h").select("doc_id", F.col("value").alias("component"))
    sizes = lists.where(F.col("length") > PART).select("token", "doc_id").join(mine, "doc_id").groupBy("token", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("x"))
    return materialize(main.select("token", F.col("x.component").alias("main"), F.ceil(F.col("x.m") / PART).cast("int").alias("parts")), "jaccard-main")


def _told(batches: Iterator[pa.RecordBatch], bundles: int) -> Iterator[pa.RecordBatch]:
    """Packed entries, by bundles of lists, from rows that come document by document, its facts before its entries. No more is
    held than a batch, the facts of the document at its end and entries up to FLUSH."""
    carried, held, n_held = None, [], 0

    def packed() -> pa.RecordBatch:
        rows = np.concatenate(held)
        salt = mix(rows["token"].astype(np.uint64) * np.uint64(31) + rows["part"].astype(np.uint64))
        held.clear()
        return _pack((salt % np.uint64(bundles)).astype(np.int32), rows, "bundle")

    for b in batches:
        if not b.num_rows:
            continue
        is_fact = b["size"].is_null().to_numpy(zero_copy_only=False)
        ints = lambda c, rows: b[c].fill_null(-1).to_numpy()[rows]  # noqa: E731, B023
        facts = np.stack([ints(c, is_fact) for c in ("doc_id", "own", "h", "rep", "value")])
        facts = facts if carried is None else np.concatenate([carried, facts], axis=1)
        carried = facts[:, facts[0] == b["doc_id"][-1].as_py()]
        e = {c: ints(c, ~is_fact) for c in ("token", "doc_id", "size", "pos", "block", "main", "parts", *HEADS)}
        if not len(e["token"]):
            continue
        # one number for a document and what it met, so that facts are found by bisection
        docs, met = np.unique(facts[0]), np.unique(facts[2])
        key = np.searchsorted(docs, facts[0]) * len(met) + np.searchsorted(met, facts[2])
        order = np.argsort(key, kind="stable")
        key, facts = key[order], facts[:, order]
        at = np.searchsorted(docs, e["doc_id"]) * len(met)
        own = at + np.searchsorted(met, e["doc_id"])
        lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
        i = np.repeat(np.arange(len(own)), hi - lo)  # rows of one id with different sets have several representatives
        mine = lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        rows = np.empty(len(i), ENTRY)
        for c in ("token", "size", "pos", "block"):
            rows[c] = e[c][i]
        rows["rep"], rows["component"], rows["parts"] = facts[3, mine], facts[4, mine], e["parts"][i]
        for c in HEADS:
            h = e[c][i]
            k = np.minimum(np.searchsorted(met, h), len(met) - 1)
            f = np.minimum(np.searchsorted(key, at[i] + k), len(key) - 1)
            ok = (met[k] == h) & (key[f] == at[i] + k) & (h != e["doc_id"][i]) & (facts[1, f] == rows["rep"]) & b[c].is_valid().to_numpy(zero_copy_only=False)[~is_fact][i]
            rows[f"{c}_rep"], rows[f"{c}_overlap"] = np.where(ok, facts[3, f], -1), np.where(ok, facts[4, f], -1)
        # a long list's largest component is dealt out to parts; what else the list holds, the fewer, goes to each part
        rows["in_main"] = (rows["parts"] > 0) & (rows["component"] == e["main"][i])
        rows["part"] = (mix(rows["rep"].astype(np.uint64)) % np.maximum(rows["parts"], 1).astype(np.uint64)).astype(np.int32)
        times = np.where(rows["in_main"] > 0, 1, np.maximum(rows["parts"], 1))
        dealt = np.repeat(rows, times)
        spread = np.arange(len(dealt)) - np.repeat(np.cumsum(times) - times, times)
        dealt["part"] = np.where(dealt["in_main"] > 0, dealt["part"], spread)
        held.append(dealt)
        n_held += len(dealt)
        if n_held >= FLUSH // 2:
            yield packed()
            n_held = 0
    if held:
        yield packed()


def _rest(lists: DataFrame, facts: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Pairs (a, b) of lists whose sets are in several components, which neither the heads' answers nor blocks and positions
    settle. Lists are shuffled twice: to what is known of their documents, and, packed, to each other."""
    bundles = max(24, lists.count() // BUNDLE)
    entries = lists.join(_main(lists, facts), "token", "left").drop("length")
    told = entries.unionByName(facts, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id", F.col("size").isNotNull())
    # a bundle's work isn't told by its bytes, so tasks get a number of bundles, not of bytes
    dealt = told.mapInArrow(tidy(lambda batches: _told(batches, bundles)), "bundle int, k int, rows binary").repartition(bundles // 4, "bundle")

    def cross(bundle: pa.Table) -> pa.Table:
        g = _unpack(bundle, ENTRY)
        g = g[np.lexsort((g["rep"], g["part"], g["token"]))]
        same = (g["token"][1:] == g["token"][:-1]) & (g["part"][1:] == g["part"][:-1]) & (g["rep"][1:] == g["rep"][:-1])
        g = g[np.concatenate(([True], ~same))]
        starts = _starts(g)
        sizes = np.diff(np.append(starts, len(g)))
        live = np.minimum.reduceat(g["component"], starts) < np.maximum.reduceat(g["component"], starts)
        g = g[np.repeat(live, sizes)]
        g = g[np.lexsort((g["pos"], g["block"], g["part"], g["token"]))]
        edges = [*_starts(g).tolist(), len(g)]
        out = [np.empty((2, 0), np.int64)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            one = {c: g[c][lo:hi].astype(np.int64) for c in ENTRY.names}
            if one["parts"][0] < 1:
                own, times = np.unique(one["component"], return_counts=True)
                one["in_main"] = one["component"] == own[np.argmax(times)]
            one["in_main"] = one["in_main"].astype(bool)
            out += _met(one)
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    met = overlaps.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return dealt.groupBy("bundle").applyInArrow(cross, "a long, b long").distinct().join(met, ["a", "b"], "left_anti")


def _starts(g: np.ndarray) -> np.ndarray:
    """Where each list's part begins."""
    changes = (g["token"][1:] != g["token"][:-1]) | (g["part"][1:] != g["part"][:-1])
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(g)), bool), changes)))


def _met(g: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Pairs of one list's part. Blocks of sizes that can't match are skipped; in the others, entries past the last position that
    leaves enough to share with the block's largest set."""
    blocks, first = np.unique(g["block"], return_index=True)
    ends = np.append(first[1:], len(g["block"]))
    whole = int(g["part"][0]) == 0
    out = []
    for k, (x, y) in enumerate(zip(first, ends, strict=True)):
        mine = x + np.flatnonzero(~g["in_main"][x:y])
        if not len(mine):
            continue
        others = []
        for n in (k - 1, k, k + 1):
            if 0 <= n < len(blocks) and abs(int(blocks[n]) - int(blocks[k])) <= 1:
                largest = int(g["size"][first[n] : ends[n]].max())
                last = largest - needed(int(g["size"][mine].min()), largest)
                others.append(np.arange(first[n], first[n] + np.searchsorted(g["pos"][first[n] : ends[n]], last, "right")))
        j = np.concatenate(others)
        step = max(1, CELLS // max(1, len(j)))
        for at in range(0, len(mine), step):
            i = mine[at : at + step, None]
            si, sj = g["size"][i], g["size"][j]
            need = needed(si, sj)
            # a pair of two sets outside the main component is met once, in part 0
            ok = (DEN * np.minimum(si, sj) >= NUM * np.maximum(si, sj)) & (g["pos"][i] <= si - need) & (g["pos"][j] <= sj - need)
            ok &= (g["component"][i] != g["component"][j]) & (g["in_main"][j] | ((j > i) & whole))
            r, c = np.nonzero(ok)
            if len(r):
                r, c = mine[at + r], j[c]
                keep = _most(g, r, c) >= needed(g["size"][r], g["size"][c])
                r, c = g["rep"][r[keep]], g["rep"][c[keep]]
                out.append(np.unique(np.stack((np.minimum(r, c), np.maximum(r, c))), axis=1))
    return out


def _most(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of entries i with entries j, from their overlaps with a head that they share:
    |x & y| <= min(|x & h|, |y & h|) + min(|x - h|, |y - h|)."""
    most = np.minimum(g["size"][i], g["size"][j])
    for one in HEADS:
        for two in HEADS:
            o, p = g[f"{one}_overlap"][i], g[f"{two}_overlap"][j]
            same = (g[f"{one}_rep"][i] == g[f"{two}_rep"][j]) & (o >= 0) & (p >= 0)
            bound = np.minimum(o, p) + np.minimum(g["size"][i] - o, g["size"][j] - p)
            most = np.where(same, np.minimum(most, bound), most)
    return most


def _classes(named: DataFrame) -> DataFrame:
    """doc_id, rep, n and parity of documents (with sig): rep is the smallest id with that signature. Hot signatures, of which there
    can't be more than HOT_SETS, go to every executor, so that their documents stay where they are."""
    reps = materialize(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), "jaccard-reps")
    whole = reps.agg(F.sum("m")).first()[0] or 0
    is_hot = F.col("m") * HOT_SETS > whole
    hot, cold = F.broadcast(reps.where(is_hot).select("sig", "rep")), reps.where(~is_hot).select("sig", "rep")
    found = named.join(hot, "sig").unionByName(named.join(hot, "sig", "left_anti").join(cold, "sig"))
    return found.select("doc_id", "rep", "n", "parity")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialize(_describe(docs), "jaccard-described")
    rows = described.where("block is null").select("doc_id", "n", "sig", "parity")
    named = rows.where("doc_id is not null and sig is not null")
    classes = materialize(_classes(named), "jaccard-classes")
    own = classes.where("doc_id = rep").select("rep", "n", "parity")
    total = classes.agg(F.sum("n")).first()[0] or 0
    shards = max(24, total // 4 // SHARD_POSTINGS)
    lists = materialize(_lists(_postings(docs, _counts(described), shards)), "jaccard-lists")

    to_rep = classes.select("doc_id", "rep").distinct()
    heads = lists.select("doc_id", F.explode(F.array(*HEADS)).alias("h")).where("h is not null").distinct()
    answers = heads.join(to_rep.select(F.col("doc_id").alias("h"), F.col("rep").alias("a")), "h").join(to_rep.withColumnRenamed("rep", "b"), "doc_id")
    answers = materialize(answers.where("a <> b"), "jaccard-heads")
    overlaps = _verified(_may_link(answers.select("a", "b").distinct(), own), docs)
    same = classes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    nodes = materialize(connected(same.union(_links(overlaps))), "jaccard-nodes")

    facts = materialize(_facts(classes, nodes, answers, overlaps), "jaccard-facts")
    rest = materialize(_rest(lists, facts, overlaps), "jaccard-rest")
    if not rest.isEmpty():
        more = _links(_verified(_may_link(rest, own), docs))
        nodes = connected(same.union(_links(overlaps)).union(more))
    found = rows.select("doc_id", F.col("n").alias("n_shingles")).join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op1_ngram_jaccard, for small tables: all pairs that share a shingle.
BRUTE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
