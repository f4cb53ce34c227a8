"""Toxicity: a linear-chain conditional random field tags toxic tokens; forward-backward marginals add up to document scores
and give the offending offsets.

Only documents carry labels here, so token labels are derived: over the training sample, a word or an affix is a marker if
it is found in toxic documents so much more often than in clean ones that chance can't explain it (log-likelihood ratio);
a token of a toxic document with a marker is labelled toxic, all others clean. The field is trained on these labels by
gradient ascent on the full likelihood. A logistic regression on each document's marginals turns them into a score.

The sample is bounded: PER_CLASS toxic and CLEAN_TIMES as many clean documents at most, the first by a hash of their id
among the rows that may be learned from, each of any length. Executors count its features, cut it into sequences and, with
the field, sum up its marginals. The driver gets the counts of FEATURES features, TRAINED_SEQUENCES sequences, the first by
a hash, and two numbers a document, and fits the field and the regression on them. A sequence without a marker of a toxic
document has no known labels and isn't trained on. Scoring reads every whole text, in sequences of SEQUENCE tokens at most
that lines end.

Defined results. A null or empty text has no token and the score that the regression gives to that. A null doc_id is held
out. Repeated rows are scored each. Without labels of both kinds every score is the share of toxic labels, or 0. Labels of
null don't count; of several labels of one document the highest counts; of several texts, the smallest is learned from. Only id, text and the columns in `keep` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.common import arrow_schema, batch, carried, materialize, table, text_slices, tidy
from lexspan.llm.shingle import shingles

PER_CLASS, CLEAN_TIMES = 1500, 2
FEATURES, SEQUENCE = 20_000, 48
#: Log-likelihood ratios from which a feature is used, and from which it marks tokens.
USED, MARKS = 12.0, 24.0
TRAINED_SEQUENCES, STEPS, RATE, DECAY = 8_000, 60, 0.15, 1e-3
#: Bytes of words that a task remembers the scores of, and again as many of those before; what an entry takes beside its word; and
#: features or sequences that a task holds before it hands them on.
REMEMBERED, EACH, HELD = 6 << 20, 160, 100_000
STANDS_OUT = 0.3
#: Files that the sample is written to.
SAMPLE_PARTS = 16
FOLDS = 5

_SPLIT = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 10 if b == 10 else 32 for b in range(256))

RESULT = (
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))),
)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def tokens(raw: bytes) -> list[list[bytes]]:
    """Lower-case words by line. Bytes of other scripts count as letters."""
    low = raw if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()
    return [w for line in low.lower().translate(_SPLIT).split(b"\n") if (w := line.split())]


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [f"={w}", *(f"^{w[:n]}" for n in (3, 4, 5, 6) if len(w) > n), *(f"{w[-n:]}$" for n in (3, 4) if len(w) > n)]


def marginals(e: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token (N, T), expected transitions (2, 2), log partition (N). e: token scores of the toxic state, (N, T)."""
    n, t = e.shape
    psi = np.exp(trans)
    emit = np.exp(np.clip(e, -30, 30))
    fwd, scale = np.empty((t, n, 2)), np.empty((t, n))
    for k in range(t):
        a = np.full((n, 2), 0.5) if k == 0 else fwd[k - 1] @ psi
        a[:, 1] *= emit[:, k]
        if k:
            a = np.where((k < length)[:, None], a, fwd[k - 1])
        scale[k] = a.sum(1)
        fwd[k] = a / scale[k][:, None]
    p, back, pairs = np.zeros((n, t)), np.ones((n, 2)), np.zeros((2, 2))
    for k in range(t - 1, -1, -1):
        live = k < length
        both = fwd[k] * back
        p[:, k] = np.where(live, both[:, 1] / both.sum(1), 0)
        if k:
            out = back.copy()
            out[:, 1] *= emit[:, k]
            joint = fwd[k - 1][:, :, None] * psi * out[:, None, :]
            z = joint.sum((1, 2))
            pairs += (joint / z[:, None, None])[live].sum(0)
            step = out @ psi.T
            back = np.where(live[:, None], step / step.sum(1)[:, None], back)
    return p, pairs, np.where(np.arange(t)[:, None] < length, np.log(scale), 0).sum(0)


def padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each token of sequences of these sizes, (N, T), and what is a token."""
    at = np.cumsum(sizes) - sizes
    k = np.arange(sizes.max(initial=1))
    real = k < sizes[:, None]
    return np.where(real, at[:, None] + k, 0), real


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    regression: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def word(self, w: bytes) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(w))

    def tag(self, docs: Sequence[list[list[bytes]]], scores: dict) -> list[np.ndarray]:
        """P(toxic) of each document's tokens. Sequences of like length go through the field together."""
        sizes, owner = [], []
        for i, lines in enumerate(docs):
            for line in lines:
                for k in range(0, len(line), SEQUENCE):
                    sizes.append(min(SEQUENCE, len(line) - k))
                    owner.append(i)
        n = np.array([sum(map(len, lines)) for lines in docs], np.int64)
        if not sizes:
            return [np.empty(0)] * len(docs)
        e = np.fromiter((scores[w] for lines in docs for line in lines for w in line), np.float64, int(n.sum()))
        sizes_, out = np.array(sizes), np.empty(len(e))
        at = np.cumsum(sizes_) - sizes_
        order = np.argsort(sizes_, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 2000)):
            idx, real = padded(sizes_[part])
            idx = np.where(real, at[part][:, None] + np.arange(idx.shape[1]), 0)
            p, _, _ = marginals(np.where(real, e[idx], 0.0), sizes_[part], self.trans)
            out[idx[real]] = p[real]
        return np.split(out, np.cumsum(n)[:-1])

    def score(self, p: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(p), self.constant)
        return 1 / (1 + np.exp(-np.clip(_summary(p) @ self.regression, -30, 30)))


class Scores(dict):
    """Token scores by word, computed once while they are remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.older, self.size = model, {}, 0

    def __missing__(self, w: bytes) -> float:
        if self.size > REMEMBERED:
            self.older, self.size = dict(self), 0
            self.clear()
        s = self.older.get(w)
        self[w] = s = self.model.word(w) if s is None else s
        self.size += len(w) + EACH
        return s


def _summary(p: list[np.ndarray]) -> np.ndarray:
    """Bias, greatest marginal, and the sum of the marginals that stand out, as such and by its logarithm: the small ones of a
    long text must not add up."""
    sums = [(x.max(initial=0), x[x >= STANDS_OUT].sum()) for x in p]
    return np.array([(1.0, m, np.log1p(s), min(s, 3.0)) for m, s in sums]).reshape(-1, 4)


def _distinct(rows: list[tuple[int, int, list[int]]]) -> dict[int, bool]:
    """What to learn from, and whether it is toxic: of near copies, those that share one of the eight least shingle hashes, the
    first. Copies would make words that they share look as frequent as markers. rows: doc_id, label, hashes."""
    seen: set[int] = set()
    out: dict[int, bool] = {}
    for i, y, least in sorted(rows):
        if seen.isdisjoint(least):
            out[i] = y == 1
        seen.update(least)
    return out


def _least(sample: DataFrame) -> DataFrame:
    """doc_id, toxic and the eight least shingle hashes of each text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in text_slices(b["text"]):
                h, _ = shingles(np.array([0, len(t)]), np.frombuffer(t, np.uint8))
                out.append(np.unique(h)[:8].astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "toxic", "least"])

    return sample.mapInArrow(run, "doc_id long, toxic int, least array<long>")


def _feature_counts(sample: DataFrame, own: dict[int, bool]) -> DataFrame:
    """feature, k1, k0: toxic and clean documents of the sample that have it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            names = list(seen[1].keys() | seen[0].keys())
            made = [pa.array(names, pa.string()), *(pa.array([seen[y][f] for f in names], pa.int64()) for y in (1, 0))]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays(made, names=["feature", "k1", "k0"])

        for b in batches:
            for i, raw in zip(b["doc_id"].to_pylist(), text_slices(b["text"]), strict=True):
                if i in own:
                    seen[own[i]].update({f for w in {w for line in tokens(raw) for w in line} for f in features(w)})
                    if len(seen[0]) + len(seen[1]) > HELD:
                        yield counted()
        yield counted()

    each = sample.mapInArrow(run, "feature string, k1 long, k0 long")
    return each.groupBy("feature").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))


def _with_ratio(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """Dunning's log-likelihood ratio, signed: positive where toxic documents have more."""
    k1, k0 = F.col("k1"), F.col("k0")
    p = (k1 + k0) / F.lit(n1 + n0)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g = 2 * (part(k1, n1 * p) + part(n1 - k1, n1 * (1 - p)) + part(k0, n0 * p) + part(n0 - k0, n0 * (1 - p)))
    return counts.withColumn("ratio", F.when(k1 * n0 > k0 * n1, g).otherwise(-g))


def _sequences(sample: DataFrame, own: dict[int, bool], marks: set[str]) -> DataFrame:
    """hot, place, words: sequences of clean documents, and those with a marker of toxic ones; place is a hash."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rows: list[tuple[bool, int, bytes]] = []

        def cut() -> pa.RecordBatch:
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.bool_(), pa.int64(), pa.binary()), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=["hot", "place", "words"])

        for b in batches:
            for i, raw in zip(b["doc_id"].to_pylist(), text_slices(b["text"]), strict=True):
                if i not in own:
                    continue
                parts = [line[k : k + SEQUENCE] for line in tokens(raw) for k in range(0, len(line), SEQUENCE)]
                marked = {w for w in {w for p in parts for w in p} if not marks.isdisjoint(features(w))} if own[i] else set()
                for n, part in enumerate(parts):
                    if not own[i] or not marked.isdisjoint(part):
                        rows.append((own[i], xxhash.xxh3_64_intdigest(f"{i} {n}") >> 1, b" ".join(part)))
                if len(rows) > HELD:
                    yield cut()
        yield cut()

    return sample.mapInArrow(run, "hot boolean, place long, words binary")


def _field(ratio: dict[str, float], marks: set[str], chosen: list[tuple[list[bytes], bool]]) -> Model:
    """The field's weights, from sequences and whether they are of toxic documents."""
    number = {f: i for i, f in enumerate(ratio)}
    if not chosen:
        return Model()
    vocabulary = sorted({w for s, _ in chosen for w in s})
    row = {w: i for i, w in enumerate(vocabulary)}
    known = [features(w) for w in vocabulary]
    marked = {w for w, fs in zip(vocabulary, known, strict=True) if not marks.isdisjoint(fs)}
    none = len(ratio)
    table_ = np.full((len(vocabulary), 8), none)
    for i, fs in enumerate(known):
        mine = [number[f] for f in fs if f in number]
        table_[i, : len(mine)] = mine
    sizes = np.array([len(s) for s, _ in chosen])
    flat = np.array([row[w] for s, _ in chosen for w in s])
    gold = np.array([y and w in marked for s, y in chosen for w in s], float)
    idx, real = padded(sizes)
    y = np.where(real, gold[idx], 0)
    yi = y.astype(int)
    inner = real[:, 1:]
    observed = np.array([[((yi[:, :-1] == a) & (yi[:, 1:] == b) & inner).sum() for b in (0, 1)] for a in (0, 1)], float)

    theta, trans = np.zeros(none + 2), np.zeros((2, 2))  # weights, a free place, the bias
    params, m, v = np.zeros(none + 6), np.zeros(none + 6), np.zeros(none + 6)
    total = real.sum()
    for step in range(1, STEPS + 1):
        theta, trans = params[: none + 2].copy(), params[none + 2 :].reshape(2, 2)
        theta[none] = 0
        e = theta[table_].sum(1) + theta[-1]
        p, pairs, _ = marginals(np.where(real, e[flat][idx], 0), sizes, trans)
        gap = np.bincount(flat, weights=(y - p)[real], minlength=len(vocabulary))
        grad = np.zeros_like(params)
        np.add.at(grad, table_.ravel(), np.repeat(gap, 8))
        grad[none], grad[none + 1] = 0, gap.sum()
        grad[none + 2 :] = (observed - pairs).ravel()
        grad = grad / total * 100 - DECAY * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta, trans = params[: none + 2], params[none + 2 :].reshape(2, 2)
    return Model({f: float(theta[i]) for f, i in number.items()}, float(theta[none + 1]), trans)


def _summaries(sample: DataFrame, own: dict[int, bool], model: Model) -> DataFrame:
    """doc_id and what the regression sees of each document of the sample."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(model)
        for b in batches:
            ids, x = [], []
            for i, raw in zip(b["doc_id"].to_pylist(), text_slices(b["text"]), strict=True):
                if i in own:
                    ids.append(i)
                    x.append(_summary(model.tag([tokens(raw)], known))[0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return sample.mapInArrow(run, "doc_id long, x array<double>")


def _regression(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Newton on the penalised likelihood."""
    w, penalty = np.zeros(x.shape[1]), np.array([1e-3, 1e-1, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (t - p) - penalty * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learns from labelled rows that aren't held out. labels: a row of (id, label) or more for each labelled document."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")
    found = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    first = F.md5(F.col("doc_id").cast("string"))
    chosen = [found.where(F.col("toxic") == k).orderBy(first, "doc_id").limit(n) for k, n in ((1, per_class), (0, CLEAN_TIMES * per_class))]
    picked = F.broadcast(materialize(chosen[0].unionByName(chosen[1]), "toxicity-picked"))  # a bounded number of ids
    sample = texts.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = materialize(sample.repartition(SAMPLE_PARTS, "doc_id"), "toxicity-sample")

    own = _distinct([tuple(r) for r in _least(sample).collect()])
    n1, n0 = sum(own.values()), len(own) - sum(own.values())
    if not n1 or not n0:
        return Model(constant=float(n1 > 0))
    counts = _with_ratio(_feature_counts(sample, own), n1, n0).where((F.col("k1") + F.col("k0") >= 3) & (F.abs("ratio") >= USED))
    rows = counts.orderBy(F.desc(F.abs("ratio")), "feature").limit(FEATURES).collect()
    # a marker is hardly ever in clean documents
    marks = {r.feature for r in rows if r.ratio >= MARKS and r.k0 * n1 <= 0.05 * r.k1 * n0}
    marks = marks or {r.feature for r in rows if r.ratio >= USED and not r.k0}
    cut = materialize(_sequences(sample, own, marks), "toxicity-sequences")
    take = lambda hot, n: [(bytes(r.words).split(b" "), hot) for r in cut.where("hot" if hot else "not hot").orderBy("place", "words").limit(n).collect()]
    hot = take(True, TRAINED_SEQUENCES // 2)
    model = _field({r.feature: r.ratio for r in rows}, marks, hot + take(False, TRAINED_SEQUENCES - len(hot)))
    seen = sorted((r.doc_id, r.x) for r in _summaries(sample, own, model).collect())
    model.regression = _regression(np.array([x for _, x in seen]), np.array([own[i] for i, _ in seen], float))
    return model


def _spans(raw: bytes, lines: list[list[bytes]], p: np.ndarray) -> list[dict]:
    """Runs of tokens that are likelier toxic than not, as code points of the original text."""
    hit = p >= 0.5
    if not hit.any():
        return []
    text = raw.decode("utf-8", "replace")
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered; keep the offsets
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    bounds, at = [], 0
    for line in lines:
        for w in line:
            s = w.decode("utf-8", "replace")
            k = low.find(s, at)
            k = at if k < 0 else k
            bounds.append((k, k + len(s)))
            at = k + len(s)
    out: list[dict] = []
    for i in np.flatnonzero(hit).tolist():
        if out and i and hit[i - 1]:
            out[-1]["end"], out[-1]["p"] = bounds[i][1], max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": bounds[i][0], "end": bounds[i][1], "p": float(p[i])})
    return out


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, `keep`, score, predicted and spans of each row."""
    fields = [docs.schema[id_col], *carried(docs, keep, [id_col, *(f.name for f in RESULT)]), *RESULT]
    schema, sent = arrow_schema(fields), docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = Scores(model)
        for b in batches:
            scores, spans, held, size = [], [], [], 0

            def flush() -> None:
                parts = [tokens(x) for x in held]
                p = model.tag(parts, known)
                scores.extend(model.score(p).tolist())
                spans.extend(map(_spans, held, parts, p))
                held.clear()

            for raw in text_slices(b[text_col]):
                held.append(raw)
                if (size := size + len(raw)) > 1 << 20:
                    flush()
                    size = 0
            flush()
            yield batch([b[id_col], *(b[c] for c in keep), scores, [int(s >= 0.5) for s in scores], spans], schema)

    return docs.select(id_col, *(c for c in dict.fromkeys([text_col, *keep]) if c != id_col)).mapInArrow(run, T.StructType(fields))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
