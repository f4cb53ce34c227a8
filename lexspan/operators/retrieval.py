"""Query expansion by rules, reciprocal rank fusion, reranking, and the retrieval pipeline over a batch of questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import word_tokens
from lexspan.operators.answers import gate
from lexspan.operators.chunking import chunked
from lexspan.operators.lexical import bm25, tokenized, top_k
from lexspan.operators.vectors import cosine_top_k, hashed, hashed_vectors
from lexspan.scratch import materialize

RRF_K = 60


@dataclass(frozen=True)
class Rule:
    """If every group has a cue that the question contains, the terms are appended."""

    groups: tuple[tuple[str, ...], ...]
    terms: str


# Colloquial cues for questions on labour law, and the statutes' terms for them.
LABOUR_RULES = (
    Rule(
        (("老闆", "主管", "雇主"), ("假日", "休假日", "休息日", "例假", "下班後", "非上班時間"), ("群組傳訊", "群組訊息", "傳訊", "回訊", "line群組", "line訊息")),
        "雇主 休息日 例假 工作時間 延長工作時間 出勤 加班",
    ),
    Rule(
        (("資遣", "資遣費", "severance", "termination package"), ("勞退新制", "新制"), ("勞基法舊制", "舊制"), ("試算", "計算", "公式", "formula", "上限", "年資")),
        "資遣費 勞工退休金條例 勞動基準法 工作年資 平均工資 六個月",
    ),
    Rule(
        (
            ("欠薪", "沒發薪", "沒有發薪", "未發薪", "沒付薪", "沒有付薪", "未付薪", "拖欠工資", "積欠工資", "沒付工資", "沒有付工資", "未付工資", "未給付工資", "未給付工作報酬", "沒有付 salary", "沒付 salary", "unpaid salary", "wage arrears"),
            ("直接離職", "立即離職", "馬上離職", "立刻離職", "立即終止", "直接終止", "直接 resign", "immediately resign", "resign without notice"),
        ),
        "勞動基準法 第十四條 不依勞動契約給付工作報酬 勞工得不經預告終止契約",
    ),
)


def matches_all(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.contains(low, F.lit(c)) for c in g)) for g in groups))


def expanded(question: Column, rules: Sequence[Rule] = LABOUR_RULES) -> Column:
    """The question with the terms of each rule that fires, in the rules' order."""
    return F.concat_ws(" ", question, *(F.when(matches_all(question, r.groups), r.terms) for r in rules))


def fuse(lists: Sequence[DataFrame], *, k: int = RRF_K, top: int = 20, digits: int | None = None) -> DataFrame:
    """qid, doc, score, rank of the union of ranked lists (qid, doc, rank): sums of 1 / (k + rank). Ties go to what is seen
    first, list by list in the order given. A document twice in a list counts twice."""
    each = [f.select("qid", "doc", "rank", F.lit(i).alias("list")) for i, f in enumerate(lists)]
    union = reduce(DataFrame.unionByName, each)
    score = F.sum(F.lit(1.0) / (k + F.col("rank")))
    fused = union.groupBy("qid", "doc").agg((F.round(score, digits) if digits is not None else score).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return top_k(fused, top, "first").drop("first")


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """pairs (with question and text) and their score: share of the question's distinct tokens that the text has. A stand-in for a
    cross-encoder."""
    q, d = F.array_distinct(word_tokens(F.col("question"))), F.array_distinct(word_tokens(F.col("text")))
    return pairs.withColumn("score", F.coalesce(F.try_divide(F.size(F.array_intersect(q, d)), F.size(q)), F.lit(0.0)).cast("double"))


def rerank(candidates: DataFrame, questions: DataFrame, texts: DataFrame, *, top: int = 5, scorer: Callable[[DataFrame], DataFrame] = overlap_scorer, digits: int | None = None) -> DataFrame:
    """qid, doc, score, rank: candidates (qid, doc, rank) by the scorer's score; ties keep the candidates' order.

    questions: qid, question. texts: doc, text, joined only for the candidates. scorer: adds score, and hands on qid, doc and before.
    """
    # texts meet the candidates first: these are few, so that they are sent where they are known to be
    placed = scorer(candidates.select("qid", "doc", F.col("rank").alias("before")).join(texts, "doc").join(questions, "qid"))
    if digits is not None:
        placed = placed.withColumn("score", F.round("score", digits))
    return top_k(placed.select("qid", "doc", "score", "before"), top, "before").drop("before")


@dataclass(frozen=True)
class RetrievalConfig:
    """strategy of chunks, mode of retrieval, and sizes. Checked when made."""

    strategy: str = "structure"
    mode: str = "hybrid"
    reranker: bool = True
    retrieve: int = 20
    final: int = 5
    rrf_k: int = RRF_K
    threshold: float = 0.03

    def __post_init__(self) -> None:
        if self.strategy not in ("structure", "fixed") or self.mode not in ("bm25", "vector", "hybrid"):
            raise ValueError(f"unknown strategy or mode: {self.strategy}, {self.mode}")
        if not 1 <= self.final <= self.retrieve or self.rrf_k < 0 or not 0 <= self.threshold <= 1:
            raise ValueError("sizes or threshold out of range")


def retrieve(docs: DataFrame, questions: DataFrame, config: RetrievalConfig, *, rules: Sequence[Rule] = (), digits: int | None = 6) -> DataFrame:
    """qid, doc, score, rank: the final hits of each question. docs: doc, text. questions: qid, question.

    Retrieval and reranking see the expanded question. The stand-ins for models are hashed counts and token overlap.
    """
    return retrieve_grid(docs, questions, {"": config}, rules=rules, digits=digits)[""]


def retrieve_grid(docs: DataFrame, questions: DataFrame, grid: Mapping[str, RetrievalConfig], *, rules: Sequence[Rule] = (), digits: int | None = 6) -> dict[str, DataFrame]:
    """retrieve() for each configuration. The lists of each retriever, `retrieve` rows a question, are made and written once. docs are read a few
    times, so that those that are costly to make are better written first; tasks cut their tokens as they go, and hand on none of them."""
    asked = questions.select("qid", expanded(F.col("question"), rules).alias("question"))
    corpus, query = docs.select("doc", "text"), tokenized(asked, "qid", "question")
    known: dict[tuple, DataFrame] = {}

    def hits(mode: str, n: int, k: int) -> DataFrame:
        key = (mode, n, k if mode == "hybrid" else 0)
        if key not in known:
            if mode == "vector":
                found = cosine_top_k(corpus, hashed_vectors(query).withColumnRenamed("doc", "qid"), k=n, digits=digits, made=hashed)
            elif mode == "bm25":
                found = bm25(corpus, query, k=n, digits=digits)
            else:
                found = fuse([hits("vector", n, k), hits("bm25", n, k)], k=k, top=n, digits=9)
            known[key] = materialize(found, "hits")
        return known[key]

    out = {}
    for name, config in grid.items():
        found = hits(config.mode, config.retrieve, config.rrf_k)
        out[name] = rerank(found, asked, docs, top=config.final, digits=digits) if config.reranker else found.where(F.col("rank") <= config.final)
    return out


def retrieve_chunks(units: DataFrame, questions: DataFrame, config: RetrievalConfig, *, rules: Sequence[Rule] = (), digits: int | None = 6) -> DataFrame:
    """qid, doc_id, chunk_id, score, rank, stage of units (see chunking) cut by config.strategy. stage: what the gate at
    config.threshold refuses the question for, or null; a question without hits isn't among the rows."""
    chunks = materialize(chunked(units, config.strategy).select("chunk_id", "doc_id", "text"), "chunks")
    found = retrieve(chunks.select(F.col("chunk_id").alias("doc"), "text"), questions, config, rules=rules, digits=digits)
    top = F.max_by("score", -F.col("rank")).over(Window.partitionBy("qid"))
    staged = found.withColumn("stage", gate(F.lit(1), top, config.threshold, config.reranker)).withColumnRenamed("doc", "chunk_id")
    return staged.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("qid", "doc_id", "chunk_id", "score", "rank", "stage")


def first_rank(hits: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, rank: the best rank of a relevant document among the hits, null if there is none. gold: qid, doc."""
    best = hits.join(gold, ["qid", "doc"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return questions.select("qid").join(best, "qid", "left")


def first_article_rank(hits: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """The same where a hit covers articles: hits (qid, doc_title, articles, rank), gold (qid, doc_title, article)."""
    each = hits.select("qid", "doc_title", F.explode("articles").alias("article"), "rank")
    best = each.join(gold, ["qid", "doc_title", "article"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return questions.select("qid").join(best, "qid", "left")


def identities(hits: DataFrame) -> DataFrame:
    """First rank of each (qid, doc)."""
    order = Window.partitionBy("qid", "doc").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
