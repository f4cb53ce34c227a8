"""Segmentation by a dictionary of words with their counts: the likeliest path through each run's graph of words, and a hidden
Markov model of word shapes for characters that no word takes in.

The dictionary is a table. It becomes a double-array trie of a few flat arrays on the driver, after a check of its size, and
travels once to each executor; texts stay where they are, and a batch's distinct runs go through the trie and the
path search together, a step for each character instead of for each text. Weights are whole millionths of a natural logarithm,
so sums don't depend on the order of additions and other engines find the same paths.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.functions.text import STOP_WORDS
from lexspan.operators.lexical import spans

#: Characters of a dictionary that may travel, and of its longest word.
MOST_CHARS, LONGEST = 50_000_000, 64
MICRO = 1_000_000
#: Characters of texts and of runs that are segmented together; characters of runs that a worker remembers.
TOGETHER, REMEMBERED = 100_000, 500_000
NONE = np.int64(-(1 << 60))
HAN = "[一-鿿]+"


def weight(n: float, total: float) -> int:
    return round(MICRO * math.log(n / total))


class Trie:
    """A double array: the child of state s by letter c is base[s] + c, if check there says s."""

    def __init__(self, words: Sequence[str], values: Sequence[int]):
        letters = sorted({ord(c) for w in words for c in w})
        self.code = np.zeros(letters[-1] + 2 if letters else 1, np.int32)
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.longest = max(map(len, words), default=1)
        rows = sorted((tuple(self.code[[ord(c) for c in w]].tolist()), v) for w, v in zip(words, values, strict=True))
        base, check, value = [0], [0], {0: NONE}
        free, stack = 1, [(0, 0, len(rows), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            if lo < hi and len(rows[lo][0]) == depth:
                value[state] = rows[lo][1]
                lo += 1
            groups = []
            while lo < hi:
                c, at = rows[lo][0][depth], lo
                while lo < hi and rows[lo][0][depth] == c:
                    lo += 1
                groups.append((c, at, lo))
            if not groups:
                continue
            while free < len(check) and check[free] >= 0:
                free += 1
            b, tries = max(1, free - groups[0][0]), 0
            while any(b + c < len(check) and check[b + c] >= 0 for c, _, _ in groups):
                b, tries = b + 1, tries + 1
            if tries > 50:  # that stretch is nearly full
                free += tries // 2
            if (need := b + groups[-1][0] + 1 - len(check)) > 0:
                base += [0] * need
                check += [-1] * need
            base[state] = b
            for c, at, to in groups:
                check[b + c] = state
                stack.append((b + c, at, to, depth + 1))
        tail = len(letters) + 1  # so that base + code stays inside
        self.base, self.check = np.array(base + [0] * tail, np.int32), np.array(check + [-1] * tail, np.int32)
        self.check[0] = -1
        self.value = np.full(len(self.base), NONE)
        self.value[list(value)] = list(value.values())

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.code[np.minimum(points, len(self.code) - 1)]

    def words_at(self, codes: np.ndarray) -> np.ndarray:
        """Of each place (row) and length less one (column) the word's weight, NONE if there is no such word. A code of 0 ends all words."""
        found = np.full((len(codes), self.longest), NONE)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        padded = np.concatenate((codes, np.zeros(self.longest, codes.dtype)))
        for k in range(self.longest):
            c = padded[at + k]
            to = self.base[state] + c
            ok = (c > 0) & (self.check[to] == state)
            at, state = at[ok], to[ok]
            if not len(at):
                break
            found[at, k] = self.value[state]
        return found


@dataclass
class Shapes:
    """A hidden Markov model over the places of characters in words: B(egin), M(iddle), E(nd), S(ingle); fitted to counted words."""

    start: tuple[int, ...]
    step: tuple[tuple[int, ...], ...]
    emit: dict[str, tuple[int, ...]]
    unseen: tuple[int, ...]

    @classmethod
    def fit(cls, rows: Iterable[tuple[str, int]]) -> Shapes:
        step, emit, total = np.zeros((4, 4)), {}, np.zeros(4)
        begins = np.zeros(4)
        for w, n in rows:
            tags = [3] if len(w) == 1 else [0, *[1] * (len(w) - 2), 2]
            begins[tags[0]] += n
            for a, b in zip(tags, tags[1:], strict=False):
                step[a, b] += n
            for t, c in zip(tags, w, strict=True):
                emit.setdefault(c, np.zeros(4))[t] += n
                total[t] += n
        step[2] = step[3] = begins  # what begins a word follows what ends one
        least = lambda n, whole: weight(n, whole) if n and whole else int(NONE) >> 4
        # a character counts half an occurrence more than it has, an unseen one half
        size = total + 0.5 * (len(emit) + 1)
        emitted = {c: tuple(weight(n + 0.5, s) for n, s in zip(x.tolist(), size.tolist(), strict=True)) for c, x in emit.items()}
        steps = tuple(tuple(least(x, row.sum()) for x in row.tolist()) for row in step)
        return cls(tuple(least(x, begins.sum()) for x in begins.tolist()), steps, emitted, tuple(weight(0.5, s) for s in size.tolist()))

    def tags(self, text: str) -> list[int]:
        """The likeliest tags, from a word's begin to a word's end; ties go to the larger tag, from the end on."""
        score, back = [s + e for s, e in zip(self.start, self.emit.get(text[0], self.unseen), strict=True)], []
        for c in text[1:]:
            e = self.emit.get(c, self.unseen)
            best = [max((score[a] + self.step[a][b], a) for a in range(4)) for b in range(4)]
            back.append([a for _, a in best])
            score = [s + x for (s, _), x in zip(best, e, strict=True)]
        tag = max((2, 3), key=lambda t: (score[t], t))
        found = [tag]
        for b in reversed(back):
            found.append(b[found[-1]])
        return found[::-1]

    def cut(self, text: str) -> list[str]:
        out, at = [], 0
        for i, t in enumerate(self.tags(text)):
            if t >= 2:
                out.append(text[at : i + 1])
                at = i + 1
        return out


@dataclass
class Segmenter:
    """Cuts runs of text into words. known: a sequence of single characters that is itself a word is left as the path has it."""

    trie: Trie
    unknown: int
    words: frozenset[str]
    shapes: Shapes | None = None
    runs: str = HAN + "|[A-Za-z0-9]+"
    #: What of the runs goes through the dictionary; the others are tokens.
    cut: str = HAN
    lower: bool = False
    stop: frozenset[str] = frozenset(STOP_WORDS)
    memory: dict[str, list[str]] = field(default_factory=dict, repr=False)
    remembered: int = field(default=0, repr=False)

    def paths(self, runs: Sequence[str]) -> list[list[str]]:
        """Each run's likeliest words; of equal paths the one whose first word is longer."""
        text = "\n".join(runs) + "\n"  # no run has a line end
        codes = np.where(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10, 0, self.trie.codes(text))
        size = np.array([len(r) for r in runs], np.int64)
        first = np.cumsum(size + 1) - size - 1
        found = self.trie.words_at(codes)
        found[:, 0] = np.where(found[:, 0] == NONE, self.unknown, found[:, 0])
        place = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(first + size, size) - place  # characters to the run's end
        best, take = np.zeros(len(codes) + self.trie.longest, np.int64), np.ones(len(codes), np.int64)
        order = np.argsort(left, kind="stable")
        ends = np.cumsum(np.bincount(left[order], minlength=1))
        ahead = np.arange(1, self.trie.longest + 1)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            p = place[order[a:b]]
            sums = found[p] + best[p[:, None] + ahead]
            k = self.trie.longest - 1 - np.argmax(sums[:, ::-1], axis=1)
            best[p], take[p] = sums[np.arange(len(p)), k], k + 1
        return [self._words(r, take[f : f + len(r)].tolist()) for r, f in zip(runs, first.tolist(), strict=True)]

    def _words(self, run: str, take: list[int]) -> list[str]:
        out, i, single = [], 0, 0
        while i < len(run):
            if take[i] == 1:
                single += 1
            else:
                out += self._singles(run[i - single : i])
                out.append(run[i : i + take[i]])
                single = 0
            i += take[i]
        return out + self._singles(run[i - single : i])

    def _singles(self, text: str) -> list[str]:
        if len(text) < 2 or self.shapes is None or text in self.words:
            return list(text)
        return self.shapes.cut(text)

    def segment(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The tokens of each text; a null has none."""
        find, is_cut = re.compile(self.runs).findall, re.compile(self.cut).fullmatch
        each = [find((t or "").lower() if self.lower else t or "") for t in texts]
        if self.remembered > REMEMBERED:
            self.memory.clear()
            self.remembered = 0
        new = [r for r in set().union(*each) if r not in self.memory]
        self.remembered += sum(map(len, new))
        part, held = [], 0
        for r in new:
            if not is_cut(r):
                self.memory[r] = [r]
                continue
            part.append(r)
            held += len(r)
            if held > TOGETHER:
                self.memory |= zip(part, self.paths(part), strict=True)
                part, held = [], 0
        if part:
            self.memory |= zip(part, self.paths(part), strict=True)
        return [[w for r in runs for w in self.memory[r] if w not in self.stop] for runs in each]


def segmenter(dictionary: DataFrame, *, hidden: bool = True, most_chars: int = MOST_CHARS, **settings) -> Segmenter:
    """From a table (word, count). One larger than `most_chars` is refused, as it travels; so are blank or repeated words, words that
    are too long and counts below 1."""
    rows = dictionary.select("word", "count")
    word, n = F.col("word"), F.col("count")
    bad = F.coalesce((F.char_length(word) < 1) | (F.char_length(word) > LONGEST) | word.contains("\n") | (n < 1), F.lit(True))
    size = rows.agg(F.sum(F.char_length("word")).alias("chars"), F.count_if(bad).alias("bad"), F.count("*").alias("n"), F.count_distinct("word").alias("words")).first()
    if not size.n or size.bad or size.words < size.n:
        raise ValueError("a dictionary has words, each once, of 1 to 64 characters and with a count")
    if size.chars > most_chars:
        raise ValueError(f"the dictionary has {size.chars} characters; {most_chars} may travel")
    held = [(r[0], int(r[1])) for r in rows.orderBy("word").collect()]
    total = sum(c for _, c in held)
    trie = Trie([w for w, _ in held], [weight(c, total) for _, c in held])
    return Segmenter(trie, weight(1, total), frozenset(w for w, _ in held), Shapes.fit(held) if hidden else None, **settings)


def dictionary_tokens(made: Segmenter, spark) -> Callable[[Column], Column]:
    """A tokenizer for tokenized() and other operators that take one: a function from a text column to a column of tokens."""
    sent = spark.sparkContext.broadcast(made)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [pa.array(sent.value.segment(batch.slice(lo, hi - lo).to_pylist()), kind) for lo, hi in spans(sizes, len(sizes), TOGETHER)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return tokens
