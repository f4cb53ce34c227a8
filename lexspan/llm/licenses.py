"""License scans: MinHash bands over overlapping windows of shingles retrieve templates, exact containment verifies them.

A template of m shingles is looked for with windows of w shingles, w the largest power of two such that any whole
occurrence holds a window of the document: windows begin at every q-th shingle, q = w / 4 (1 at least), and w + q - 1 <= m.
All windows of a template are indexed, at every offset, so an unchanged occurrence always collides; with ROWS hashes in a
band and as many bands as bands_for() says, a window of the assumed similarity collides with probability CERTAIN. A window
that collides is evidence only: the stretch of the document around it is compared shingle by shingle, and the template is
reported if CONTAINED of its shingles are there.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII; case and punctuation don't matter.

Defined results. Null or empty text: no match. Overlapping matches of one template are one match, the best. Repeated rows
are each scanned. Templates of fewer than five words are refused. Only id, text and the columns in `keep` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm.common import arrow_schema, batch, carried, runs, table, utf8
from lexspan.llm.shingle import WIDTH, shingles, word_bounds

CONTAINED, CERTAIN = 0.75, 0.99
CHUNK = 1 << 20

# Notices by which the named licences are applied, as their publishers word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_KEPT = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_FACTORS = np.random.Generator(np.random.PCG64(10)).integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

RESULT = (
    T.StructField(
        "matches",
        T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("contained", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
    ),
)


def rows_for(w: int) -> tuple[int, float]:
    """Hashes in a band, and the similarity of windows that is assumed: single hashes for small windows."""
    return (1, 0.6) if w <= 8 else (2, 0.5)


def bands_for(similarity: float, rows: int, certain: float = CERTAIN) -> int:
    """The fewest bands with which windows of this similarity share one with the wanted probability."""
    return math.ceil(math.log(1 - certain) / math.log(1 - similarity**rows))


def window_for(m: int) -> int:
    w = 1
    while 2 * w + max(1, w // 2) - 1 <= m:
        w *= 2
    return w


def minhash(h: np.ndarray, w: int) -> np.ndarray:
    """MinHash values of the windows of w shingles at every q-th shingle, (windows, hashes); past the end counts as nothing."""
    q, (rows, j) = max(1, w // 4), rows_for(w)
    k = rows * bands_for(j, rows) if w > 1 else 1
    blocks = -(-len(h) // q)
    per = w // q
    out = np.empty((blocks, k), np.uint32)
    for i in range(k):
        x = np.full((blocks + per) * q, 0xFFFFFFFF, np.uint32)
        x[: len(h)] = (h * _FACTORS[i]) >> np.uint64(32)
        if q > 1:
            x = x.reshape(-1, q).min(1)
        y = x[:blocks].copy()
        for d in range(1, per):
            np.minimum(y, x[d : d + blocks], out=y)
        out[:, i] = y
    return out


def band_keys(values: np.ndarray, w: int) -> np.ndarray:
    """A 64-bit key for each window and band."""
    rows = rows_for(w)[0]
    bands = values.shape[1] // rows
    with np.errstate(over="ignore"):
        key = np.zeros((len(values), bands), np.uint64)
        for r in range(rows):
            key = key * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows][:, :bands]
        return key * np.uint64(0xC4CEB9FE1A85EC53) + np.arange(bands, dtype=np.uint64)


class Templates:
    """The index: for each window size the sorted band keys of all template windows."""

    def __init__(self, texts: Mapping[str, str]):
        self.names, self.sets, self.levels = list(texts), [], {}
        entries: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for t, name in enumerate(self.names):
            raw = _KEPT[np.frombuffer(texts[name].encode(), np.uint8)]
            at = np.array([0, len(raw)])
            if len(word_bounds(at, raw)[0]) < WIDTH:
                raise ValueError(f"template {name} has fewer than {WIDTH} words")
            h, _ = shingles(at, raw)
            self.sets.append(np.unique(h))
            w = window_for(len(h))
            for offset in range(len(h) - w + 1):
                own = h[offset : offset + w]
                entries.setdefault(w, []).append((band_keys(minhash(own, w)[:1], w)[0], t, offset))
        for w, found in entries.items():
            keys = np.concatenate([k for k, _, _ in found])
            owner = np.repeat([t for _, t, _ in found], [len(k) for k, _, _ in found])
            offset = np.repeat([o for _, _, o in found], [len(k) for k, _, _ in found])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.levels[w] = keys[order], owner[order], offset[order], seen

    def candidates(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(template, shingle where it would begin) of all collisions."""
        out: set[tuple[int, int]] = set()
        for w, (keys, owner, offset, seen) in self.levels.items():
            own = band_keys(minhash(h, w), w)
            maybe = np.flatnonzero(seen[(own >> np.uint64(48)).astype(np.int64)].ravel())
            key = own.ravel()[maybe]
            first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(last > first).tolist():
                begin = int(maybe[i]) // own.shape[1] * max(1, w // 4)
                out.update((int(owner[j]), begin - int(offset[j])) for j in range(first[i], last[i]))
        return out

    def verify(self, h: np.ndarray, t: int, begin: int) -> tuple[float, int, int]:
        """Share of the template's shingles around a place in a document's, and the stretch they're in."""
        own = self.sets[t]
        slack = len(own) // 4 + 2
        lo = max(0, begin - slack)
        hit = np.flatnonzero(np.isin(h[lo : begin + len(own) + slack], own))
        if not len(hit):
            return 0.0, 0, 0
        share = len(np.unique(h[lo + hit])) / len(own)
        return share, lo + int(hit[0]), lo + int(hit[-1])


def scan(at: np.ndarray, raw: np.ndarray, index: Templates) -> list[list[dict]]:
    """Matches in each text of a part of a batch."""
    kept = _KEPT[raw[at[0] : at[-1]]]
    off = at - at[0]
    h, first = shingles(off, kept)
    if not len(h):
        return [[] for _ in range(len(off) - 1)]
    found: list[dict[int, list[tuple[float, int, int]]]] = [{} for _ in range(len(off) - 1)]
    for t, begin in sorted(index.candidates(h)):
        # a window may reach over the end of a text; each text that it touches is looked at
        lo = int(np.searchsorted(first, max(begin, 0), "right")) - 1
        hi = int(np.searchsorted(first, begin + len(index.sets[t]), "left")) - 1
        for d in range(max(0, lo), min(hi, len(found) - 1) + 1):
            share, a, b = index.verify(h[first[d] : first[d + 1]], t, begin - int(first[d]))
            if share >= CONTAINED:
                found[d].setdefault(t, []).append((share, a, b))
    out = []
    for d, own in enumerate(found):
        rows = []
        if own:
            text = raw[at[d] : at[d + 1]].tobytes()
            starts, ends, _ = word_bounds(np.array([0, len(text)]), kept[off[d] : off[d + 1]])
            for t, hits in own.items():
                best: list[tuple[float, int, int]] = []
                for share, a, b in sorted(set(hits), key=lambda x: (-x[0], x[1], x[2])):
                    if all(b < x or a > y for _, x, y in best):
                        best.append((share, a, b))
                for share, a, b in best:
                    x, y = int(starts[a]), int(ends[min(b + WIDTH - 1, len(ends) - 1)])
                    begin = len(text[:x].decode("utf-8", "replace"))
                    rows.append({"license": index.names[t], "contained": share, "start": begin, "end": begin + len(text[x:y].decode("utf-8", "replace"))})
        out.append(sorted(rows, key=lambda r: (r["start"], r["license"])))
    return out


def find_licenses(docs: DataFrame, *, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, `keep` and matches (license, contained, start and end in code points) of each row."""
    fields = [docs.schema[id_col], *carried(docs, keep, [id_col, *(f.name for f in RESULT)]), *RESULT]
    schema, texts = arrow_schema(fields), dict(templates)
    Templates(texts)  # refuses bad ones before the job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(texts)
        for b in batches:
            at, raw = utf8(b[text_col])
            matches = [m for i, j in runs(at, CHUNK) for m in scan(at[i : j + 1], raw, index)]
            yield batch([b[id_col], *(b[c] for c in keep), matches], schema)

    return docs.select(id_col, *(c for c in dict.fromkeys([text_col, *keep]) if c != id_col)).mapInArrow(run, T.StructType(fields))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["contained"])), F.lit(0.0)).alias("best"), "matches",
    )


def brute_force(text: str | None, templates: Mapping[str, str] = TEMPLATES) -> set[str]:
    """Licences with CONTAINED of their shingles in some stretch of the text about as long as the template, by sets of words."""
    import re

    words = lambda t: re.findall(r"[^\W_]+|[^\x00-\x7F]+", re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ", t).lower())
    grams = lambda w: [tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)]
    own, out = grams(words(text or "")), set()
    for name, t in templates.items():
        want = set(grams(words(t)))
        reach = len(want) + 2 * (len(want) // 4 + 2)
        if any(len(want & set(own[i : i + reach])) >= CONTAINED * len(want) for i in range(max(1, len(own) - reach + 1))):
            out.add(name)
    return out
