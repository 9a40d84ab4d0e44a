"""License scans (operator 9): a trained paragraph classifier with template confirmation.

Paragraphs (lines with a word) are sets of hashed word 2- and 3-grams. A sparse
multinomial logistic regression, trained here, gives the probability of each licence
family and of "unknown". It is trained on passages of the templates below, whole, cut
and with words left out, against ordinary paragraphs from a bounded sample of the
scanned table (BACKGROUND paragraphs); a temperature fitted on held-out passages
calibrates it, unknown class included. A prediction counts when its probability reaches
MIN_PROBABILITY and the paragraph then agrees with a template of that family: CONFIRM of
a template's word 3-grams in common, or of the paragraph's own if it has QUOTE or more.

Scanning is one pass over whole texts without a shuffle. One row comes out per confirmed
paragraph. Defined cases: null, empty and wordless texts give no row; repeated rows give
repeated results; paragraphs of any length are scored whole; a very long paragraph that
quotes a licence is scored window by window (WINDOW words, half overlapping), so that its
other words do not drown the quote.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BITS = 18
#: Ordinary paragraphs the model sees, at most, and characters taken of each document of the sample for them.
BACKGROUND = 4_000
PASSAGES = 120
WINDOW = 64
MIN_PROBABILITY = 0.4
CONFIRM = 0.5
#: A part of a template confirms a family from this many word 3-grams on.
QUOTE = 6

# Short notices in which public licences are named or granted.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "This service is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
    ),
}

FAMILIES = tuple(TEMPLATES)
_TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_hash = _Words()


def _grams(words: list[str], n: int) -> np.ndarray:
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = (acc ^ h[i:len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc


def features(words: list[str]) -> np.ndarray:
    """Distinct hashed indexes of word 2- and 3-grams."""
    return np.unique(np.concatenate([_grams(words, n) for n in (2, 3)]) >> np.uint64(64 - BITS)).astype(np.int64)


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


@dataclass
class LicenseModel:
    index: np.ndarray    # sorted hashed features in use
    weights: np.ndarray  # (features in use, families + 1); the last class is unknown
    bias: np.ndarray
    temperature: float

    def logits(self, f: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.index, f), len(self.index) - 1)
        hit = at[self.index[at] == f]
        return self.weights[hit].sum(axis=0) / np.sqrt(max(len(f), 1)) + self.bias

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        z = self.logits(f) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _template_grams() -> list[list[frozenset[int]]]:
    return [[frozenset(_grams(w, 3).tolist()) for w in map(tokens, TEMPLATES[f])] for f in FAMILIES]


_GRAMS = _template_grams()
#: Words of templates that ordinary paragraphs rarely hold together: a window without a shared word 2-gram is unknown.
_PAIRS = frozenset(g for f in FAMILIES for t in TEMPLATES[f] for g in _grams(tokens(t), 2).tolist())


def agreement(words: list[str], family: int) -> float:
    """Best share of a template's word 3-grams in common, or of the paragraph's if it has QUOTE or more."""
    own = set(_grams(words, 3).tolist())
    best = 0.0
    for t in _GRAMS[family]:
        common = len(own & t)
        best = max(best, common / len(t), common / len(own) if len(own) >= QUOTE else 0.0)
    return best


def _passages(rng: np.random.Generator) -> list[tuple[list[str], int]]:
    out = []
    for k, f in enumerate(FAMILIES):
        words = [tokens(t) for t in TEMPLATES[f]]
        for w in words:
            out += [(w, k)] * 3
        for _ in range(PASSAGES):
            w = words[rng.integers(len(words))]
            if rng.random() < 0.5 and len(w) > 10:
                a = int(rng.integers(0, len(w) - 8))
                w = w[a:a + int(rng.integers(6, len(w) - a + 1))]
            w = [x for x in w if rng.random() > 0.08]
            out.append((w, k))
    return out


def fit(background: list[str], seed: int = 5, steps: int = 200) -> LicenseModel:
    """Fit on template passages and ordinary paragraphs; paragraphs that agree with a template are left out."""
    rng = np.random.default_rng(seed)
    rows = _passages(rng)
    unknown = len(FAMILIES)
    for p in sorted(set(background))[:BACKGROUND]:
        w = tokens(p)[:4 * WINDOW]
        if w and max(agreement(w, k) for k in range(unknown)) < 0.2:
            rows.append((w, unknown))
    # words of licences without a grant, and single words of templates, are unknown too
    pool = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)})
    rows += [([pool[i] for i in rng.integers(0, len(pool), int(rng.integers(1, 9)))], unknown) for _ in range(4 * PASSAGES)]
    feats = [features(w) for w, _ in rows]
    y = np.array([k for _, k in rows])
    # only features of licence passages carry weights: other words count through a paragraph's length
    index = np.unique(np.concatenate([f for f, k in zip(feats, y, strict=True) if k < unknown]))
    value = 1 / np.sqrt([max(len(f), 1) for f in feats])
    feats = [f[np.isin(f, index, assume_unique=True)] for f in feats]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    col = np.searchsorted(index, np.concatenate(feats))
    held = rng.random(len(rows)) < 0.2
    share = np.bincount(y[~held], minlength=unknown + 1).astype(float)
    weight = np.where(held, 0, (len(rows) / (unknown + 1) / np.maximum(share, 1))[y])
    onehot = np.eye(unknown + 1)[y]
    w, b = np.zeros((len(index), unknown + 1)), np.zeros(unknown + 1)
    sq = np.full(w.shape, 1e-8)
    sqb = np.full(b.shape, 1e-8)

    def z_of() -> np.ndarray:
        z = np.empty((len(rows), unknown + 1))
        for c in range(unknown + 1):
            z[:, c] = np.bincount(row, weights=w[col, c], minlength=len(rows)) * value + b[c]
        return z
    for _ in range(steps):
        z = z_of()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        r = (onehot - p) * weight[:, None] / weight.sum()
        g = np.stack([np.bincount(col, weights=(r[:, c] * value)[row], minlength=len(index)) for c in range(unknown + 1)], axis=1) - 1e-6 * w
        sq += g * g
        sqb += r.sum(0)**2
        w += 0.3 * g / np.sqrt(sq)
        b += 0.1 * r.sum(0) / np.sqrt(sqb)
        w[np.abs(w) < 1e-3] = 0  # sparse
    z = z_of()[held]
    best = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum(
        (lambda e: e / e.sum(1, keepdims=True))(np.exp(z / t - (z / t).max(1, keepdims=True)))[np.arange(len(z)), y[held]], 1e-12)).mean()) if held.any() else 1.0
    live = np.abs(w).max(axis=1) > 0
    return LicenseModel(index[live], w[live], b, float(best))


def scan_text(text: str | None, model: LicenseModel) -> list[tuple[int, str, float, float, str]]:
    """(paragraph number, family, probability, template agreement, paragraph) of confirmed paragraphs."""
    out = []
    for k, p in enumerate((text or "").split("\n")):
        words = tokens(p)
        if not words:
            continue
        pairs = _grams(words, 2).tolist()
        near = [i for i, g in enumerate(pairs) if g in _PAIRS]
        if not near:
            continue
        best: dict[str, tuple[float, float]] = {}
        step = WINDOW // 2
        starts = [0] if len(words) <= WINDOW else sorted({max(0, i // step * step - d) for i in near for d in (0, step)})
        for a in starts:
            w = words[a:a + WINDOW]
            # the part between the first and the last shared pair, so that other words around a quote do not count
            at = [i - a for i in near if a <= i < a + len(w) - 1]
            if not at:
                continue
            w = w[max(0, at[0] - 1):at[-1] + 3]
            pr = model.probabilities(features(w))
            c = int(pr.argmax())
            if c < len(FAMILIES) and pr[c] >= MIN_PROBABILITY and (s := agreement(w, c)) >= CONFIRM:
                best[FAMILIES[c]] = max(best.get(FAMILIES[c], (0.0, 0.0)), (float(pr[c]), float(s)))
        out += [(k, f, pr, s, p) for f, (pr, s) in sorted(best.items())]
    return out


def train(docs: DataFrame, text: str = "text") -> LicenseModel:
    """Background: one paragraph each of at most BACKGROUND documents, taken by hash of the text."""
    t = F.col(f"`{text}`")
    share = docs.select(t.alias("t")).filter("t IS NOT NULL")
    n = share.count()
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0)
    h = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    some = (share.filter(h < F.lit(int((1 << 30) * min(1.0, BACKGROUND / max(n, 1))))).select(lines.alias("l"), F.xxhash64("t").alias("h"))
            .filter(F.size("l") > 0).select(F.substring(F.element_at("l", (F.pmod(F.shiftright("h", 32), F.size("l")) + 1).cast("int")), 1, 4000).alias("p")))
    return fit([r["p"] for r in some.limit(2 * BACKGROUND).collect()])


def scan(docs: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, agreement, passage of every confirmed paragraph."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.Table:
        row, cols = [], [[], [], [], [], []]
        for i, t in enumerate(b.column(1)):
            for hit in scan_text(t.as_py(), model):
                row.append(i)
                for c, v in zip(cols, hit, strict=True):
                    c.append(v)
        kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        return pa.Table.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                    names=["doc_id", "paragraph", "family", "probability", "agreement", "passage"])
    return map_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), run,
                       f"doc_id {kind}, paragraph int, family string, probability double, agreement double, passage string")
