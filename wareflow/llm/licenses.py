"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (lines, long ones in overlapping windows) are classified by multinomial logistic regression on
hashed word n-grams, fitted with sparsity on licence templates and on paragraphs of the corpus as the class
"unknown", with calibrated probabilities. A family that the classifier names is reported only if the
paragraph holds most of the word triples of one of that family's templates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, text_slices
from .decontam import NORMAL
from .langid import softmax
from .suffixes import BASE, MIX, MUL, sums_of

UNKNOWN = "unknown"
#: Texts of the corpus, at most about so many, whose paragraphs stand for the class "unknown".
NEGATIVE_TEXTS = 1500
BUCKETS = 1 << 20
WINDOW_WORDS = 64
MIN_PROBABILITY, MIN_SIMILARITY = 0.5, 0.6

# Notices and key paragraphs of public licences, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "Released under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution ShareAlike License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words of normalised bytes."""
    inside = np.concatenate([[False], data != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    x = (data.astype(np.uint64) + np.uint64(1)) * MUL
    sums, inverse = sums_of(x ^ (x >> np.uint64(31)), BASE)
    h = (sums[ends] - sums[starts]) * inverse[starts] * MIX
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of one to three words that start at each word."""
    out, g = [], h
    for n in range(1, 4):
        if n > 1:
            g = (g[:-1] ^ (g[:-1] >> np.uint64(29))) * MIX + h[n - 1 :] * MUL
        out.append(((g ^ (g >> np.uint64(33))) * MUL >> np.uint64(44)).astype(np.int64))
    return out


NORMAL_TABLE = np.frombuffer(NORMAL, np.uint8)


def features(raw: bytes) -> tuple[np.ndarray, int]:
    """Buckets of all n-grams of a paragraph, and its number of words."""
    data = NORMAL_TABLE[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, np.uint8)
    a, b = words_at(data)
    if not len(a):
        return np.zeros(0, np.int64), 0
    return np.concatenate(grams(word_hashes(data, a, b))), len(a)


def triples(raw: bytes) -> set[bytes]:
    words = raw.translate(NORMAL).split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


class Model:
    """Sparse weights of the n-grams that matter, and the templates; its size is set by the templates and the sample."""

    def __init__(self, negatives: list[bytes], seed: int = 5):
        self.families = [UNKNOWN, *TEMPLATES]
        self.templates = {f: [triples(t.encode()) for t in ts] for f, ts in TEMPLATES.items()}
        rng, rows = np.random.default_rng(seed), []
        every = [t for ts in self.templates.values() for t in ts]
        negatives = sorted({n for n in negatives if not any(len(t & triples(n)) >= 0.5 * len(t) for t in every)})
        vocabulary = [w for n in negatives[:200] for w in n.split()] or [b"lorem"]
        for y, family in enumerate(self.families[1:], 1):
            for text in TEMPLATES[family]:
                words = text.encode().split()
                for k in range(24):
                    own = list(words)
                    if k and len(own) > 12:  # a part of it
                        a = int(rng.integers(0, len(own) - 10))
                        own = own[a : a + int(rng.integers(10, len(own) - a + 1))]
                    if k % 3 == 1:  # among other words
                        pick = [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(1, 20)))]
                        own = pick + own if k % 2 else own + pick
                    if k % 5 == 2 and len(own) > 4:  # a word lost
                        del own[int(rng.integers(0, len(own)))]
                    rows.append((b" ".join(own), y))
        rows += [(n, 0) for n in negatives]
        # Words of the templates in other order are unknown, too.
        pool = [w for ts in TEMPLATES.values() for t in ts for w in t.encode().split()]
        rows += [(b" ".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(3, 12)))), 0) for _ in range(300)]
        data = [(b, y) for raw, y in rows for b in [features(raw)] if b[1]]
        order = rng.permutation(len(data))
        held, train = [data[i] for i in order[::6]], [data[i] for k, i in enumerate(order) if k % 6]
        used = np.unique(np.concatenate([b for (b, _), _ in train] or [np.zeros(0, np.int64)]))
        z = np.zeros((len(used) + 1, len(self.families)))
        n = np.zeros_like(z)
        alpha, beta, l1, l2 = 0.8, 1.0, 0.05, 0.05

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

        for _ in range(3):
            for (bucket, size), y in train:
                at = np.append(np.unique(np.searchsorted(used, bucket)), len(used))
                x = np.full(len(at), 1 / np.sqrt(size))
                x[-1] = 1.0
                zi, ni = z[at], n[at]
                w = weights(zi, ni)
                p = softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p[None, :]
                more = ni + g * g
                z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
                n[at] = more
        w = weights(z, n)
        kept = np.flatnonzero(np.abs(w[:-1]).max(axis=1) > 1e-6)
        self.row = np.full(BUCKETS, -1, np.int32)
        self.row[used[kept]] = np.arange(len(kept))
        self.w, self.bias, self.temperature = w[kept], w[-1], 1.0
        scores = [(self.logits(b, size), y) for (b, size), y in held]
        loss = lambda t: -float(np.mean([np.log(max(softmax(s / t)[y], 1e-300)) for s, y in scores])) if scores else 0.0
        self.temperature = float(min(np.exp(np.linspace(np.log(0.1), np.log(5), 60)), key=loss))

    def logits(self, bucket: np.ndarray, size: int) -> np.ndarray:
        rows = np.unique(bucket[self.row[bucket] >= 0])
        return self.w[self.row[rows]].sum(axis=0) / np.sqrt(max(size, 1)) + self.bias

    def findings(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str, float, float]]:
        """(text, first, end, family, probability, similarity) of the paragraphs of a step that name a licence."""
        low = NORMAL_TABLE[data]
        a, b = words_at(low)
        if not len(a):
            return []
        # A word that would span two texts is cut where the second one starts.
        cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
        split = np.searchsorted(a, cut[(cut > 0) & (cut < len(data))], "right") - 1
        inside = cut[(cut > 0) & (cut < len(data))]
        hit = (split >= 0) & (a[np.maximum(split, 0)] < inside) & (b[np.maximum(split, 0)] > inside)
        a, b = np.sort(np.concatenate([a, inside[hit]])), np.sort(np.concatenate([b, inside[hit]]))
        h = word_hashes(low, a, b)
        line = np.searchsorted(cut, a, "right") - 1
        first = np.searchsorted(line, line, "left")
        place = np.arange(len(a)) - first
        out = {}
        hits = []
        for n, g in enumerate(grams(h)):
            r = self.row[g]
            at = np.flatnonzero(r >= 0)
            at = at[line[at] == line[at + n]]
            hits.append((at, g[at]))
        at, bucket = (np.concatenate(c) for c in zip(*hits, strict=True))
        for shift in (0, WINDOW_WORDS // 2):  # paragraphs, and the overlapping windows of long ones
            window = first + np.maximum(0, (place + shift) // WINDOW_WORDS * WINDOW_WORDS - shift)
            own = window[at]
            key = np.unique(own * np.int64(BUCKETS) + bucket)
            own, rows = key // BUCKETS, self.row[key % BUCKETS]
            names, group = np.unique(own, return_inverse=True)
            if not len(names):
                continue
            size = np.bincount(np.searchsorted(names, window[np.isin(window, names)]), minlength=len(names))
            logits = np.stack([np.bincount(group, weights=self.w[rows, c], minlength=len(names)) for c in range(len(self.families))], axis=1)
            logits = (logits / np.sqrt(np.maximum(size, 1))[:, None] + self.bias) / self.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for k in np.flatnonzero((best > 0) & (p[np.arange(len(best)), best] >= MIN_PROBABILITY)).tolist():
                s, e = int(a[names[k]]), int(b[names[k] + size[k] - 1])
                have, family = triples(data[s:e].tobytes()), self.families[best[k]]
                same = max(len(have & t) / len(t) for t in self.templates[family])
                if same >= MIN_SIMILARITY:
                    text = int(np.searchsorted(offsets, s, "right")) - 1
                    out[(text, s, family)] = (text, s - int(offsets[text]), e - int(offsets[text]), family, float(p[k, best[k]]), same)
        return sorted(out.values())


def train(docs: DataFrame, negatives: int = NEGATIVE_TEXTS) -> Model:
    """Fit the classifier; the class "unknown" comes from paragraphs of about ``negatives`` distinct texts of ``docs``."""
    texts = docs.select("text").where("text IS NOT NULL")
    n = texts.select(F.countDistinct(F.xxhash64("text"))).first()[0]
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    lines = F.split(F.col("text"), "\n")
    middle = F.element_at(lines, F.floor((F.size(lines) + 1) / 2).cast("int"))
    rows = texts.where(draw < min(1.0, negatives / max(1, n))).dropDuplicates(["text"]).select(F.substring(middle, F.lit(1), F.lit(600)).alias("p")).collect()
    return Model([r.p.encode() for r in rows if r.p])


FINDING = "array<struct<first: int, end: int, family: string, probability: double, similarity: double>>"


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "licenses") -> DataFrame:
    """Add ``out`` to ``docs``: licence paragraphs as (byte span, family, probability, similarity to the template).

    Null and empty texts have none. Whole texts are scanned, all rows stay (repeated rows too), no shuffle. A column named ``out``
    is refused.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    spark, names = docs.sparkSession, docs.columns
    ready(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found: list[list[dict]] = []
            for _, data, offsets in text_slices(batch.column(text), 1 << 20):
                own: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
                for k, a, b, family, p, same in m.findings(data, offsets) if len(data) else []:
                    own[k].append({"first": a, "end": b, "family": family, "probability": p, "similarity": same})
                found += own
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {out: pa.array(found, kind)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(FINDING))]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_findings, families (sorted, comma-joined), probability (greatest; 0 if none), licenses."""
    done = scan(docs.select("doc_id", "text"), train(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.col("licenses.family"))), ",")
    return done.select("doc_id", F.size("licenses").cast("long").alias("n_findings"), families.alias("families"), F.coalesce(F.array_max("licenses.probability"), F.lit(0.0)).alias("probability"), "licenses")
