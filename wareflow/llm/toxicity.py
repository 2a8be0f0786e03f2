"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

A bounded sample of labelled texts is the index. Its terms are all words of the sample; their document
frequencies are counted over all documents. Posting lists are cut into blocks
of examples with the largest weight of each term in each block, so that blocks whose bound is below the
k-th best cosine are never opened. Votes of the neighbours, weighted by distance, are calibrated on the sample,
each example against all others, which also decides the number of neighbours. Labels count in the calibration by the square
root of their number, so that a score of a half lies between the natural and the even odds of the rare label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranges, ready, text_slices, written
from .decontam import NORMAL
from .langid import fold

#: Labelled texts in the index, at most about so many with label 1 and with label 0.
POSITIVES, NEGATIVES = 1000, 2000
#: Numbers of neighbours to choose from; the best one is found on the sample.
NEIGHBOURS = (5, 15, 31, 63)
BLOCK = 256
EVIDENCE = 3


def terms_of(raw: bytes) -> list[bytes]:
    """Words of letters and digits, lower-cased."""
    return raw.decode("utf-8", "replace").lower().encode().translate(NORMAL).split()


class Index:
    """Block-max inverted index of the labelled examples."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, rows: list[tuple[int | None, int, dict[int, int]]], priors: tuple[float, float], neighbours: tuple[int, ...] = NEIGHBOURS):
        """rows: (id, label, {term number: count}); priors: weight of an example with label 0 and with label 1."""
        self.terms, self.idf, self.k = {t: i for i, t in enumerate(terms)}, idf, max(neighbours)
        vectors = [self.weights(c) for _, _, c in rows]
        self.empty = np.zeros(2)
        full = []
        for (i, y, _), v in zip(rows, vectors, strict=True):
            if v[0].size:
                full.append((i, y, v))
            else:
                self.empty[y] += priors[y]
        # Examples with the same strongest terms lie in the same blocks, which makes the bounds tight.
        full.sort(key=lambda e: (e[2][0][np.argsort(-e[2][1], kind="stable")][:3].tolist(), -1 if e[0] is None else e[0]))
        self.ids = [e[0] for e in full]
        self.label = np.array([e[1] for e in full], np.int64)
        self.vote = np.array([priors[e[1]] for e in full])
        n, m = len(full), len(terms)
        self.blocks = max(1, -(-n // BLOCK))
        term = np.concatenate([e[2][0] for e in full] or [np.zeros(0, np.int64)])
        example = np.repeat(np.arange(n), [len(e[2][0]) for e in full])
        weight = np.concatenate([e[2][1] for e in full] or [np.zeros(0)])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        key = term[order] * self.blocks + self.example // BLOCK
        self.start = np.searchsorted(key, np.arange(m * self.blocks + 1))
        self.best = np.zeros(m * self.blocks)
        np.maximum.at(self.best, key, self.weight)
        self.best = self.best.reshape(m, self.blocks)
        self.scale = (0.0, 1.0)
        self.prior = float(np.clip(sum(priors[y] for _, y, _ in rows if y) / max(sum(priors[y] for _, y, _ in rows), 1e-12), 0, 1)) if rows else 0.0
        found = self.nearest_of([v for _, _, v in full], np.arange(n))
        weight = np.array([1 / math.sqrt(max(1, (self.label == y).sum())) for y in (0, 1)])[self.label] if n else np.zeros(0)
        fits = [(*self.fit(np.array([self.share(p[:k], c[:k]) for p, c in found]), weight), k) for k in neighbours] if len(set(self.label.tolist())) == 2 else []
        if fits:
            _, self.scale, self.k = min(fits, key=lambda f: (f[0], f[2]))

    def weights(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        where = np.array(sorted(counts), np.int64)
        x = (1 + np.log([counts[t] for t in where.tolist()])) * self.idf[where] if len(where) else np.zeros(0)
        size = math.sqrt(float((x * x).sum()))
        return where, x / size if size else x

    def vector(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.weights({self.terms[w]: n for w, n in Counter(terms_of(raw)).items() if w in self.terms})

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the k examples of greatest cosine above 0, ties by place; exact.

        Every vector opens its blocks in the order of their bounds, in rounds of 1, 2, 4 ... blocks for all vectors at
        once, until no closed block can hold an example better than its k-th one. ``skip``: an example for each that doesn't count.
        """
        out = []
        for at in range(0, len(vectors), 256):
            own = vectors[at : at + 256]
            size = np.array([len(w) for w, _ in own])
            first = np.cumsum(size) - size
            where = np.concatenate([w for w, _ in own]).astype(np.int64)
            x = np.concatenate([v for _, v in own])
            cosine = np.zeros((len(own), self.blocks * BLOCK))
            bound = np.zeros((len(own), self.blocks))
            some = np.flatnonzero(size)
            if len(some):
                bound[some] = np.add.reduceat(self.best[where] * x[:, None], first[some], axis=0)
            order = np.argsort(-bound, axis=1, kind="stable")
            floor, done, step = np.zeros(len(own)), 0, 1
            while done < self.blocks:
                many = order[:, done : done + step]
                reach = np.take_along_axis(bound, many, axis=1)
                q, r = np.nonzero((reach > 0) & (reach >= floor[:, None] - 1e-12))
                if not len(q):
                    break
                terms = ranges(first[q], size[q])
                block = np.repeat(many[q, r], size[q])
                cell = where[terms] * self.blocks + block
                n = self.start[cell + 1] - self.start[cell]
                post = ranges(self.start[cell], n)
                flat = np.repeat(np.repeat(q, size[q]) * cosine.shape[1], n) + self.example[post]
                cosine += np.bincount(flat, weights=self.weight[post] * np.repeat(x[terms], n), minlength=cosine.size).reshape(cosine.shape)
                if skip is not None:
                    cosine[np.arange(len(own)), skip[at : at + len(own)]] = 0.0
                if cosine.shape[1] > self.k:
                    floor = np.partition(cosine, -self.k, axis=1)[:, -self.k]
                done, step = done + step, 2 * step
            q, place = np.nonzero((cosine > 0) & (cosine >= floor[:, None]))
            value = cosine[q, place]
            best = np.lexsort((place, -value, q))
            edge = np.searchsorted(q, np.arange(len(own) + 1))
            out += [(place[best[a:b]][: self.k], np.minimum(value[best[a:b]][: self.k], 1.0)) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return out

    def nearest(self, where: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(where, x)])[0]

    def share(self, places: np.ndarray, cosine: np.ndarray) -> float:
        """Share of the neighbours' votes for label 1; without neighbours that of the examples without a term, or of all."""
        if not len(places):
            total = self.empty.sum()
            return float(self.empty[1] / total) if total else self.prior
        w = self.vote[places] / (1.05 - cosine)
        return float((w * self.label[places]).sum() / w.sum())

    def fit(self, share: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, tuple[float, float]]:
        """Loss and scale of the logistic calibration of the vote share's log odds, by Newton steps."""
        y, w = self.label.astype(float), weight / weight.mean()
        x = np.stack([np.ones(len(y)), log_odds(share)], axis=1)
        beta = np.array([0.0, 1.0])
        chance = lambda: 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        for _ in range(rounds):
            p = chance()
            grad = x.T @ (w * (p - y)) + 1e-3 * (beta - [0.0, 1.0])
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            beta = beta - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if beta[1] <= 0:
            beta = np.array([0.0, 1.0])
        p = chance()
        return -float(np.mean(w * (y * np.log(p) + (1 - y) * np.log1p(-p)))), (float(beta[0]), float(beta[1]))

    def scores(self, texts: list[bytes]) -> list[tuple[float, list[tuple[int | None, int, float]]]]:
        """(score, evidence) of each text."""
        out = []
        for places, cosine in self.nearest_of([self.vector(t) for t in texts]):
            share = self.share(places, cosine)
            if len(places):
                share = float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale[0] + self.scale[1] * float(log_odds(share)))))))
            out.append((share, [(self.ids[p], int(self.label[p]), float(c)) for p, c in zip(places[:EVIDENCE].tolist(), cosine[:EVIDENCE].tolist(), strict=True)]))
        return out


def log_odds(s: np.ndarray) -> np.ndarray:
    s = np.clip(s, 0.005, 0.995)
    return np.log(s / (1 - s))


def build(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Index:
    """Index labelled texts of ``docs`` (doc_id, text); ``labels`` (doc_id, toxic) are those that may be learned from.

    Examples: of each label the ids of least hash, about ``positives`` and ``negatives``; repeated texts count once. Null
    labels and texts are no examples; an id with several labels has their rounded mean. All words of the examples are terms,
    whatever their length; document frequencies cover all texts. Ids are long, int or string, in both tables alike.
    """
    spark = docs.sparkSession
    ready(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("toxic") == 1, min(1.0, positives / max(1, sizes.get(1, 0)))).otherwise(min(1.0, negatives / max(1, sizes.get(0, 0))))
    chosen = given.where(F.col("toxic").isin(0, 1)).where(draw < share)
    if sum(n * min(1.0, most / n) for (y, n) in sizes.items() if y in (0, 1) for most in [positives if y else negatives]) <= 4 * (POSITIVES + NEGATIVES):
        chosen = F.broadcast(chosen)  # about so many rows
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text"), 1 << 20):
                raw, ends = data.tobytes(), offsets.tolist()
                counts = [Counter(terms_of(raw[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                cols = {c: batch.column(c).slice(at, len(counts)) for c in ("doc_id", "toxic", "copy")}
                yield pa.RecordBatch.from_pydict(cols | {"words": pa.array([list(c) for c in counts], pa.list_(pa.binary())), "n": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))})

    one = sample.withColumn("copy", F.xxhash64("text")).mapInArrow(count, f"doc_id {id_type}, toxic int, copy long, words array<binary>, n array<int>")
    one = written(one)
    first = one.groupBy("copy").agg(F.min("doc_id").alias("doc_id"))
    one = one.join(first, ["copy", "doc_id"]).dropDuplicates(["copy", "doc_id"]).orderBy("doc_id")
    rows, number = [], {}
    for batch in one.select("doc_id", "toxic", "words", "n").toArrow().to_batches():  # positives + negatives texts in the mean
        for i, y, words, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((i, y, {number.setdefault(w, len(number)): n for w, n in zip(words, ns, strict=True)}))
    terms = list(number)
    n1 = sum(y for _, y, _ in rows)
    n0 = len(rows) - n1
    sent = spark.sparkContext.broadcast(number)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        df = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), 1 << 20):
                raw, ends = data.tobytes(), offsets.tolist()
                for s, e in zip(ends[:-1], ends[1:], strict=True):
                    df[[known[w] for w in set(terms_of(raw[s:e])) if w in known]] += 1
                df[-1] += len(ends) - 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k.astype(np.int32)), "n": pa.array(df[k])})

    df = np.zeros(len(terms) + 1)
    if terms:
        counted = docs.select("text").mapInArrow(frequencies, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
        df[counted.column("k").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    weight = (sizes.get(0, 0) / max(1, n0), sizes.get(1, 0) / max(1, n1))
    mean = max(1e-12, (weight[0] * n0 + weight[1] * n1) / max(1, n0 + n1))
    return Index(terms, idf, rows, (weight[0] / mean, weight[1] / mean))


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Add score (0 to 1), predicted (score of a half or more) and evidence to ``docs``; whole texts, no shuffle.

    evidence: the nearest examples as (doc_id, label, cosine). Texts that share no term with the index, such as null
    and empty ones, get the share of label 1 among such examples, or among all if there are none. All rows stay. Columns named score,
    predicted or evidence, in any case, are refused.
    """
    for name in ("score", "predicted", "evidence"):
        if name in {c.lower() for c in docs.columns}:
            raise ValueError(f"column {name} exists")
    id_type = docs.schema["doc_id"].dataType
    arrow_id = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}.get(id_type)
    if arrow_id is None:
        raise TypeError(f"doc_id: {id_type.simpleString()} is not supported")
    spark, names = docs.sparkSession, docs.columns
    ready(spark)
    sent = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", arrow_id), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            values, evidence = [], []
            for _, data, offsets in text_slices(batch.column(text), 1 << 20):
                raw, ends = data.tobytes(), offsets.tolist()
                for s, near in own.scores([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]):
                    values.append(s)
                    evidence.append([{"doc_id": i, "label": y, "cosine": c} for i, y, c in near])
            s = np.array(values, float)
            cols = {n: batch.column(n) for n in names}
            yield pa.RecordBatch.from_pydict(cols | {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32)), "evidence": pa.array(evidence, kind)})

    more = f"score double, predicted int, evidence array<struct<doc_id: {id_type.simpleString()}, label: int, cosine: double>>"
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(more).fields]))


def report(docs: DataFrame, labels: DataFrame, held_out: int = 0, parts: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; learned from labels whose fold isn't ``held_out``."""
    index = build(docs, labels.where(fold(F.col("doc_id"), parts) != held_out))
    apart = F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False))
    return score(docs.select("doc_id", apart.alias("held_out"), "text"), index).drop("text")
