"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters over lower-cased letters are hashed to a fixed number of buckets. Document
frequencies cover all training rows. The weights are fitted with follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties) on a bounded sample, and the scores calibrated with a temperature.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ready, text_slices

BUCKETS = 1 << 16
#: Training texts that the weights are fitted on, at most about so many for each language and in all.
PER_LANGUAGE, ALL_LANGUAGES = 1000, 8000
UNKNOWN = "und"


@lru_cache(1)
def folded() -> np.ndarray:
    """Lower-case form of each code point that is a letter or a mark, a space for all others."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(ch := chr(c))[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(1)
def is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of each text with single spaces between words and around it, offsets, and numbers of letters."""
    lead = (data & 0xC0) != 0x80
    raw = data.tobytes()
    try:
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are not UTF-8 count as spaces
        cp, lead = np.where(data < 0x80, data, 32).astype(np.uint32), np.ones(len(data), bool)
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    n_letters = np.diff(np.concatenate([[0], np.cumsum(is_letter()[cp])])[at])
    n = len(offsets) - 1
    out = np.full(len(cp) + 2 * n, 32, np.uint32)
    edge = at + 2 * np.arange(n + 1)
    put = np.arange(len(cp)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1
    out[put] = folded()[cp]
    first = np.zeros(len(out), bool)
    first[edge[:-1]] = True
    keep = first | (out != 32) | np.concatenate([[True], out[:-1] != 32])
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[edge], n_letters


def buckets(cp: np.ndarray) -> list[np.ndarray]:
    """Hash buckets of the n-grams of one, two and three characters that start at each place."""
    x = cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out, h = [], x
    for n in range(1, 4):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[n - 1 :]
        out.append(((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
    return out


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text of a step: its buckets and how often each occurs; no letters give none."""
    cp, at, n_letters = letters(data, offsets)
    grams = buckets(cp)
    for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), n_letters.tolist(), strict=True):
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        count = np.bincount(np.concatenate([g[a : b - k] for k, g in enumerate(grams)]), minlength=BUCKETS)
        where = np.flatnonzero(count)
        yield where, count[where]


class Model:
    """Weights, inverse document frequencies and temperature; its size depends on buckets and languages only."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights = np.zeros((BUCKETS + 1, len(languages)))  # the last row is the bias
        self.temperature = 1.0

    def features(self, where: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[where]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, where: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[where] + self.weights[-1]

    def predict(self, where: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        if not len(where) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(where, self.features(where, count)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def fit(self, rows: Iterable[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        """Fit on (buckets, counts, language number); every fifth row is kept for the temperature. A ``Sample`` is fitted in a task."""
        if isinstance(rows, Sample):
            self.weights, self.temperature = rows.fitted(self, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
            return
        data = [(np.append(w, np.array(BUCKETS, w.dtype)), np.append(self.features(w, c), 1.0), y) for w, c, y in rows if len(w)]
        order = np.random.default_rng(7).permutation(len(data))
        held = [data[k] for k in order[::5]] if len(data) >= 20 else data
        train = [data[k] for i, k in enumerate(order) if i % 5 or len(data) < 20]
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

        for _ in range(epochs):
            for where, x, y in train:
                zi, ni = z[where], n[where]
                w = weights(zi, ni)
                p = softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p[None, :]
                more = ni + g * g
                z[where] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
                n[where] = more
        self.weights = weights(z, n)
        scores = [(x @ self.weights[where], y) for where, x, y in held]

        def loss(t: float) -> float:
            return -float(np.mean([np.log(max(softmax(s / t)[y], 1e-300)) for s, y in scores])) if scores else 0.0

        grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
        best = min(grid, key=loss)
        self.temperature = float(min(best * np.exp(np.linspace(-0.1, 0.1, 21)), key=loss))


class Sample:
    """Rows (lang, k, n) of a DataFrame as (buckets, counts, language number), read as one iterates; ``fitted`` leaves them to one task."""

    def __init__(self, rows: DataFrame, languages: list[str]):
        self.rows, self.number = rows, {lang: i for i, lang in enumerate(languages)}

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for r in self.rows.toLocalIterator():
            yield np.array(r.k, np.int32), np.array(r.n, np.int32), self.number[r.lang]

    def fitted(self, model: Model, **rates: float) -> tuple[np.ndarray, float]:
        """Weights and temperature. The sample is bounded, so one task holds it; the driver gets the weights alone."""
        languages, idf, number = model.languages, model.idf, self.number

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Fit on all rows, in the same order whatever the order of tasks."""
            rows = []
            for batch in batches:
                lang, ks, ns = batch.column("lang").to_pylist(), batch.column("k"), batch.column("n")
                rows += [(ks[i].values.to_numpy(), ns[i].values.to_numpy(), number[lang[i]]) for i in range(len(lang))]
            own = Model(languages, idf)
            own.fit(sorted(rows, key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes())), **rates)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([own.weights.tobytes()], pa.binary()), "temperature": pa.array([own.temperature])})

        made = self.rows.repartition(1).mapInArrow(run, "weights binary, temperature double").first()
        return np.frombuffer(made.weights, np.float64).reshape(model.weights.shape), made.temperature


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit a model on ``docs`` (text, lang): all rows for document frequencies, a bounded sample for weights.

    The sample takes of each language the distinct texts of least hash, about ``per_language`` of them (fewer with many languages), and of each of these
    texts a short piece too. Rows whose lang or text is null don't count. No rows give a model that knows no language.
    """
    ready(docs.sparkSession)
    docs = docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), 1 << 20):
                for where, _ in counted(data, offsets):
                    df[where] += 1
                df[BUCKETS] += len(offsets) - 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k.astype(np.int32)), "n": pa.array(df[k])})

    df = np.zeros(BUCKETS + 1)
    met = docs.select("text").mapInArrow(frequencies, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df[met.column("k").to_numpy()] = met.column("n").to_numpy()
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.countDistinct(F.xxhash64("text", "lang")).alias("n")).collect()}
    model = Model(sorted(sizes), np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1)
    if not sizes:
        return model
    per_language = min(per_language, max(1, ALL_LANGUAGES // len(sizes)))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = docs.where(draw < share[F.col("lang")]).dropDuplicates(["text", "lang"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text"), 1 << 20):
                langs = batch.column("lang").slice(at, len(offsets) - 1).to_pylist()
                pieces = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = data[a:b].tobytes().split()
                    skip = (b - a) % max(1, len(words) - 8)
                    pieces.append(b" ".join(words[skip : skip + 3 + (b - a) % 9]))
                short = np.frombuffer(b"".join(pieces), np.uint8)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                rows = [*counted(data, offsets), *counted(short, ends)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs + langs, pa.string()), "k": pa.array([w.astype(np.int32) for w, _ in rows], pa.list_(pa.int32())), "n": pa.array([c.astype(np.int32) for _, c in rows], pa.list_(pa.int32()))})

    model.fit(Sample(sample.mapInArrow(features, "lang string, k array<int>, n array<int>"), model.languages))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the language and its calibrated probability to ``docs``; whole texts, no shuffle.

    A text that is null, empty or without a letter gets ``und`` with score 0. All rows and columns stay.
    """
    for name in (lang_out, score_out):
        if name in docs.columns:
            raise ValueError(f"column {name} exists")
    spark, names = docs.sparkSession, docs.columns
    ready(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            lang, score = [], []
            for _, data, offsets in text_slices(batch.column(text), 1 << 20):
                for where, count in counted(data, offsets):
                    a, b = m.predict(where, count)
                    lang.append(a)
                    score.append(b)
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {lang_out: pa.array(lang, pa.string()), score_out: pa.array(score, pa.float64())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def report(docs: DataFrame, held_out: int = 2, parts: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose fold isn't ``held_out``."""
    apart = fold(F.col("doc_id"), parts) == held_out
    model = train(docs.where(~apart))
    return predict(docs.select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "text"), model).drop("text")


#: Least probability of a language for a text to stay in a corpus.
MIN_SCORE = 0.35


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` (text, lang) that have a letter and a likely language of those learned from ``docs``."""
    a, b = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    apart = fold(F.col("doc_id"), 4) == 2
    scored = predict(docs, train(docs.where(~apart)), lang_out=a, score_out=b)
    return scored.where((F.col(a) != UNKNOWN) & (F.col(b) >= min_score)).drop(a, b)
