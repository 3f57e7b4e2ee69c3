"""Toxicity by a convolutional text classifier (operator 7).

A word is the sum of the embeddings of its hash and of the hashes of its first letters, so that
inflected forms share what their stems have learnt. Filters of several widths slide over the words,
the strongest answer of each filter over the whole text counts (max pooling), and a logistic layer
makes the score. Trained with numpy in one task from a bounded sample of labelled documents; the
model is sent to the executors and scores whole texts there. A hash that the sample shows in too few
documents has no embedding, and a hash is compared in full, so unknown words say nothing.

Scores know the text alone. Thresholds are set by language from all labelled documents of the
calibration fold, so that at most ``MOST_FALSE`` of the clean ones lie above.

Defined cases: null and empty texts get the score of a text without a known word; null labels teach
nothing; a doc_id labelled twice is toxic if any label says so; of several texts of a doc_id, the
smallest teaches; a null or unlabelled language gets the
threshold of all languages; without both classes every score is the share of toxic labels; other
columns are kept, but for those named score, threshold or toxic. Memory: the words of the longest document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumencat.llm.columns import apart, together
from lumencat.llm.textvec import separators, stretches, word_hashes
from lumencat.sources.storage import materialize

#: The sample: so many documents of each class, none longer than MOST_CHARS.
SAMPLE, MOST_CHARS = 1500, 50_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
HEADS = (4, 5, 6)
FEWEST_DOCS, BUCKETS = 5, 1 << 20
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 32, 0.02, 1e-4, 7
MOST_FALSE = 0.005
_PAD = max(WIDTHS) - 1
_ROWS = 1 << 17

_APART = separators(bytes(b for b in range(128) if not chr(b).isalnum()))


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


@dataclass
class Model:
    known: np.ndarray  # the hash of each embedding; row 0 is of no word
    embeddings: np.ndarray
    kernels: list[np.ndarray]  # per width: width x SIZE x FILTERS
    biases: np.ndarray
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self) -> None:
        self.bucket = np.zeros(BUCKETS, np.int32)
        self.bucket[(self.known[1:] & np.uint64(BUCKETS - 1)).astype(np.int64)] = np.arange(1, len(self.known))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The embedding of each hash, 0 where it has none."""
        at = self.bucket[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
        return np.where(self.known[at] == hashes, at, 0)

    def words(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.embeddings[r] for r in rows)

    def answers(self, x: np.ndarray) -> np.ndarray:
        """What each filter says at each word; ``x`` ends with padding."""
        n = len(x) - _PAD
        return np.concatenate(
            [sum(x[j : j + n] @ k[j] for j in range(len(k))) for k in self.kernels], axis=1) + self.biases

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The strongest answer of each filter in one text, in stretches of bounded size."""
        rows = np.pad(rows, ((0, 0), (0, 1 + _PAD)))
        n = rows.shape[1] - _PAD
        best = [self.answers(self.words(rows[:, a : min(a + _ROWS, n) + _PAD])).max(axis=0) for a in range(0, n, _ROWS)]
        return np.max(best, axis=0)

    def score(self, column: pa.Array) -> np.ndarray:
        scores = [self._score(part) for part in stretches(column)]
        return np.concatenate(scores) if scores else np.zeros(0)

    def _score(self, column: pa.Array) -> np.ndarray:
        hashes, begins = word_hashes(column, _APART, heads=HEADS)
        pooled, first = np.zeros((len(column), len(self.biases)), np.float32), 0
        while first < len(column):
            # Short texts go together, with padding after each.
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + _ROWS, side="right")) - 1)
            if last == first + 1:
                pooled[first] = self.pooled(self.rows(hashes[:, begins[first] : begins[last]]))
            else:
                sizes = np.diff(begins[first : last + 1])
                starts = begins[first:last] - begins[first] + np.arange(last - first) * (1 + _PAD)
                rows = np.zeros((len(hashes), int(sizes.sum()) + (last - first) * (1 + _PAD)), np.int64)
                place = np.arange(sizes.sum()) + np.repeat(np.arange(last - first) * (1 + _PAD), sizes)
                rows[:, place] = self.rows(hashes[:, begins[first] : begins[last]])
                said = self.answers(self.words(np.pad(rows, ((0, 0), (0, _PAD)))))
                for k in range(1, _PAD + 1):  # where a filter would reach into the next text
                    said[starts + sizes + 1 + _PAD - k] = -np.inf
                pooled[first:last] = np.maximum.reduceat(said, starts)
            first = last
        return self.probability(self.logit(pooled))

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.offset

    def probability(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits.astype(np.float64) + b, -30, 30)))


def _vocabulary(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hashes that at least FEWEST_DOCS documents have, one for each bucket."""
    often = np.zeros(0, np.uint64)
    for head in hashes:  # one after the other, for the driver's memory
        own = [np.unique(head[a:b]) for a, b in zip(begins[:-1], begins[1:])]
        values, counts = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
        often = np.union1d(often, values[counts >= FEWEST_DOCS])
    _, one = np.unique(often & np.uint64(BUCKETS - 1), return_index=True)
    return np.concatenate([np.zeros(1, np.uint64), often[one]])


def train(texts: pa.Array, toxic: np.ndarray, calibrate: np.ndarray) -> Model:
    """Fit on the rows that are not ``calibrate``; those set the scale of the scores."""
    rng = np.random.default_rng(SEED)
    hashes, begins = word_hashes(texts, _APART, heads=HEADS)
    n_filters = FILTERS * len(WIDTHS)
    model = Model(
        known := _vocabulary(hashes, begins),
        np.zeros((len(known), SIZE), np.float32),
        [rng.normal(0, 0.5 / np.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.3, n_filters).astype(np.float32),
        0.0,
    )
    share = float(toxic.mean()) if len(toxic) else 0.0
    fit = np.flatnonzero(~calibrate)
    if len(np.unique(toxic[fit])) < 2:
        model.out[:] = 0
        model.scale = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        return model
    model.embeddings[1:] = rng.normal(0, 0.1, (len(known) - 1, SIZE))
    rows = np.stack([model.rows(head) for head in hashes])
    del hashes
    texts_rows = [np.pad(rows[:, a:b], ((0, 0), (0, 1 + 2 * _PAD))) for a, b in zip(begins[:-1], begins[1:])]
    dense = [*model.kernels, model.biases, model.out]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    squares, step = np.full(len(known), 1e-8, np.float32), 0
    widths = np.repeat(WIDTHS, FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(fit)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            step += 1
            gradients = [np.zeros_like(p) for p in dense]
            touched, pushes = [], []
            for d in chosen:
                r = texts_rows[d]
                x = model.words(r)
                said = model.answers(x)
                where = said.argmax(axis=0)
                pooled = said[where, np.arange(n_filters)]
                active = np.maximum(pooled, 0)
                logit = float(active @ model.out + model.offset)
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[d]) / len(chosen)
                gradients[-1] += error * active
                back = error * model.out * (pooled > 0)
                gradients[-2] += back
                model.offset -= rate * error
                for f in np.flatnonzero(back):
                    w, k = widths[f], f % FILTERS
                    layer = WIDTHS.index(w)
                    spot = slice(where[f], where[f] + w)
                    gradients[layer][:, :, k] += back[f] * x[spot]
                    push = back[f] * model.kernels[layer][:, :, k]
                    for head in r[:, spot]:
                        touched.append(head)
                        pushes.append(push)
            for p, g, m, v in zip(dense, gradients, first, second):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            if touched:
                places, which = np.unique(np.concatenate(touched), return_inverse=True)
                change = np.zeros((len(places), SIZE), np.float32)
                np.add.at(change, which, np.concatenate(pushes))
                change += DECAY * model.embeddings[places]
                squares[places] += (change * change).mean(axis=1)
                model.embeddings[places] -= 0.1 * change / np.sqrt(squares[places])[:, None]
                model.embeddings[0] = 0
    held = np.flatnonzero(calibrate) if len(np.unique(toxic[calibrate])) == 2 else fit
    logits = model.logit(np.array([model.pooled(texts_rows[d]) for d in held]))
    model.scale = _platt(logits.astype(np.float64), toxic[held])
    return model


def _platt(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit of the labels to the logits, by Newton's method."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([logits, np.ones_like(logits)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - target)), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


_SAMPLE_COLUMNS = "doc_id long, text string, _toxic long, _fold long"


def _learn(rows: pa.Table) -> Model:
    rows = rows.sort_by("doc_id")
    return train(
        rows["text"].combine_chunks(), rows["_toxic"].to_numpy().astype(np.int64), rows["_fold"].to_numpy() == CALIBRATION)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on up to ``sample`` labelled documents of each class, never on those held out.

    The sample, a text per doc_id, goes to one task, which trains; the driver gets the model alone.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold() != HELD_OUT)
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = picked[0].union(picked[1]).withColumnRenamed("toxic", "_toxic")
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")  # 2 * sample rows
        .where(F.length("text") <= MOST_CHARS)
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").cast("long").alias("_toxic"))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_toxic", fold().cast("long").alias("_fold"))
    )
    names, kinds = zip(*[c.split() for c in _SAMPLE_COLUMNS.split(", ")])
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in zip(names, kinds)])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _learn(pa.Table.from_batches([b.cast(schema) for b in batches], schema))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learnt = rows.coalesce(1).mapInArrow(learn, "model binary").first()  # 2 * sample rows
    return pickle.loads(learnt["model"]) if learnt else _learn(schema.empty_table())


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a ``score``, and without ``text`` unless it is kept."""
    docs = docs.drop("score", "threshold", "toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    out = [*others, "text"] if keep_text else others
    rows = docs.select(*others, F.col("text").cast("string").alias("text"))
    schema = rows.select(*out, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(batch.column(len(others)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(scores)], [*out, "score"])

    return rows.mapInArrow(run, schema)


def thresholds(scored: DataFrame, labels: DataFrame, most_false: float = MOST_FALSE) -> DataFrame:
    """(lang, threshold), with a null language for all: from the clean documents of the fold."""
    clean = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 0")
    held = scored.where(fold() == CALIBRATION).join(clean.select("doc_id"), "doc_id", "left_semi")
    above = F.greatest(F.lit(0.5), F.percentile_approx("score", F.lit(1 - most_false), F.lit(100_000)))
    return held.where("lang is not null").groupBy("lang").agg(above.alias("threshold")).union(
        held.agg(above.alias("threshold")).select(F.lit(None).cast("string"), F.coalesce("threshold", F.lit(0.5))))


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` with ``threshold`` and ``toxic`` (the score is over the threshold of the language)."""
    own = limits.where("lang is not null").withColumnRenamed("lang", "_lang")
    general = limits.where("lang is null").select(F.col("threshold").alias("_general"))
    # A row per language, and one.
    joined = scored.join(F.broadcast(own), F.col("lang") == F.col("_lang"), "left").join(F.broadcast(general))
    return joined.withColumn("threshold", F.coalesce("threshold", "_general")).drop("_lang", "_general").withColumn(
        "toxic", F.col("score") > F.col("threshold"))


def remove_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_false: float = MOST_FALSE) -> DataFrame:
    """``docs`` without those whose score is over the threshold of their language.

    The calibration fold is scored ahead for the thresholds, so no text is shuffled or written twice.
    """
    model = fit(docs, labels, sample)
    fold_rows = docs.select("doc_id", "lang", "text").where(fold() == CALIBRATION)
    limits = materialize(thresholds(score(fold_rows, model), labels, most_false), "thresholds")
    rows = apart(docs, ["doc_id", "text", "lang"])
    return together(judge(score(rows, model), limits).where("not toxic"), docs)
