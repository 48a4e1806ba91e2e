"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased (A-Z) and cut at everything that is no ASCII letter and no character beyond ASCII. Its
subwords are the 3- and 4-byte runs of its words, with a boundary mark before and after each word. Every subword
is hashed to one of BUCKETS embeddings; the text's vector is their mean over the whole text, and a linear
softmax gives the languages' scores. Embeddings and weights are trained together by stochastic gradient descent
in numpy, from zero-mean random starts with a fixed seed.

Training reads a bounded sample: of each label about ``per_lang`` rows (twice that at most), fewer where there are so
many labels that ``rows_most`` rows in all would be passed, but LEAST of each label at any rate, so no language is
left out. Rows are chosen by a hash of doc_id and text, so they are the same at every run; copies of a row under one doc_id
count once. A row gives its FEATURES most frequent subwords at most, fewer where all rows together would pass
SAMPLE_BYTES, and LEAST_FEATURES at any rate; labels so many that even those pass it (some 80,000) are refused with a
ValueError before anything is collected. So the driver holds at most SAMPLE_BYTES. A tenth of them is held back to fit the softmax
temperature and the rejection threshold: the score under which only a ``miss`` share of the correct held-back
predictions fall, and never over one half. Predictions are made for every row, over whole texts.

Cases: a null text, or one without letters, gets lang_pred ``und`` and score 0 and is rejected; an unlabelled table
trains no model and gives ``und`` everywhere; rows that repeat a doc_id each get their row; an empty table gives
no rows; a null doc_id stays null, counts as not held out and is not trained on; other columns are ignored,
whatever their names. Memory: one chunk of texts, and HELD
probabilities of them; a longer text is read in slices of SLICE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, write_table
from .words import chunks

BUCKETS = 1 << 15
DIM = 16
SIZES = (3, 4)
SLICE = 1 << 20
UNKNOWN = "und"
#: Of the training sample: rows of any label (where it has them), and subwords of a row.
LEAST, FEATURES, LEAST_FEATURES = 8, 4096, 64
#: What the sample may take on the driver, at FEATURE_BYTES a subword.
SAMPLE_BYTES, FEATURE_BYTES = 1 << 29, 6
#: Probabilities (texts times labels) that are held at once.
HELD = 1 << 21

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[:65] = 0
_LETTER[91:97] = 0
_LETTER[123:128] = 0


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of the subwords of a buffer whose texts are parted by a zero byte at least."""
    b = _LETTER[data].astype(np.uint32)
    buckets, places = [], []
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        good = np.ones(m, bool)
        for k in range(n):
            x = b[k : k + m]
            code = code * np.uint32(0x01000193) + x + np.uint32(n)
            if 0 < k < n - 1:
                good &= x != 0
        at = np.flatnonzero(good)
        code = code[at] * np.uint32(0x9E3779B1)
        buckets.append((code >> np.uint32(17)).astype(np.int32))
        places.append(at)
    return np.concatenate(buckets or [np.zeros(0, np.int32)]), np.concatenate(places or [np.zeros(0, np.int64)])


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a zero byte before each and after the last, and where each then begins."""
    n = len(offsets) - 1
    out = np.zeros(len(data) + n + 1, np.uint8)
    begin = offsets + np.arange(n + 1) + 1
    for k in range(n):
        out[begin[k] : begin[k] + offsets[k + 1] - offsets[k]] = data[offsets[k] : offsets[k + 1]]
    return out, begin


@dataclass
class Model:
    langs: list[str]
    embeddings: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def tables(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The columns to average, and the matrix that turns the averages into logits (None: they are logits)."""
        if len(self.langs) <= DIM:
            return np.ascontiguousarray((self.embeddings @ self.weights).T), None
        return np.ascontiguousarray(self.embeddings.T), self.weights

    def softmax(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def score_texts(model: Model, tables: tuple[np.ndarray, np.ndarray | None], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, number of subwords) of every text of a chunk."""
    columns, matrix = tables
    buffer, begin = parted(data, offsets)
    n = len(offsets) - 1
    sums, counts = np.zeros((n, len(columns))), np.zeros(n)
    overlap = max(SIZES) - 1
    for lo in range(0, len(buffer), SLICE):
        bucket, at = subwords(buffer[lo : lo + SLICE + overlap])
        keep = at < SLICE
        bucket, at = bucket[keep], at[keep]
        text = np.searchsorted(begin, at + lo + 1, "right") - 1
        text = np.clip(text, 0, n - 1)
        counts += np.bincount(text, minlength=n)
        for k, column in enumerate(columns):
            sums[:, k] += np.bincount(text, weights=column[bucket], minlength=n)
    means = sums / np.maximum(counts, 1)[:, None]
    return model.softmax(means if matrix is None else means @ matrix), counts


def features_of(labels: int, each: int) -> int:
    """Subwords of a row that keep ``labels`` times twice ``each`` rows within SAMPLE_BYTES."""
    found = SAMPLE_BYTES // (FEATURE_BYTES * 2 * each * max(labels, 1))
    if found < LEAST_FEATURES:
        raise ValueError(f"{labels} labels of {each} rows do not fit {SAMPLE_BYTES} bytes: join labels, or train on groups of them")
    return min(FEATURES, found)


def _features(batches, most: int = FEATURES) -> Iterator[pa.RecordBatch]:
    """label, key, and the buckets of a text with their counts, whatever the text's length."""
    for batch in batches:
        labels, keys = batch.column("lang"), batch.column("key")
        for i, j, data, offsets in chunks(batch.column("text")):
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                counts = np.zeros(BUCKETS, np.int64)
                padded = np.concatenate([np.zeros(1, np.uint8), data[a:b], np.zeros(1, np.uint8)])
                for lo in range(0, len(padded), SLICE):
                    bucket, at = subwords(padded[lo : lo + SLICE + max(SIZES) - 1])
                    counts += np.bincount(bucket[at < SLICE], minlength=BUCKETS)
                used = np.sort(np.argsort(-counts, kind="stable")[: min(most, np.count_nonzero(counts))])
                rows.append((used.astype("<u2").tobytes(), counts[used].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([labels.slice(i, j - i), keys.slice(i, j - i), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "key", "buckets", "counts"])


def sample_features(docs: DataFrame, per_lang: int, rows_most: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of the training sample, in a fixed order."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold(docs) != 1))
    rows = rows.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"))
    # shares are of distinct rows, so that a label of many copies of few rows keeps them
    sizes = write_table(rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("kinds")), "labels")
    labels = sizes.count()
    each = max(LEAST, min(per_lang, rows_most // max(labels, 1)))
    features = features_of(labels, each)
    # where few rows of a label are wanted, more are drawn, so that a label drawn empty is out of the question
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(max(each, 4 * LEAST))) / F.greatest("kinds", F.lit(1))).alias("share"))
    chosen = rows.join(F.broadcast(share) if labels <= 10_000 else share, "lang").filter(F.pmod("key", F.lit(1 << 24)) < F.ceil(F.col("share") * (1 << 24))).drop("share")
    chosen = chosen.dropDuplicates(["lang", "key"])
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("n") <= 2 * each).drop("n")
    got = in_batches(chosen).mapInArrow(lambda it: _features(it, features), "lang string, key long, buckets binary, counts binary").collect()
    out = [(r["lang"], r["key"], np.frombuffer(r["buckets"], "<u2").astype(np.int32), np.frombuffer(r["counts"], "<f4")) for r in got]
    return [(lang, b, c) for lang, _, b, c in sorted(out, key=lambda r: (r[1], r[0], len(r[2]))) if len(b)]


def _fold(docs: DataFrame):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)), F.lit(2))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 1.0, seed: int = 17, miss: float = 0.002) -> Model | None:
    """Fit embeddings and softmax by SGD on nine tenths of the rows, then temperature and threshold on the rest."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(langs)}
    model = Model(langs, rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    held = rows[::10] if len(rows) >= 50 else rows
    fit = [r for i, r in enumerate(rows) if i % 10] if len(rows) >= 50 else rows
    steps, done = epochs * len(fit), 0
    for epoch in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, buckets, counts = fit[i]
            if epoch % 2 and len(buckets) > 20:  # part of a text, so that short texts are met in training too
                part = rng.choice(len(buckets), int(rng.integers(10, min(len(buckets), 200))), replace=False)
                buckets, counts = buckets[part], counts[part]
            share = counts / counts.sum()
            own = model.embeddings[buckets]
            x = share @ own
            z = x @ model.weights + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            step = rate * (1 - done / steps)
            done += 1
            model.embeddings[buckets] = own - step * np.outer(share * min(len(buckets), 50), model.weights @ p)
            model.weights -= step * np.outer(x, p)
            model.bias -= 0.05 * step * p
    logits = np.array([c / c.sum() @ model.embeddings[b] @ model.weights for _, b, c in held])
    truth = np.array([number[r[0]] for r in held])
    best = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(model, logits, truth, t))
    model.temperature = float(best)
    p = model.softmax(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    model.threshold = float(min(np.quantile(right, miss) if len(right) else 0.0, 0.5))
    model.embeddings = model.embeddings.astype(np.float32)
    return model


def _loss(model: Model, logits: np.ndarray, truth: np.ndarray, temperature: float) -> float:
    model.temperature = temperature
    return float(-np.log(np.maximum(model.softmax(logits)[np.arange(len(truth)), truth], 1e-12)).mean())


def predict_chunk(model: Model | None, tables, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, scores, rejected) of a chunk's texts."""
    n = len(offsets) - 1
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    step = max(1, HELD // len(model.langs))
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        p, _ = score_texts(model, tables, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
    letters = (_LETTER[data] != 0) & (data < 128)
    upto = np.concatenate([[0], np.cumsum(letters)])
    plain = upto[offsets[1:]] > upto[offsets[:-1]]
    langs = []
    for k in range(n):
        seen = plain[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
        if not seen:
            score[k] = 0
        langs.append(model.langs[best[k]] if seen else UNKNOWN)
    return langs, score, (score < model.threshold) | (score == 0)


def _predict(batches, handle) -> Iterator[pa.RecordBatch]:
    model = handle.value
    tables = model and model.tables()
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            langs, score, rejected = predict_chunk(model, tables, data, offsets)
            part = batch.slice(i, j - i)
            columns = [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])


def train_on(docs: DataFrame, per_lang: int = 800, rows_most: int = 16_000) -> Model | None:
    """The model of ``docs`` (doc_id, text, lang): trained on rows whose fold, crc32 of doc_id as text mod 3, is not 1."""
    return train(sample_features(docs, per_lang, rows_most))


def identify(docs: DataFrame, model: Model | None = None, per_lang: int = 800, rows_most: int = 16_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs`` (doc_id, text, lang)."""
    handle = docs.sparkSession.sparkContext.broadcast(model or train_on(docs, per_lang, rows_most))
    rows = docs.select("doc_id", "text", (_fold(docs) == 1).alias("held_out"))
    return in_batches(rows).mapInArrow(lambda it: _predict(it, handle), RESULT)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    handle = docs.sparkSession.sparkContext.broadcast(model or train_on(docs))

    def run(batches):
        found = handle.value
        tables = found and found.tables()
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                _, _, rejected = predict_chunk(found, tables, data, offsets)
                yield batch.slice(i, j - i).filter(pa.array(~rejected))

    return in_batches(docs).mapInArrow(run, docs.schema)
