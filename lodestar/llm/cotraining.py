"""Quality classifier by co-training two views of a document.

The text view sees the words (presence of those that tell labels apart) and the shape of the text;
the metadata view sees language, source and length. Both are logistic models. In each round each
view labels the documents of an unlabelled pool that it is surest of, in the proportion of the
classes, and the other view learns from them too. A fold of the labelled documents is kept out of
all that: on it each view's scores are calibrated (Platt), and the calibrated log odds add up,
less the prior's that both hold. Two such pairs are trained, one for quality and one for toxicity.

Models are fitted on the driver on at most `sample` labelled and `pool` other documents, the first
by a hash of their ids; only their features come to the driver (bounded by those parameters and
`vocabulary`). All documents are scored, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, with_rows
from .hashing import joined, mixed, some_texts, texts_of, word_hashes

SAMPLE, POOL, VOCABULARY, ROUNDS, TELLING = 5000, 5000, 1024, 3, 3.0
MARKS = b"!*$%#&|.,;:?()[]{}<>/@_-=+'\""
SOURCES, LANGS, LENGTHS = 512, 64, 24

_CLASS = np.zeros(256, dtype=np.uint8)  # upper, lower, digit, white space, new line, other bytes, then each mark
_CLASS[:] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 0, 1, 2, 3, 4
for _i, _m in enumerate(MARKS):
    _CLASS[_m] = 6 + _i
CLASSES = 6 + len(MARKS)
SHAPES = CLASSES + 7


def shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features of each text, its words' hashes, and the index of each text's first word (and the end)."""
    n = len(texts)
    data, begins = joined(texts)
    doc = np.repeat(np.arange(n), np.diff(begins))
    counts = np.bincount(doc * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    counts[:, 3] -= 1  # the space after each text
    size = np.maximum(1, counts.sum(axis=1))
    h, at = word_hashes(texts)
    words = np.diff(at)
    of = np.repeat(np.arange(n), words)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    many = np.maximum(1, words)
    upper_words = counts[:, 0] / many
    out = np.concatenate([
        np.sqrt(counts / size[:, None]),
        np.stack([np.log1p(size), np.log1p(words), size / many / 10, np.bincount(of, again, minlength=n) / many, distinct / many, np.minimum(upper_words, 5), (words == 0).astype(float)], axis=1),
    ], axis=1)
    return out, h, at


def present(h: np.ndarray, at: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of the vocabulary's words that each text has."""
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    found = np.flatnonzero(vocabulary[place] == h)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))[found]
    pairs = np.unique(of * len(vocabulary) + place[found])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _bucket(values: list, n: int) -> np.ndarray:
    """A bucket of each whole value's hash; null is a value of its own."""
    codes = {v: 0 if v is None else xxhash.xxh64_intdigest(str(v), 1) | 1 for v in set(values)}
    return (mixed(np.array([codes[v] for v in values], dtype=np.uint64)) % np.uint64(n)).astype(np.int64)


def meta_places(lang: list, source: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the three metadata features that are 1 (language, source, length), and the length itself."""
    logs = np.log2(np.maximum(1, sizes))
    length = np.minimum(LENGTHS - 1, logs.astype(np.int64))
    return np.stack([_bucket(lang, LANGS), LANGS + _bucket(source, SOURCES), LANGS + SOURCES + length], axis=1).reshape(-1, 3), logs / 16


def metadata(lang: list, source: list, sizes: np.ndarray) -> np.ndarray:
    """The same as a matrix."""
    places, logs = meta_places(lang, source, sizes)
    out = np.zeros((len(sizes), LANGS + SOURCES + LENGTHS + 1), dtype=np.float32)
    np.put_along_axis(out, places, 1, axis=1)
    out[:, -1] = logs
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, l2: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) of an L2-penalized logistic model, by accelerated gradient steps from `start`."""
    x1 = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    y, weight = y.astype(x.dtype), weight.astype(x.dtype)
    penalty = np.full(x1.shape[1], l2, dtype=x.dtype)
    penalty[-1] = 1e-6
    rate = x.dtype.type(1.0 / (0.25 * _top(x1, weight) + l2))
    w = v = np.zeros(x1.shape[1], dtype=x.dtype) if start is None else start.astype(x.dtype)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        new = v - rate * ((weight * (p - y)) @ x1 + penalty * v)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + x.dtype.type((old - 1) / t) * (new - w), new
    return w.astype(np.float64)


def _top(x: np.ndarray, weight: np.ndarray) -> float:
    """The largest eigenvalue of the weighted Gram matrix, by power iteration (with some room)."""
    u = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(12):
        u = (weight * (x @ u)) @ x
        u /= max(1e-12, float(np.linalg.norm(u)))
    return 1.2 * float(np.linalg.norm((weight * (x @ u)) @ x))


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of the log odds, with smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 0.0, _prior(y)
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        d, s = p - target, np.maximum(1e-9, p * (1 - p))
        g = np.array([(d * scores).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(s * scores * scores).sum() + 1e-3, (s * scores).sum()], [(s * scores).sum(), s.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    if a < 0:
        return 0.0, _prior(y)
    return float(a), float(b)


def _prior(y: np.ndarray) -> float:
    return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0


@dataclass
class Head:
    """A pair of views: weights, calibration, and the prior's log odds."""

    views: list[np.ndarray]
    calibration: list[tuple[float, float]]
    prior: float

    def log_odds(self, scores: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(scores[0]), -self.prior * (len(scores) - 1))
        for s, (a, b) in zip(scores, self.calibration, strict=True):
            total += a * s + b
        return total


def co_train(views: list[np.ndarray], y: np.ndarray, fold: np.ndarray, labelled: np.ndarray, rounds: int = ROUNDS, share: float = 0.05, sure: float = 0.9) -> Head:
    """views: features of all rows. `labelled` rows outside `fold` are learned from; those in it calibrate; the rest is the pool."""
    learn, pool = np.flatnonzero(labelled & ~fold), np.flatnonzero(~labelled)
    if not len(learn) or y[learn].min() == y[learn].max():
        constant = _prior(y[labelled]) if labelled.any() else 0.0
        return Head([np.zeros(v.shape[1] + 1) for v in views], [(0.0, constant)] * len(views), constant)
    given: list[dict[int, float]] = [{} for _ in views]
    models = []
    for r in range(rounds + 1):
        before, models = models or [None] * len(views), []
        for v, extra, start in zip(views, given, before, strict=True):
            rows = np.concatenate([learn, np.array(list(extra), dtype=np.int64)]).astype(np.int64)
            target = np.concatenate([y[learn], np.array(list(extra.values()))])
            weight = np.concatenate([np.ones(len(learn)), np.full(len(extra), 0.5)])
            models.append(fit_logistic(v[rows], target, weight, start, steps=150 if start is None else 50))
        if r == rounds or not len(pool):
            break
        rate = y[learn].mean()
        for i, (v, m) in enumerate(zip(views, models, strict=True)):
            p = 1 / (1 + np.exp(-np.clip(v[pool] @ m[:-1] + m[-1], -30, 30)))
            order = np.argsort(-p, kind="stable")
            n_good, n_bad = int(np.ceil(share * len(pool) * rate)), int(np.ceil(share * len(pool) * (1 - rate)))
            for j, other in enumerate(given):
                if j != i:
                    other.update({int(pool[k]): 1.0 for k in order[:n_good] if p[k] >= sure and int(pool[k]) not in other})
                    other.update({int(pool[k]): 0.0 for k in order[::-1][:n_bad] if p[k] <= 1 - sure and int(pool[k]) not in other})
    held = np.flatnonzero(labelled & fold)
    held = held if len(held) else learn
    return Head(models, [platt(v[held] @ m[:-1] + m[-1], y[held]) for v, m in zip(views, models, strict=True)], _prior(y[held]))


@dataclass
class Classifier:
    vocabulary: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    quality: Head
    toxic: Head

    def text_view(self, shape: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = np.zeros((len(shape), len(self.vocabulary) + shape.shape[1]), dtype=np.float32)
        x[rows, words] = 1
        x[:, len(self.vocabulary) :] = (shape - self.mean) / self.scale
        return x

    def score(self, texts: list[bytes], lang: list, source: list) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of good quality and of toxicity."""
        shape, h, at = shapes(texts)
        rows, words = present(h, at, self.vocabulary)
        dense = (shape - self.mean) / self.scale
        places, logs = meta_places(lang, source, np.fromiter((len(t) for t in texts), np.int64, len(texts)))
        v, out = len(self.vocabulary), []
        for head in (self.quality, self.toxic):
            w, m = head.views
            text = np.bincount(rows, w[:v][words], minlength=len(texts)) + dense @ w[v:-1] + w[-1]
            out.append(1 / (1 + np.exp(-np.clip(head.log_odds([text, m[places].sum(axis=1) + logs * m[-2] + m[-1]]), -30, 30))))
        return out[0], out[1]


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    has = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), has("lang").alias("lang"), has("source").alias("source"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit on labels (doc_id, quality, toxic); rows with a null in any of them are left out, of several for one id the largest counts."""
    rows = _columns(docs, id_col, text_col)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id", F.lit(11))
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    some = known.join(ids, "doc_id", "left_semi").orderBy(by_hash, "doc_id").limit(sample)
    others = ids.join(known, "doc_id", "left_anti").orderBy(by_hash, "doc_id").limit(pool).select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    chosen = some.union(others).collect()  # at most sample + pool rows
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, quality int, toxic int"))  # likewise
    # One row an id, even where the table repeats it.
    picked = rows.join(wanted, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("toxic").alias("toxic"), F.min(F.struct("text", "lang", "source")).alias("d")).select("doc_id", "d.text", "d.lang", "d.source", "quality", "toxic")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = (np.array(batch.column(i).to_pylist(), dtype=np.int64) for i in (1, 2))
            for first, texts in some_texts(texts_of(batch.column(0))):
                h, at = word_hashes(texts)
                of = np.repeat(np.arange(len(texts)), np.diff(at))
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                fresh = np.ones(len(h), dtype=bool)
                fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, of = h[fresh], of[fresh] + first
                word, back = np.unique(h, return_inverse=True)
                sums = [np.bincount(back, x[of], minlength=len(word)).astype(np.int64) for x in (np.ones(len(q)), q, t)]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, sums)], names=["word", "n", "good", "toxic"])

    labelled = picked.filter("quality IS NOT NULL").select("text", "quality", "toxic")
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")).first()
    counts = labelled.mapInArrow(words, "word long, n long, good long, toxic long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n >= 3")

    def telling(column: str):
        share = (totals[column] or 0) / max(1, totals.n)
        return F.abs(F.col(column) - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-6) + 1)

    # Words whose share differs by chance alone (under TELLING standard deviations) are left out.
    best = [counts.filter(telling(c) >= TELLING).orderBy(telling(c).desc(), "word").limit(vocabulary // 2).select("word") for c in ("good", "toxic")]
    vocab = np.unique(np.array([r.word for r in best[0].union(best[1]).distinct().collect()], dtype=np.int64).view(np.uint64))  # at most `vocabulary` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in some_texts(texts_of(batch.column(1))):
                shape, h, at = shapes(texts)
                r, w = present(h, at, vocab)
                cut = np.searchsorted(r, np.arange(len(texts) + 1))
                part = batch.slice(first, len(texts))
                lists = [w[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([len(t) for t in texts], pa.int64()), part.column(4), part.column(5), pa.array(list(shape), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "lang", "source", "size", "quality", "toxic", "shape", "words"])

    got = picked.mapInArrow(features, "doc_id long, lang string, source string, size long, quality int, toxic int, shape array<double>, words array<int>").collect()  # at most sample + pool rows
    got.sort(key=lambda r: r.doc_id)
    shape = np.array([r["shape"] for r in got], dtype=np.float64).reshape(-1, SHAPES)
    blank = Head([], [], 0.0)
    model = Classifier(vocab, shape.mean(axis=0) if len(shape) else np.zeros(SHAPES), np.maximum(1e-3, shape.std(axis=0)) if len(shape) else np.ones(SHAPES), blank, blank)
    r_ = np.repeat(np.arange(len(got)), [len(r.words) for r in got]) if got else np.zeros(0, np.int64)
    w_ = np.concatenate([np.array(r.words, dtype=np.int64) for r in got]) if got else np.zeros(0, np.int64)
    views = [model.text_view(shape, r_, w_), metadata([r.lang for r in got], [r.source for r in got], np.array([r["size"] for r in got], dtype=np.int64))]
    has = np.array([r.quality is not None for r in got], dtype=bool)
    fold = mixed(np.array([r.doc_id for r in got], dtype=np.int64).view(np.uint64)) % np.uint64(5) == 0
    for name in ("quality", "toxic"):
        y = np.array([float(r[name] or 0) for r in got])
        setattr(model, name, co_train(views, y, fold, has, rounds))
    return model


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """doc_id, quality, toxic (probabilities) of every document, with the columns in `extra`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, texts in some_texts(texts_of(batch.column(1))):
                part = batch.slice(first, len(texts))
                good, toxic = model.score(texts, part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(good), pa.array(toxic), *part.columns[4:]], names=["doc_id", "quality", "toxic", *extra])

    rows = _columns(docs, id_col, text_col) if not extra else docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", *extra)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, "doc_id long, quality double, toxic double" + "".join(f", {c} {kinds[c]}" for c in extra))


def classify(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, **options) -> DataFrame:
    """doc_id, quality, toxic, kept: a row a document (repeated rows too).

    Null or empty text has the features of an empty text; null language or source is a value of its
    own; a null id can be scored but not learned from. Without labels of two classes a head gives
    the same probability to all, the rate seen, and without any labels everything is kept.
    """
    return score(docs, train(docs, labels, **options)).withColumn("kept", (F.col("quality") >= least_quality) & (F.col("toxic") <= most_toxic))


def drop_low_quality(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, **options) -> DataFrame:
    """The documents that `classify` keeps, all columns as they came.

    Null or empty texts and null ids are scored like others; repeated rows fare alike, each on its own; an
    empty table stays empty; columns may have any names. Without `lang` or `source` these are null.
    """
    stored = with_rows(docs, doc=F.struct(*[docs[c] for c in docs.columns]))
    text = lambda c: (F.col(f"doc.{c}").cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    rows = stored.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"), text("lang"), text("source"), "row")
    scored = score(rows, train(docs, labels, **options), extra=["row"])
    return keep_rows(stored, scored.filter((F.col("quality") >= least_quality) & (F.col("toxic") <= most_toxic)))
