"""Toxicity by a convolutional text classifier, trained here in numpy.

A word is embedded as the sum of hashed vectors: one of the whole word and one of each of its first 4, 5 and 6 bytes, so that
inflected forms share what they begin with. Filters over 1, 2 and 3 words, a rectifier and the maximum over the whole text
feed a logistic output. Training follows the maxima back (Adagrad), and leaves out a part of the whole-word vectors, so that
beginnings are learnt too.

The model is fitted on at most `per_class` labelled documents of each class, the first by a hash of their id, of at most
`longest` words: a bounded sample, on the driver. The bias is then moved from the sample's share of toxic documents to that
of all labelled ones, so that a score means the same at every size. Scoring reads whole texts, in tasks, with a model of 8 MB.

A fifth of the labelled documents, by another hash, is never fitted on. All labelled documents that the model was not fitted
on, neither held out, are scored and counted by language and bin of score (1/64 of the log-odds), weighted to the share of
toxic documents that the language has among all labelled ones. The bound between two bins with the best F1 is its threshold,
where it has at least `least` of both classes; others get 0.5. Language picks the threshold only and is no input of the score.

Null and empty texts have no words and get the score of the bias. Without labels of both classes to fit on, all scores are the
smoothed share of toxic labels. A document with several labels counts as toxic if any is. Repeated rows get equal scores. Extra
columns stay; `score` and `toxic` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.spans import mix, slices, span_hashes, text_bytes, word_spans
from logsift.session import stored

BITS, SIZE, FILTERS, WIDTHS, PREFIXES = 18, 8, 8, (1, 2, 3), (4, 5, 6)
PIECES = 1 + len(PREFIXES)
INSIDE = np.zeros(256, bool)
INSIDE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
INSIDE[128:] = True


@dataclass(frozen=True)
class Training:
    per_class: int = 3000
    longest: int = 5000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.1
    drop: float = 0.5
    least: int = 20  # documents of either class a language needs for a threshold of its own
    seed: int = 11


def word_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's pieces, and the first word's index of each text (one more at the end)."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    starts, ends, first = word_spans(data, offsets, INSIDE)
    out = np.empty((len(starts), PIECES), np.int32)
    for i, length in enumerate((0, *PREFIXES)):
        upto = np.minimum(starts + length, ends) if length else ends
        with np.errstate(over="ignore"):
            out[:, i] = mix(span_hashes(data, starts, upto) + np.uint64(length)) >> np.uint64(64 - BITS)
    return out, first


@dataclass
class Model:
    vectors: np.ndarray  # 2^BITS rows, and one of zeros
    filters: list[np.ndarray]  # width x SIZE x FILTERS each
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, pieces: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each text, and at which word."""
        words = self.vectors[pieces[:, 0]]
        for i in range(1, pieces.shape[1]):
            words += self.vectors[pieces[:, i]]
        n = np.diff(first)
        best = np.zeros((len(n), len(self.bias)), np.float32)
        place = np.zeros(best.shape, np.int64)
        have = np.flatnonzero(n > 0)
        if not len(have):
            return best, place
        left = np.repeat(first[1:], n) - np.arange(len(words))  # words to the end of the text
        for k, kernel in enumerate(self.filters):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            response = words @ kernel[0]
            for j in range(1, len(kernel)):
                response[:-j] += np.where((left[:-j] > j)[:, None], words[j:] @ kernel[j], 0)
            best[have, cols] = np.maximum.reduceat(response, first[:-1][have])
            if self.training:
                for i in have.tolist():
                    place[i, cols] = first[i] + response[first[i]:first[i + 1]].argmax(axis=0)
        best[have] += self.bias
        return np.maximum(best, 0), place

    training = False

    def scores(self, pieces: np.ndarray, first: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(pieces, first)
        return 1 / (1 + np.exp(-(best.astype(np.float64) @ self.out + self.base)))


def fit(samples: list[tuple[np.ndarray, int]], counts: tuple[int, int], settings: Training = Training()) -> Model:
    """Train on (pieces of the words, toxic) of documents; `counts` are all labelled documents that are not toxic, and toxic."""
    rng = np.random.default_rng(settings.seed)
    blank = 1 << BITS
    vectors = rng.normal(0, 0.02, (blank + 1, SIZE)).astype(np.float32)
    vectors[blank] = 0
    filters = [rng.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = Model(vectors, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)
    toxic = sum(t for _, t in samples)
    if not 0 < toxic < len(samples):
        model.out[:] = 0
        model.base = float(np.log((counts[1] + 1) / (counts[0] + 1)))
        return model
    train = rng.permutation(len(samples))
    model.training = True
    state = {"v": np.full(vectors.shape, 1e-3, np.float32), "f": [np.full(f.shape, 1e-2, np.float32) for f in filters],
             "b": np.full(model.bias.shape, 1e-2, np.float32), "o": np.full(model.out.shape, 1e-2), "z": 1e-2}
    for epoch in range(settings.epochs):
        rng.shuffle(train)
        for i in range(0, len(train), settings.batch):
            _step(model, [samples[j] for j in train[i:i + settings.batch]], state, settings, rng)
    model.training = False
    model.base += float(np.log(counts[1] / counts[0]) - np.log(toxic / (len(samples) - toxic)))
    return model


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle between the two neighbouring scores that part the classes with the best F1."""
    values, place = np.unique(scores, return_inverse=True)
    toxic = np.bincount(place, weights=truth)
    return best_bound(values, values, toxic, np.bincount(place) - toxic)


def best_bound(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, others: np.ndarray) -> float:
    """The same between bins of scores from `low` to `high`, in any order, with so many toxic and other documents."""
    order = np.argsort(-high, kind="stable")
    low, high, hits = low[order], high[order], np.cumsum(toxic[order])
    i = int((2 * hits / (hits + np.cumsum(others[order]) + hits[-1])).argmax())
    return float((low[i] + (high[i + 1] if i + 1 < len(high) else 0)) / 2)


def _together(samples: list) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum([len(p) for p, _ in samples])))
    return np.concatenate([p for p, _ in samples]) if len(samples) else np.zeros((0, PIECES), np.int32), first


def _step(model: Model, samples: list, state: dict, settings: Training, rng: np.random.Generator) -> None:
    pieces, first = _together(samples)
    pieces = pieces.copy()
    pieces[rng.random(len(pieces)) < settings.drop, 0] = 1 << BITS
    best, place = model.pooled(pieces, first)
    truth = np.array([t for _, t in samples], np.float64)
    error = (1 / (1 + np.exp(-(best @ model.out + model.base))) - truth) / len(samples)
    back = (error[:, None] * model.out * (best > 0)).astype(np.float32)
    grads: dict[str, object] = {"o": best.T @ error, "z": error.sum(), "b": back.sum(axis=0)}
    touched, moves, kernels = [], [], []
    words = lambda at: model.vectors[pieces[at]].sum(axis=-2)
    for k, kernel in enumerate(model.filters):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        at, g = place[:, cols], back[:, cols]
        part = np.zeros_like(kernel)
        for j in range(len(kernel)):
            inside = (at + j < first[1:, None]) & (g != 0)
            i, f = np.nonzero(inside)
            if len(i):
                own, weight = at[i, f] + j, g[i, f]
                np.add.at(part[j].T, f, weight[:, None] * words(own))
                touched.append(pieces[own].ravel())
                moves.append(np.repeat(weight[:, None] * kernel[j].T[f], PIECES, axis=0))
        kernels.append(part)
    rate = settings.rate
    for kernel, part, s in zip(model.filters, kernels, state["f"]):
        s += part * part
        kernel -= rate * part / np.sqrt(s)
    if touched:
        rows, back_to = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(rows), SIZE), np.float32)
        np.add.at(total, back_to, np.concatenate(moves))
        state["v"][rows] += total * total
        model.vectors[rows] -= rate * total / np.sqrt(state["v"][rows])
        model.vectors[1 << BITS] = 0
    for name, key in (("bias", "b"), ("out", "o")):
        state[key] += grads[key] ** 2
        setattr(model, name, getattr(model, name) - rate * grads[key] / np.sqrt(state[key]))
    state["z"] += grads["z"] ** 2
    model.base -= rate * grads["z"] / np.sqrt(state["z"])


def held_out(id: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves no rest by 5."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def spared(id: str) -> Column:
    """Whether a labelled document is kept from fitting, so that it can set thresholds at every size: a fifth by hash."""
    return F.pmod(F.xxhash64(F.lit("thresholds"), F.col(id).cast("string")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Training = Training()) -> Model:
    """Fit on a sample of the labelled documents that are not held out, and set thresholds by the others of them; `labels` has
    the id and toxic, 0 or 1."""
    labels = labels.where(F.col(id).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id)).groupBy(id).agg((F.max("toxic") != 0).cast("int").alias("__toxic"))
    labels = stored(labels.join(docs.select(id), id, "left_semi"), "labelled")
    counted = {r["__toxic"]: r["count"] for r in labels.groupBy("__toxic").count().collect()}
    chosen = None
    for value in (0, 1):
        some = labels.where((F.col("__toxic") == value) & ~spared(id)).orderBy(F.xxhash64(id), id).limit(settings.per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(id), F.col(text).alias("text"), F.col(lang).alias("lang") if lang in docs.columns else F.lit(None).cast("string").alias("lang"))
    fields = T.StructType([rows.schema[id], T.StructField("pieces", T.BinaryType()), T.StructField("toxic", T.IntegerType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces, first = word_pieces(batch.column("text"))
            short = [i for i in range(batch.num_rows) if first[i + 1] - first[i] <= settings.longest]
            packed = [pieces[first[i]:first[i + 1]].tobytes() for i in short]
            yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(short, pa.int64())), pa.array(packed, pa.binary()), batch.column("__toxic").take(pa.array(short, pa.int64()))], fields.names)

    found = rows.join(F.broadcast(chosen), id).select(id, "text", "__toxic").mapInArrow(read, fields).collect()  # 2 x per_class rows
    found.sort(key=lambda r: (bytes(r.pieces), r.toxic))
    model = fit([(np.frombuffer(r.pieces, np.int32).reshape(-1, PIECES), r.toxic) for r in found], (counted.get(0, 0), counted.get(1, 0)), settings)
    if counted.get(0) and counted.get(1):
        used = docs.sparkSession.createDataFrame([(x,) for x in sorted({r[id] for r in found})], T.StructType([rows.schema[id]]))
        set_thresholds(model, rows, labels, used.withColumn("__used", F.lit(True)), id, settings)
    return model


def set_thresholds(model: Model, rows: DataFrame, labels: DataFrame, used: DataFrame, id: str, settings: Training) -> None:
    """Thresholds by all labelled documents but the `used` ones, which only count for the share of toxic ones in a language."""
    scored = score(rows, model, lang="lang").select(id, "lang", "score").join(labels, id).join(F.broadcast(used), id, "left")  # 2 x per_class ids
    odds = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    new, toxic = F.col("__used").isNull(), F.col("__toxic") == 1
    bins = stored(scored.groupBy("lang", F.floor(F.log(odds / (1 - odds)) * 64).alias("bin")).agg(
        F.count_if(new & toxic).alias("toxic"), F.count_if(new & ~toxic).alias("others"), F.count_if(toxic).alias("all_toxic"), F.count_if(~toxic).alias("all_others"),
        F.min(F.when(new, F.col("score"))).alias("low"), F.max(F.when(new, F.col("score"))).alias("high")), "bins")
    enough = bins.groupBy(F.col("lang").alias("l")).agg(F.sum("toxic").alias("t"), F.sum("others").alias("o")).where((F.col("t") >= settings.least) & (F.col("o") >= settings.least)).select("l")
    by: dict[str | None, list] = {}
    for r in bins.join(enough, F.col("lang").eqNullSafe(F.col("l"))).collect():  # some thousand bins a language
        by.setdefault(r.lang, []).append(r)
    for name, found in by.items():
        toxic, others, all_toxic, all_others = (np.array([r[c] for r in found], np.float64) for c in ("toxic", "others", "all_toxic", "all_others"))
        some = toxic + others > 0
        low, high = (np.array([r[c] for r, s in zip(found, some) if s]) for c in ("low", "high"))
        model.thresholds[name] = best_bound(low, high, toxic[some] * all_toxic.sum() / toxic.sum(), others[some] * all_others.sum() / others.sum())


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add score, from 0 to 1, and toxic: whether it reaches the threshold of the document's language."""
    docs = docs.drop("score", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(*word_pieces(batch.column(text))))], names)

    limit = F.lit(0.5)
    if lang in docs.columns:
        for name, threshold in model.thresholds.items():
            limit = F.when(F.col(lang).eqNullSafe(F.lit(name)), threshold).otherwise(limit)
    return docs.mapInArrow(run, schema).withColumn("toxic", F.col("score") >= limit)
