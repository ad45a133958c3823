"""Quality rules: statistics of whole texts, a fixed base rule, and gradient-boosted trees that judge what passes it.

Statistics are counted over whole Arrow columns, without a loop per word. Words are runs of characters other than space and \\t to
\\r. n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>; n_dup_lines, lines between line feeds that have
a word and equal an earlier line of the text; n_repeat_words, words in windows of five words found twice or more in the text, the
first one included. Lines and windows are compared by 62-bit hashes within their text. The base rule fails texts of fewer than 10
words, and those with over 20 % of words in repeated windows.

The trees see FEATURES, ratios of these and of some further counts, and nothing else: neither language, source nor id. They are
boosted by Newton steps on the logistic loss over histograms of at most `bins` values, and kept as arrays of nodes in heap order,
so that scoring is `depth` steps for all texts and trees at once. For the features in FALLING the score may only fall as they
grow: a split that would raise it is not made, and each half keeps to its side of the middle in all later splits.

The model is fitted on at most `per_class` labelled documents of each class, the first by a hash of their id, on the driver:
a row of numbers each. Documents whose crc32 leaves no rest by 5 are never fitted on. The share of good documents among all
labelled ones then shifts the score, so that it means the same at every size. kept: the base rule passes and the score is 0.5 or more.

Null and empty texts have no words and fail the base rule. A document with several labels is good if all of them are. Without
labels of both classes all texts get the smoothed share of good labels. Repeated rows get equal results; an empty table gives no
rows. Extra columns stay; the columns of COUNTS, base_failed, score and kept replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.spans import line_spans, mix, sequences, slices, span_hashes, text_bytes, word_spans
from logsift.llm.toxic_cnn import held_out
from logsift.session import stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_chars", "n_distinct", "n_capitals", "n_digits", "n_marks")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "distinct", "line_words")
FALLING = ("symbols", "dup_lines", "repeats")
WINDOW = 5


def _bytes_of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOLS, _CAPITALS, _DIGITS, _MARKS = _bytes_of("#*$%&|<>"), _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_of("0123456789"), _bytes_of(".,;:!?")
_BEGINS = (np.arange(256) & 0xC0) != 0x80
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text."""
    data, offsets = text_bytes(texts)
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    out = {"n_words": words, "n_chars": total(_BEGINS[data]), "word_chars": total((_BEGINS & ~_SPACE)[data]), "n_symbols": total(_SYMBOLS[data]),
           "n_capitals": total(_CAPITALS[data]), "n_digits": total(_DIGITS[data]), "n_marks": total(_MARKS[data])}
    row_of = np.repeat(np.arange(rows), words)
    hashes = span_hashes(data, starts, ends)
    out["n_distinct"] = _distinct(hashes, row_of, rows)
    out["n_repeat_words"] = np.diff(np.concatenate(([0], np.cumsum(_in_repeats(hashes, first, row_of))))[first])
    a, z, line = line_spans(data, offsets)
    has = np.searchsorted(starts, z) > np.searchsorted(starts, a)
    row_of = np.repeat(np.arange(rows), np.diff(line))[has]
    out["n_lines"] = np.bincount(row_of, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - _distinct(span_hashes(data, a, z)[has], row_of, rows)
    return out


def _own(hashes: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Hashes that tell the texts apart as well."""
    with np.errstate(over="ignore"):
        return mix(hashes + mix(row_of.astype(np.uint64) + np.uint64(1)))


def _distinct(hashes: np.ndarray, row_of: np.ndarray, rows: int) -> np.ndarray:
    _, at = np.unique(_own(hashes, row_of), return_index=True)
    return np.bincount(row_of[at], minlength=rows)


def _in_repeats(hashes: np.ndarray, first: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Which words are in a window that its text has twice or more."""
    whole = np.flatnonzero(first[row_of + 1] - np.arange(len(hashes)) >= WINDOW)
    value = _own(sequences(hashes, WINDOW)[whole], row_of[whole])
    order = np.argsort(value)
    same = np.flatnonzero(value[order][1:] == value[order][:-1])
    again = np.zeros(len(hashes) + WINDOW, np.int64)
    again[whole[order[same]]] = again[whole[order[same + 1]]] = 1
    edge = again.copy()
    edge[WINDOW:] -= again[:-WINDOW]
    return np.cumsum(edge)[:len(hashes)] > 0


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_chars"], 1)
    columns = {"log_words": np.log(words), "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"] / lines,
               "repeats": c["n_repeat_words"] / words, "capitals": c["n_capitals"] / chars, "digits": c["n_digits"] / chars, "marks": c["n_marks"] / words,
               "distinct": c["n_distinct"] / words, "line_words": c["n_words"] / lines}
    return np.stack([columns[f] for f in FEATURES], axis=1).astype(np.float64)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


@dataclass(frozen=True)
class Boosting:
    per_class: int = 20_000
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    weight: float = 1.0  # added to the second derivatives of a leaf
    least: float = 2.0  # second derivatives of a half
    gain: float = 0.05


@dataclass(frozen=True)
class Forest:
    """Trees of equal depth in heap order, node i's halves being 2i + 1 and 2i + 2; a text goes to the second if its feature is over the limit."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of the odds that each row of features is good."""
        trees, inner = self.feature.shape
        odds = np.full(len(x), self.base)
        every = np.arange(trees)
        for a in range(0, len(x), 4096):
            part = x[a:a + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (part[row, self.feature[every, node]] > self.limit[every, node])
            odds[a:a + 4096] += self.value[every, node - inner].sum(axis=1)
        return odds


def fit(x: np.ndarray, good: np.ndarray, counts: tuple[int, int], settings: Boosting = Boosting()) -> Forest:
    """Boost on rows of features; `counts` are all labelled documents that are not good, and good."""
    inner = (1 << settings.depth) - 1
    n_good = int(good.sum())
    if not 0 < n_good < len(good):
        none = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
        return Forest(*none, float(np.log((counts[1] + 1) / (counts[0] + 1))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, settings.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: over edge b - 1, up to edge b
    falling = np.array([f in FALLING for f in FEATURES])
    base = float(np.log(n_good / (len(good) - n_good)))
    odds, parts = np.full(len(x), base), []
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-odds))
        parts.append(_tree(binned, edges, p - good, p * (1 - p), falling, settings))
        odds += Forest(*[a[None] for a in parts[-1]], 0.0).odds(x)
    # The sample's own odds, which the trees start from, give way to those of all labelled documents.
    return Forest(*[np.stack([t[i] for t in parts]) for i in range(3)], float(np.log(counts[1] / counts[0])))


def _tree(binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, falling: np.ndarray, s: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner, bins = (1 << s.depth) - 1, s.bins
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
    node = np.zeros(len(g), np.int64)
    leaf = lambda a, b, at: np.clip(-a / (b + s.weight), low[at], high[at])
    worth = lambda w, a, b: -(a * w + 0.5 * (b + s.weight) * w * w)
    for at in range(inner):
        rows = np.flatnonzero(node == at)
        best, middle = s.gain, 0.0
        if len(rows):
            ga, ha = g[rows].sum(), h[rows].sum()
            whole = worth(leaf(ga, ha, at), ga, ha)
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], bins))[:len(edges[f])]
                hl = np.cumsum(np.bincount(b, h[rows], bins))[:len(edges[f])]
                wl, wr = leaf(gl, hl, at), leaf(ga - gl, ha - hl, at)
                gain = worth(wl, gl, hl) + worth(wr, ga - gl, ha - hl) - whole
                gain[(hl < s.least) | (ha - hl < s.least) | (falling[f] & (wl < wr))] = -np.inf
                i = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[i] > best:
                    best, feature[at], limit[at] = gain[i], f, edges[f][i]
                    middle = (wl[i] + wr[i]) / 2
            node[rows] = 2 * at + 1 + (binned[rows, feature[at]] > np.searchsorted(edges[feature[at]], limit[at]))
        for child in (2 * at + 1, 2 * at + 2):
            low[child], high[child] = low[at], high[at]
        if np.isfinite(limit[at]) and falling[feature[at]]:
            low[2 * at + 1] = max(low[at], middle)
            high[2 * at + 2] = min(high[at], middle)
    value = np.zeros(inner + 1)
    for i in range(inner + 1):
        rows = node == inner + i
        value[i] = s.rate * float(leaf(g[rows].sum(), h[rows].sum(), inner + i)) if rows.any() else 0.0
    return feature, limit, value


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality", settings: Boosting = Boosting()) -> Forest:
    """Fit on a sample of the labelled documents that are not held out; `labels` has the id and quality, 0 or 1."""
    labels = labels.where(F.col(id).isNotNull() & F.col(quality).isNotNull() & ~held_out(id)).groupBy(id).agg((F.min(quality) != 0).alias("__good"))
    labels = stored(labels.join(docs.select(id), id, "left_semi"), "labelled")
    counted = {r["__good"]: r["count"] for r in labels.groupBy("__good").count().collect()}
    chosen = None
    for value in (False, True):
        some = labels.where(F.col("__good") == value).orderBy(F.xxhash64(id), id).limit(settings.per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(id, F.col(text).alias("text")).join(F.broadcast(chosen), id).select("text", "__good")  # 2 x per_class ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(text_counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("__good")], ["x", "good"])

    found = sorted((r.x, r.good) for r in rows.mapInArrow(read, "x array<double>, good boolean").collect())
    x = np.array([f for f, _ in found]).reshape(-1, len(FEATURES))
    return fit(x, np.array([g for _, g in found], bool), (counted.get(False, 0), counted.get(True, 0)), settings)


def judge(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """Add COUNTS, base_failed, score and kept."""
    docs = docs.drop(*COUNTS, "base_failed", "score", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            c = text_counts(batch.column(text))
            failed = base_failed(c["n_words"], c["n_repeat_words"])
            score = 1 / (1 + np.exp(-shared.value.odds(features(c))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c[n].astype(np.int64)) for n in COUNTS], pa.array(failed), pa.array(score)], schema.names)

    return docs.mapInArrow(run, schema).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))
