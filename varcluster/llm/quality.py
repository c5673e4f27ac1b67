"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Each text gives a few numbers, such as shares of letters, symbols and repeated words. A feature is cut into bins at
quantiles. The model is a lookup table per feature and per chosen pair of features: boosting goes round the features
in a cycle, and each turn fits a shallow tree of logistic gradients to the bins of that one feature and adds a small
part of it to the feature's table. Then the pairs that explain most of what is left get tables of their own in the
same way. A score is the sigmoid of a constant plus one table entry per feature and pair, read for a whole batch at once.

Fitting takes MAX_TRAINING labelled texts at most, by hash of id and text, each once however often a row repeats: a
bounded sample that comes to the driver as numbers, never as texts. Only rows whose crc32(id as text) mod 5 is not 0 are learnt from. The model, a few
thousand numbers, goes to the tasks, which score whole texts where they lie: nothing shuffles but the labels.

Nulls and edge cases: a null text is empty, and its features are those of the empty text; a null id is neither learnt
from nor held out, and its text is scored; null labels are left out; labels that repeat an id count once, by their
mean; without labels, or with one kind only, every score is the share of label 1, smoothed; an empty table gives an
empty result; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table, text_key

MAX_TRAINING = 20_000
FOLDS = 5
CUT = 0.3
BINS, PAIR_BINS, PAIRS = 48, 12, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 160, 80, 0.1, 3

_LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 192 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_STOP = np.array([chr(b) in ".,;:!?'\"()-" for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 for b in range(256)]) & ~_LETTERS & ~_DIGIT & ~_STOP
_EXCLAIM = np.array([chr(b) in "!?" for b in range(256)])
_HIGH = np.array([b >= 128 for b in range(256)])
FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "symbols", "stops", "exclaims", "non_ascii", "spaces",
    "distinct_words", "commonest_word", "lines_per_word", "distinct_lines", "repeated_triples", "capitalised_words", "symbol_words", "short_words", "sentence_words",
)


def features(text: str | None) -> list[float]:
    """The numbers of one text, in the order of FEATURES."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = data.split()
    w = max(1, len(words))
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x]
    letters = max(1, int(counts[_LETTERS].sum()))
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    if len(words) >= 3:
        triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7)
        repeated = 1 - len(np.unique(triples)) / len(triples)
    else:
        repeated = 0.0
    ordered = np.sort(hashes)
    commonest = int(np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))).max()) if len(ordered) else 0
    ends = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    symbolic = sum(data.count(b"%c " % c) for c in b"*&%$#|@~^=<>_")
    capitals = sum(x[:1].isupper() for x in distinct)
    short = sum(len(x) <= 3 for x in distinct)
    d = max(1, len(distinct))
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, distinct)) / d, letters / n, counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n, counts[_SYMBOL].sum() / n, counts[_STOP].sum() / n,
        counts[_EXCLAIM].sum() / n, counts[_HIGH].sum() / n, counts[_SPACE].sum() / n, len(distinct) / w, commonest / w, len(lines) / w, len(set(lines)) / max(1, len(lines)), repeated,
        capitals / d, symbolic / w, short / d, w / (ends + 1),
    ]


@dataclass
class Model:
    """base + tables[f][bin of f] + the pairs' grids[p][bin, bin]; edges cut features into bins, coarse into a grid's."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> tuple[np.ndarray, float]:
    """A tree over ordered bins: splits the range that gains most until it has so many leaves. Newton steps and gain."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    ranges, gain = [(0, len(gradient))], 0.0
    while len(ranges) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(ranges):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gains = worth(a, mid) + worth(mid, b) - worth(a, b)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (float(gains[k]), i, int(mid[k]))
        if best[1] is None:
            break
        a, b = ranges[best[1]]
        ranges[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
        gain += best[0]
    out = np.empty(len(gradient))
    for a, b in ranges:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out, gain


def _grid_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Two splits of a grid: rows in two, then each part's columns in two, wherever that gains most."""
    g, h = gradient.cumsum(1), weight.cumsum(1)
    top_g, top_h = g.cumsum(0), h.cumsum(0)
    best = (-1.0, 1, 1, 1)
    all_g, all_h = top_g[-1], top_h[-1]
    for r in range(1, len(g)):
        gain, cuts = 0.0, []
        for pg, ph in ((top_g[r - 1], top_h[r - 1]), (all_g - top_g[r - 1], all_h - top_h[r - 1])):
            worth = pg[:-1] ** 2 / (ph[:-1] + 1) + (pg[-1] - pg[:-1]) ** 2 / (ph[-1] - ph[:-1] + 1)
            cuts.append(int(worth.argmax()) + 1)
            gain += float(worth.max())
        if gain > best[0]:
            best = (gain, r, *cuts)
    out = np.empty_like(gradient)
    for rows, c in ((slice(0, best[1]), best[2]), (slice(best[1], None), best[3])):
        for part in (slice(0, c), slice(c, None)):
            out[rows, part] = gradient[rows, part].sum() / (weight[rows, part].sum() + 1.0)
    return out, best[0] - float(gradient.sum() ** 2 / (weight.sum() + 1.0))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of FEATURES; y: labels from 0 to 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    empty = Model(float(np.log(share / (1 - share))), [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [np.zeros(0)] * len(FEATURES), [], [])
    if len(y) < 2 or y.min() == y.max():
        return empty
    edges, coarse = [_cuts(c, BINS) for c in x.T], [_cuts(c, PAIR_BINS) for c in x.T]
    at = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), empty.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(len(tables)):
            g, h = slope()
            step, _ = _tree(np.bincount(at[f], g, len(tables[f])), np.bincount(at[f], h, len(tables[f])), LEAVES)
            tables[f] += RATE * step
            total += RATE * step[at[f]]
    g, h = slope()
    shapes = [len(e) + 1 for e in coarse]
    usable = [f for f in range(len(shapes)) if shapes[f] > 1]
    grid = lambda v, f, k: np.bincount(rough[f] * shapes[k] + rough[k], v, shapes[f] * shapes[k]).reshape(shapes[f], shapes[k])
    gains = sorted(((_grid_tree(grid(g, f, k), grid(h, f, k))[1], f, k) for i, f in enumerate(usable) for k in usable[i + 1 :]), reverse=True)[:PAIRS]
    pairs = [(f, k) for gain, f, k in gains if gain > 0]
    grids = [np.zeros((shapes[f], shapes[k])) for f, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for p, (f, k) in enumerate(pairs):
            g, h = slope()
            step, _ = _grid_tree(grid(g, f, k), grid(h, f, k))
            grids[p] += RATE * step
            total += RATE * step[rough[f], rough[k]]
    return Model(empty.base, edges, tables, coarse, pairs, grids)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def with_features(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with features, an array of double."""
    name = free_name(rows, "features")

    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return rows.withColumn(name, udf(text_col))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING) -> DataFrame:
    """(id, label, features) of `most` texts at most, outside the held-out fold: of labelled ids those of least hash, and of their
    texts likewise. Rows that repeat both id and text are one, so a repeated id brings no more than any other."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("label"))
    ids = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    few = texts.select("id", "key").distinct().orderBy(F.xxhash64("id", "key"), "id", "key").limit(most)
    once = texts.join(F.broadcast(few), ["id", "key"]).groupBy("id", "key", "label").agg(F.first("text").alias("text"))
    return with_features(once, "text").select("id", "key", "label", "features")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING) -> Model:
    """Fits on a bounded sample of the labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, most).drop("key").toPandas()
    rows = rows.assign(order=[tuple(f) for f in rows["features"]]).sort_values(["id", "order"])
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with held_out, score and predicted."""
    names = [free_name(docs, c) for c in ("held_out", "score", "predicted")]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))))

    out = docs.withColumn(names[1], score(text_col))
    return out.withColumns({names[0]: F.coalesce(held_out(F.col(id_col)), F.lit(False)), names[2]: (F.col(names[1]) >= cut).cast("int")})


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")
