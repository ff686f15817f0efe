"""Toxicity by a classifier chain of linear models.

The label columns form the chain, in order.  Each link is a logistic regression
over the presence of word features (whole words and word beginnings, so that
inflected forms share evidence) and over the probabilities of the links before
it.  A link is trained with out-of-fold probabilities of the earlier links:
those that models fitted without the row's fold give; scoring feeds the full
models' probabilities on.

Features are chosen by their association with a label, counted by Spark over
the training rows, for the full models over all of them and for the models of a
fold without that fold's rows; the models are fitted in the driver on the chosen
features only.  Texts that share their least shingle hash, copies above all, are
in one fold, so that no fold learns from copies of its own rows.  The training
rows are bounded (``TRAIN_ROWS`` labelled rows by a hash of the id).  Scoring is
one narrow pass over all texts, with a model whose size does not depend on the
data.  The chain has as many links as there are label columns; the labels table
gives two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets
from .shared import keep, table

#: Bound of the labelled rows that are used for training, and of the features chosen for each label.
TRAIN_ROWS, FEATURES = 16_384, 512
#: Bytes of a word's beginnings that are features; a feature must be in so many training rows.
PREFIXES, LEAST = (3, 4, 5, 6, 7, 8), 4
FOLDS, L2, ROUNDS = 4, 1e-3, 100


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature hash) pairs of a run of texts, by row."""
    words = bytesets.Words(data, offsets, bytesets.LETTERS)
    if not len(words.row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = bytesets.xxh64(words.text, words.start, words.end)
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    pairs = np.unique(words.row * len(first) + inverse)
    row, word = pairs // len(first), pairs % len(first)
    kinds = [whole[first]]
    start, size = words.start[first], (words.end - words.start)[first]
    for n in PREFIXES:
        kinds.append(np.where(size > n, bytesets.xxh64(words.text, start, start + np.minimum(size, n), 100 + n), np.uint64(0)))
    grid = np.stack(kinds, axis=1)[word]
    row, feature = np.repeat(row, grid.shape[1]), grid.ravel()
    row, feature = row[feature != 0], feature[feature != 0]
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


def known_features(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index in the sorted ``chosen``) pairs: only chosen features are expanded to rows."""
    words = bytesets.Words(data, offsets, bytesets.LETTERS)
    if not len(words.row) or not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = bytesets.xxh64(words.text, words.start, words.end)
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    start, size = words.start[first], (words.end - words.start)[first]
    rows, found = [], []
    for n in (0, *PREFIXES):
        use = np.arange(len(first)) if not n else np.flatnonzero(size > n)
        value = whole[first] if not n else bytesets.xxh64(words.text, start[use], start[use] + n, 100 + n)
        at = np.minimum(np.searchsorted(chosen, value), len(chosen) - 1)
        hit = chosen[at] == value
        index = np.full(len(first), -1)
        index[use[hit]] = at[hit]
        each = index[inverse]
        rows.append(words.row[each >= 0])
        found.append(each[each >= 0])
    pairs = np.unique(np.concatenate(rows) * len(chosen) + np.concatenate(found))
    return pairs // len(chosen), pairs % len(chosen)


def features(data: np.ndarray, offsets: np.ndarray, found) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """a, b, row (from 0) and feature of rows a to b by ``found``, one of the two above; a long text is taken cut by cut."""
    for a, b in bytesets.pieces(offsets):
        part = data[offsets[a] : offsets[b]]
        if b == a + 1 and len(part) > bytesets.PIECE:
            each = np.unique(np.concatenate([found(part[i:j], np.array([0, j - i]))[1] for i, j in bytesets.spans(part, 1, bytesets.LETTERS)]))
            yield a, b, np.zeros(len(each), np.int64), each
        else:
            yield a, b, *found(part, offsets[a : b + 1] - offsets[a])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(row: np.ndarray, col: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Nesterov's method with step halving: sparse and dense weights, bias."""
    n, m = len(y), dense.shape[1]
    base = float(np.clip(y.mean() if n else 1e-6, 1e-6, 1 - 1e-6))
    x = np.zeros(width + m + 1)
    x[-1] = np.log(base / (1 - base))
    if n == 0 or y.min() == y.max():
        return x[:width], x[width:-1], float(x[-1])

    def slope(z: np.ndarray) -> tuple[float, np.ndarray]:
        p = _sigmoid(np.bincount(row, z[:width][col], n) + dense @ z[width:-1] + z[-1])
        loss = -np.mean(np.where(y > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))) + L2 / 2 * (z[:-1] @ z[:-1])
        g = (p - y) / n
        return loss, np.concatenate([np.bincount(col, g[row], width), dense.T @ g, [g.sum()]]) + L2 * np.append(z[:-1], 0)

    step, t, z, before = 16.0, 1.0, x, np.inf
    for _ in range(ROUNDS):
        loss, g = slope(z)
        if loss > before:
            step, t, z = step / 2, 1.0, x
            loss, g = slope(z)
        before = loss
        after = z - step * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, z, t = after, after + (t - 1) / t2 * (after - x), t2
    return x[:width], x[width:-1], float(x[-1])


@dataclass
class Chain:
    categories: list[str]
    chosen: np.ndarray
    links: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x categories."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.categories)))
        for a, b, row, col in features(data, offsets, lambda d, o: known_features(d, o, self.chosen)):
            for k, (w, d, bias) in enumerate(self.links):
                out[a:b, k] = _sigmoid(np.bincount(row, w[col], b - a) + out[a:b, :k] @ d + bias)
        return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, in the middle of its gap; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, features_: int = FEATURES) -> Chain:
    """A chain over ``targets`` (name to a boolean column of ``labels``, in chain order).

    Rows with a null id or label, and labels without a document, are left out;
    several labels of an id count as set if one is.  Without labelled rows every
    probability is near zero; a label of one class gets its base rate.
    """
    names = list(targets)
    kept = labels.select(F.col(f"`{id_col}`").alias("id"), *[c.cast("int").alias(n) for n, c in targets.items()]).dropna()
    kept = kept.groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    kept = kept.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it may be broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = keep(texts.join(F.broadcast(kept), "id"), "toxicity-sample")

    def folded(batches):
        for batch in batches:
            data, offsets = bytesets.raw(batch.column(1))
            mark = np.zeros(len(batch), np.uint64)
            for a, _, row, h in bytesets.shingle_hashes(data, offsets, 3):
                if len(row):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    mark[a + row[first]] = np.minimum.reduceat(h, first)
            # least hashes are small numbers: the lower bits tell them apart
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((mark % np.uint64(FOLDS)).astype(np.int32))], names=["id", "text", *names, "fold"])

    ids, each = found.schema["id"].dataType.simpleString(), ", ".join(f"{n} int" for n in names)
    sample = keep(found.select("id", "text", *names).mapInArrow(folded, f"id {ids}, text string, {each}, fold int"), "toxicity-train")

    def counted(batches):
        for batch in batches:
            data, offsets = bytesets.raw(batch.column(0))
            fold = batch.column(1).to_numpy().astype(np.int64)
            y = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(names))], 1) if len(batch) else np.zeros((0, len(names)))
            for a, b, row, feature in features(data, offsets, word_features):
                each, inverse = np.unique(feature, return_inverse=True)
                place = inverse * FOLDS + fold[a:b][row]
                sums = [np.bincount(place, minlength=len(each) * FOLDS)] + [np.bincount(place, y[a:b, k][row], len(each) * FOLDS) for k in range(len(names))]
                use = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays([pa.array(each[use // FOLDS].view(np.int64)), pa.array((use % FOLDS).astype(np.int32)), *[pa.array(s[use].astype(np.int64)) for s in sums]], names=["feature", "fold", "n", *names])

    sums = ["n", *names]
    counts = sample.select("text", "fold", *names).mapInArrow(counted, "feature long, fold int, " + ", ".join(f"{n} long" for n in sums))
    part = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}")
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in sums], *[part(c, k) for c in sums for k in range(FOLDS)])
    counts = keep(counts.where(F.col("n") >= LEAST), "toxicity-counts")
    total = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names]).collect()}
    every = {c: sum(r[c] for r in total.values()) for c in sums}

    def best(label: str, out: int | None) -> np.ndarray:
        """The features most associated with the label in all rows, or in those outside of a fold."""
        less = {c: total[out][c] if out in total else 0 for c in sums}
        rows_, hits = every["n"] - less["n"], every[label] - less[label]
        if not 0 < hits < rows_:
            return np.zeros(0, np.uint64)
        n, y = (F.col(c) - (F.col(f"{c}_{out}") if out is not None else 0) for c in ("n", label))
        expected = n * F.lit(hits / rows_)
        chi = F.pow(y - expected, 2) / (expected * F.lit(1 - hits / rows_))
        top = counts.where(n >= LEAST).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(features_).collect()
        return np.array([r["feature"] for r in top], np.int64).view(np.uint64)

    sets = [np.unique(np.concatenate([best(n, k) for n in names])) for k in (*range(FOLDS), None)]
    chosen, known = sets[-1], np.unique(np.concatenate(sets))

    def picked(batches):
        for batch in batches:
            data, offsets = bytesets.raw(batch.column(1))
            lists: list[np.ndarray] = []
            for a, b, row, col in features(data, offsets, lambda d, o: known_features(d, o, known)):
                lists += np.split(col, np.searchsorted(row, np.arange(1, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), *batch.columns[2:]], names=["id", "cols", *names, "fold"])

    # at most ``rows`` rows of a few dozen indexes each
    got = sample.select("id", "text", *names, "fold").mapInArrow(picked, f"id {ids}, cols array<int>, {each}, fold int").orderBy(F.xxhash64("id"), "id", *names).collect()
    chain = Chain(names, chosen)
    row = np.repeat(np.arange(len(got)), [len(r["cols"]) for r in got]).astype(np.int64)
    col = np.array([c for r in got for c in r["cols"]], np.int64)
    fold = np.array([r["fold"] for r in got], np.int64)
    mine = [np.isin(known, s)[col] for s in sets]  # a model's own features
    outside = np.zeros((len(got), 0))
    for n in names:
        y = np.array([r[n] for r in got], float)
        w, d, b = fit(row[mine[-1]], col[mine[-1]], len(known), outside, y)
        chain.links.append((w[np.isin(known, chosen)], d, b))
        p = np.zeros(len(got))
        for k in range(FOLDS):
            use, rest = fold != k, fold == k
            place = np.cumsum(use) - 1
            pair = use[row] & mine[k]
            w, d, b = fit(place[row[pair]], col[pair], len(known), outside[use], y[use])
            p[rest] = _sigmoid(np.bincount(row[mine[k]], w[col[mine[k]]], len(got)) + outside @ d + b)[rest] if len(got) else p[rest]
        chain.thresholds.append(_threshold(p, y))
        outside = np.column_stack([outside, p])
    return chain


def score(df: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a probability ``p_<category>`` and a boolean ``<category>`` for each category of the chain.

    Null, empty and letterless texts get the base rates.  Texts may be of any
    length.  Equal texts get equal scores; repeated rows come back as often as they came; other columns do not
    matter; an empty table gives an empty table.
    """
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = [x for n in chain.categories for x in (f"p_{n}", n)]

    def run(batches):
        for batch in batches:
            p = chain.probabilities(*bytesets.raw(batch.column(1)))
            out = [x for k, cut in enumerate(chain.thresholds) for x in (pa.array(p[:, k]), pa.array(p[:, k] > cut))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["id", *names])
        bytesets.trim()

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, " + ", ".join(f"p_{n} double, {n} boolean" for n in chain.categories))


def clean(df: DataFrame, chain: Chain, category: str, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is not in ``category``, with all their columns."""
    at, cut, place = chain.categories.index(category), chain.thresholds[chain.categories.index(category)], df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            p = chain.probabilities(*bytesets.raw(batch.column(place)))[:, at]
            yield batch.filter(pa.array(p <= cut))
        bytesets.trim()

    return df.mapInArrow(run, df.schema)


def targets() -> dict[str, Column]:
    """The chain of the labels table: what a text's quality says goes into its toxicity."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels"), targets())
    return score(docs, chain).withColumnRenamed("id", "doc_id")
