"""Quality classifier: Bradley-Terry scores from preference pairs.

Each document has a vector of text statistics. Labelled rows give preference pairs:
a good document is preferred to a bad one. The score is a linear function of the
statistics, fitted by Newton's method on the logistic loss of the pairs' feature
differences (with a small ridge), as in a Bradley-Terry model whose strengths are
linear in features. Documents below a quantile of all documents' scores are marked.

The fit uses about ``max_labelled`` labelled rows, chosen by id hash, and
``pairs_per_row`` partners for each of them. Scores, their quantile (exact: counts of
a histogram that narrows on the rank) and the marks cover all documents. Texts are
read once; what is kept of them is one small vector.

Defined results
---------------
* null, empty and wordless texts have a null score, are not kept and don't count for the quantile.
* the quantile is ``drop``, or if that is None the share of bad rows among the labelled; documents that score below it go, ties with it stay.
* without a pair of labels every score is 0 and every document with words stays.
* rows that repeat an id get equal results if their texts are equal; labels that repeat count each time; null labels don't count.
* other columns pass through except the text; ``score`` and ``keep`` get leading underscores if their names are taken. Empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import Words, as_strings, slices
from .common import col, durable, fresh, require

FEATURES = ["log_words", "word_length", "upper", "symbols", "exclaim", "bars", "digits", "distinct", "adjacent_repeat", "line_words", "short_words", "stops", "title"]
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[]^_`{}~\\"))


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, len(FEATURES)) statistics and whether the text has any word."""
    out, has = [np.zeros((0, len(FEATURES)))], [np.zeros(0, bool)]
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        w = Words(part)
        raw = Words.bytes_of(part)
        n = np.maximum(w.count, 1).astype(float)
        size = np.maximum(np.diff(raw[1]), 1).astype(float)

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.append(0, np.cumsum(mask))
            return (total[raw[1][1:]] - total[raw[1][:-1]]) / size

        def words_where(mask: np.ndarray) -> np.ndarray:
            return np.bincount(w.doc[mask], minlength=b - a)

        data = raw[0]
        ascii_upper = (data >= 65) & (data <= 90)
        latin_upper = np.append(False, (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))[: len(data)]
        length = w.end - w.start
        key = np.sort((w.hash >> np.uint64(16)) | (w.doc.astype(np.uint64) << np.uint64(48)))
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(w.hash)]
        lines = share(data == 10) * size + 1
        columns = [
            np.log1p(w.count), np.bincount(w.doc, weights=length, minlength=b - a) / n, share(ascii_upper | latin_upper), share(_SYMBOL[data]),
            share(data == 33), share(data == 124), share((data >= 48) & (data <= 57)), np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=b - a) / n / np.sqrt(1 / n),
            words_where(again) / n, np.log1p(w.count / lines), words_where(length < 4) / n, share((data == 46) | (data == 44)), share(ascii_upper) * size / n,
        ]
        out.append(np.stack(columns, axis=1))
        has.append(w.count > 0)
    return np.concatenate(out), np.concatenate(has)


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs_per_row: int = 8, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights w that maximise the likelihood of sigmoid(w . (good - bad)) over random pairs."""
    rng = np.random.Generator(np.random.PCG64(3))
    n = max(len(good), len(bad)) * pairs_per_row
    x = good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)]
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(x @ v)).mean() + ridge / 2 * v @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
        grad = -(x * p[:, None]).mean(axis=0) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-10:
            break
        w, now = w - size * step, new
    return w


def exact_quantile(values: DataFrame, name: str, q: float, bins: int = 4096, at_most: int = 10_000) -> float | None:
    """The value at rank floor(q * n) of a column without nulls, by histograms that narrow on it."""
    low, high, n = values.agg(F.min(name), F.max(name), F.count("*")).first()
    if not n:
        return None
    rank = min(int(q * n), n - 1)
    while True:
        inside = values.where((F.col(name) >= low) & (F.col(name) <= high))
        width = (high - low) / bins
        if low == high or width <= 0 or low + width == low:
            return low
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)).alias("place")
        seen = 0
        for row in inside.groupBy(place).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).orderBy("place").collect():
            if seen + row["n"] > rank:
                break
            seen += row["n"]
        rank, low, high = rank - seen, row["low"], row["high"]
        if row["n"] <= at_most:
            return sorted(r[0] for r in values.where((F.col(name) >= low) & (F.col(name) <= high)).select(name).collect())[rank]


def rank_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", drop: float | None = None, max_labelled: int = 20_000, pairs_per_row: int = 8
) -> DataFrame:
    """``docs`` without the text but with ``score`` and ``keep``; see the module's text."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    stats, score, keep = fresh(docs, "stats", "score", "keep")
    at = docs.columns.index(text_col)
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField(stats, T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, has = statistics(as_strings(batch.column(at)))
            rows = pa.array([list(v) if h else None for v, h in zip(x, has)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], rows], [*rest, stats])

    rows = durable(docs.mapInArrow(measure, schema))
    known = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("label_id"), (col(label_col) > 0).alias("good"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < round(max_labelled / n * (1 << 20)))
    sample = rows.where(col(stats).isNotNull()).select(col(id_col).alias("id"), col(stats).alias("x")).join(known, F.col("id") == F.col("label_id")).select("good", "x").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES))
    good = sample["good"].to_numpy(bool)
    total = F.lit(0.0)
    if good.any() and not good.all():
        order = np.lexsort((*x.T, good))  # the draw of pairs does not depend on the order of arrival
        x, good = x[order], good[order]
        mean, spread = x.mean(axis=0), x.std(axis=0)
        spread[spread == 0] = 1
        w = fit_pairs((x[good] - mean) / spread, (x[~good] - mean) / spread, pairs_per_row) / spread
        total = reduce(lambda s, i: s + F.lit(float(w[i])) * col(stats)[i], range(len(w)), F.lit(float(-mean @ w)))
        drop = float((~good).mean()) if drop is None else drop
    scored = rows.withColumn(score, F.when(col(stats).isNotNull(), F.round(total, 6))).drop(stats)
    bar = exact_quantile(scored.where(col(score).isNotNull()).select(col(score).alias("s")), "s", drop or 0.0)
    return scored.withColumn(keep, F.coalesce(col(score) >= F.lit(bar if bar is not None else 0.0), F.lit(False)))
