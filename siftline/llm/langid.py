"""Language identification as mixture inference.

Each language is a distribution over hashed byte trigrams of the lower-cased
letters of its texts, learned from rows that carry a language label. A document
is a mixture of these and of ``und``, a uniform distribution for what no known
language explains. Expectation-maximisation estimates the mixture's proportions;
the language set is the one with the highest likelihood less ``penalty`` x
log(trigrams) for each member. Sets are tried in the order of the proportions, and
the search for a document ends when the concave likelihood's duality gap proves
that no larger set can win.

Fitting reads a sample of about ``max_train`` labelled rows, chosen by id hash;
the trigram counts are summed by Spark, so what reaches the driver is one row for
each language and trigram. Inference is one pass over all documents, whole texts,
without a shuffle.

Defined results
---------------
* null, empty or letterless texts: no languages, no shares, rejected.
* a document is rejected if ``und`` has the largest share or stands alone.
* languages are ordered by share, ties by code; equal rows get equal results.
* ids and other columns may be null, repeated or anything else; they pass through. New columns get leading underscores if their names are taken.
* an empty table gives an empty table; without any labelled row every document is ``und`` and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import _CLASS, as_strings, byte_view, slices
from .common import col, fresh, require

BINS = 4096
_LETTER = _CLASS.copy()
_LETTER[ord("0") : ord("9") + 1] = 0
_rng = np.random.Generator(np.random.PCG64(23))
_H = [_rng.integers(0, BINS, 256).astype(np.int64) for _ in range(3)]
ROWS = 256


def gram_counts(texts: pa.Array) -> np.ndarray:
    """(n, BINS) counts of hashed trigrams whose middle byte belongs to a letter."""
    data, off = byte_view(pc.utf8_lower(as_strings(texts)))
    n = len(off) - 1
    c = _LETTER[data]
    if len(c) < 3:
        return np.zeros((n, BINS), np.float32)
    doc = np.repeat(np.arange(n), np.diff(off))
    ok = (c[1:-1] != 0) & (doc[:-2] == doc[2:])
    cell = (_H[0][c[:-2]] + 3 * _H[1][c[1:-1]] + 5 * _H[2][c[2:]]) & (BINS - 1)
    return np.bincount((doc[:-2] * BINS + cell)[ok], minlength=n * BINS).astype(np.float32).reshape(n, BINS)


def _em(counts: np.ndarray, total: np.ndarray, share: np.ndarray, p: np.ndarray, steps: int):
    """Proportions after ``steps`` steps, log-likelihood there, and the gradient of each component."""
    for step in range(steps + 1):
        mix = np.maximum(share @ p, 1e-30)
        pull = (counts / mix) @ p.T / total[:, None]
        if step < steps:
            share = share * pull
            share /= share.sum(axis=1, keepdims=True)
    return share, np.einsum("ij,ij->i", counts, np.log(mix), dtype=np.float64), pull


def mixtures(counts: np.ndarray, p: np.ndarray, penalty: float) -> np.ndarray:
    """(n, K) proportions of the chosen sets; rows without trigrams are zero."""
    out = np.zeros((len(counts), len(p)))
    rows = np.flatnonzero(counts.sum(axis=1) > 0)
    if not len(rows):
        return out
    counts = counts[rows]
    total = counts.sum(axis=1)
    k = len(p)
    cost = penalty * np.log1p(total.astype(np.float64))
    full, ll, pull = _em(counts, total, np.full((len(rows), k), 1 / k, np.float32), p, 12)
    bound = ll + total * np.maximum(pull.max(axis=1) - 1, 0)
    single = (counts @ np.log(p).T).astype(np.float64)
    best = single.max(axis=1) - cost
    share = np.zeros((len(rows), k))
    share[np.arange(len(rows)), single.argmax(axis=1)] = 1
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        open_ = np.flatnonzero(best < bound - size * cost)
        if not len(open_):
            break
        start = full[open_].copy()
        np.put_along_axis(start, order[open_, size:], 0, axis=1)
        start /= start.sum(axis=1, keepdims=True)
        got, ll, _ = _em(counts[open_], total[open_], start, p, 25)
        better = ll - size * cost[open_] > best[open_]
        best[open_[better]] = (ll - size * cost[open_])[better]
        share[open_[better]] = got[better]
    out[rows] = share
    return out


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 8000) -> tuple[list[str], np.ndarray]:
    """Codes (``und`` last) and their (K, BINS) distributions, from about ``max_train`` labelled rows."""
    require(docs, id_col, text_col, lang_col)
    rows = docs.where(col(lang_col).isNotNull() & col(text_col).isNotNull()).select(
        col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"), F.pmod(F.xxhash64(col(id_col)), F.lit(1 << 20)).alias("draw")
    )
    n = rows.count()
    sample = rows.where(F.col("draw") < max(1, round(max_train / max(n, 1) * (1 << 20)))) if n > max_train else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = as_strings(batch.column(1))
            for a, b in slices(texts, rows=ROWS):
                counts = gram_counts(texts.slice(a, b - a))
                for lang in set(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + counts[langs[a:b] == lang].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            bins = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins), pa.array(total[bins].astype(np.int64))], ["lang", "bin", "n"])

    found = sample.select("lang", "text").mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    codes = sorted(x for x in set(found["lang"]) if x != "und")
    p = np.ones((len(codes) + 1, BINS))
    for i, code in enumerate(codes):
        own = found[found["lang"] == code]
        p[i] = 0.5
        p[i, own["bin"].to_numpy()] += own["n"].to_numpy()
    return [*codes, "und"], (p / p.sum(axis=1, keepdims=True)).astype(np.float32)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = 4.0, max_train: int = 8000, model: tuple[list[str], np.ndarray] | None = None
) -> DataFrame:
    """``docs`` with ``languages``, ``shares`` (rounded to 4 digits) and ``accepted``; see the module's text."""
    require(docs, id_col, text_col)
    codes, p = model or fit_languages(docs, id_col, text_col, lang_col, max_train)
    languages, shares, accepted = fresh(docs, "languages", "shares", "accepted")
    at, names = docs.columns.index(text_col), [*docs.columns, languages, shares, accepted]
    added = [T.StructField(languages, T.ArrayType(T.StringType())), T.StructField(shares, T.ArrayType(T.DoubleType())), T.StructField(accepted, T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(at))
            share = [np.zeros((0, len(codes)))]
            share += [mixtures(gram_counts(texts.slice(a, b - a)), p, penalty) for a, b in slices(texts, rows=ROWS)]
            share = np.round(np.concatenate(share), 4)
            order = np.argsort(-share, axis=1, kind="stable")
            langs = [[codes[k] for k in o if s[k] > 0] for o, s in zip(order, share)]
            parts = [[float(s[k]) for k in o if s[k] > 0] for o, s in zip(order, share)]
            fine = [bool(x) and x[0] != "und" for x in langs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(fine, pa.bool_())], names=names
            )

    return docs.mapInArrow(infer, schema)
