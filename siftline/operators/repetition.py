"""Spurious repetition: windows of low entropy and phrases said twice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def low_entropy(codes: np.ndarray, window: int, bits: float) -> np.ndarray:
    """Mask of the positions that some window of entropy below ``bits`` covers."""
    n = len(codes) - window + 1
    mask = np.zeros(len(codes), bool)
    if n <= 0:
        return mask
    view = np.sort(np.lib.stride_tricks.sliding_window_view(codes, window), axis=1)
    run = np.ones((n, window))
    same = view[:, 1:] == view[:, :-1]
    for i in range(1, window):  # length of the run of equal values that ends here
        run[:, i] = np.where(same[:, i - 1], run[:, i - 1] + 1, 1)
    ends = np.append(~same, np.ones((n, 1), bool), axis=1)
    p = np.where(ends, run / window, 1.0)
    entropy = -(p * np.log2(p)).sum(axis=1)
    for s in np.flatnonzero(entropy < bits - 1e-12):
        mask[s : s + window] = True
    return mask


def remove_low_entropy(text: Column, window: int = 5, bits: float = 1.0, block: int = 1 << 16) -> Column:
    """Texts without characters that a window of low entropy covers."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None or len(t) < window:
                out.append(t)
                continue
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            mask = np.zeros(len(codes), bool)
            for a in range(0, len(codes), block):  # blocks overlap by a window, so memory stays bounded
                mask[a : a + block + window - 1] |= low_entropy(codes[a : a + block + window - 1], window, bits)
            out.append(codes[~mask].tobytes().decode("utf-32-le", "surrogatepass"))
        return pd.Series(out)

    return run(text)


def remove_low_entropy_words(text: Column, window: int = 20, bits: float = 3.0) -> Column:
    """The same over words."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = [] if t is None else t.split()
            codes = np.unique(words, return_inverse=True)[1].ravel() if words else np.zeros(0, np.int64)
            mask = low_entropy(codes, window, bits)
            out.append(None if t is None else " ".join(w for w, m in zip(words, mask) if not m))
        return pd.Series(out)

    return run(text)


def drop_echo(words: list[str]) -> list[str]:
    """One removal: the first phrase of two to five words that is said again at once."""
    for n in range(2, 6):
        for i in range(len(words) - 2 * n):
            if words[i : i + n] == words[i + n : i + 2 * n]:
                return words[: i + n] + words[i + 2 * n :]
    return words


def remove_echoes(text: Column, least: int = 6) -> Column:
    """In every sentence of ``least`` words or more, one repeated phrase goes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            parts = [p.strip() for p in t.split(".") if p.strip()]
            return ". ".join(p if len(p.split()) < least else " ".join(drop_echo(p.split())) for p in parts)

        return texts.map(lambda t: one(t) if t else t)

    return run(text)
