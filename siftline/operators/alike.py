"""Pairs of alike strings: candidates by the letters they share, scores bit-parallel over many pairs at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Longest string and most letters of the kernels below; other pairs are scored one at a time. Pairs scored at once. Classes of letters.
_WIDE, _LETTERS, _SLAB, _CLASSES = 64, 512, 1 << 14, 64
_WINDOW = np.array([[sum(1 << k for k in range(max(0, i - r), min(_WIDE, i + r + 1))) for r in range(_WIDE // 2)] for i in range(_WIDE)], np.uint64)
_ONE = np.uint64(1)


class Strings:
    """Strings as numbers of their letters, and for each letter the places where it stands, as bits."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        self.texts, self.size, rows = texts, np.fromiter(map(len, texts), np.int64, n), np.arange(n)
        self.short = np.fromiter((len(t) <= _WIDE and "\0" not in t for t in texts), bool, n)
        raw = np.array([t if s else "" for t, s in zip(texts, self.short)], f"U{_WIDE}").view(np.uint32).reshape(n, _WIDE)
        letters = np.unique(np.append(raw, np.uint32(0)))
        if len(letters) > _LETTERS:
            self.short[:] = False
            raw, letters = np.zeros_like(raw), letters[:1]
        self.codes, self.marks = np.ascontiguousarray(np.searchsorted(letters, raw).T), np.zeros((n, len(letters)), np.uint64)
        self.bag = np.zeros((n, _CLASSES), np.uint32)
        for i in range(_WIDE):
            self.marks[rows, self.codes[i]] |= _ONE << np.uint64(i)
            np.add.at(self.bag, (rows, raw[:, i] % _CLASSES), raw[:, i] > 0)
        self.marks[:, 0] = 0  # what lies behind the end
        for k in np.flatnonzero(~self.short):
            self.bag[k] = np.bincount(np.frombuffer(texts[k].encode("utf-32-le", "surrogatepass"), np.uint32) % _CLASSES, minlength=_CLASSES)

    def places(self, p: np.ndarray, q: np.ndarray, upto: int) -> Iterator[np.ndarray]:
        """For one letter of each of p after the other, where it stands in each of q."""
        flat, row = self.marks.ravel(), q * self.marks.shape[1]
        for i in range(upto):
            yield flat.take(row + self.codes[i].take(p))

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many letters any two of left and right have in common at most, places aside: of each class the smaller number."""
        a, b = self.bag[left], self.bag[right]
        out, most = np.zeros((len(left), len(right)), np.float32), np.minimum(a.max(0), b.max(0))
        kinds = [(k, t) for k in range(_CLASSES) for t in range(1, int(most[k]) + 1)]
        for at in range(0, len(kinds), 512):
            k, t = np.array(kinds[at : at + 512]).T
            out += (a[:, k] >= t).astype(np.float32) @ (b[:, k] >= t).astype(np.float32).T
        return out


def jaro(s: Strings, p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, score) of pairs of short strings, without those that stay under ``least``."""
    la, lb = s.size[p], s.size[q]
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    taken, mine = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    for i, at in enumerate(s.places(p, q, la.max(initial=0))):
        free = at & _WINDOW[i].take(reach) & ~taken
        first = free & (~free + _ONE)
        taken |= first
        mine |= (first != 0).astype(np.uint64) << np.uint64(i)
    m = np.bitwise_count(mine).astype(np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        keep = ~((m / la + m / lb + 1) / 3 < least)
    p, q, la, lb, taken, mine, m = (x[keep] for x in (p, q, la, lb, taken, mine, m))
    swaps = np.zeros(len(p), np.uint64)
    for i, at in enumerate(s.places(p, q, la.max(initial=0))):
        has, first = mine >> np.uint64(i) & _ONE, taken & (~taken + _ONE)
        swaps += has & (at & first == 0)
        taken ^= first * has
    with np.errstate(invalid="ignore", divide="ignore"):
        score = (m / la + m / lb + (m - (swaps // np.uint64(2)).astype(np.int64)) / m) / 3
    return p, q, np.where(m > 0, score, (la + lb == 0).astype(float))


def jaro_winkler(s: Strings, p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, q, score = jaro(s, p, q, (least - 0.4) / 0.6 - 1e-9)
    same = np.cumprod((s.codes[:4, p] == s.codes[:4, q]) & (s.codes[:4, p] > 0), axis=0).sum(0)
    return p, q, np.where(score > 0.7, score + same * 0.1 * (1 - score), score)


def levenshtein(s: Strings, p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, 1 - distance / longer length) of pairs of short strings."""
    la, lb = s.size[p], s.size[q]
    far = lb.copy()
    last = np.where(lb > 0, _ONE << np.maximum(lb - 1, 0).astype(np.uint64), np.uint64(0))
    up, down = np.full(len(p), ~np.uint64(0)), np.zeros(len(p), np.uint64)
    for i, at in enumerate(s.places(p, q, la.max(initial=0))):
        x = at | down
        diagonal = ((up + (x & up)) ^ up) | x
        plus, minus = down | ~(up | diagonal), up & diagonal
        end = np.where(i < la, last, np.uint64(0))
        far += (plus & end != 0).astype(np.int64) - (minus & end != 0)
        x = plus << _ONE | _ONE
        up, down = minus << _ONE | ~(x | diagonal), x & diagonal
    far = np.where(lb > 0, far, la)
    return p, q, 1 - far / np.maximum(np.maximum(la, lb), 1)


def levenshtein_of_two(a: str, b: str) -> float:
    """The same for two strings of any length."""
    if not a or not b:
        return 1.0 - max(len(a), len(b)) / max(len(a), len(b), 1)
    marks: dict[str, int] = {}
    for i, c in enumerate(b):
        marks[c] = marks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    far, up, down = len(b), full, 0
    for c in a:
        x = marks.get(c, 0) | down
        diagonal = (((up + (x & up)) ^ up) | x) & full
        plus, minus = down | (~(up | diagonal) & full), up & diagonal
        far += (plus >> len(b) - 1 & 1) - (minus >> len(b) - 1 & 1)
        x = plus << 1 | 1
        up, down = (minus << 1 | ~(x | diagonal)) & full, x & diagonal & full
    return 1 - far / max(len(a), len(b))


KERNELS = {"levenshtein": levenshtein, "jaro": jaro, "jaro_winkler": jaro_winkler}


def _bound(metric: str, shared: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """What a score can be at most."""
    if metric == "levenshtein":
        best = shared / np.maximum(np.maximum(la, lb), 1)
    else:
        best = (shared / np.maximum(la, 1) + shared / np.maximum(lb, 1) + 1) / 3
        best = best + 0.4 * (1 - best) if metric == "jaro_winkler" else best
    return np.where(la + lb == 0, 1.0, best)


def alike(metric: str, threshold: float, one: Callable[[str, str], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted rows (block, i, j, own, id, t), the pairs (x, y, score) of each tile (block, i, j) that may reach the threshold once rounded.

    A tile's rows with ``own`` = i meet those with ``own`` = j. Memory follows the rows of the largest tile.
    """
    least = threshold - 1e-6

    def candidates(s: Strings, left: np.ndarray, right: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(left), 256):
            l = left[at : at + 256]  # noqa: E741
            good = ~(_bound(metric, s.shared(l, right), s.size[l][:, None], s.size[right][None, :]) < least)
            if alone:
                good &= np.arange(at, at + len(l))[:, None] < np.arange(len(right))[None, :]
            x, y = np.nonzero(good)
            yield l[x], right[y]

    def scored(s: Strings, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        short = s.short[p] & s.short[q]
        fast = np.flatnonzero(short)
        for at in range(0, len(fast), _SLAB):
            k = fast[at : at + _SLAB]
            yield KERNELS[metric](s, p[k], q[k], least)
        if not short.all():
            p, q = p[~short], q[~short]
            yield p, q, np.array([one(s.texts[x], s.texts[y]) for x, y in zip(p, q)])

    def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, s = table["id"].combine_chunks(), Strings(table["t"].to_pylist())
        keys = list(zip(*(table[c].to_pylist() for c in ("block", "i", "j"))))
        own = table["own"].to_numpy()
        starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            rows, (_, i, j) = np.arange(start, end), keys[start]
            for found in candidates(s, rows[own[start:end] == i], rows[own[start:end] == j], i == j):
                held.append(found)
                if sum(len(p) for p, _ in held) >= 1 << 18:
                    yield from batch(s, ids, held)
                    held = []
        yield from batch(s, ids, held)

    def batch(s: Strings, ids: pa.Array, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        parts = []
        for p, q, score in scored(s, *(np.concatenate(x) for x in zip(*held))):
            good = score >= least
            parts.append((p[good], q[good], score[good]))
        if parts:
            p, q, score = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(score)], ["x", "y", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for new in batches:
            if not new.num_rows:
                continue
            key = lambda b, k: tuple(b[c][k].as_py() for c in ("block", "i", "j"))
            last, cut = key(new, new.num_rows - 1), new.num_rows - 1
            while cut and key(new, cut - 1) == last:
                cut -= 1
            if cut:
                yield from results(pa.Table.from_batches([*held, new.slice(0, cut)]))
                held = []
            elif held and key(held[-1], 0) != last:
                yield from results(pa.Table.from_batches(held))
                held = []
            held.append(new.slice(cut))
        if held:
            yield from results(pa.Table.from_batches(held))

    return run
