"""Periodic runs of words by block convolution.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are equal) that is at least
max(MIN_LENGTH, 2q) words long. Dyadic scales: periods from 2L to 4L - 1 belong to blocks of L words (the smallest
periods to the smallest blocks). A run of period q then holds an aligned block of L words together with the same words q
places later. For every block the sum of squared differences to all places of the window that follows,

    sum x^2 + sum y^2 - 2 (x correlated with y),

comes from exact integer number-theoretic transforms, all blocks of a batch of documents at once; words are numbers modulo
the transform's prime, so a zero-mismatch occurrence is always a zero. Each zero is a seed (block, distance). Seeds of
neighbouring blocks at one distance are one stretch; its two ends are extended word by word (less than a block each way),
which also throws out the rare zero that is no match, as word numbers themselves are compared. Stretches of less than
max(MIN_LENGTH, 2q) words go, and of several distances with one extent only the smallest is its period.

Words are runs of bytes other than ASCII white space, case kept. Documents lie one after another in a batch; no seed
crosses a document. Null, empty and blank texts have no run. Repeated rows get equal results, a null doc_id is kept. Very
long texts are treated whole: transforms longer than 2**16 take a larger prime. Memory grows with a batch's longest
text alone. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MIN_LENGTH = 12
# Words of a batch that are numbered and searched together, and numbers of one block of transforms (both or one longer text).
BATCH_WORDS = 1 << 17
STEP = 1 << 15
# Primes with a primitive root; 65537 = 2**16 + 1 is reduced without a division and serves transforms up to 2**16.
FERMAT = (65537, 3)
LARGE = (998244353, 3)

class Transform:
    """Number-theoretic transform of length n over the columns of an (n, m) array. `forward` leaves the spectrum in
    bit-reversed order, which `inverse` takes."""

    _known: dict[int, "Transform"] = {}

    def __init__(self, n: int):
        self.n = n
        self.p, root = FERMAT if n <= FERMAT[0] - 1 else LARGE
        if n > 1 << 23:
            raise ValueError("a transform holds at most 2**23 numbers")
        w = pow(root, (self.p - 1) // n, self.p)
        self.stages = []  # from half = n / 2 down to 1
        half = n // 2
        while half:
            step = pow(w, n // 2 // half, self.p)
            self.stages.append((half, self._powers(step, half), self._powers(pow(step, -1, self.p), half)))
            half //= 2
        self.scale = pow(n, -1, self.p)

    @classmethod
    def of(cls, n: int) -> "Transform":
        if n not in cls._known:
            cls._known[n] = cls(n)
        return cls._known[n]

    def _powers(self, w: int, n: int) -> np.ndarray:
        out = np.ones(1, np.int64)
        while len(out) < n:
            out = np.concatenate([out, out * pow(w, len(out), self.p) % self.p])
        return out[:n]

    def reduce(self, x: np.ndarray, folds: int = 2) -> np.ndarray:
        """x, overwritten by small numbers congruent to it. For 65537, as 2**16 is -1, a fold takes 16 bits off and may leave
        a negative number; two take any product to 18 bits."""
        if self.p != FERMAT[0]:
            x %= self.p
            return x
        for _ in range(folds):
            high = x >> 16
            x &= 0xFFFF
            x -= high
        return x

    def _twiddled(self, d: np.ndarray, w: np.ndarray, stage: int) -> np.ndarray:
        # A stage adds at most two bits to numbers folded once: below 2**63 in all stages, if the later ones fold twice.
        return self.reduce(d * w[None, :, None], 1 if stage < 8 else 2) if len(w) > 1 else d

    def forward(self, a: np.ndarray) -> np.ndarray:
        n, m = a.shape
        for i, (half, w, _) in enumerate(self.stages):
            v, out = a.reshape(n // (2 * half), 2, half, m), np.empty_like(a)
            o = out.reshape(v.shape)
            np.add(v[:, 0], v[:, 1], out=o[:, 0])
            o[:, 1] = self._twiddled(v[:, 0] - v[:, 1], w, i)
            a = out if self.p == FERMAT[0] else self.reduce(out)
        return self.reduce(a)

    def inverse(self, a: np.ndarray) -> np.ndarray:
        n, m = a.shape
        for i, (half, _, w) in enumerate(reversed(self.stages)):
            v, out = a.reshape(n // (2 * half), 2, half, m), np.empty_like(a)
            o = out.reshape(v.shape)
            d = self._twiddled(v[:, 1], w, i)
            np.add(v[:, 0], d, out=o[:, 0])
            np.subtract(v[:, 0], d, out=o[:, 1])
            a = out if self.p == FERMAT[0] else self.reduce(out)
        a = self.reduce(a)
        a *= self.scale
        return self.reduce(a)


def scales(n: int):
    """(block length, smallest, largest period) for texts of at most n words."""
    yield 2, 1, 7
    size = 4
    while 4 * size <= n:  # a run of the scale's smallest period, 2 * size, has twice as many words
        yield size, 2 * size, 4 * size - 1
        size *= 2


def transform_of(size: int, least: int, most: int) -> Transform:
    """The shortest transform in which a block and its window do not wrap around."""
    return Transform.of(1 << (most - least + 2 * size - 2).bit_length())


def block_zeros(x: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance): the aligned blocks of x that recur at a distance from least to most, by squared differences
    that vanish modulo the transform's prime. Beyond the end x is continued with zeros."""
    t = transform_of(size, least, most)
    window, blocks = most - least + size, len(x) // size
    padded = np.concatenate([x % t.p, np.zeros(least + window + size, np.int64)])
    squares = np.concatenate([[0], np.cumsum(padded * padded % t.p)])
    squares = squares[size:] - squares[:-size]  # of the `size` words from each place
    views = np.lib.stride_tricks.sliding_window_view(padded, window)
    square_views = np.lib.stride_tricks.sliding_window_view(squares, most - least + 1)
    starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    each = max(1, STEP // t.n)
    for i in range(0, blocks, each):
        j = min(blocks, i + each)
        first, last = i * size, (j - 1) * size + 1
        a = np.zeros((t.n, j - i), np.int64)
        a[:size] = padded[first: j * size].reshape(-1, size).T[::-1]  # reversed, so that the product is the correlation
        b = np.zeros((t.n, j - i), np.int64)
        b[:window] = views[first + least: last + least: size].T
        c = t.inverse(t.reduce(t.forward(a) * t.forward(b)))[size - 1: size + most - least]
        apart = squares[first: last: size] + square_views[first + least: last + least: size].T - 2 * c
        d, k = np.nonzero(apart % t.p == 0)
        starts.append(first + k * size)
        found.append(d + least)
    return np.concatenate(starts), np.concatenate(found)


def _extend(x: np.ndarray, at: np.ndarray, q: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many further words equal those q places later, from `at` in direction `step`, up to `limit` of them each."""
    out = np.zeros(len(at), np.int64)
    act = np.flatnonzero(limit > 0)
    width = 4
    while len(act):
        i = np.minimum(np.arange(width)[None, :], limit[act, None] - out[act, None] - 1)  # beyond the limit: its last word again
        pos = at[act, None] + step * (out[act, None] + i)
        same = x[pos] == x[pos + q[act, None]]
        run = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[act] = np.minimum(out[act] + run, limit[act])
        act = act[(run == width) & (out[act] < limit[act])]
        width = min(2 * width, max(4, STEP // max(1, len(act))))
    return out


def _stretches(y: np.ndarray, start: int, end: int, q: int):
    """The maximal stretches of period q in y[start:end] (whose neighbours do not continue it)."""
    same = np.concatenate([[False], y[start: end - q] == y[start + q: end], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return start + edge[::2], start + edge[1::2] + q


def _proven(y: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray, min_length: int):
    """(start, end, period) of the runs among candidate stretches. In each extent the smallest distance is compared word by
    word; where it holds, its multiples have the same words and no smaller period. What does not hold is split."""
    order = np.lexsort((q, end, start))
    out, extent, period = [], None, 0
    for s, e, d in zip(start[order].tolist(), end[order].tolist(), q[order].tolist()):
        if extent == (s, e) and d % period == 0:
            continue
        for s2, e2 in zip(*(c.tolist() for c in _stretches(y, s, e, d))):
            if e2 - s2 >= max(min_length, 2 * d):
                out.append((s2, e2, d))
                if (s2, e2) == (s, e) and extent != (s, e):
                    extent, period = (s, e), d
    return out


def runs(x: np.ndarray, off: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run in the word numbers x of documents off[i]:off[i+1], by document,
    start and period."""
    if min_length < 5:
        raise ValueError("runs are at least five words long")
    size_of = np.diff(off)
    made = [np.zeros((0, 4), np.int64)]
    for size, least, most in scales(int(size_of.max()) if len(size_of) else 0):
        docs = np.flatnonzero(size_of >= max(min_length, 2 * least))  # that can hold a run of this scale
        if not len(docs):
            continue
        n = size_of[docs]
        new = np.concatenate([[0], np.cumsum(n)])
        y = x if len(docs) == len(size_of) else x[np.repeat(off[docs] - new[:-1], n) + np.arange(new[-1])]
        at, q = block_zeros(y, size, least, most)
        own = np.searchsorted(new, at, side="right") - 1
        ok = at + q + size <= new[own + 1]  # block and occurrence in one document, or no seed
        at, q, own = at[ok], q[ok], own[ok]
        for k in sorted({0, 1, size // 2, size - 1}):  # zeros that are no match mostly differ in these words
            ok = y[at + k] == y[at + q + k]
            at, q, own = at[ok], q[ok], own[ok]
        order = np.lexsort((at, q))
        at, q, own = at[order], q[order], own[order]
        head = np.ones(len(at), bool)  # neighbouring blocks of one document at one distance are one stretch
        head[1:] = (at[1:] != at[:-1] + size) | (q[1:] != q[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(head)
        if not len(head):
            continue
        first, last = at[head], at[np.append(head[1:], len(at)) - 1] + size
        q, own = q[head], own[head]
        start = first - _extend(y, first - 1, q, np.minimum(first - new[own], size), -1)
        end = last + q + _extend(y, last, q, np.minimum(new[own + 1] - q - last, size), 1)
        ok = end - start >= np.maximum(min_length, 2 * q)
        found = _proven(y, start[ok], end[ok], q[ok], min_length)
        if found:
            s, e, d = np.array(found, np.int64).T
            own = np.searchsorted(new, s, side="right") - 1
            made.append(np.stack([docs[own], s - new[own], e - s, d], axis=1))
    doc, start, length, period = np.concatenate(made).T
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = (c[order] for c in (doc, start, length, period))
    # one extent with several distances: the smallest is the period
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = (c[new] for c in (doc, start, length, period))
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _batches(bodies, limit: int):
    """Lists of word lists with at most `limit` words together, or one longer text."""
    group, n = [], 0
    for body in bodies:
        words = (body.as_py() or b"").split()
        if group and n + len(words) > limit:
            yield group
            group, n = [], 0
        group.append(words)
        n += len(words)
    if group:
        yield group


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: runs by start and period, and the words left when every run is cut down to
    its first period, joined by spaces."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            done = 0
            for group in _batches(b.column(1), BATCH_WORDS):
                off = np.concatenate([[0], np.cumsum([len(w) for w in group], dtype=np.int64)])
                doc, start, length, period = runs(np.concatenate([numbered(w) for w in group]), off, min_length)
                cover = np.zeros(off[-1] + 1, np.int64)
                np.add.at(cover, off[doc] + start + period, 1)
                np.add.at(cover, off[doc] + start + length, -1)
                keep = np.cumsum(cover) == 0
                kept = [b" ".join(w if k.all() else [x for x, y in zip(w, k.tolist()) if y]) for w, k in zip(group, np.split(keep[:-1], off[1:-1]))]
                at = np.searchsorted(doc, np.arange(len(group) + 1))
                items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(group)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), items), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"])
                done += len(group)

    return docs.select(F.col(doc_id), F.col(text).cast("string").cast("binary")).mapInArrow(
        run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
