"""Removal of repeated byte strings by blockwise suffix ranking over a difference cover.

A byte goes when some string of `length` bytes that covers it starts anywhere else too (another document or the same one).
Only suffixes that may repeat are ever sorted, bucket by bucket:

1. Cover ranks. Positions whose offset in the document, modulo v, lies in a perfect difference set D (v = q*q+q+1, |D| = q+1)
   are ranked by the w = length-v+1 bytes that follow. For two equal strings starting at i and j there is a shift below v
   that takes both to cover positions, so a string repeats only if one of the cover positions in its first v bytes has a
   rank shared by another position. Anchors (positions chosen by their next ANCHOR bytes alone, about one in 32) are ranked
   the same way: a string that contains an unshared anchor does not repeat.
2. Long ties. Candidate starts that are cover positions themselves (and a document's last start) are compared on their whole
   `length` bytes. Between shared ones at most `length` apart every byte is already covered.
3. Rims. For the remaining candidates whose bytes are not all covered, a document asks, by the ranks of their cover positions,
   for the starts at the same shifts in all documents of those ranks; these and the candidates are compared the same way.

A comparison deals packed hashes into buckets by their leading bits; a task sorts one bucket and returns, per chunk of
documents, those that occur twice. Ranks are 32 bits within their bucket (a clash only adds a candidate); whole strings use
96 further bits. Buckets and chunks have bounded size, whatever the number of copies: a chunk sends each hash once.

Null text counts as empty; texts shorter than `length` keep everything. Repeated rows repeat each other (all their covered
bytes go). Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, bounded_batches, discard, flat, mix64, parts_for, prefix_hash, row_blocks, span_hash, store

LENGTH = 400
ANCHOR = 24
ANCHOR_EVERY = 32
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20  # text behind one bucket of ranks
_SECOND = mix64(BYTE_VALUE)


def difference_cover(length: int = LENGTH) -> tuple[int, np.ndarray]:
    """(v, D): the largest perfect difference set (Singer) with v at most 4/5 of the length; it holds 0.

    In the cyclic group of points of the projective plane over q, the points of one line meet every difference once: with
    x**3 = a*x**2 + b*x + c, the powers of x without an x**2 term.
    """
    primes = [p for p in range(2, 200) if all(p % d for d in range(2, p)) and p * p + p + 1 <= length * 4 // 5]
    for q in reversed(primes):
        v = q * q + q + 1
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    x, d = (1, 0, 0), []
                    for i in range(v):
                        if x[2] == 0:
                            d.append(i)
                        top = x[2]
                        x = (top * c % q, (x[0] + top * b) % q, (x[1] + top * a) % q)
                    if len(d) == q + 1 and len({(s - t) % v for s in d for t in d}) == v:
                        return v, np.array(d)
    return 1, np.zeros(1, np.int64)


class Plan:
    """The numbers of one run: string length, cover, ranked bytes, buckets."""

    def __init__(self, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.v, cover = difference_cover(length)
        self.w = length - self.v + 1
        self.anchor = min(ANCHOR, self.w)
        self.in_cover = np.zeros(self.v, bool)
        self.in_cover[cover] = True

    def places(self, buf: np.ndarray, off: np.ndarray):
        """Cover positions and anchors of a buffer of documents, with their rank hashes."""
        s = prefix_hash(buf)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        pos = np.arange(len(buf)) - off[doc]
        room = off[doc + 1] - np.arange(len(buf))
        at = np.flatnonzero(self.in_cover[pos % self.v] & (room >= self.w))
        k = np.flatnonzero((room >= self.anchor) & (off[doc + 1] - off[doc] >= self.length))
        h = mix64(span_hash(s, k, k + self.anchor))
        chosen = h % np.uint64(ANCHOR_EVERY) == 0
        return at, mix64(span_hash(s, at, at + self.w)), k[chosen], mix64(h[chosen] + np.uint64(1))

    def asked(self, candidate: np.ndarray) -> np.ndarray:
        """The candidate starts compared first: those at cover positions, and the last start."""
        out = candidate & self.in_cover[np.arange(len(candidate)) % self.v]
        out[-1] = candidate[-1]
        return out

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)


def _blobs(chunk: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray]):
    """Distinct keys (lists of columns) per (chunk, bucket), packed by bucket: rows (bucket, owners, keys, twice).

    owners holds the chunk of every key. A bucket gets one row a call, however many chunks the keys come from."""
    order = np.lexsort((*columns, chunk, bucket))
    chunk, bucket, columns = chunk[order], bucket[order], [c[order] for c in columns]
    if not len(order):
        return []
    new = np.ones(len(order), bool)
    new[1:] = (chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1]) | np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(order))) > 1
    chunk, bucket, columns = chunk[first].astype(np.uint32), bucket[first], [c[first] for c in columns]
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(first)]])
    return [(int(bucket[i]), chunk[i:j].tobytes(), b"".join(c[i:j].tobytes() for c in columns), np.packbits(twice[i:j]).tobytes())
            for i, j in zip(edges[:-1], edges[1:])]


_BLOB = "bucket long, owners binary, keys binary, twice binary"


def _unpack(blob, kinds: list) -> list[np.ndarray]:
    raw = blob.as_buffer()
    n = raw.size // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _shared(kinds: list):
    """Sorts one bucket and returns to each chunk those of its keys that occur twice or more in the bucket."""

    def run(key, group):
        parts = [_unpack(x, kinds) for x in group["keys"]]
        size = [len(p[0]) for p in parts]
        cols = [np.concatenate([p[k] for p in parts]) for k in range(len(kinds))]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n).astype(bool) for x, n in zip(group["twice"], size)])
        owner = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group["owners"]])
        order = np.lexsort(cols)
        cols, twice, owner = [c[order] for c in cols], twice[order], owner[order]
        same = np.ones(max(0, len(order) - 1), bool)
        for c in cols:
            same &= c[1:] == c[:-1]
        # a key that stands in several rows, or that one row says is there twice, is shared: mark all of its rows
        first_at = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), ~same]))
        count = np.diff(np.append(first_at, len(order)))
        hit = np.repeat((count > 1) | (np.logical_or.reduceat(twice, first_at) if len(first_at) else twice), count)
        del same, order
        at = np.flatnonzero(hit)
        at = at[np.argsort(owner[at], kind="stable")]
        cut = np.flatnonzero(np.diff(owner[at])) + 1
        rows = [(int(owner[x[0]]), b"".join(c[x].tobytes() for c in cols)) for x in np.split(at, cut) if len(x)]
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()), "chunk": pa.array([r[0] for r in rows], pa.int64()),
                         "keys": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _compare(blobs: DataFrame, kinds: list) -> DataFrame:
    return blobs.groupBy("bucket").applyInArrow(_shared(kinds), "bucket long, chunk long, keys binary")


_RANK = [np.uint32]
_WHOLE = [np.uint64, np.uint32]
_ASK = [np.uint32, np.uint16, np.uint16]


def _ranked(plan: "Plan", h: np.ndarray) -> np.ndarray:
    """Bucket and 32-bit rank of a rank hash in one number."""
    return (plan.bucket(h).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _known_ranks(group: pa.Table) -> np.ndarray:
    """Sorted ranks that came back to a chunk."""
    parts = [(np.uint64(b) << np.uint64(32)) | _unpack(x, _RANK)[0].astype(np.uint64) for b, x in zip(group["bucket"].to_pylist(), group["keys"])]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def _find(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted known ones, -1 where it is missing."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _known_strings(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash columns of the shared whole strings of a chunk, sorted."""
    parts = [_unpack(x, _WHOLE) for x in group["keys"]]
    a, b = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate(_WHOLE))
    order = np.lexsort((b, a))
    return a[order], b[order]


def _is_shared(known: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(a), bool)
    at = np.searchsorted(known[0], a)
    while True:  # more than one step only where two strings agree in 64 bits
        left = np.flatnonzero(~hit & (at < len(known[0])))
        left = left[known[0][at[left]] == a[left]]
        if not len(left):
            return hit
        hit[left] = known[1][at[left]] == b[left]
        at[left] += 1


def _window_keys(buf: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each whole string: two independent hashes."""
    a = mix64(span_hash(prefix_hash(buf), start, start + length))
    b = mix64(span_hash(prefix_hash(buf, _SECOND), start, start + length))
    return a, (b >> np.uint64(32)).astype(np.uint32)


def _spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Marks the union of the ranges [start, end) of 0..n."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def _ranges(mask: np.ndarray) -> np.ndarray:
    """Pairs (start, end) of the runs of a mask, as int32."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)], axis=1).astype(np.int32)


def _expand(ranges: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(s, e) for s, e in ranges]) if len(ranges) else np.zeros(0, np.int64)


def _result(body: bytes, starts: np.ndarray, length: int) -> tuple[int, int, int, str, str]:
    """(n_bytes, n_removed, n_spans, kept_sha256, removed) for the shared starts of one document."""
    gone = _ranges(_spread(starts, starts + length, len(body))) if len(starts) else np.zeros((0, 2), np.int32)
    at, kept = 0, hashlib.sha256()
    for s, e in gone.tolist():
        kept.update(memoryview(body)[at:s])
        at = e
    kept.update(memoryview(body)[at:])
    return len(body), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest(), ",".join(f"{s}:{e}" for s, e in gone.tolist())


def _pack(body) -> bytes:
    """A text on its way between steps: its length, then its zstd block."""
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpack_body(x: bytes) -> bytes:
    return pa.decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


class _Rows:
    """Collects the output rows of one chunk: finished documents, open documents, keys to compare."""

    def __init__(self, doc_type):
        self.doc_type, self.rows, self.keys = doc_type, [], []

    def done(self, doc_id, body, starts, length):
        self.rows.append((doc_id, None, None, None, *_result(body, starts, length)))

    def open(self, doc_id, body, known, left):
        self.rows.append((doc_id, _pack(body), known.astype(np.int32).tobytes(), left.tobytes(), None, None, None, None, None))

    def table(self, chunk: int, plan: Plan, blobs: list | None = None) -> pa.Table:
        """blobs: rows (bucket, owners, keys, twice)."""
        blobs = blobs or []
        if self.keys:
            a, b = (np.concatenate(x) for x in zip(*self.keys))
            blobs = _blobs(np.full(len(a), chunk), plan.bucket(a), [a, b])
        n, m = len(self.rows), len(blobs)
        col = list(zip(*self.rows)) if n else [()] * 9
        none = [None] * m
        types = [self.doc_type, pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "body", "known", "left", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        out = {"chunk": pa.array([chunk] * (n + m), pa.int64())} | {name: pa.array([*c, *none], t) for name, c, t in zip(names, col, types)}
        out["bucket"] = pa.array([None] * n + [x[0] for x in blobs], pa.int64())
        out["owners"] = pa.array([None] * n + [x[1] for x in blobs], pa.binary())
        out["keys"] = pa.array([None] * n + [x[2] for x in blobs], pa.binary())
        out["twice"] = pa.array([None] * n + [x[3] for x in blobs], pa.binary())
        return pa.table(out)


def repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the byte ranges start:end that went, comma-joined)."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("body"))
    total = int(docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    chunks, plan = parts_for(total, chunk_bytes), Plan(length, parts_for(total, bucket_bytes))
    kind, doc_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("body")), F.lit(chunks)))

    def ranks(batches):
        for b in batches:
            buf, off = flat(b.column(1))
            chunk, made = b.column(0).to_numpy(), []
            for i, j in row_blocks(off):
                at, h, k, g = plan.places(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                where = np.concatenate([at, k])
                made.append((chunk[i:j][np.searchsorted(off[i: j + 1] - off[i], where, side="right") - 1], np.concatenate([h, g])))
            own, h = (np.concatenate(x) for x in zip(*made)) if made else (chunk, np.zeros(0, np.uint64))
            rows = _blobs(own, plan.bucket(h), [(h & np.uint64(0xFFFFFFFF)).astype(np.uint32)])
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                             names=["bucket", "owners", "keys", "twice"])

    long_enough = dealt.where(F.octet_length("body") >= length).select("chunk", "body")
    shared = store(_compare(long_enough.mapInArrow(ranks, _BLOB), _RANK), "ranks")

    def first(key, left, right):
        """Candidate starts from the cover ranks; asks about those at cover positions and the last one."""
        chunk, out = key[0].as_py(), _Rows(doc_type)
        buf, off = flat(pa.array([_unpack_body(x) for x in left["body"].to_pylist()], pa.binary()))
        ids = left["doc_id"].to_pylist()
        known = _known_ranks(right)
        for i, j in row_blocks(off):
            part, o = buf[off[i]: off[j]], off[i: j + 1] - off[i]
            at, h, k, g = plan.places(part, o)
            hot = at[_find(known, _ranked(plan, h)) >= 0]
            cold = k[_find(known, _ranked(plan, g)) < 0]
            for d in range(j - i):
                lo, hi = int(o[d]), int(o[d + 1])
                n = hi - lo - length + 1  # number of possible starts
                p = hot[np.searchsorted(hot, lo): np.searchsorted(hot, hi)] - lo if n > 0 else hot[:0]
                body = part[lo:hi]
                cand = np.zeros(0, bool)
                if len(p):
                    c = cold[np.searchsorted(cold, lo): np.searchsorted(cold, hi)] - lo
                    p = p[p - plan.v + 1 < n]
                    cand = _spread(np.maximum(p - plan.v + 1, 0), np.minimum(p + 1, n), n)
                    cand &= ~_spread(np.clip(c + plan.anchor - length, 0, n), np.minimum(c + 1, n), n)
                if not cand.any():
                    out.done(ids[i + d], body.tobytes(), np.zeros(0, np.int64), length)
                    continue
                out.open(ids[i + d], body.tobytes(), np.zeros(0, np.int32), _ranges(cand))
                out.keys.append(_window_keys(body, np.flatnonzero(plan.asked(cand)), length))
        return out.table(chunk, plan)

    schema = (f"chunk long, doc_id {kind}, body binary, known binary, left binary, n_bytes long, n_removed long, n_spans long, "
              "kept_sha256 string, removed string, bucket long, owners binary, keys binary, twice binary")
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]

    def ties(key, left, right):
        """Takes the shared cover starts in; finishes a document or asks about its rims by rank."""
        chunk, out = key[0].as_py(), _Rows(doc_type)
        known, asks = _known_strings(right), []
        for doc, body, cand in zip(left["doc_id"].to_pylist(), left["body"].to_pylist(), left["left"].to_pylist()):
            body = _unpack_body(body)
            buf = np.frombuffer(body, np.uint8)
            n = len(buf) - length + 1
            mask = np.zeros(n, bool)
            mask[_expand(np.frombuffer(cand, np.int32).reshape(-1, 2))] = True
            asked = np.flatnonzero(plan.asked(mask))
            starts = asked[_is_shared(known, *_window_keys(buf, asked, length))]
            bare = np.concatenate([[0], np.cumsum(~_spread(starts, starts + length, len(buf)))])
            rim = mask & (bare[length:] > bare[:n])
            rim[starts] = False
            if not rim.any():
                out.done(doc, body, starts, length)
                continue
            out.open(doc, body, starts, _ranges(rim))
            at, h, _, _ = plan.places(buf, np.array([0, len(buf)]))
            c = np.concatenate([[0], np.cumsum(rim)])
            near = at[c[np.minimum(at + 1, n)] > c[np.maximum(at - plan.v + 1, 0).clip(max=n)]]
            h = h[np.searchsorted(at, near)]
            where = np.flatnonzero(rim)
            far = where[np.searchsorted(where, near - plan.v + 1)]  # first and last rim start of the position's reach
            close = where[np.searchsorted(where, near, side="right") - 1]
            asks.append((_ranked(plan, h), near - close, near - far))
        blobs = []
        if asks:
            rank, lo, hi = (np.concatenate(x) for x in zip(*asks))
            order = np.argsort(rank, kind="stable")
            rank, lo, hi = rank[order], lo[order], hi[order]
            first_at = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            lo, hi, rank = np.minimum.reduceat(lo, first_at), np.maximum.reduceat(hi, first_at), rank[first_at]
            own = (rank >> np.uint64(32)).astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            blobs = [(int(own[i]), None, (rank[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + lo[i:j].astype(np.uint16).tobytes() + hi[i:j].astype(np.uint16).tobytes(), None)
                     for i, j in zip(edges[:-1], edges[1:])]
        return out.table(chunk, plan, blobs)

    def passed_on(key, asks, have):
        """The asked ranks of one bucket and their widest shifts, to every chunk that holds them."""
        bucket = key[0].as_py()
        if not asks.num_rows or not have.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})
        rank, lo, hi = (np.concatenate(x) for x in zip(*(_unpack(x, _ASK) for x in asks["keys"])))
        order = np.argsort(rank, kind="stable")
        rank, lo, hi = rank[order], lo[order], hi[order]
        first_at = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        lo, hi, rank = np.minimum.reduceat(lo, first_at), np.maximum.reduceat(hi, first_at), rank[first_at]
        rows = []
        for chunk, x in zip(have["chunk"].to_pylist(), have["keys"]):
            at = _find(rank, np.unique(_unpack(x, _RANK)[0]))
            at = at[at >= 0]
            if len(at):
                rows.append((chunk, rank[at].tobytes() + lo[at].tobytes() + hi[at].tobytes()))
        return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int64()), "chunk": pa.array([r[0] for r in rows], pa.int64()),
                         "keys": pa.array([r[1] for r in rows], pa.binary())})

    def rims(key, left, right):
        """Sends the candidate starts at the asked shifts of the asked ranks."""
        chunk, out = key[0].as_py(), _Rows(doc_type)
        parts = [(_unpack(x, _ASK), np.uint64(b) << np.uint64(32)) for b, x in zip(right["bucket"].to_pylist(), right["keys"])]
        rank = np.concatenate([np.zeros(0, np.uint64), *(p[0].astype(np.uint64) | b for p, b in parts)])
        lo, hi = (np.concatenate([np.zeros(0, np.int64), *(p[k].astype(np.int64) for p, _ in parts)]) for k in (1, 2))
        order = np.argsort(rank, kind="stable")
        rank, lo, hi = rank[order], lo[order], hi[order]
        for body, cand in zip(left["body"].to_pylist(), left["left"].to_pylist()):
            buf = np.frombuffer(_unpack_body(body), np.uint8)
            n = len(buf) - length + 1
            at, h, _, _ = plan.places(buf, np.array([0, len(buf)]))
            of = _find(rank, _ranked(plan, h))
            at, of = at[of >= 0], of[of >= 0]
            reach = _spread((at - hi[of]).clip(0, n), (at - lo[of] + 1).clip(0, n), n)
            mask = np.zeros(n, bool)
            mask[_expand(np.frombuffer(cand, np.int32).reshape(-1, 2))] = True
            where = np.flatnonzero(mask & reach)
            if len(where):
                out.keys.append(_window_keys(buf, where, length))
        return out.table(chunk, plan)

    def finish(key, left, right):
        chunk, out = key[0].as_py(), _Rows(doc_type)
        known = _known_strings(right)
        for doc, body, old, rim in zip(left["doc_id"].to_pylist(), left["body"].to_pylist(), left["known"].to_pylist(), left["left"].to_pylist()):
            body = _unpack_body(body)
            asked = _expand(np.frombuffer(rim, np.int32).reshape(-1, 2))
            hit = asked[_is_shared(known, *_window_keys(np.frombuffer(body, np.uint8), asked, length))]
            out.done(doc, body, np.concatenate([np.frombuffer(old, np.int32).astype(np.int64), hit]), length)
        return out.table(chunk, plan)

    bodies = ["chunk", "doc_id", "body", "known", "left"]

    def with_answers(rows: DataFrame, answers: DataFrame, fn) -> DataFrame:
        return rows.where("body is not null").select(bodies).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fn, schema)

    def blobs(rows: DataFrame) -> DataFrame:
        return rows.where("keys is not null").select("bucket", "owners", "keys", "twice")

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_pack(x.as_buffer()) for x in b.column(2)], pa.binary())], names=["chunk", "doc_id", "body"])

    on_the_way = dealt.select("chunk", "doc_id", "body").mapInArrow(packed, f"chunk long, doc_id {kind}, body binary")
    candidates = store(on_the_way.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(first, schema), "candidates")
    tied = store(with_answers(candidates, _compare(blobs(candidates), _WHOLE), ties), "ties")
    asked = blobs(tied).groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(passed_on, "bucket long, chunk long, keys binary")
    rim = store(blobs(with_answers(candidates, asked, rims)), "rims")
    done = store(candidates.where("kept_sha256 is not null").select(result), "done")
    discard(shared, candidates)
    last = with_answers(tied, _compare(rim, _WHOLE), finish)
    return done.union(tied.where("kept_sha256 is not null").select(result)).union(last.select(result))
