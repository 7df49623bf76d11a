"""Language-model scoring by context-tree weighting (CTW) over binary-decomposed byte contexts, with unigram base scores.

Every byte is coded as 8 binary decisions; each decision has its own tree whose contexts are the preceding 0 to `DEPTH`
bytes. A node with a zeros and b ones has the Krichevsky-Trofimov (KT) block estimate
Pe = G(a+1/2) G(b+1/2) / (pi G(a+b+1)) and the weighted probability Pw = (Pe + prod Pw(children)) / 2, so all depths are
mixed. Counts are gathered from all training documents; with statistics frozen, the probability of the next decision
follows the path root to leaf: p(node) = (r * KT + p(child)) / (r + 1) with r = Pe / prod Pw(children); a context never
seen predicts 1/2.

The tree grows with the corpus and is never held in one place. Documents are dealt into chunks; a chunk asks for its
distinct (context, byte) codes, with their training counts, from the shard of their last `TOP` + 1 = 3 context bytes, which
so holds whole subtrees. A first pass over the shards sums the weights log Pw of these subtrees per pair of bytes (in
steps of 2**-20, so that no order of summing changes a result); they make the levels 0 to 2 of the tree, which are bounded
by construction (at most 65,793 contexts x 255 decisions, 268 MB; the pairs that occur in text are far fewer) and are
broadcast. In a second pass every shard answers its codes with their log10 P. One task thus holds all codes behind the
most frequent three bytes.

Base scores are add-0.1 unigram scores over whole words, whose table grows with the corpus and is never broadcast: documents
are dealt into chunks, every chunk asks for the training counts of its distinct words (64-bit hashes, packed per shard), a
shard sums the chunks' own training counts and answers, and the answers meet the chunk's documents again. Two words share
a hash with probability V**2 / 2**65 for V distinct words in all.

A-Z is lower-cased for words; bytes are scored as they are, from a context of zero bytes at the start of each document.
Null text counts as empty (one end token, score 0). Repeated rows get equal results. Without any training text every
byte costs 8 bits and base_score is null. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, bounded_batches, by_shard, flat, free_memory, mix64, parts_for, row_blocks, shard_of, sorted_unique, store, text_bytes, word_hashes

CHUNK_BYTES = 12 << 20
SHARD_BYTES = 64 << 20
DEPTH = 6  # context bytes; a code (DEPTH + 1 bytes) fits 64 bits up to 7
TOP = 2  # the deepest broadcast level
_STEPS = 1 << 20  # of a weight, where weights are summed across shards
_LOG10 = np.log(10.0)
_END = mix64(np.array([0xE4D], np.uint64))[0]  # the end token


def _codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Previous two bytes and the byte itself, packed; zeros before a document's first byte."""
    code = buf.astype(np.uint32)
    first = off[:-1][np.diff(off) > 0]
    for k in (1, 2):
        prev = np.zeros(len(buf), np.uint32)
        prev[k:] = buf[:-k]
        for j in range(k):
            at = first + j
            prev[at[at < len(buf)]] = 0  # a byte beyond a short document is reset again by the next one
        code |= prev << np.uint32(8 * k)
    return code


def context_codes(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """Previous `depth` bytes, nearest one highest, and the byte itself lowest; zeros before a document's first byte."""
    code = buf.astype(np.uint64)
    at = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, min(depth, len(buf) - 1) + 1):
        prev = np.where(at[k:] >= k, buf[:-k], 0).astype(np.uint64)
        code[k:] |= prev << np.uint64(8 * (depth - k + 1))
    return code


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after shifting x up to 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


_SMALL = 4096
_HALF, _WHOLE = (log_gamma(np.arange(_SMALL) + x) for x in (0.5, 1.0))


def _log_gamma_count(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """ln Gamma(n + plus) of whole counts, the small ones from a table."""
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    if large.any():
        out[large] = log_gamma(n[large] + plus)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln Pe of a zeros and b ones (whole counts)."""
    return _log_gamma_count(a, _HALF, 0.5) + _log_gamma_count(b, _HALF, 0.5) - _log_gamma_count(a + b, _WHOLE, 1.0) - np.log(np.pi)


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1)


def _weight(r: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate, from log of Pe over the children's Pw."""
    return 1 / (1 + np.exp(-np.clip(r, -700, 700)))


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 decision nodes (heap order from 1) of byte counts (rows, 256)."""
    total = np.zeros((len(counts), 512))
    total[:, 256:] = counts
    for i in range(255, 0, -1):
        total[:, i] = total[:, 2 * i] + total[:, 2 * i + 1]
    node = np.arange(1, 256)
    return total[:, 2 * node], total[:, 2 * node + 1]


def _leaf_log10(p_one: np.ndarray) -> np.ndarray:
    """log10 P(byte) from the probability of a one at each decision node."""
    out = np.zeros((len(p_one), 512))
    for i in range(1, 256):
        out[:, 2 * i] = out[:, i] + np.log1p(-p_one[:, i - 1])
        out[:, 2 * i + 1] = out[:, i] + np.log(p_one[:, i - 1])
    return out[:, 256:] / _LOG10


class FrozenCTW:
    """Levels 0 to 2 of the weighted tree: `index` maps the byte pair to a row.

    Without `below`, the whole tree has two context bytes: `table` holds log10 P(byte | two bytes). With `below` (log of the
    product of the children's Pw, per pair and decision) the tree goes on, and P(one) = add + mul * P(one) at level 3.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        pair, pos = np.unique(code >> 8, return_inverse=True)
        c2 = np.zeros((len(pair), 256))
        np.add.at(c2, (pos, code & 255), n)
        one, at1 = np.unique(pair & 255, return_inverse=True)
        c1 = np.zeros((len(one), 256))
        np.add.at(c1, at1, c2)
        a2, b2 = _decisions(c2)
        e2 = w2 = log_kt(a2, b2)  # at the deepest nodes Pw = Pe
        if below is not None:
            below2 = np.zeros((len(pair), 255))
            below2[np.searchsorted(pair, below[0]), below[1] - 1] = below[2]
            w2 = np.logaddexp(e2, below2) - np.log(2)
        a1, b1 = _decisions(c1)
        e1, below1 = log_kt(a1, b1), np.zeros((len(one), 255))
        np.add.at(below1, at1, w2)
        w1 = np.logaddexp(e1, below1) - np.log(2)
        a0, b0 = _decisions(c1.sum(axis=0, keepdims=True))
        r0, r1 = log_kt(a0, b0) - w1.sum(axis=0, keepdims=True), e1 - below1
        self.index = np.full(65536, len(pair) + len(one), np.int32)
        if below is not None:
            self.add, self.mul = np.zeros((len(pair), 255)), np.ones((len(pair), 255))
            for r, a, b, up in ((e2 - below2, a2, b2, np.arange(len(pair))), (r1, a1, b1, at1), (r0, a0, b0, np.zeros(len(pair), int))):
                w = _weight(r)[up]
                self.add, self.mul = w * _kt(a, b)[up] + (1 - w) * self.add, (1 - w) * self.mul
            self.index[pair] = np.arange(len(pair))
            return
        mix = lambda r, own, child: child + (own - child) * _weight(r)
        # rows: seen pairs; then seen last byte with an unseen byte before it; then an unseen last byte
        first = np.concatenate([_kt(a2, b2), np.full((len(one) + 1, 255), 0.5)])
        up = np.concatenate([at1, np.arange(len(one))])
        second = np.concatenate([mix(r1[up], _kt(a1, b1)[up], first[:-1]), np.full((1, 255), 0.5)])
        self.table = _leaf_log10(mix(r0, _kt(a0, b0), second)).astype(np.float32)
        for k, byte in enumerate(one):
            self.index[np.arange(256) * 256 + byte] = len(pair) + k
        self.index[pair] = np.arange(len(pair))

    def log10_bytes(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 P of every document in the buffer."""
        out = np.zeros(len(off) - 1)
        for i, j in row_blocks(off):
            part, o = buf[off[i]: off[j]], off[i: j + 1] - off[i]
            code = _codes(part, o)
            c = np.concatenate([[0.0], np.cumsum(self.table[self.index[code >> np.uint32(8)], code & np.uint32(255)], dtype=np.float64)])
            out[i:j] = c[o[1:]] - c[o[:-1]]
        return out


class Subtrees:
    """The tree below level `TOP` over some sorted distinct codes (all of their three last context bytes) and their counts.

    Codes that were only asked for have count 0: Pe = Pw = 1 and KT = 1/2, as for a context never seen.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        self.levels = [(codes, n.astype(np.float64), None)]  # deepest first: codes, counts, and the code of each deeper code
        for _ in range(depth - TOP - 1):
            c, n, _ = self.levels[-1]
            up, at = np.unique(((c >> np.uint64(16)) << np.uint64(8)) | (c & np.uint64(255)), return_inverse=True)
            self.levels.append((up, np.bincount(at, n, len(up)), at.astype(np.int32)))

    def decision(self, j: int):
        """Of the j-th bit, level by level from the deepest: node of each code, first code of each node, zeros, ones, log Pe -
        log children, log Pw. Only one level is held at a time."""
        low = low_w = None
        for c, n, at in self.levels:
            node = c >> np.uint64(8 - j)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            run = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(c))))
            del node
            ones = np.where((c >> np.uint64(7 - j)) & np.uint64(1) == 1, n, 0)
            b = np.add.reduceat(ones, first)
            a = np.add.reduceat(n, first) - b
            del ones
            e = w = log_kt(a, b)
            r = None
            if low is not None:
                below = np.bincount(run[at[low]], low_w, len(first))
                r, w = e - below, np.logaddexp(e, below) - np.log(2)
            yield run, first, a, b, r, w
            low, low_w = first, w

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts and summed weights for level `TOP`: key = pair * 512 + slot, slot = 256 + byte or the decision's node."""
        c, n, _ = self.levels[-1]
        pair = _pair(c)
        keys, values = [pair * 512 + 256 + (c & np.uint64(255)).astype(np.int64)], [n.astype(np.int64)]
        for j in range(8):
            for _, first, _, _, _, w in self.decision(j):
                pass  # the highest level is the last
            slot = (1 << j) | ((c[first] & np.uint64(255)) >> np.uint64(8 - j)).astype(np.int64)
            keys.append(pair[first] * 512 + slot), values.append(np.rint(w * _STEPS).astype(np.int64))
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate(values))
        return keys, total

    def log10_codes(self, top: FrozenCTW) -> np.ndarray:
        """log10 P(byte | context) of every code."""
        c = self.levels[0][0]
        last = np.arange(len(c), dtype=np.int32)
        for _, _, up in self.levels[1:]:
            last = up[last]
        row = top.index[_pair(self.levels[-1][0])][last]
        del last
        byte = (c & np.uint64(255)).astype(np.int16)
        out = np.zeros(len(c))
        for j in range(8):
            p = own = None
            for (_, _, up), (run, _, a, b, r, _) in zip(self.levels, self.decision(j)):
                own = np.arange(len(c), dtype=np.int32) if own is None else up[own]
                node = run[own]
                kt = _kt(a, b)[node]
                p = kt if p is None else p + (kt - p) * _weight(r)[node]
            slot = ((1 << j) | (byte >> (8 - j))) - 1
            p = top.add[row, slot] + top.mul[row, slot] * p
            out += np.log(np.where(byte >> (7 - j) & 1, p, 1 - p))
        return out / _LOG10


def _pair(codes: np.ndarray) -> np.ndarray:
    """Last two bytes before a code of three context bytes, the nearest one low (as FrozenCTW has them)."""
    return ((codes >> np.uint64(24)) | ((codes >> np.uint64(16) & np.uint64(255)) << np.uint64(8))).astype(np.int64)


def _context_shard(codes: np.ndarray, shards: int, depth: int) -> np.ndarray:
    return shard_of(mix64((codes >> np.uint64(8 * (depth - TOP))) + np.uint64(1)), shards)


def _by_context_shard(u: np.ndarray, shards: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted codes by shard, and the cuts between the shards."""
    shard = _context_shard(u, shards, depth)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _distinct_codes(buf: np.ndarray, off: np.ndarray, train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct codes in order, and their counts in training documents."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]

    def merge():
        u, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(u)).astype(np.uint32)
        codes[:], counts[:] = [u], [n]

    for i, j in row_blocks(off):
        o = off[i: j + 1] - off[i]
        u, at = np.unique(context_codes(buf[off[i]: off[j]], o, depth), return_inverse=True)
        codes.append(u), counts.append(np.bincount(at, np.repeat(train[i:j], np.diff(o)).astype(float), len(u)).astype(np.uint32))
        if sum(map(len, codes[1:])) > 2 * STEP_BYTES:
            merge()
    merge()
    return codes[0], counts[0]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpacked(x, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x.as_buffer(), n * np.dtype(kind).itemsize, "zstd"), kind)


def _context_requests(buf: np.ndarray, off: np.ndarray, train: np.ndarray, shards: int, depth: int) -> list[tuple]:
    """(shard, differences of the chunk's distinct codes, their counts in training documents, codes), packed."""
    u, n = _distinct_codes(buf, off, train, depth)
    order, cut = _by_context_shard(u, shards, depth)
    u, n = u[order], n[order]
    return [(s, _packed(np.diff(u[i:j], prepend=np.uint64(0))), _packed(n[i:j]), int(j - i)) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]


def _subtrees(group, depth: int) -> tuple[Subtrees, np.ndarray, list[int]]:
    sizes = group["size"].to_pylist()
    codes, at = np.unique(np.concatenate([np.cumsum(_unpacked(x, n, np.uint64), dtype=np.uint64) for x, n in zip(group["words"], sizes)]), return_inverse=True)
    n = np.bincount(at, np.concatenate([_unpacked(x, n, np.uint32) for x, n in zip(group["counts"], sizes)]), len(codes))
    return Subtrees(codes, n, depth), at, sizes


def _top_levels(asked: DataFrame, depth: int) -> FrozenCTW:
    """Levels 0 to `TOP` from the shards' subtrees, summed by Spark."""

    def run(key, group):
        keys, values = _subtrees(group, depth)[0].weights()
        free_memory()
        return pa.table({"key": pa.array(keys), "value": pa.array(values)})

    got = asked.groupBy("shard").applyInArrow(run, "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    key, value = got["key"].to_numpy(), got["value"].to_numpy()
    leaf = key & 511 >= 256
    code = (key[leaf] >> 9 << 8) | (key[leaf] & 255)
    return FrozenCTW(code, value[leaf], (key[~leaf] >> 9, key[~leaf] & 511, value[~leaf] / _STEPS))


def _context_answers(top, depth: int):
    """log10 P of a shard's codes, back to every chunk that asked."""

    def run(key, group):
        trees, at, sizes = _subtrees(group, depth)
        log_p = trees.log10_codes(top.value).astype(np.float32)
        del trees
        back = [log_p[x].tobytes() for x in np.split(at, np.cumsum(sizes)[:-1])]
        free_memory()
        return pa.table({"chunk": group["chunk"], "shard": group["shard"], "logs": pa.array(back, pa.binary())})

    return run


def _log10_documents(buf: np.ndarray, off: np.ndarray, log_p: np.ndarray, shards: int, depth: int) -> np.ndarray:
    """log10 P of every document of a chunk, from the answers in the order of its requests."""
    out = np.zeros(len(off) - 1)
    if not len(buf):
        return out
    blocks = []
    for i, j in row_blocks(off):
        own, at = np.unique(context_codes(buf[off[i]: off[j]], off[i: j + 1] - off[i], depth), return_inverse=True)
        blocks.append((i, j, own, at.astype(np.int32)))
        del own, at
    u = sorted_unique(np.concatenate([x[2] for x in blocks]))
    values = np.zeros(len(u), np.float32)
    values[_by_context_shard(u, shards, depth)[0]] = log_p
    for i, j, own, at in blocks:
        doc = np.repeat(np.arange(j - i), np.diff(off[i: j + 1]))
        out[i:j] = np.bincount(doc, values[np.searchsorted(u, own)].astype(np.float64)[at], j - i)
    return out


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the documents of one chunk, and words per document (end tokens apart)."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in row_blocks(off):
        h, _, _, n = word_hashes(buf[off[i]: off[j]], off[i: j + 1] - off[i])
        parts.append(h), sizes.append(n)
    return np.concatenate(parts), np.concatenate(sizes)


def _requests(shards: int, deep: int, depth: int):
    """Per chunk and shard: the chunk's distinct words and their counts in its training documents; with a size, the
    chunk's distinct codes, packed."""

    def run(key, group):
        buf, off = flat(group["body"])
        train = np.asarray(group["train"].to_pylist(), bool)
        codes = _context_requests(buf, off, train, deep, depth)
        h, n = _tokens(buf, off)
        words, at = np.unique(h, return_inverse=True)
        count = np.bincount(at, np.repeat(train, n).astype(float), len(words)).astype(np.int64)
        words, count = np.append(words, _END), np.append(count, int(train.sum()))
        order = np.argsort(words, kind="stable")
        words, count = words[order], count[order]
        rows = [(s, words[i:j].tobytes(), _packed(count[i:j]), None) for s, i, j in by_shard(words, shards)] + codes
        del h, at, words, count, order
        free_memory()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "words": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()),
                         "size": pa.array([r[3] for r in rows], pa.int64())})

    return run


def _answers(key, group):
    """Total counts of a shard's words, back to every chunk that asked; row chunk = -1 holds the shard's (V, N)."""
    asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["words"]]
    words, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, np.concatenate([_unpacked(x, len(w), np.int64) for x, w in zip(group["counts"], asked)]).astype(float), len(words)).astype(np.int64)
    cut = np.cumsum([len(a) for a in asked])[:-1]
    back = [x.tobytes() for x in np.split(total[at], cut)]
    sums = np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()
    return pa.table({"chunk": pa.concat_arrays([*group["chunk"].chunks, pa.array([-1], pa.int64())]),
                     "shard": pa.array([key[0].as_py()] * (len(back) + 1), pa.int64()), "totals": pa.array([*back, sums], pa.binary())})


def score(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES,
          shard_bytes: int = SHARD_BYTES, depth: int = DEPTH) -> DataFrame:
    """Scores of all documents by a model of those for which `train` holds: doc_id, n_tokens, n_known, train_tokens,
    base_score, score (log10) and bits_per_byte."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), train.alias("train"))
    total = text_bytes(docs, "text")
    chunks, shards = parts_for(total, chunk_bytes), parts_for(total, shard_bytes)
    deep = parts_for(total, max(1, shard_bytes // 8))  # of the context tree
    dealt = docs.select("doc_id", "train", F.col("text").cast("binary").alias("body"),
                        F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).alias("chunk"))
    asked = dealt.select("chunk", "train", "body").groupBy("chunk").applyInArrow(_requests(shards, deep, depth), "shard long, chunk long, words binary, counts binary, size long")
    asked = store(asked, "requests")
    answers = store(asked.where("size is null").groupBy("shard").applyInArrow(_answers, "chunk long, shard long, totals binary"), "counts")
    sums = [np.frombuffer(r["totals"], np.int64) for r in answers.where("chunk = -1").select("totals").collect()]  # two numbers a shard
    V, N = (int(sum(s[k] for s in sums)) for k in (0, 1))
    contexts = asked.where("size is not null")
    top = docs.sparkSession.sparkContext.broadcast(_top_levels(contexts, depth))
    logs = contexts.groupBy("shard").applyInArrow(_context_answers(top, depth), "chunk long, shard long, logs binary")
    back = answers.where("chunk >= 0").withColumn("logs", F.lit(None).cast("binary")).unionByName(logs.withColumn("totals", F.lit(None).cast("binary")))

    def run(key, left, right):
        buf, off = flat(left["body"])
        logs = {s: x for s, x in zip(right["shard"].to_pylist(), right["logs"]) if x.is_valid}
        own = _log10_documents(buf, off, np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(logs[s].as_buffer(), np.float32) for s in sorted(logs)]]), deep, depth)
        h, n = _tokens(buf, off)
        words, at = np.unique(np.append(h, _END), return_inverse=True)
        parts = {s: x for s, x in zip(right["shard"].to_pylist(), right["totals"]) if x.is_valid}
        count = np.concatenate([np.frombuffer(parts[s].as_buffer(), np.int64) for s in sorted(parts)])
        c = count[at]  # of every word, and of the end token at last
        log_p = np.log10((c + 0.1) / (N + 0.1 * (V + 1))) if N else np.full(len(c), np.nan)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, log_p[:-1], len(n)) + log_p[-1]
        known = np.bincount(doc, c[:-1] > 0, len(n)).astype(np.int64) + int(c[-1] > 0)
        bits = -own / np.log10(2) / np.maximum(np.diff(off), 1)
        del h, at, c, log_p, doc, words, count, parts, logs
        free_memory()
        return pa.table({"doc_id": left["doc_id"], "train": left["train"], "n_tokens": pa.array(n + 1), "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(n), N, np.int64)), "base_score": pa.array(base, mask=np.isnan(base)), "score": pa.array(own),
                         "bits_per_byte": pa.array(bits)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
