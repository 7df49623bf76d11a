"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint bit is set where more than half of a text's shingle hashes have it. Distinct fingerprints are sorted by
their rank in the reflected Gray code, so that neighbours in the order differ in few bits, and cut into leaf blocks of
bounded size. A node of the index stands for a run of blocks and keeps the pattern that all fingerprints below it share
(their bitwise AND and OR: a position is masked out where the two differ). Shared bits are thereby held once, in the upper
nodes, and what a lower node adds accumulates on the way down.

The search walks the index against itself, level by level, as Spark joins on node numbers: a pair of nodes whose shared
bits already differ in more than `distance` places is dropped with everything below it; the others are replaced by the
pairs of their children. Surviving pairs of leaf blocks meet with their packed fingerprints; inside a pair the same pruning
goes on over groups of 256 and of 16 fingerprints before fingerprints are compared. A pair of blocks returns a spanning
forest of its links, so a dense group never leaves a task as all its pairs. No table of nodes is broadcast or collected.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles are space-joined, repeats count. A text
with fewer words than a shingle has its whole sequence as one; null, empty and blank texts have fingerprint zero and are
linked like any other. Repeated rows get equal results; a null doc_id stands after all others. Very long texts are hashed
whole. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, store
from .graph import components

SHINGLE_WORDS = 3
DISTANCE = 2
SEED = 42
# Fingerprints of a leaf block, blocks below a node, fingerprints of a sorted partition.
LEAF = 4096
FANOUT = 64
PARTITION = 1 << 16
# Group sizes inside a pair of blocks, and pairs handled by one numpy step.
GROUPS = (256, 16)
STEP = 1 << 20
# A fingerprint of at least this share of all rows is joined by broadcast (there are at most so many).
HOT_SHARE = 1000


def fingerprint(body: bytes | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    words = (body or b"").lower().split()  # on bytes: A-Z, and runs of ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle_words, len(words))
    start = np.concatenate([[0], end[: len(words) - k]])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(start.tolist(), (end[k - 1:] - 1).tolist())), np.uint64, len(start))
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[i: i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle_words, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fp: Column) -> Column:
    """Rank of the code in the reflected Gray order, shifted so that signed order is its order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(2**63)))


# -- the index ---------------------------------------------------------------------------------------------------------


def leaf_blocks(fps: DataFrame, n: int, leaf: int = LEAF, fanout: int = FANOUT, partition: int = PARTITION) -> DataFrame:
    """(part, block, all1, any1, fps): the distinct fingerprints in Gray order, packed into blocks; part and block ascend with
    the rank."""
    parts = -(-n // partition)

    def pack(batches):
        from pyspark import TaskContext

        part, block, left = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

        def rows(x):
            nonlocal block
            for i in range(0, len(x), leaf):
                yield part, block, int(np.bitwise_and.reduce(x[i: i + leaf])), int(np.bitwise_or.reduce(x[i: i + leaf])), x[i: i + leaf].tobytes()
                block += 1

        def batch(x):
            made = list(rows(x))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              names=["part", "block", "all1", "any1", "fps"])

        for b in batches:
            left = np.concatenate([left, b.column(0).to_numpy()])
            whole = len(left) // leaf * leaf
            if whole:
                yield batch(left[:whole])
                left = left[whole:]
        if len(left):
            yield batch(left)

    ordered = fps.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    return ordered.select("fp").mapInArrow(pack, "part long, block long, all1 long, any1 long, fps binary")


def differing(a: str, b: str) -> Column:
    """Positions at which everything under a has one value and everything under b the other."""
    apart = F.col(f"{a}_all1").bitwiseAND(F.bitwise_not(f"{b}_any1")).bitwiseOR(F.col(f"{b}_all1").bitwiseAND(F.bitwise_not(f"{a}_any1")))
    return F.bit_count(apart)


def block_pairs(blocks: DataFrame, distance: int = DISTANCE, fanout: int = FANOUT) -> DataFrame:
    """(a, b): pairs of leaf blocks, a <= b, that no node on the way down could rule out."""
    bits = (fanout - 1).bit_length()
    nodes = store(blocks.select((F.shiftleft(F.col("part"), 32) + F.col("block")).alias("id"), "all1", "any1"), "nodes")
    levels = [nodes]
    # Parents: runs of blocks inside a partition, then the partition, then runs of partitions, up to one root.
    shifts = [bits, 32]
    top = int(nodes.agg(F.max(F.shiftright("id", 32))).first()[0] or 0)
    while top >> (shifts[-1] - 32):
        shifts.append(shifts[-1] + bits)
    most = int(nodes.agg(F.max(F.col("id").bitwiseAND(F.lit((1 << 32) - 1)))).first()[0] or 0)
    shifts = [s for s in shifts if s >= 32 or most >> s]
    for s in shifts:
        # a parent carries the number of its first possible block, so that a node's parent is a shift of its own number
        up = F.shiftleft(F.shiftright("id", s), s).alias("id")
        levels.append(store(levels[-1].groupBy(up).agg(F.bit_and("all1").alias("all1"), F.bit_or("any1").alias("any1")), "nodes"))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for s, level in zip(reversed(shifts), reversed(levels[:-1])):
        up = F.shiftleft(F.shiftright("id", s), s)
        left, right = (level.select(up.alias(x), F.col("id").alias(f"{x}_id"), F.col("all1").alias(f"{x}_all1"), F.col("any1").alias(f"{x}_any1")) for x in "ab")
        met = pairs.join(left, "a").join(right, "b").where((F.col("a_id") <= F.col("b_id")) & (differing("a", "b") <= distance))
        pairs = store(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "node-pairs")
    return pairs


def _grouped(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    cut = np.arange(0, len(x), size)
    return np.bitwise_and.reduceat(x, cut), np.bitwise_or.reduceat(x, cut)


def _within(p: np.ndarray, q: np.ndarray, na: int, nb: int, size_up: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Children (groups of `size` out of groups of `size_up`) of the group pairs (p, q)."""
    r = size_up // size
    grid = np.arange(r)
    a = np.repeat(p[:, None] * r + grid, r, axis=1).ravel()
    b = np.tile(q[:, None] * r + grid, (1, r)).ravel()
    ok = (a < na) & (b < nb)
    return a[ok], b[ok]


def near_pairs(x: np.ndarray, y: np.ndarray, same: bool, distance: int = DISTANCE):
    """Positions (i, j) in two Gray-ordered blocks (i < j in the same one) of fingerprints at most `distance` bits apart."""
    levels = [(_grouped(x, s), _grouped(y, s)) for s in GROUPS]
    sizes = [*GROUPS, 1]

    def descend(p, q, depth):
        if depth < len(GROUPS):
            (xa, xo), (ya, yo) = levels[depth]
            near = np.bitwise_count((xa[p] & ~yo[q]) | (ya[q] & ~xo[p])) <= distance
            p, q = p[near & (p <= q)] if same else p[near], q[near & (p <= q)] if same else q[near]
            r = sizes[depth] // sizes[depth + 1]
            step = max(1, STEP // (r * r))
            for i in range(0, len(p), step):
                n = [-(-len(v) // sizes[depth + 1]) for v in (x, y)]
                yield from descend(*_within(p[i: i + step], q[i: i + step], *n, sizes[depth], sizes[depth + 1]), depth + 1)
        else:
            near = np.bitwise_count(x[p] ^ y[q]) <= distance
            if same:
                near &= p < q
            if near.any():
                yield p[near], q[near]

    p, q = (v.ravel() for v in np.meshgrid(np.arange(len(levels[0][0][0])), np.arange(len(levels[0][1][0])), indexing="ij"))
    yield from descend(p, q, 0)


def forest(links, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smaller node) that connect 0..n-1 as the links do: one for each node that is not its component's
    smallest."""
    label = np.arange(n)
    for u, v in links:
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def block_links(blocks: DataFrame, pairs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) fingerprints: for every block pair a spanning forest of its links."""

    def run(batches):
        for batch in batches:
            for same, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = x if same else np.concatenate([x, y])
                shift = 0 if same else len(x)
                node, root = forest(((p, q + shift) for p, q in near_pairs(x, y, same, distance)), len(both))
                yield pa.RecordBatch.from_arrays([pa.array(both[i].view(np.int64), pa.int64()) for i in (node, root)], names=["a", "b"])

    body = blocks.select((F.shiftleft(F.col("part"), 32) + F.col("block")).alias("id"), "fps")
    met = pairs.join(body.select(F.col("id").alias("a"), F.col("fps").alias("x")), "a").join(body.select(F.col("id").alias("b"), F.col("fps").alias("y")), "b")
    return met.select((F.col("a") == F.col("b")).alias("same"), "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS,
                    distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the row's component)."""
    rows = store(fingerprints(docs, text, doc_id, shingle_words, seed), "fingerprints")
    classes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    n, total = classes.agg(F.count("*"), F.sum("n")).first()
    if n > 1:
        blocks = store(leaf_blocks(classes, n), "blocks")
        links = store(block_links(blocks, block_pairs(blocks, distance), distance), "links")
        root = store(components(links), "components")
        member = classes.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root"))
        least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        known = store(member.join(least, "root").select("fp", "n", "component_id"), "known")
    else:
        known = classes.select("fp", "n", F.col("doc_id").alias("component_id"))
    # Fingerprints of a thousandth of all rows or more: at most a thousand, so they are broadcast; the others are shuffled.
    hot = F.broadcast(known.where(F.col("n") * HOT_SHARE >= F.lit(total or 0)).select("fp", "component_id"))
    out = rows.join(hot, "fp").unionByName(rows.join(hot.select("fp"), "fp", "left_anti").join(known.select("fp", "component_id"), "fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
