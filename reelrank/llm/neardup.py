"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set gets a signature of K MinHash coordinates. Documents are posted under (coordinate, value)
pairs; two sets with similarity at or above the threshold collide in at least `match` of the K coordinates but for a
stated probability (binomial tail, below `MISS`). So only prefixes are posted: with the K pairs of a document ordered
by their number of documents, two documents with `match` common pairs share one among the first K - match + 1. Pairs
that no other document has fill the front of that prefix and need no posting; the longest lists, beyond it, are
skipped. Collisions over the whole signature are then counted, and pairs that reach `match` are confirmed on their
full shingle sets.

No list is expanded into all its pairs as rows. Equal sets are one class from the start. Round one confirms each list's
documents against its most central one (the one whose pairs are the most common) and contracts the linked ones. Round
two takes the lists that still hold several components, in blocks of bounded size with the documents' sets: pairs that
reach `match` and are not connected yet are confirmed on the spot, each in one list only (that of its first common
posted coordinate), and a block returns a spanning forest of the links it found. No pair that reaches `match` goes
unchecked unless its two sides are already connected.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null and wordless texts have an empty set and are
linked with nothing; texts with fewer words than a shingle have their whole sequence as one. Repeated rows get equal
results; a null doc_id stands after all others. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, flat, free_memory, mix64, row_blocks, shingle_hashes, sorted_unique, store, word_hashes
from .graph import components

SHINGLE_WORDS = 5
THRESHOLD_PCT = 80
COORDINATES = 64
MISS = 1e-6
# Documents of one block of a posting list; longer lists are compared block against block, each in its own group.
BLOCK = 2048
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, 512), dtype=np.uint64)


def match_threshold(k: int = COORDINATES, pct: int = THRESHOLD_PCT, miss: float = MISS) -> int:
    """Largest number of matches that sets of similarity pct/100 reach with probability at least 1 - miss."""
    p, tail = pct / 100, 0.0
    for m in range(k + 1):
        tail += comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > miss:
            return max(m, 1)
    return k


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return sorted_unique(shingle_hashes(words, k))


def _sets(body: pa.Array, k: int):
    """The sorted distinct shingle hashes of each row."""
    buf, off = flat(body)
    for i, j in row_blocks(off):
        h, _, _, n = word_hashes(buf[off[i]: off[j]], off[i: j + 1] - off[i])
        at = np.concatenate([[0], np.cumsum(n)])
        for r in range(j - i):
            yield shingle_set(h[at[r]: at[r + 1]], k)


def signature(s: np.ndarray, k: int) -> np.ndarray:
    """K coordinates of 32 bits: the smallest image of the set under each of K multiplicative permutations."""
    odd, add = _SEEDS[0, :k] | np.uint64(1), _SEEDS[1, :k]
    low = np.full(k, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i: i + 4096, None] * odd + add).min(axis=0))
    return (mix64(low) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS,
               k: int = COORDINATES) -> DataFrame:
    """(doc_id, set_key, n_shingles, sig): set_key is a 128-bit digest of the whole set, null for an empty one."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        free_memory()  # of what the worker did before
        for b in batches:
            key, size, sig = [], [], []
            for s in _sets(b.column(1), shingle_words):
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, k).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(size, pa.int64()),
                                              pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "set_key", "n_shingles", "sig"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string").cast("binary")).mapInArrow(
        run, f"doc_id {kind}, set_key binary, n_shingles long, sig array<int>")


def postings(classes: DataFrame, k: int, match: int) -> tuple[DataFrame, DataFrame]:
    """Stored postings, and from them (pair, node, posted, size, first): prefix postings of the classes. `posted` has a bit for each posted coordinate of
    the node, size counts the documents posted under the pair, first is the most central of them."""
    if k > 64:
        raise ValueError("at most 64 coordinates")
    spread = classes.select("node", F.posexplode("sig").alias("i", "v")).select(
        "node", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v").cast("long") + 2**31).alias("pair"), F.expr("shiftleft(1L, i)").alias("bit"))
    shared = spread.groupBy("pair").agg(F.count("*").alias("df")).where("df > 1")
    ranked = spread.join(shared, "pair").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "pair", "bit"))).alias("p"))
    front = ranked.where(F.size("p") >= match).select(
        "node", F.slice("p", 1, F.size("p") - match + 1).alias("front"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["df"]).alias("weight"))
    bits = F.aggregate("front", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bit"]))
    made = store(front.select("node", "weight", bits.alias("posted"), F.explode("front").alias("p")).select("node", "weight", "posted", F.col("p.pair").alias("pair")), "postings")
    lists = made.groupBy("pair").agg(F.count("*").alias("size"), F.max_by("node", F.struct("weight", "node")).alias("first")).where("size > 1")
    return made, made.drop("weight").join(lists, "pair")


def _matches(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, text: str, doc_id: str, shingle_words: int) -> DataFrame:
    """(node, s): the whole shingle set of each node, from the text of one of its documents. The scan keeps the documents that
    are asked for by a semi-join on a hash of their id (one long each, so no text is shuffled while that list can be
    broadcast); the digest of the set, not the id, then says whose it is."""
    need = store(nodes.distinct().join(classes, "node").select("node", "set_key", F.xxhash64("doc_id").alias("_id")), "needed")
    asked = docs.select(F.xxhash64(doc_id).alias("_id"), F.col(text).cast("string").cast("binary").alias("body")).join(
        need.select("_id").distinct(), "_id", "left_semi").select("body")

    def sets(batches):
        free_memory()
        for b in batches:
            key, out = [], []
            for s in _sets(b.column(0), shingle_words):
                if len(s):
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest()), out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(out, pa.binary())], names=["set_key", "s"])

    found = asked.mapInArrow(sets, "set_key binary, s binary").join(need.select("node", "set_key"), "set_key")
    out = store(found.dropDuplicates(["node"]).select("node", "s"), "sets")
    discard(need)
    return out


def confirm(pairs: DataFrame, full: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets reach the threshold."""

    def check(batches):
        free_memory()
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= pct * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(full.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        full.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return store(joined.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "links")


def _block_links(k: int, match: int, pct: int):
    """Confirmed links between the components of one block pair of a list: a spanning forest."""
    coordinate = np.arange(k, dtype=np.uint64)

    def forest(c: int, idx: np.ndarray, col: dict, sig: np.ndarray, sets: list):
        same = col["lo"][idx[0]] == col["hi"][idx[0]]
        node, block, size = (col[x][idx] for x in ("node", "block", "n"))
        own = sig[idx]
        posted = (col["posted"][idx].astype(np.uint64)[:, None] >> coordinate & np.uint64(1)).astype(bool)
        _, label = np.unique(col["root"][idx], return_inverse=True)  # component of each document, contracted as links are found
        for t in range(len(idx) - 1):
            rest = np.arange(t + 1, len(idx))
            near = (label[rest] != label[t]) & (100 * np.minimum(size[rest], size[t]) >= pct * np.maximum(size[rest], size[t]))
            rest = rest[near & (same | (block[rest] != block[t]))]
            equal = own[rest] == own[t]
            hit = (equal.sum(axis=1) >= match) & ((equal & posted[rest] & posted[t]).argmax(axis=1) == c)  # this list is the pair's own
            rest = rest[hit]
            for part in np.split(rest, range(256, len(rest), 256)) if len(rest) else []:
                each = [sets[idx[r]] for r in part]
                flat_sets, mine = np.concatenate(each), sets[idx[t]]
                at = np.minimum(np.searchsorted(mine, flat_sets), len(mine) - 1)
                first = np.concatenate([[0], np.cumsum([len(x) for x in each])[:-1]])
                both = np.add.reduceat((mine[at] == flat_sets).astype(np.int64), first)
                for r in part[100 * both >= pct * (len(mine) + size[part] - both)]:
                    if label[r] != label[t]:
                        label[label == label[r]] = label[t]
                        yield int(node[t]), int(node[r])

    def run(group: pa.Table) -> pa.Table:
        col = {c: group[c].to_numpy() for c in ("pair", "lo", "hi", "block", "node", "root", "n", "posted")}
        sig = pa.concat_arrays(group["sig"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["s"]]
        order = np.lexsort((col["node"], col["hi"], col["lo"], col["pair"]))
        key = np.stack([col["pair"], col["lo"], col["hi"]])[:, order]
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        links = [x for idx in np.split(order, cut) for x in forest(int(col["pair"][idx[0]] >> 32), idx, col, sig, sets)]
        a, b = zip(*links) if links else ((), ())
        del sets, sig, col
        free_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS,
                    threshold_pct: int = THRESHOLD_PCT, k: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of the row's component), kept."""
    match = match_threshold(k, threshold_pct, miss)
    rows = store(signatures(docs, text, doc_id, shingle_words, k), "signatures")
    made = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = store(made.withColumn("node", F.monotonically_increasing_id()), "classes")
    made, lists = postings(classes.select("node", "sig"), k, match)
    posted = store(lists, "lists")
    discard(made)

    # Round one: each list's documents against its most central one.
    sig = classes.select("node", "n", "sig")
    star = posted.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(sig.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    near = store(star.where((100 * F.least("na", "nb") >= threshold_pct * F.greatest("na", "nb")) & (_matches("sa", "sb") >= match)).select("a", "b"), "pairs")
    ends = near.select(F.col("a").alias("node")).union(near.select("b"))
    sets = full_sets(ends, classes, docs, text, doc_id, shingle_words)
    confirmed = confirm(near, sets, threshold_pct)
    discard(near, sets)
    root = store(components(confirmed), "components")
    discard(confirmed)

    # Round two: what is left of the longer lists, block against block.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    left = posted.where("size > 2").join(root, "node", "left").select("pair", "node", "posted", F.coalesce("root", "node").alias("root"), blocks.alias("blocks"))
    open_lists = left.groupBy("pair").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("pair")
    left = open_ = store(left.join(open_lists, "pair", "left_semi"), "open")
    discard(posted)
    n_left = left.count()
    if n_left:
        full = full_sets(left.select("node"), classes, docs, text, doc_id, shingle_words)
        left = left.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sig, "node").join(full, "node")
        left = left.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        groups = left.withColumn("_g", F.pmod(F.xxhash64("pair", "lo", "hi"), F.lit(1 + n_left // 4000)))
        found = store(groups.select("_g", "pair", "lo", "hi", "block", "node", "root", "n", "posted", "sig", "s").groupBy("_g").applyInArrow(
            _block_links(k, match, threshold_pct), "a long, b long"), "links")
        discard(full, open_)
        if not found.isEmpty():
            # the found links between roots; then every node follows its root
            of = lambda x: F.coalesce(F.col(f"root_{x}"), F.col(x)).alias(x)
            ra, rb = (root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
            top = store(components(found.join(ra, "a", "left").join(rb, "b", "left").select(of("a"), of("b"))), "components")
            up = top.select(F.col("node").alias("root"), F.col("root").alias("top"))
            moved = root.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            root = store(moved.union(top.join(root, "node", "left_anti").select("node", "root")), "components")

    # Smallest doc_id of each component, over all classes in it; nulls last.
    member = classes.select("set_key", "node", "doc_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = member.join(least, "root").select("set_key", "component_id", "root")
    out = rows.select("doc_id", "set_key", "n_shingles").join(known, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
