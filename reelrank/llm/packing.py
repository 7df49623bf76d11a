"""Harmonic packing of tokenized documents into fixed-capacity sequences.

A piece of length in (C/(i+1), C/i] belongs to class i, and a bin of class i takes exactly i pieces, so a worker fills
its bins class by class without looking at any other worker's. Documents longer than C are cut into full pieces; the
rest is cut at reciprocal capacities (floor(C/(i+1))) until what is left is within `slack` of its class limit, so a full
bin of class i wastes at most C*slack (or i) positions. A worker's last, partly filled bins (fewer than i pieces each)
are emptied and refilled next-fit by falling length; they are few against the `PIECES_PER_WORKER` pieces it packs.

The tokenizer is used as its file has it: strings of added tokens in a text become those tokens. Null text counts as
empty: such a document is the single end id. Equal rows are packed once each; pieces of equal length are placed in row
order. Very long texts are tokenized whole. An empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, store

CAPACITY = 2048
END_ID = 1
SLACK = 1 / 64
PIECES_PER_WORKER = 100_000
# Pre-token cache of one Python worker; emptied when full (bounds memory, never changes ids).
CACHE_WORDS = 400_000

# Characters for which splitting and lower-casing below provably agree with the tokenizer's own rules: ASCII, Latin-1 and
# Latin Extended-A letters without the dotted/long-s specials, common punctuation. Other texts go to the tokenizer whole.
_LOW = "a-zß-öø-įı-ķĺ-ňŊ-ž"
_UP = "A-ZÀ-ÖØ-ÞĹ"
_MARK = "¡£§©«®°±»¿×÷–—‘-„•…€"
_SIMPLE = re.compile(f"[\x00-\x1b\x20-\x7f{_LOW}{_UP}{_MARK}]*")
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[0-9]|[^ \t\n\r\x0b\x0c{_LOW}0-9]+")


class WordTokenizer:
    """Ids of a text by a `tokenizers` file whose model works word by word with an end-of-word suffix: distinct
    pre-tokens are encoded once per worker and looked up after that. Other files: every text is encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        # texts that hold an added token's string, in any case, are the tokenizer's own business
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith("</w>")
        probe = "The müße don't 42 %%, Été"
        self.cache: dict[str, bytes] = {}
        self.by_word = bool(self.ends.any())
        self.by_word = self.by_word and self.encode(probe) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k: k + 4096]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):  # a pre-token that the tokenizer splits differently: one by one
                self.cache.update((w, self._whole(w)) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for w, c in zip(part, (cut * 4).tolist()):
                self.cache[w] = raw[at:c]
                at = c

    def _words(self, text: str) -> list[str] | None:
        """The pre-tokens of a text that splits by the rules above, else None."""
        if self.by_word and _SIMPLE.fullmatch(text) and not self.added.search(text):
            return _PRETOKEN.findall(text.lower())
        return None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; each text is split once, and the new pre-tokens of all
        of them are learned together."""
        split = [self._words(t) for t in texts]
        new = set().union(*(w for w in split if w)).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = set().union(*(w for w in split if w))
        self._learn(list(new))
        known = self.cache.__getitem__
        return [self._whole(t) if w is None else b"".join(map(known, w)) for t, w in zip(texts, split)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in text order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        i = capacity // rest
        if rest >= capacity / i * (1 - slack):
            out.append(rest)
            break
        out.append(capacity // (i + 1))
        rest -= capacity // (i + 1)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           slack: float = SLACK, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids as binary, if asked for)."""
    bounded_batches(docs.sparkSession)
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    end = np.uint32(end_id).tobytes()
    cuts: dict[int, list[int]] = {}

    def run(batches):
        tok = tokenizer(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for k in range(0, len(texts), 256):
                encoded = tok.encode_all(texts[k: k + 256])
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, own in enumerate(encoded, k):
                    raw = memoryview(own + end)
                    n = len(raw) // 4
                    rest = n % capacity
                    if rest not in cuts:
                        cuts[rest] = cut_lengths(rest, capacity, slack)
                    at = 0
                    for size in [capacity] * (n // capacity) + cuts[rest]:
                        part = raw[4 * at: 4 * (at + size)]
                        row.append(i), start.append(at), length.append(size), crc.append(zlib.crc32(part)), total.append(n)
                        if with_ids:
                            ids.append(bytes(part))
                        at += size
                cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=fields)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema)


def harmonic_bins(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece of one worker, by harmonic classes."""
    n = len(length)
    kind = capacity // length  # class i: i pieces of at most capacity/i each
    order = np.lexsort((-length, kind))
    k, size = kind[order], length[order]
    first = np.searchsorted(k, k, side="left")
    rank = np.arange(n) - first
    count = np.searchsorted(k, k, side="right") - first
    full = rank < count // k * k
    bin_of = np.full(n, -1, np.int64)
    key = np.where(full, first + rank // k, -1)  # first + rank // k is unique: a class has at least as many rows as bins
    _, bin_of[full] = np.unique(key[full], return_inverse=True)
    at, fill = int(bin_of.max(initial=-1)), capacity
    for i in np.flatnonzero(~full)[np.argsort(-size[~full], kind="stable")]:  # the last bins: fewer than i of each class
        if fill + size[i] > capacity:
            at, fill = at + 1, 0
        bin_of[i] = at
        fill += size[i]
    placed = np.lexsort((np.arange(n), bin_of))
    run = np.cumsum(size[placed]) - size[placed]
    b = bin_of[placed]
    offset = run - run[np.searchsorted(b, b, side="left")]
    out_bin, out_off = np.empty(n, np.int64), np.empty(n, np.int64)
    out_bin[order[placed]], out_off[order[placed]] = b, offset
    return out_bin, out_off


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, pieces_per_worker: int = PIECES_PER_WORKER) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (any columns beside `length` travel along).

    Pieces are dealt evenly by row number, so no document, however often it is repeated, loads one worker.
    """
    bounded_batches(piece_rows.sparkSession)
    workers = max(1, -(-piece_rows.count() // pieces_per_worker))
    dealt = piece_rows.withColumn("_worker", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(workers)))
    names = [c for c in piece_rows.columns if c not in ("sequence_id", "offset")]

    def run(group: pa.Table) -> pa.Table:
        where, offset = harmonic_bins(group["length"].to_numpy(), capacity)
        base = group["_worker"][0].as_py() << 32
        cols = [group[c] for c in names] + [pa.array(where + base), pa.array(offset)]
        return pa.table(cols, names=names + ["sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {piece_rows.schema[c].dataType.simpleString()}" for c in names)
    return dealt.groupBy("_worker").applyInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
                   slack: float = SLACK, with_ids: bool = False) -> DataFrame:
    """Tokenize once (the pieces are stored), then pack."""
    return pack(store(pieces(docs, tokenizer_path, text, doc_id, capacity, slack, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences of a table made with ids, unpadded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces a sequence
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("_hex")).select(
        "sequence_id", "length", F.unhex("_hex").alias("ids"))
