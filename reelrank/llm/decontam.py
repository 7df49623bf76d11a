"""Benchmark decontamination: word-pair seeds with a counting filter, then Smith-Waterman alignment.

Test items are cut into passages of at most `PASSAGE_WORDS` words (half overlapping). Documents are aligned with a passage
(match +2, mismatch -1, gap -1, on words); the score is the best local alignment over that of an exact copy, so copies with
edited, inserted or missing words still score high. An item's score in a document is its best passage's; pairs from
`min_score` on are returned.

What is aligned is chosen without loss. A passage's seeds are its pairs of neighbouring words; a document has a pair where
the words stand side by side or with one word between them. An alignment that reaches `min_score` has at least
`needed_pairs` of them, within `span_words` words of the document, so only such spans are aligned. As many of the pairs
may be missing from the search as are taken off the number needed: half of that number, the most frequent ones by
corpus-wide word counts. The counts thus order the seeds only; how often an item leaks and how large the corpus is
changes the time, not the result. (Where `min_score` is so low that no pair is needed, one still is: below 0.5 for
passages of five words.)

Words are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text: case and punctuation edits cost
nothing. Characters of scripts written without spaces (Chinese, Japanese, Thai, Lao, Tibetan, Burmese, Khmer) are a word
each. Items of fewer than `MIN_WORDS` words are found where their whole word sequence stands, unedited (score 1);
`short_items=False` leaves them out, for callers to whom a common phrase is no leak.

Null or wordless items and documents match nothing. Repeated documents give repeated rows, repeated items count once, equal
items are each reported. Of several places of an item in a document the best is returned, the last of equally good ones
(neighbouring places count as one, with its first). Very long texts are searched whole. Empty tables give an empty result.
Extra columns are not read.

The benchmark is a stated query set: it is handled in blocks of at most `BLOCK_WORDS` words, each broadcast, and every
block is held against all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PUNCTUATED, CodeTable, bounded_batches, flat, mix64, prefix_hash, row_blocks, span_hash, word_hashes

PASSAGE_WORDS = 64
MIN_WORDS = 5
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK_WORDS = 1_000_000


def _unspaced() -> np.ndarray:
    """Marks the first two UTF-8 bytes (as one number) of the characters that are a word each."""
    # First and last code point of the blocks of these scripts.
    blocks = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x33FFF)]
    out = np.zeros(1 << 16, bool)
    for first, last in blocks:
        lo, hi = (int.from_bytes(chr(c).encode()[:2], "big") for c in (first, last))
        out[lo: hi + 1] = True
    return out


UNSPACED = _unspaced()


def words_of(buf: np.ndarray, off: np.ndarray):
    """As `word_hashes` with PUNCTUATED, but every character of an unspaced script is a word of its own."""
    lead = np.flatnonzero(buf[:-1] >= 0xE0)
    lead = lead[UNSPACED[buf[lead].astype(np.int64) << 8 | buf[lead + 1]]]
    if not len(lead):
        return word_hashes(buf, off, PUNCTUATED)
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    cut[lead] = True
    cut[np.minimum(lead + 3 + (buf[lead] >= 0xF0), len(buf))] = True
    low = LOWER[buf]
    word = np.concatenate([[False], ~PUNCTUATED[low], [False]])
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return mix64(span_hash(prefix_hash(low), start, end)), start, end, np.diff(np.searchsorted(start, off))


def _hashes(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return words_of(buf, np.array([0, len(buf)]))[0]


class Passages:
    """The passages of one block of items as word hashes, and their seeds once word counts are known."""

    def __init__(self, items: list[tuple], words: int = PASSAGE_WORDS, short_items: bool = True):
        self.item, self.words = [], []
        for n, (_, text) in enumerate(items):
            h = _hashes(text or "")
            if len(h) < (1 if short_items else MIN_WORDS):
                continue
            step = max(1, words // 2)
            for at in range(0, max(1, len(h) - step), step):
                self.item.append(n), self.words.append(h[at: at + words])
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)

    def choose_seeds(self, counts: np.ndarray, total: int, min_score: float = MIN_SCORE) -> None:
        """The rarer pairs of every passage, and how many of them an alignment has within how many words."""
        log_p = np.log((counts + 1) / (total + len(counts) + 1))
        self.need, self.span, parts = np.ones(len(self.words), np.int64), np.zeros(len(self.words), np.int64), []
        self.least, self.single = np.full(len(self.words), min_score), False
        for n, h in enumerate(self.words):
            if len(h) < MIN_WORDS:  # the whole sequence: every pair, side by side; a lone word is its own seed
                self.least[n] = max(1.0, min_score)
                self.need[n], self.span[n] = max(1, len(h) - 1), len(h)
                self.single |= len(h) == 1
                parts.append((np.unique(pair_hashes(h, 1) if len(h) > 1 else lone_hashes(h)), n))
                continue
            need = needed_pairs(len(h), min_score)
            left_out = need // 2
            p = log_p[np.searchsorted(self.vocabulary, h)]
            at = np.argsort(p[1:] + p[:-1], kind="stable")[: len(h) - 1 - left_out]
            self.need[n], self.span[n] = need - left_out, span_words(len(h), min_score)
            parts.append((np.unique(pair_hashes(h, 1)[at]), n))
        keys = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        of = np.repeat([n for _, n in parts], [len(x) for x, _ in parts]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first, count = np.unique(keys[order], return_index=True, return_counts=True)
        self.seeds = CodeTable(keys), first, count, of[order]


def needed_pairs(words: int, min_score: float) -> int:
    """Fewest passage pairs (neighbours in the passage; in the document too, or one word apart) of an alignment that scores
    at least min_score.

    Of the steps between matched words, s lose passage words (one error and one match at least), t insert two or more
    words; u words are missing at the ends. A score of 2 * words - lost has 3s + 2t + 2u <= lost and words - 1 - 2s - t - u
    steps that are pairs.
    """
    lost = int(MATCH * words * (1 - min_score) + 1e-9)
    return max(1, words - 1 - 2 * (lost // 3) - (lost % 3 == 2))


def span_words(words: int, min_score: float) -> int:
    """Most document words of such an alignment: all words matched, and every error an insertion."""
    return words + int(MATCH * words * (1 - min_score) + 1e-9)


_PAIR_ODD = np.array([0xD1342543DE82EF95, 0xBF58476D1CE4E5B9], np.uint64)


def pair_hashes(h: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the one `apart` places after it."""
    n = max(0, len(h) - apart)
    return mix64(h[:n] * _PAIR_ODD[0] + h[apart: apart + n] * _PAIR_ODD[1])


def lone_hashes(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ _PAIR_ODD[0])


def align(passage: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of a passage in a window of word hashes: (score, first, last + 1 word of the window).

    One numpy row per passage word. A cell holds score * 2**32 + start, so the start travels with the maximum; gaps along
    the row are a running maximum after the gap cost is made constant.
    """
    one = np.int64(1) << 32
    m = len(window)
    j = np.arange(m + 1, dtype=np.int64)
    fresh, slope = j.copy(), j * GAP * one
    row, best, end = fresh.copy(), np.int64(0), 0
    for w in passage:
        new = np.maximum(fresh, row - GAP * one)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(window == w, MATCH, MISMATCH) * one)
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] // one > best // one:
            best, end = row[top], top
    return int(best // one), int(best % one), end


def _windows(at: np.ndarray, need: int, span: int, n: int):
    """Windows of a document of n words, from sorted distinct seed positions: every span with `need` of them, merged."""
    first, last = at[: len(at) - need + 1], at[need - 1:]
    near = last - first < span
    lo, hi = np.maximum(0, last[near] + 1 - span), np.minimum(n, first[near] + span)
    if len(lo):
        cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
        for i, j in zip([0, *cut], [*cut, len(lo)]):
            yield int(lo[i]), int(hi[j - 1])


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """Corpus-wide counts of the benchmark's words (bounded by the block), and the number of all words."""
    bounded_batches(docs.sparkSession)
    size = len(vocabulary)
    bc = docs.sparkSession.sparkContext.broadcast(CodeTable(vocabulary))

    def run(batches):
        n = np.zeros(size + 1, np.int64)
        for b in batches:
            buf, off = flat(b.column(0))
            for i, j in row_blocks(off):
                row = bc.value.rows(words_of(buf[off[i]: off[j]], off[i: j + 1] - off[i])[0])
                n[:size] += np.bincount(row[row >= 0], minlength=size)
                n[size] += len(row)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["w", "n"])

    got = docs.select(F.lower(F.col(text).cast("string")).cast("binary")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size + 1, np.int64)
    n[got["w"].to_numpy()] = got["n"].to_numpy()
    return n[:size], int(n[size])


def _scan(docs: DataFrame, items: list[tuple], passages: Passages, text: str, doc_id: str, min_score: float, item_type: str) -> DataFrame:
    bc = docs.sparkSession.sparkContext.broadcast((passages, [x[0] for x in items]))

    def hits(h: np.ndarray, doc: np.ndarray, p: Passages):
        """(document, passage, word position) of the pairs found, each once, sorted; only where enough are near."""
        index, first, count, of = p.seeds
        out = []
        for apart in (0, 1, 2) if p.single else (1, 2):
            row = index.rows(pair_hashes(h, apart) if apart else lone_hashes(h))
            at = np.flatnonzero((row >= 0) & (doc[: len(row)] == doc[apart:])) if len(row) else np.zeros(0, np.int64)
            row = row[at]
            k = np.repeat(first[row] - np.cumsum(count[row]) + count[row], count[row]) + np.arange(count[row].sum())
            out.append(of[k] * len(h) + np.repeat(at, count[row]))
        key = np.unique(np.concatenate(out))
        q, at = key // max(1, len(h)), key % max(1, len(h))
        d = doc[at]
        # a hit stays if some `need` hits around it, of its passage and document, lie within the span
        keep = np.zeros(len(key), bool)
        for need in np.unique(p.need[q]):
            x = np.flatnonzero(p.need[q] == need)
            i, j = x[: max(0, len(x) - need + 1)], x[need - 1:]
            good = np.flatnonzero((q[i] == q[j]) & (d[i] == d[j]) & (at[j] - at[i] < p.span[q[i]]))
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, good, 1)
            np.add.at(edge, good + need, -1)
            keep[x[np.cumsum(edge[:-1]) > 0]] = True
        found = np.stack([d, q, at])[:, keep]
        return found[:, np.lexsort(found[::-1])]

    def run(batches):
        p, ids = bc.value
        for b in batches:
            buf, off = flat(b.column(1))
            rows = []
            for i, j in row_blocks(off):
                part, o = buf[off[i]: off[j]], off[i: j + 1] - off[i]
                h, start, end, n = words_of(part, o)
                doc = np.repeat(np.arange(j - i), n)
                first = np.concatenate([[0], np.cumsum(n)])
                found = hits(h, doc, p)
                cut = np.flatnonzero((found[:2, 1:] != found[:2, :-1]).any(axis=0)) + 1
                best: dict[tuple[int, int], tuple] = {}
                for group in np.split(found, cut, axis=1) if found.shape[1] else []:
                    d, q = int(group[0, 0]), int(group[1, 0])
                    words, own = p.words[q], h[first[d]: first[d + 1]]
                    for lo, hi in reversed(list(_windows(group[2] - first[d], p.need[q], p.span[q], len(own)))):
                        score, s, e = align(words, own[lo:hi])
                        x = (score / (MATCH * len(words)), first[d] + lo + s, first[d] + lo + e - 1)
                        if x[0] >= p.least[q] and x > best.get((d, p.item[q]), (0,)):
                            best[d, p.item[q]] = x
                        if x[0] >= 1:  # no earlier place counts more
                            break
                for (d, item), (score, s, e) in sorted(best.items()):
                    points = np.flatnonzero((part[o[d]: end[e]] & 0xC0) != 0x80) + o[d]
                    rows.append((i + d, ids[item], score, int(np.searchsorted(points, start[s])), len(points)))
            row, item, score, s, e = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(item, schema_item), pa.array(score, pa.float64()),
                 pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "item_id", "score", "start", "end"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema_item = to_arrow_type(_parse_datatype_string(item_type))
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.lower(F.col(text).cast("string")).cast("binary")).mapInArrow(
        run, f"doc_id {kind}, item_id {item_type}, score double, start long, end long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
               item_text: str = "text", min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS, short_items: bool = True) -> DataFrame:
    """(doc_id, item_id, score, start, end): start and end are code points of the aligned part of the lower-cased document (the same as
    in the document, but for the rare letters whose lower case is longer)."""
    bounded_batches(docs.sparkSession)
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.lower(F.col(item_text).cast("string")).alias("t")).distinct()
    # words at most: separated ASCII runs, and one for each other character
    total = items.agg(F.sum(F.size(F.split("t", r"[^\p{Alnum}]+")) + F.length(F.regexp_replace("t", r"\p{ASCII}", "")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    item_type = benchmark.schema[item_id].dataType.simpleString()
    out = None
    for k in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()]  # at most about block_words words
        passages = Passages(own, short_items=short_items)
        counts, words = word_counts(docs, passages.vocabulary, text)
        passages.choose_seeds(counts, words, min_score)
        found = _scan(docs, own, passages, text, doc_id, min_score, item_type)
        out = found if out is None else out.unionByName(found)
    return out
