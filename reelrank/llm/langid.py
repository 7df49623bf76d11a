"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order byte context tree (orders 0 to `order`) with escape probabilities, frozen after
training. A text's code length under a language is the exact sum of -log2 P(byte | context). Method-C escapes:
a context with n training bytes and d distinct followers gives a seen follower c/(n+d) and escapes with d/(n+d); the
escape mass goes to the next shorter context, renormalised over the followers not seen here, so each context's 256
probabilities sum to 1. The language with the shortest code wins; the score is its posterior under equal priors.

Text is lower-cased and every ASCII byte that is no letter counts as a space. Null, empty or letterless text is `und`
with score 0. Ties go to the smaller language name. Repeated rows get equal results. With no labelled row at all every
text is `und`. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, CodeTable, bounded_batches, flat, map_batches, row_blocks

ORDER = 3
# Fit on about this many labelled documents of each language (all, where there are fewer), chosen by a hash of doc_id.
FIT_DOCS_PER_LANGUAGE = 2000
UNDETERMINED = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


_SHORT = np.uint64(2**64 - 1)


def _ngrams(buf: np.ndarray, pos: np.ndarray, order: int, lo: int, hi: int) -> list[np.ndarray]:
    """For k = 0..order the codes of the (k+1)-byte strings that end at positions lo..hi. `pos` is the offset inside the
    document; strings that would start before it get the largest code."""
    seg = np.zeros(hi - lo + order, np.uint64)
    start = max(0, lo - order)
    seg[order - (lo - start):] = buf[start:hi]
    codes, code = [], np.zeros(hi - lo, np.uint64)
    for k in range(order + 1):
        code = code | (seg[order - k: order - k + hi - lo] << np.uint64(8 * k))
        codes.append(np.where(pos[lo:hi] < k, _SHORT, code) if k else code)
    return codes


def _steps(buf: np.ndarray, off: np.ndarray):
    """(bytes, document number and in-document offset of each byte, lo, hi) for ranges of bounded length."""
    for i, j in row_blocks(off):
        part, o = buf[off[i]: off[j]], off[i: j + 1] - off[i]
        doc = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(o))
        pos = np.arange(len(part)) - o[doc - i]
        for lo in range(0, len(part), STEP_BYTES):
            yield _FOLD[part], doc, pos, lo, min(len(part), lo + STEP_BYTES)


def context_counts(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, order, code, n): how often each byte follows each context, pre-aggregated per batch before the shuffle."""
    bounded_batches(docs.sparkSession)
    schema = "lang string, order int, code long, n long"

    def run(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for name in sorted(set(langs)):
                pick = pa.array([i for i, x in enumerate(langs) if x == name])
                for buf, _, pos, lo, hi in _steps(*flat(b.column(1).take(pick))):
                    for k, code in enumerate(_ngrams(buf, pos, order, lo, hi)):
                        u, n = np.unique(code[code != _SHORT], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(u)), pa.array(np.full(len(u), k, np.int32)), pa.array(u.astype(np.int64)),
                             pa.array(n.astype(np.int64))], names=["lang", "order", "code", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.lower(F.col(text).cast("string")).cast("binary"))
    return rows.mapInArrow(run, schema).groupBy("lang", "order", "code").agg(F.sum("n").alias("n"))


class PPMModel:
    """Frozen context trees of all languages side by side: one row per byte string seen in any language, one column per
    language."""

    def __init__(self, langs: list[str], counts: list[dict[str, np.ndarray]], order: int = ORDER):
        """counts[k]: arrays lang (index), code, n of order k."""
        self.langs, self.order = langs, order
        L = len(langs)
        self.tables, self.value, self.bow = [], [], [np.zeros((0, L), np.float32) for _ in range(order + 1)]
        prev = None  # log2 P of the rows of the next lower order, as float64
        for k in range(order + 1):
            codes = np.unique(counts[k]["code"]).astype(np.uint64)
            c = np.zeros((len(codes), L))
            np.add.at(c, (np.searchsorted(codes, counts[k]["code"].astype(np.uint64)), counts[k]["lang"]), counts[k]["n"])
            ctx = codes >> np.uint64(8)
            ctxs, first = np.unique(ctx, return_index=True)
            n, d = (np.add.reduceat(x, first, axis=0) if len(first) else np.zeros((0, L)) for x in (c, c > 0))
            of = np.searchsorted(ctxs, ctx)
            if k == 0:
                lower = np.full((len(codes), L), 1 / 256)
            else:
                lower = 2.0 ** prev[self.tables[k - 1].rows(codes & np.uint64(2 ** (8 * k) - 1))]
            seen_mass = np.add.reduceat(np.where(c > 0, lower, 0), first, axis=0) if len(first) else np.zeros((0, L))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, d / (n + d), 1.0)
                full = seen_mass >= 1 - 1e-12
                bow = np.where(n > 0, escape / np.where(full, 1.0, 1 - seen_mass), 1.0)
                p = np.where(c > 0, c / (n + d)[of], bow[of] * lower)
            prev = np.log2(np.maximum(p, 1e-300))
            self.tables.append(CodeTable(codes))
            self.value.append(prev.astype(np.float32))
            if k == 0:
                self.unseen = np.log2(np.maximum(bow[0] if len(bow) else np.ones(L), 1e-300)) - 8
            else:  # aligned with the rows of order k-1: the context is itself a byte string of that order
                rows = np.zeros((len(self.value[k - 1]), L), np.float32)
                rows[self.tables[k - 1].rows(ctxs)] = np.log2(np.maximum(bow, 1e-300))
                self.bow[k] = rows

    def log2_rows(self, buf: np.ndarray, pos: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """log2 P of each byte lo..hi under each language, shape (hi - lo, languages)."""
        out = np.zeros((hi - lo, len(self.langs)), np.float32)
        left = np.arange(hi - lo)
        codes = _ngrams(buf, pos, self.order, lo, hi)
        for k in range(self.order, -1, -1):
            code = codes[k][left]
            short = code == _SHORT
            row = np.where(short, -1, self.tables[k].rows(code))
            hit = row >= 0
            out[left[hit]] += self.value[k][row[hit]]
            miss = ~hit & ~short
            if k == 0:
                out[left[miss]] += self.unseen.astype(np.float32)
            elif miss.any():
                ctx = self.tables[k - 1].rows(code[miss] >> np.uint64(8))
                out[left[miss][ctx >= 0]] += self.bow[k][ctx[ctx >= 0]]
            left = left[~hit]
        return out

    def code_lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each document under each language, shape (documents, languages); buf holds raw lower-cased bytes."""
        bits = np.zeros((len(off) - 1, len(self.langs)))
        for part, doc, pos, lo, hi in _steps(buf, off):
            row = self.log2_rows(part, pos, lo, hi)
            at = doc[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            bits[at[first]] -= np.add.reduceat(row, first, axis=0, dtype=np.float64)
        return bits


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", order: int = ORDER,
        docs_per_language: int = FIT_DOCS_PER_LANGUAGE) -> PPMModel:
    """Fit on a bounded, hash-chosen sample of the rows with a non-null language and text.

    The languages and the sample's context counts come to the driver; both are bounded by the sample, not by the corpus.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return PPMModel([], [{"lang": np.zeros(0, int), "code": np.zeros(0, np.int64), "n": np.zeros(0)}] * (order + 1), order)
    share = F.lit(0)
    for name in langs:
        share = F.when(F.col(lang) == name, F.lit(int(min(1.0, docs_per_language / sizes[name]) * 10**6))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("ppm-fit"), F.col(doc_id)), F.lit(10**6)) < share)
    got = context_counts(sample, text, lang, order).toArrow()
    index = np.searchsorted(np.array(langs), np.array(got["lang"].to_pylist(), dtype=str)) if got.num_rows else np.zeros(0, int)
    k, code, n = (got[c].to_numpy() for c in ("order", "code", "n"))
    return PPMModel(langs, [{"lang": index[k == i], "code": code[k == i], "n": n[k == i]} for i in range(order + 1)], order)


def identify(docs: DataFrame, model: PPMModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with lang_pred, score, and bits_per_byte of the winning language."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit sample

    def run(has_letter, body):
        m = bc.value
        ok = np.array(has_letter.to_pylist(), bool) & bool(m.langs)
        buf, off = flat(body)
        size = np.maximum(np.diff(off), 1)
        if not m.langs:
            return [pa.array([UNDETERMINED] * len(ok)), pa.array(np.zeros(len(ok))), pa.array(np.zeros(len(ok)))]
        bits = m.code_lengths(buf, off)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(best)), best]
        score = 1 / np.exp2(np.minimum(0, low[:, None] - bits)).sum(axis=1)
        names = np.array(m.langs, dtype=object)[best]
        names[~ok] = UNDETERMINED
        return [pa.array(names.tolist(), pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, low / size, 0.0))]

    t = F.col(text).cast("string")
    return map_batches(docs, {"ok": F.coalesce(t.rlike(r"\p{L}"), F.lit(False)), "body": F.lower(t).cast("binary")},
                       {"lang_pred": T.StringType(), "score": T.DoubleType(), "bits_per_byte": T.DoubleType()},
                       run, docs.columns if keep is None else keep)
