"""Quality rules as a bitmask ledger.

`ledger` measures every document once and stores each rule's outcome as one bit of `fail_bits` beside the measurements.
Policies are versioned masks over those bits with a number of tolerated failures, so applying, comparing or ablating
policies never reads a text again: `apply_policy` is one bitwise AND per row and `ablations` aggregates the distinct bit
patterns.

Words are runs of bytes other than ASCII white space. Texts of any length are measured whole. Null text counts as empty (no words). Repeated rows get equal
results; empty tables give empty results; extra columns travel along, and columns named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, flat, map_batches, mix64, prefix_hash, row_blocks, shingle_hashes, span_hash, word_spans

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_digits"]
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 0xC0 for b in range(256)])
_UPPER = np.arange(256)
_UPPER = (_UPPER >= 65) & (_UPPER <= 90)
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds; conditions use integers only."""

    bit: int
    name: str
    fails: str


# Bits are never reused: a changed rule gets a new bit, so stored ledgers stay readable.
RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_share", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "upper_case", "100 * n_upper > 60 * n_letters"),
    Rule(7, "digits", "100 * n_digits > 30 * word_chars"),
    Rule(8, "too_long", "n_words > 100000"),
]


@dataclass(frozen=True)
class Policy:
    """Documents pass whose failures among `rules` number at most `tolerated`."""

    name: str
    version: int
    rules: tuple[str, ...]
    tolerated: int = 0

    def mask(self, rules: list[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
QUALITY = Policy("quality", 1, ("few_words", "repeated_words", "symbol_share", "duplicate_lines", "short_words", "long_words"))
STRICT = Policy("quality", 2, (*QUALITY.rules, "upper_case", "digits", "too_long"))
POLICIES = [BASE, QUALITY, STRICT]


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[off[1:]] - c[off[:-1]]


def _repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the keys that occur more than once in their document."""
    _, at, n = np.unique(key ^ mix64(doc.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    return n[at] > 1


def measure_buffer(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of the documents in one buffer."""
    rows = len(off) - 1
    s = prefix_hash(buf)
    start, end, n = word_spans(buf, off)
    words = mix64(span_hash(s, start, end))
    doc = np.repeat(np.arange(rows), n)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        hit = at[_repeats(shingle_hashes(words, 3)[at], doc[at])]
        for k in range(3):
            covered[hit + k] = True
    first = np.ones(len(buf) + 1, bool)  # where a line starts: after a newline, and at each document's start
    first[1:] = np.concatenate([buf == 10])
    first[off[:-1]] = True
    first[-1] = False
    empty_end = off[1:][(np.diff(off) > 0)]
    line = np.flatnonzero(first[:-1]) if len(buf) else np.zeros(0, int)
    line_doc = np.searchsorted(off, line, side="right") - 1
    nxt = np.concatenate([line[1:], [len(buf)]]) if len(line) else line
    line_end = np.where(np.isin(nxt, empty_end), nxt, nxt - 1)
    # a line's newline is not part of it; the last line of a document may end without one
    line_end = np.where((line_end > line) & (buf[np.maximum(line_end - 1, 0)] == 10) & (line_end == nxt), line_end - 1, line_end)
    line_end = np.maximum(line_end, line)
    inked = np.concatenate([[0], np.cumsum(~SPACE[buf])])
    real = inked[line_end] > inked[line]
    key = mix64(span_hash(s, line[real], line_end[real])) ^ mix64(line_doc[real].astype(np.uint64) + np.uint64(1))
    _, one = np.unique(key, return_index=True)
    repeated = np.ones(int(real.sum()), bool)
    repeated[one] = False
    count = lambda d, w=None: np.bincount(d, w, rows).astype(np.int64)
    whole = (buf & 0xC0) != 0x80  # first byte of a code point
    return {
        "n_words": n, "word_chars": _per_row(~SPACE[buf] & whole, off), "n_symbols": _per_row(_SYMBOL[buf], off),
        "n_lines": count(line_doc[real]), "n_dup_lines": count(line_doc[real][repeated]), "n_repeat_words": count(doc[covered]),
        "n_letters": _per_row(_LETTER[buf], off), "n_upper": _per_row(_UPPER[buf], off), "n_digits": _per_row(_DIGIT[buf], off),
    }


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def run(body):
        buf, off = flat(body)
        parts = [measure_buffer(buf[off[i]: off[j]], off[i: j + 1] - off[i]) for i, j in row_blocks(off)]
        return [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64)) for m in MEASURES]

    return map_batches(docs, {"body": F.col(text).cast("string").cast("binary")}, {m: T.LongType() for m in MEASURES}, run,
                       docs.columns if keep is None else keep)


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Measurements and fail_bits of every document."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits + F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0))
    return measure(docs, text, keep).withColumn("fail_bits", bits.cast("long"))


def passes(policy: Policy, fail_bits: str = "fail_bits", rules: list[Rule] = RULES) -> Column:
    return F.bit_count(F.col(fail_bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long"))) <= policy.tolerated


def apply_policy(rows: DataFrame, policy: Policy, rules: list[Rule] = RULES) -> DataFrame:
    return rows.withColumn("kept", passes(policy, rules=rules))


def saved_by(policy: Policy, fail_bits: str = "fail_bits", rules: list[Rule] = RULES) -> Column:
    """Bits of the rules each of which, taken out alone, would let a rejected document pass; 0 where it passes or no single
    rule decides."""
    failures = F.col(fail_bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long"))
    return F.when(F.bit_count(failures) == policy.tolerated + 1, failures).otherwise(F.lit(0).cast("long"))


def ablations(rows: DataFrame, policies: list[Policy] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents failing the rule, documents kept by the policy, and documents it would keep beside
    those without the rule. Works on the distinct bit patterns (one aggregate of the ledger; 2**rules of them at most)."""
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("docs"))
    asked = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
                               F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(p.tolerated).alias("tolerated"))
                      for p in policies for r in rules if r.name in p.rules])
    x = patterns.select("fail_bits", "docs", F.explode(asked).alias("a")).select("fail_bits", "docs", "a.*")
    failures = F.col("fail_bits").bitwiseAND(F.col("mask"))
    kept = F.bit_count(failures) <= F.col("tolerated")
    without = F.bit_count(failures.bitwiseAND(F.bitwise_not("bit"))) <= F.col("tolerated")
    return x.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("failing"),
        F.sum(F.when(kept, F.col("docs")).otherwise(0)).alias("kept"),
        F.sum(F.when(without & ~kept, F.col("docs")).otherwise(0)).alias("regained"))
