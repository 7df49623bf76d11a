"""Personal data by fixed patterns plus a linear-chain conditional random field (CRF).

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind. The CRF adds spans the
patterns miss (phone numbers without a plus sign, card numbers side by side, spelled-out e-mail addresses, access tokens
...). It labels words B-/I- per kind or O from word-shape features of the word and its neighbours, is trained by
gradient ascent on the exact log-likelihood over a small labelled table, and is decoded by Viterbi in numpy, many runs of
words at once. Words whose form the labelled table never marks (no digit, no @, no cue) are fixed to O: the chain falls
apart there, so decoding the runs of candidate words alone is exact. A document with `(at)` or `[at]` spells an address
out: there the joiners are candidates too, with the words beside them for as long as dots follow. CRF spans that overlap a
base span or an earlier CRF span are dropped; of two that start together the one of the first kind stays.

Offsets are code points, end exclusive. Null text counts as empty and has no span. Very long texts are handled whole (all
scans are linear). Repeated rows get equal results; empty tables give empty results; extra columns travel along, and
columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, map_batches, row_blocks, word_spans

# Kinds in the order of joined spans; the CRF may also find access tokens ("secret").
KINDS = ["email", "ip", "card", "phone", "secret"]
N_BASE = 4
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern spans, sorted."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:  # the address ends after its only @; its name is the run of name characters before it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def join_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# -- word shapes ------------------------------------------------------------------------------------------------------

# Words that often stand beside personal data and are features themselves.
CUES = ["token", "=", "key", "secret", "api_key", "password", "phone", "tel", "call", "fax", "mobile", "card", "visa", "mail", "email",
        "e-mail", "ip", "address", "contact", "at", "(at)", "[at]", "dot", "(dot)", "[dot]"]
_CUE_SET = frozenset(CUES)
_JOINERS = frozenset(["at", "(at)", "[at]", "dot", "(dot)", "[dot]"])
_AT, _DOT = frozenset(["(at)", "[at]"]), frozenset(["dot", "(dot)", "[dot]"])
_SPELLED = re.compile(rb"\(at\)|\[at\]", re.IGNORECASE)
CACHED_CHARS = 64  # longer words are looked at anew each time
_TRIM = " .,;:!?\"'%*$&#<>|{}“”"
_RUNS = re.compile(r"9+|a+|A+")


def shape(word: str) -> str:
    """Letters to a/A, digits to 9, runs with their length (up to 20); outer punctuation is dropped."""
    core = word.strip(_TRIM)
    if core.lower() in _CUE_SET:
        return "cue:" + core.lower()
    if not core:
        return "mark:" + word[:1]
    plain = "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in core)
    if "9" in plain and re.fullmatch("[9aA]{24,}", plain) and re.fullmatch("[0-9a-fA-F_-]+", core):
        return "hex"
    return _RUNS.sub(lambda m: f"9{min(len(m[0]), 20)}" if m[0][0] == "9" else m[0][0], plain)


def features(word: str) -> list[str]:
    """State features of one word; the first is its shape, which neighbours see too."""
    s = shape(word)
    coarse = re.sub(r"9\d+", "9", s)
    digits = sum("0" <= c <= "9" for c in word)
    return [s, "~" + coarse, f"d{min(digits, 20)}", "@" if "@" in word else "no@", f"dots{min(word.strip(_TRIM).count('.'), 4)}",
            "open" if word[:1] in "([+" else "plain"]


def is_candidate(word: str) -> bool:
    return any("0" <= c <= "9" for c in word) or "@" in word or word.strip(_TRIM).lower() in _JOINERS


LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_L = len(LABELS)
# A label I-k may follow only B-k or I-k.
ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])


def labelled_table(n: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Small labelled table made by rule: sentences of filler words with one or two marked values of varied form, and with
    numbers that are no personal data."""
    r = np.random.default_rng(seed)
    syllables = "an er in the th re on ti ne la que men ung sch ver os ar ció é ü".split()
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4))) + str(r.choice(["", "", "", ",", ".", "!!", "%%%"]))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    host = lambda: f"{r.choice(['mail', 'post', 'host'])}{r.integers(1, 99)}.{r.choice(['example.com', 'example.org', 'test.net'])}"
    name = lambda: "".join(r.choice(syllables[:12], 2)) + str(r.choice(["", ".", "_"])) + num(int(r.integers(0, 3)))

    def value():
        k = int(r.integers(0, 14))
        if k == 0:
            return "email", [f"{name()}@{host()}"]
        if k == 1:
            return "email", [name(), str(r.choice(["(at)", "[at]"])), *host().replace(".", " (dot) ").split()]
        if k == 2:
            return "ip", [".".join(str(x) for x in r.integers(0, 256, 4))]
        if k == 3:
            return "card", [num(16)]
        if k == 4:
            return "card", [num(4) for _ in range(4)]
        if k == 5:
            return "card", ["-".join(num(4) for _ in range(4))]
        if k == 6:
            return "phone", [f"+{r.integers(1, 99)}", f"({num(3)})", f"{num(3)}-{num(4)}"]
        if k == 7:
            return "phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]
        if k == 8:
            return "phone", [f"{num(3)}-{num(3)}-{num(4)}"]
        if k == 9:
            return "secret", ['"' + "".join(r.choice(list("0123456789abcdef"), 40)) + '"']
        if k == 10:
            return "O", [str(r.choice([num(1), num(2), num(3), "19" + num(2), "20" + num(2), num(5), num(6)]))]
        if k == 11:
            return "O", [f"{num(1)}.{num(1)}", f"v{num(1)}.{num(2)}"]
        if k == 12:
            return "O", [f"{num(2)}:{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)}-{num(2)}-{num(2)}"]
        return "O", [str(r.choice([f"{num(3)},{num(3)}", f"{num(2)}%", f"${num(4)}", f"{num(2)}th", f"A{num(2)}", "at", f"§{num(2)}"]))]

    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            fill = [word() for _ in range(int(r.integers(0, 6)))]
            words += fill
            labels += ["O"] * len(fill)
            kind, parts = value()
            if kind == "secret":
                words += ["token", "="]
                labels += ["O", "O"]
            words += parts
            labels += ["O"] * len(parts) if kind == "O" else ["B-" + kind] + ["I-" + kind] * (len(parts) - 1)
        rows.append((words, labels))
    return rows


class CRF:
    """Weights: state features x labels, neighbours' shapes x labels, label transitions."""

    def __init__(self, table: list[tuple[list[str], list[str]]], steps: int = 80, rate: float = 0.5, l2: float = 1e-3):
        self.index: dict[str, int] = {"?": 0}
        rows = [[self._ids(w, True) for w in words] for words, _ in table]
        size = max(len(x) for x in rows)
        S, D = len(rows), len(features("x")) + 2
        X = np.zeros((S, size, D), np.int64)
        Y = np.zeros((S, size), np.int64)
        mask = np.zeros((S, size), bool)
        for i, (ids, (_, labels)) in enumerate(zip(rows, table)):
            n = len(ids)
            X[i, :n], Y[i, :n], mask[i, :n] = self._with_neighbours(ids), [LABELS.index(y) for y in labels], True
        self.w, self.t = np.zeros((len(self.index), _L)), np.zeros((_L, _L))
        start = np.where([y.startswith("I-") for y in LABELS], -1e9, 0.0)
        seen_t = np.zeros_like(self.t)
        cells = X[mask]

        def gather(p: np.ndarray) -> np.ndarray:
            """Sum of label weights p over the words that have each feature."""
            return sum(np.stack([np.bincount(c, p[:, y], len(self.index)) for y in range(_L)], axis=1) for c in cells.T)

        seen_w = gather(np.eye(_L)[Y[mask]])
        pair = mask[:, 1:]
        np.add.at(seen_t, (Y[:, :-1][pair], Y[:, 1:][pair]), 1)
        gw, gt = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(steps):  # Adagrad on the log-likelihood; expectations by scaled forward-backward passes
            E = self.w[X].sum(axis=2)
            P = np.where(mask[..., None], np.exp(E - E.max(axis=2, keepdims=True)), 1.0)
            M = np.where(ALLOWED, np.exp(self.t), 0.0)
            A, B, c = np.zeros((S, size, _L)), np.ones((S, size, _L)), np.ones((S, size))
            A[:, 0] = P[:, 0] * np.exp(start)
            for k in range(size):
                if k:
                    A[:, k] = np.where(mask[:, k, None], (A[:, k - 1] @ M) * P[:, k], A[:, k - 1])
                c[:, k] = A[:, k].sum(axis=1)
                A[:, k] /= c[:, k, None]
            for k in range(size - 2, -1, -1):
                B[:, k] = np.where(mask[:, k + 1, None], ((P[:, k + 1] * B[:, k + 1]) @ M.T) / c[:, k + 1, None], 1.0)
            exp_w = gather((A * B)[mask])
            after = (P * B / c[..., None])[:, 1:][pair]
            exp_t = (A[:, :-1][pair].T @ after) * M
            for weights, grad, hist in ((self.w, seen_w - exp_w, gw), (self.t, seen_t - exp_t, gt)):
                grad = grad / S - l2 * weights
                hist += grad**2
                weights += rate * grad / np.sqrt(hist)
        self.t = np.where(ALLOWED, self.t, -1e9)
        self.start = start
        self.cache: dict[str, list[int]] = {}

    def _ids(self, word: str, learn: bool = False) -> list[int]:
        if learn:
            return [self.index.setdefault(f"{k}={f}", len(self.index)) for k, f in enumerate(features(word))] + [
                self.index.setdefault(f"{side}={shape(word)}", len(self.index)) for side in ("prev", "next")]
        ids = self.cache.get(word)
        if ids is None:
            own = features(word)
            ids = [self.index.get(f"{k}={f}", 0) for k, f in enumerate(own)] + [self.index.get(f"{side}={own[0]}", 0) for side in ("prev", "next")]
            if len(word) <= CACHED_CHARS:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    @staticmethod
    def _with_neighbours(ids: list[list[int]]) -> np.ndarray:
        """Own features, the shape of the word before and of the word after (0: none)."""
        a = np.asarray(ids)
        out = a.copy()
        out[:, -2], out[:, -1] = 0, 0
        out[1:, -2], out[:-1, -1] = a[:-1, -2], a[1:, -1]
        return out

    def decode(self, runs: list[tuple[str, list[str], str]]) -> list[np.ndarray]:
        """Best labels of runs of words, each with the word before and after it (fixed to O, may be empty)."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        by_size: dict[int, list[int]] = {}
        for i, (_, words, _) in enumerate(runs):
            by_size.setdefault(len(words), []).append(i)
        for size, members in by_size.items():
            for part in (members[k: k + 2048] for k in range(0, len(members), 2048)):
                X = np.stack([self._with_neighbours([self._ids(w) for w in (runs[i][0], *runs[i][1], runs[i][2])])[1:-1] for i in part])
                E = self.w[X].sum(axis=2)
                score, back = E[:, 0] + np.maximum(self.start, self.t[0]), []
                for k in range(1, size):
                    x = score[:, :, None] + self.t
                    back.append(x.argmax(axis=1).astype(np.int8))
                    score = x.max(axis=1) + E[:, k]
                last = (score + self.t[:, 0]).argmax(axis=1)
                path = [last]
                for b in reversed(back):
                    path.append(b[np.arange(len(part)), path[-1]].astype(np.int64))
                for i, labels in zip(part, np.stack(path[::-1], axis=1)):
                    out[i] = labels
        return out


def fit(table=None) -> CRF:
    return CRF(labelled_table() if table is None else table)


_MARKED = np.zeros(256, bool)
_MARKED[48:58] = True
_MARKED[64] = True


def crf_spans(buf: np.ndarray, off: np.ndarray, model: CRF) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points, per document of a byte buffer."""
    start, end, n = word_spans(buf, off)
    marked = np.concatenate([[0], np.cumsum(_MARKED[buf])])
    cand = marked[end] > marked[start]
    size = end - start
    raw = buf.tobytes()
    word = lambda i: raw[start[i]: end[i]].decode("utf-8", "replace")
    doc = np.repeat(np.arange(len(off) - 1), n)
    spelled = np.zeros(len(off) - 1, bool)  # documents that spell an address out: there plain joiners are candidates too
    for m in _SPELLED.finditer(raw):
        d = int(np.searchsorted(off, m.start(), side="right")) - 1
        spelled[d] |= m.end() <= off[d + 1]
    for i in np.flatnonzero(~cand & (size >= 2) & spelled[doc]) if spelled.any() else []:
        cand[i] = is_candidate(word(i))
    at = np.flatnonzero(cand)
    spans: list[list] = [[] for _ in range(len(off) - 1)]
    if not len(at):
        return spans
    # a spelled-out address has plain words around its joiners: they join the run, as far as dots follow
    grown = cand.copy()
    past = np.cumsum(n)
    core = lambda i: word(i).strip(_TRIM).lower()
    for i in at[spelled[doc[at]]]:
        if core(i) not in _AT:
            continue
        hi = int(past[doc[i]])
        lo = hi - int(n[doc[i]])
        j = i + 1
        grown[j: min(j + 1, hi)] = True
        while j + 1 < hi and core(j + 1) in _DOT:
            grown[j + 1: min(j + 3, hi)] = True
            j += 2
        j = i - 1
        grown[max(j, lo): j + 1] = True
        while j - 1 >= lo and core(j - 1) in _DOT:
            grown[max(j - 2, lo): j] = True
            j -= 2
    at = np.flatnonzero(grown)
    runs = np.split(at, np.flatnonzero((np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])) + 1)
    asked = []
    for r in runs:
        a, b = int(r[0]) - 1, int(r[-1]) + 1
        asked.append((word(a) if a >= 0 and doc[a] == doc[r[0]] else "", [word(i) for i in r], word(b) if b < len(doc) and doc[b] == doc[r[0]] else ""))
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    for r, labels in zip(runs, model.decode(asked)):
        k = 0
        while k < len(r):
            if labels[k] == 0:
                k += 1
                continue
            kind, last = (int(labels[k]) - 1) // 2, k
            while last + 1 < len(r) and LABELS[labels[last + 1]] == "I-" + KINDS[kind]:
                last += 1
            s, e = int(start[r[k]]), int(end[r[last]])
            core = raw[s:e].decode("utf-8", "replace")
            lead, tail = len(core) - len(core.lstrip(_TRIM)), len(core) - len(core.rstrip(_TRIM))
            d = int(doc[r[0]])
            a, z = int(points[s] - points[off[d]]) + lead, int(points[e] - points[off[d]]) - tail
            if z > a:
                spans[d].append((a, kind, z))
            k = last + 1
    return spans


def all_spans(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those others that overlap no earlier one. Sorted merge: what ends furthest among the spans that start
    before a new one's end decides."""
    out, fixed = list(base), sorted((s, e) for s, _, e in base)
    starts, reach = [s for s, _ in fixed], list(accumulate((e for _, e in fixed), max))
    last = 0  # end of the last span taken in
    for s, k, e in sorted(more):
        i = bisect_left(starts, e)
        if last <= s and (i == 0 or reach[i - 1] <= s):
            out.append((s, k, e))
            last = e
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans are merged under the first one's kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, model: CRF, text: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """`keep` (default: all columns) with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (and `redacted`)."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(body):
        buf, off = flat(body)
        counts, digest, joined, added, clean = [[], [], [], []], [], [], [], []
        for i, j in row_blocks(off):
            part, o = buf[off[i]: off[j]], off[i: j + 1] - off[i]
            raw = part.tobytes()
            for d, more in enumerate(crf_spans(part, o, bc.value)):
                t = raw[o[d]: o[d + 1]].decode("utf-8", "replace")
                base = base_spans(t)
                spans = all_spans(base, more) if more else base
                for k in range(N_BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                joined.append(join_spans(spans))
                added.append(len(spans) - len(base))
                if with_text:
                    clean.append(redact(t, spans))
        out = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(joined, pa.string()), pa.array(added, pa.int64())]
        return out + [pa.array(clean, pa.string())] * with_text

    outputs = {f"n_{k}": T.LongType() for k in KINDS[:N_BASE]} | {"base_sha256": T.StringType(), "spans": T.StringType(), "n_added": T.LongType()}
    if with_text:
        outputs["redacted"] = T.StringType()
    return map_batches(docs, {"body": F.col(text).cast("string").cast("binary")}, outputs, run, docs.columns if keep is None else keep)
