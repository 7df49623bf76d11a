import collections
import random
import re

import numpy as np

from reelrank.llm import rule_ledger as R


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i: i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)]


def test_measures_against_brute_force():
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", "é", "\n", "\n", " ", " ", "#", "\t", "\r", "a b\n", "€"]) for _ in range(r.randint(0, 30))) for _ in range(8000)]
    raw = [t.encode() for t in texts]
    m = R.measure_buffer(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, t in enumerate(texts):
        assert [int(m[k][i]) for k in R.MEASURES[:6]] == brute(t), t


def fails(r, rule):
    return eval(rule.fails, {}, r.asDict())


def test_bits_policies_and_ablations(sample):
    led = R.ledger(sample).cache()
    rows = led.collect()
    for r in rows:
        assert [r[k] for k in R.MEASURES[:6]] == brute(r.text)
        assert r.fail_bits == sum(1 << x.bit for x in R.RULES if fails(r, x))
    loose = R.Policy("loose", 1, R.QUALITY.rules, tolerated=1)
    names = {x.name: x for x in R.RULES}
    for p in (R.BASE, R.QUALITY, R.STRICT, loose):
        kept = {r.doc_id: r.kept for r in R.apply_policy(led, p).collect()}
        count = {r.doc_id: sum(fails(r, names[n]) for n in p.rules) for r in rows}
        assert kept == {d: n <= p.tolerated for d, n in count.items()}
        for a in R.ablations(led, [p]).collect():
            less = {r.doc_id: sum(fails(r, names[n]) for n in p.rules if n != a.rule) for r in rows}
            assert a.failing == sum(fails(r, names[a.rule]) for r in rows)
            assert a.kept == sum(kept.values()) and a.regained == sum(n <= p.tolerated for n in less.values()) - a.kept


def test_edge_rows(edge_docs, no_docs):
    for r in R.ledger(edge_docs).collect():
        assert [r[k] for k in R.MEASURES[:6]] == brute(r.text) and r.fail_bits != "own"
    assert R.ledger(no_docs).count() == 0 and R.ablations(R.ledger(no_docs)).count() == 0


def test_rules_that_alone_reject(sample):
    led = R.ledger(sample)
    loose = R.Policy("loose", 1, R.QUALITY.rules, tolerated=1)
    names = {x.name: x for x in R.RULES}
    for p in (R.QUALITY, R.STRICT, loose):
        for r in led.withColumn("saved_by", R.saved_by(p)).collect():
            failed = [names[n] for n in p.rules if fails(r, names[n])]
            assert r.saved_by == (sum(1 << x.bit for x in failed) if len(failed) == p.tolerated + 1 else 0)
