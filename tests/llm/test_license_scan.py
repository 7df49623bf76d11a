import random
import re

from reelrank.llm import license_scan as L


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())


def brute(text):
    """(license, template) of every template with enough of its shingles in a run as long as the template."""
    w, out = words(text), set()
    for name, kind, t in L.TEMPLATES:
        tw = words(t)
        ts, n = {tuple(tw[j: j + 5]) for j in range(len(tw) - 4)}, len(tw) - 4
        pos = [j for j in range(len(w) - 4) if tuple(w[j: j + 5]) in ts]
        if any(len({tuple(w[q: q + 5]) for q in pos if p <= q < p + n}) >= 0.8 * len(ts) for p in pos):
            out.add((name, kind))
    return out


def test_windows_hold_every_occurrence():
    for n in range(1, 300):
        stride, per = L.windows_for(n)
        assert all(x // stride * stride + stride * per >= x + n for x in range(3 * stride))


def test_bands_guarantee():
    for s in (0.2, 0.35, 0.5, 0.8, 1.0):
        rows, bands = L.bands_for(s)
        assert (1 - s**rows) ** bands <= L.MISS


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        text = [f"w{r.randint(0, 999)}" for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 2)):
            t = r.choice(L.TEMPLATES)[2].split()
            if r.random() < 0.5 and len(t) > 40:  # light edits
                t[len(t) // 2] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = [x.upper() for x in t] if r.random() < 0.3 else t
        rows.append((i, "\n".join([" ".join(text[:50]), " ".join(text[50:])])))
    got = {}
    for x in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, set()).add((x.license, x.template))
        assert x.containment >= L.MIN_CONTAINMENT
    want = {i: b for i, t in rows if (b := brute(t))}
    # a window may be wider than the template: it can only find more
    assert all(b <= got.get(i, set()) for i, b in want.items())
    assert sum(len(v) for v in got.values()) <= 1.05 * sum(len(v) for v in want.values())


def test_edge_rows(edge_docs, no_docs, spark):
    assert L.scan(edge_docs).count() == 0 and L.scan(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License. " * 2), (1, "Released under the MIT License. " * 2)], "doc_id long, text string")
    got = L.scan(twice).collect()
    assert len(got) == 4 and {r.containment for r in got} == {1.0}


def test_inserted_text(spark):
    """Notices with 60 words inserted, at every place and for every template that can spare the shingles this breaks."""
    docs, want = [], {}
    for k, (name, kind, t) in enumerate(L.TEMPLATES):
        w = t.split()
        n = len(words(t)) - 4
        if n - 4 < 0.8 * n or n < 60:
            continue
        for at in (len(w) // 4, len(w) // 2, 2 * len(w) // 3):
            i = len(docs)
            docs.append((i, " ".join([f"a{j}" for j in range(70)] + w[:at] + [f"in{j}" for j in range(60)] + w[at:] + [f"z{j}" for j in range(70)])))
            want[i] = (name, kind)
    got = L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(want) >= 12 and {(r.doc_id, r.license, r.template) for r in got} >= {(i, *x) for i, x in want.items()}
    texts = dict(docs)
    for r in got:
        if (r.license, r.template) == want[r.doc_id]:
            span = texts[r.doc_id].lower()[r.start: r.end]
            own = [t for a, b, t in L.TEMPLATES if (a, b) == want[r.doc_id]][0]
            shingles = lambda x: {tuple(words(x)[j: j + 5]) for j in range(len(words(x)) - 4)}
            assert {tuple(words(span)[:5]), tuple(words(span)[-5:])} <= shingles(own)
            assert r.containment == len(shingles(span) & shingles(own)) / len(shingles(own)) >= 0.8


def test_widened_spans_against_brute_force():
    import numpy as np

    r = random.Random(9)
    for _ in range(400):
        own = np.arange(10, 10 + r.randint(5, 12), dtype=np.uint64)
        doc = np.array([r.choice([0, 0, *own.tolist()]) for _ in range(r.randint(0, 60))], np.uint64)
        size, taken = r.randint(1, 4), [[20, 30, 1.0]] if r.random() < 0.3 else []
        lone = sorted(r.sample(range(60), 3))
        chains, last = [], None
        for i, x in enumerate(doc.tolist()):
            if x and not any(s <= i <= e - L.SHINGLE for s, e, _ in taken):
                chains = chains + [[i]] if last is None or i - last - L.SHINGLE > size else chains[:-1] + [chains[-1] + [i]]
                last = i
        want = [[c[0], c[-1] + L.SHINGLE, len({int(doc[i]) for i in c}) / len(own)] for c in chains
                if len({int(doc[i]) for i in c}) >= 0.8 * len(own) and any(c[0] <= x + 2 and x <= c[-1] for x in lone)]
        assert L.widened(doc, 0, len(doc), own, size, 0.8, taken, [(x, x + 2) for x in lone]) == want


def test_two_intact_notices_stay_two_matches(spark):
    t = L.TEMPLATES[2][2]
    got = L.scan(spark.createDataFrame([(1, t + " " + " ".join(f"m{i}" for i in range(400)) + " " + t)], "doc_id long, text string")).collect()
    assert [r.containment for r in got if r.template == "permission" and r.license == "MIT"] == [1.0, 1.0]
