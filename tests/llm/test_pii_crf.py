import random
import re

import pytest
from pyspark.sql import functions as F

from reelrank.llm import pii_crf as P


@pytest.fixture(scope="module")
def model():
    return P.fit()


def brute(t):
    """The fixed patterns, as plain regular expressions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(40_000):
        s = "".join(r.choice("12 5.-+@a_%()9é") for _ in range(r.randint(0, 40)))
        assert brute(s) == P.base_spans(s), s
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_base_spans_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "a@" * 200_000, "1 " * 200_000):
        P.base_spans(t)


def test_crf_held_out(model):
    held = P.labelled_table(300, seed=5)
    got = model.decode([("", w, "") for w, _ in held])
    right = sum(P.LABELS[a] == y for (_, labels), g in zip(held, got) for a, y in zip(g, labels))
    assert right >= 0.98 * sum(len(w) for w, _ in held)


def test_viterbi_is_the_best_path(model):
    import itertools

    import numpy as np

    words = ["token", "=", '"9233A8ECF7C5B09FE5949719B6B82BC439E9329B"']
    X = model._with_neighbours([model._ids(w) for w in ["", *words, ""]])[1:-1]
    E = model.w[X].sum(axis=1)
    score = lambda p: max(model.start[p[0]], model.t[0, p[0]]) + sum(E[i, y] for i, y in enumerate(p)) + sum(model.t[a, b] for a, b in zip(p, p[1:])) + model.t[p[-1], 0]
    best = max(itertools.product(range(len(P.LABELS)), repeat=3), key=score)
    assert np.array_equal(model.decode([("", words, "")])[0], best)


def test_added_spans(spark, model):
    texts = ["call (017) 555-7713 now", 'the token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" here', "of 7536784127813050 4845168114407329 end",
             "in 1999 there were 42 of 300,000 things at 12:30", "write to ann_re (at) mail7 (dot) example (dot) org soon", "nothing here at all, of the and"]
    rows = {r.doc_id: r for r in P.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, with_text=True).collect()}
    kinds = {i: [x.split(":")[0] for x in r.spans.split(",") if x] for i, r in rows.items()}
    assert kinds[0] == ["phone"] and kinds[1] == ["secret"] and kinds[2] == ["card", "card"] and kinds[3] == [] and kinds[4] == ["email"] and kinds[5] == []
    assert rows[5].redacted == texts[5] and "9233" not in rows[1].redacted


def test_documents(sample, model):
    import hashlib

    rows = P.find_pii(sample, model, with_text=True).collect()
    assert sum(r.n_email for r in rows) > 0
    for r in rows:
        base = brute(r.text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(P.join_spans(base).encode()).hexdigest()
        assert set(P.join_spans(base).split(",")) - {""} <= set(r.spans.split(","))
        assert not P.base_spans(r.redacted)


def test_edge_rows(edge_docs, no_docs, model):
    got = P.find_pii(edge_docs, model, with_text=True).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert r.spans != "own" and (r.text is not None or r.spans == "" and r.redacted == "")
        if r.doc_id == 13:
            assert [x.split(":")[0] for x in r.spans.split(",")] == ["email", "phone", "ip", "card"]
            assert r.redacted == "mail me at [EMAIL] or [PHONE] from [IP], card [CARD]"
    assert P.find_pii(no_docs, model).count() == 0


def test_spans_merge_in_linear_time_and_as_by_pairs():
    import random
    import time

    r = random.Random(2)
    for _ in range(300):
        make = lambda n: [(a, r.randint(0, 3), a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(n))]
        base, more = make(r.randint(0, 6)), make(r.randint(0, 9))
        want, taken = list(base), [(s, e) for s, _, e in base]
        for s, k, e in sorted(more):
            if all(e <= a or s >= b for a, b in taken):
                want.append((s, k, e)), taken.append((s, e))
        assert P.all_spans(base, more) == sorted(want)
    started = time.time()
    assert len(P.all_spans([(10 * i, 0, 10 * i + 4) for i in range(100_000)], [(10 * i + 5, 1, 10 * i + 8) for i in range(100_000)])) == 200_000
    assert time.time() - started < 5


def buffer(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_spelled_out_addresses_of_any_length(model):
    for hosts in (2, 3, 4, 9, 40):
        name = "ann_re (at) " + " (dot) ".join(["mail7"] + ["example"] * (hosts - 2) + ["com"])
        text = f"write to {name} soon and stay"
        got = P.crf_spans(*buffer([text]), model)[0]
        assert [(text[s:e], k) for s, k, e in got] == [(name, 0)], hosts
    text = "name (at) a (dot) b (dot) c (dot) com now"
    assert P.redact(text, P.crf_spans(*buffer([text]), model)[0]).split()[-2:] == ["[EMAIL]", "now"]


def test_spans_of_a_document_do_not_depend_on_its_neighbours(model):
    r = random.Random(8)
    pool = ["at", "dot", "(at)", "[AT]", "(dot)", "call", "555-123-4567", "mail7", "x", "a@b.cd", "1999", "token", "=", "“(at)”", "com,", "(a", "t)"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(600)]
    together = P.crf_spans(*buffer(texts), model)
    assert together == [P.crf_spans(*buffer([t]), model)[0] for t in texts]


def test_the_shape_reads_the_whole_word(model):
    import time

    long = "a" * 200
    assert P.shape(long + "9") != P.shape(long) and P.shape("f0" * 64) == "hex" and P.shape("f0" * 64 + "z") != "hex"
    started = time.time()
    P.crf_spans(*buffer(["1a" * 300_000 + " " + "(at) x (dot) " * 20_000 + "end"]), model)
    assert time.time() - started < 20
