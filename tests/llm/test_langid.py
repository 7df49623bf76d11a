import numpy as np
from pyspark.sql import functions as F

from reelrank.llm import langid as L
from reelrank.llm.common import CodeTable, crc_mod


def small_model(texts, order=3):
    counts = [{"lang": [], "code": [], "n": []} for _ in range(order + 1)]
    for i, t in enumerate(texts):
        for part, _, pos, lo, hi in L._steps(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])):
            for k, c in enumerate(L._ngrams(part, pos, order, lo, hi)):
                u, n = np.unique(c[c != L._SHORT], return_counts=True)
                counts[k]["lang"] += [i] * len(u)
                counts[k]["code"] += u.tolist()
                counts[k]["n"] += n.tolist()
    return L.PPMModel([f"l{i}" for i in range(len(texts))], [{"lang": np.array(c["lang"]), "code": np.array(c["code"], np.uint64), "n": np.array(c["n"])} for c in counts], order)


def brute_log2(text, history, byte, order=3):
    """log2 P(byte | history) of a single language, by the definition."""
    b = text.encode().translate(bytes(L._FOLD))

    def p(k, s):
        if k < 0:
            return 1 / 256
        ctx = history[len(history) - k:] if k else b""
        follow = [b[i + k] for i in range(len(b) - k) if b[i: i + k] == ctx]
        if not follow:
            return p(k - 1, s)
        n, d = len(follow), len(set(follow))
        if s in follow:
            return follow.count(s) / (n + d)
        return d / (n + d) * p(k - 1, s) / (1 - sum(p(k - 1, x) for x in set(follow)))

    return np.log2(p(min(order, len(history)), byte))


def test_exact_probabilities():
    texts = ["the cat and the hat and the bat", "el gato y la gata y el pato"]
    m = small_model(texts)
    probe = b"the gata z"
    got = m.log2_rows(np.frombuffer(probe, np.uint8), np.arange(len(probe)), 0, len(probe))
    for i, t in enumerate(texts):
        want = [brute_log2(t, probe[max(0, k - 3): k], probe[k]) for k in range(len(probe))]
        assert np.allclose(got[:, i], want, atol=1e-3)


def test_contexts_sum_to_one():
    m = small_model(["the cat and the hat", "el gato y la gata"])
    for ctx in (b"", b"t", b"th", b"the", b"zzz"):
        n = len(ctx) + 1
        buf = np.frombuffer(b"".join(ctx + bytes([s]) for s in range(256)), np.uint8)
        row = m.log2_rows(buf, np.tile(np.arange(n), 256), 0, len(buf))
        assert np.allclose((2.0 ** row[n - 1:: n]).sum(axis=0), 1, atol=1e-4)


def test_code_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**40, 5000, dtype=np.uint64))
    t = CodeTable(keys)
    assert (t.rows(keys) == np.arange(len(keys))).all() and (t.rows(keys + np.uint64(2**50)) == -1).all()


def test_held_out_accuracy_and_no_label_leak(sample):
    held = crc_mod("doc_id", 3) == 1
    model = L.fit(sample.where(~held))
    got = L.identify(sample.withColumn("held", held), model)
    right, n = got.where("held").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    blind = L.identify(sample.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}), model)
    a, b = ({r.doc_id: r.lang_pred for r in x.collect()} for x in (got, blind))
    assert a == b


def test_edge_rows(edge_docs, no_docs, sample):
    model = L.fit(sample)
    got = L.identify(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and set(edge_docs.columns) <= set(got[0].asDict())
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert L.identify(no_docs, model).count() == 0
    empty = L.fit(no_docs)
    assert {r.lang_pred for r in L.identify(edge_docs, empty).collect()} == {"und"}
