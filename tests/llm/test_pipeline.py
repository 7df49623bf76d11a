import pytest

import corpus_pipeline as C
from reelrank.llm import pii_crf
from reelrank.llm.common import store, table

from .test_neardup import brute as all_pairs
from .test_packing import _plain, check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in C.STAGES:
        out.append((name, docs, store(stage(spark, docs, SF), name)))
        docs = out[-1][2]
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "personal_data", "packing"]
    assert all(b.columns == a.columns for a, b in list(stages.values())[:-1])


def test_language_id_keeps_clean_documents(stages):
    a, b = (rows(x) for x in stages["language_id"])
    assert all(i in b for i, r in a.items() if r.text and any(c.isalpha() for c in r.text))


def test_one_document_of_each_group(stages):
    a, b = (rows(x) for x in stages["near_dedup"])
    want = {d for d, _, c in all_pairs([(i, r.text) for i, r in sorted(a.items())], 5, 80) if d == c}
    assert set(b) == want and all(b[i] == a[i] for i in b)


def test_decontamination(stages, spark):
    a, b = (rows(x) for x in stages["decontamination"])
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    leaked = {i for i, r in a.items() if any(t in r.text for t in items)}
    assert leaked and not leaked & set(b)
    assert len(a) - len(b) <= len(leaked) + 2 and all(b[i] == a[i] for i in b)


def test_personal_data(stages):
    a, b = (rows(x) for x in stages["personal_data"])
    assert set(a) == set(b)
    for i in a:
        assert not pii_crf.base_spans(b[i].text) and b[i].n_chars == len(b[i].text)
        assert pii_crf.base_spans(a[i].text) or b[i].text == a[i].text or "[" in b[i].text
        assert (b[i].lang, b[i].source) == (a[i].lang, a[i].source)


def test_packing(stages):
    a, b = stages["packing"]
    check(b.collect(), {i: [r.text] for i, r in rows(a).items()}, _plain())


def test_edge_rows(spark, edge_docs, no_docs):
    docs = edge_docs
    for name, stage in C.STAGES:
        out = store(stage(spark, docs, SF), name)
        assert stage(spark, no_docs, SF).count() == 0
        if name != "packing":
            assert out.columns == docs.columns and out.where("kept <> 'own'").count() == 0
        if name == "language_id":
            assert out.where("text is null or doc_id = 4").count() == 0
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in out.collect()).count("10") <= 1
        docs = out
    assert docs.count() > 0


def test_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_decisions_hold_for_rows_not_ids(spark, tmp_path):
    """Rows that share an id with another text, or have no id, are judged on their own."""
    r = __import__("random").Random(4)
    prose = [" ".join(f"word{r.randint(0, 4000)}" for _ in range(120)) for _ in range(4)]
    item = " ".join(f"question{r.randint(0, 900)}" for _ in range(30))
    rows = [(5, prose[0]), (9, prose[1]), (9, prose[0] + " end"), (5, prose[2]), (3, prose[2]), (None, prose[1]), (None, prose[3]), (None, prose[3] + " tail"), (7, item + " " + prose[3][:200]), (7, "clean " + prose[3][300:600])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted(((x.doc_id, x.text) for x in C.near_dedup(spark, stored, str(tmp_path)).collect()), key=repr)
    one = [t for i, t in kept if i is None]
    assert len(one) == 1 and one[0].startswith(prose[3])
    assert sorted(((i, t) for i, t in kept if i is not None)) == sorted([(5, prose[0]), (9, prose[1]), (3, prose[2]), (7, rows[8][1]), (7, rows[9][1])])
    clean = C.decontamination(spark, stored, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.text) for x in clean), key=repr) == sorted((x for x in rows if item not in x[1]), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_bound_their_batches(spark, name):
    """Each stage, also one that runs alone, holds its Arrow batches to the pipeline's bound; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    made = [(i, f"The quick brown fox number {i} jumps over the lazy dog, see a{i}@example.org.", "en", "web", 70) for i in range(8)]
    docs, before = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long"), spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        dict(C.STAGES)[name](spark, docs, SF)
        assert int(spark.conf.get(key)) == C.STAGE_BATCH_BYTES < 16 * 1024 * 1024
        spark.conf.set(key, "4096")
        rows = [tuple(r) for r in dict(C.STAGES)["personal_data"](spark, docs, SF).orderBy("doc_id").collect()]
        assert spark.conf.get(key) == "4096" and len(rows) == docs.count()
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
