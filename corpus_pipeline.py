"""Corpus pipeline: language ID, near-dedup, decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs; the last returns the packed pieces. Nothing is sampled: a stage
works on every row that its predecessor kept. Empty tables pass through all stages. Null texts go with the first stage (they
have no letter); null, repeated and clashing ids are told apart by row; extra columns travel along whatever their names;
very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.llm import decontam, langid, neardup, packing, pii_crf
from reelrank.llm.common import bounded_batches, discard, store, table
from reelrank.llm.queries import pack_vocabulary

# Below this posterior the language is not settled and the document goes.
MIN_LANGUAGE_SCORE = 0.5
# Upper bound on the Arrow batches of all stages: they share their executors, and what one leaves there the next one finds.
STAGE_BATCH_BYTES = 2 * 1024 * 1024


# A private number of each row of a stage's stored input (the scan's splits are fixed, so it is the same wherever it is read).
ROW = "__row__"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in gone, without the number."""
    return keyed.join(gone.select(ROW).distinct(), ROW, "left_anti").drop(ROW)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language has a posterior below MIN_LANGUAGE_SCORE."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    model = langid.fit(docs)
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the operator's own
    marked = langid.identify(docs.withColumnsRenamed(names), model, text=names["text"])
    kept = marked.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(v).alias(c) for c, v in names.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (five-word shingles, similarity 0.8): the one with the smallest doc_id, ids that are null
    last, the first row where ids are equal. Decisions hold for rows, so rows that share an id or have none are told apart."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    keyed = _keyed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    found = store(neardup.near_duplicates(keyed.select(key.alias("key"), "text"), doc_id="key"), "near_duplicates")
    return _without(keyed, found.where("not kept").select(F.col("doc_id.row").alias(ROW)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that contain a test item of five words or more: shorter ones also stand in clean text."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    keyed = _keyed(docs)
    leaks = store(decontam.find_leaks(keyed.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), short_items=False), "leaks")
    return _without(keyed, leaks.select(F.col("doc_id").alias(ROW)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every personal-data span by its kind; other text and all other columns stay (n_chars is counted anew)."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    found = pii_crf.find_pii(docs.withColumnsRenamed(names), pii_crf.fit(), text=names["text"], with_text=True)
    text = F.when(F.col(names["text"]).isNull(), F.lit(None)).when(F.col("spans") == "", F.col(names["text"])).otherwise(F.col("redacted"))
    new = {"text": text} | ({"n_chars": F.when(F.col("spans") == "", F.col(names["n_chars"])).otherwise(F.length("redacted")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return found.select(*[new.get(c, F.col(names[c])).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens: one row per piece."""
    bounded_batches(spark, STAGE_BATCH_BYTES)
    return packing.pack_documents(docs, pack_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

# PPM code lengths, MinHash, alignment, CRF and tokenizers are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, store(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discard(before)  # all that came of it is stored
    return STAGES[-1][1](spark, docs, sf_dir)
