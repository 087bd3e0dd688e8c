"""The corpus pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import byte_bpe, common, decontaminate, language, minhash, suffix_array

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the row key ``k``: ids may be null or stand for several texts."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    return docs.withColumn("k", common.row_key("doc_id", "text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the model knows; ``lang`` becomes the prediction where the label is missing.

    Fitted on all labelled documents of the stage's input. ``und`` (null text, or no letter) goes. Without a labelled
    document there is no model: all texts with a letter stay, as ``und``.
    """
    model = language.fit(docs)
    if model is None:
        lettered = docs.filter(F.regexp_like(F.col("text").cast("string"), F.lit(r"\p{L}")))
        return lettered.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "source", "n_chars")
    told = language.predict(docs, model, extra=["text", "lang", "source", "n_chars"])
    return told.filter("lang_pred <> 'und'").select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8) stays: the one with the smallest doc_id.

    Different texts that share an id are documents of their own; so are those with a null id, which come after all others.
    """
    kept = minhash.near_duplicates(docs, words=5, percent=80).filter("first").select("k").distinct()
    return keyed(docs).join(kept, "k", "left_semi").dropDuplicates(["k"]).select(COLUMNS)


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring 400-byte strings out of the texts; documents with nothing left go. ``n_chars`` follows the text."""
    # cuts may fall inside a character: its other bytes go too
    cut = suffix_array.remove_repeats(docs, extra=["lang", "source"], as_text=True).withColumnRenamed("kept", "text")
    return cut.filter("text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    docs = keyed(docs)
    found = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark"), id_col="k").select(F.col("doc_id").alias("k")).distinct()
    return docs.join(found, "k", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, proven by decoding them: (doc_id, lang, source, n_chars, n_tokens, ids, exact)."""
    docs = keyed(docs)
    # rows equal in id and text have one key and the same ids
    both = byte_bpe.decode(byte_bpe.encode(docs, id_col="k")).select(F.col("doc_id").alias("k"), "ids", F.sha2("decoded", 256).alias("d")).dropDuplicates(["k"])
    meta = docs.select("k", "doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("t"))
    return meta.join(both, "k").select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("d") == F.col("t")).alias("exact"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("substrings", remove_substrings),
    ("benchmark", remove_benchmark),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
