"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated strings go, the rest is packed.

Counts as part of ``obsidia.llm``. Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
Null texts count as empty and stay null, documents without an id are told apart by their texts, an empty table stays
empty, and other columns of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidia.llm import minhash, packing, suffix_dedup, toxicity
from obsidia.llm._common import written

#: SQL cannot express the classifier; tests compare each other stage with a brute-force version of its rows.
ORACLE_SQL = None

#: Bytes of a string that goes when it repeats: about 45 words, so that a passage of over 50 words is caught.
REPEAT_BYTES = 240


def _numbered(docs: DataFrame) -> DataFrame:
    """``_id``, the document's or, where it has none, one made from its text; ``_key``, a hash of the text.

    Made ids are beyond 2**62, so documents that have ids come first. Rows alike in both are one document.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    made = F.lit(1 << 62).bitwiseOR(key.bitwiseAND(F.lit((1 << 62) - 1)))
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), made), "_key": key})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, gives less than one half."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return toxicity.score(docs, model).where("toxicity < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five-word shingles, similarity 0.8).

    Of rows that repeat an id and its text one stays; documents without words stay; so does one of each group whose
    documents all lack an id.
    """
    rows = _numbered(docs)
    kept = minhash.near_duplicates(rows.select("_id", "text"), id_col="_id").where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    once = Window.partitionBy("_id", "_key").orderBy("_id", "_key")
    return rows.join(kept.distinct(), ["_id", "_key"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of ``REPEAT_BYTES`` that start twice; ``n_chars`` follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    rows = _numbered(docs).withColumn("_none", F.col("text").isNull())
    cut = suffix_dedup.remove_repeats(rows, REPEAT_BYTES, id_col="_id", as_text=True, carry=[*rest, "_none"])
    text, n_chars = F.when(~F.col("carried._none"), F.col("kept")), F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("carried.n_chars"))
    kinds = {f.name: f.dataType for f in docs.schema}
    return cut.select([text.alias(c) if c == "text" else n_chars.cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, mixed by source."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_copies), ("suffix_array", cut_repeats), ("packing", pack_rest)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
