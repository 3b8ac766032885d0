"""Five stages from raw documents to token ids; each works on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import mixing, simhash_anchors, suffix_dedup, toxicity
from jobtide.llm.byte_bpe import Vocabulary
from jobtide.llm.common import fold, staged, table

#: Bytes of the shortest repeated passage that is cut out: about 35 words.
PASSAGE_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the conditional random field doesn't find toxic. It learns from the labelled rows outside the held-out fold."""
    learned = docs.select("doc_id", "text").filter(fold("doc_id", 5) != 0)
    field = toxicity.fit(*toxicity.labelled_sample(learned, table(spark, sf_dir, "labels")))
    tagged = toxicity.tag(docs.select("text", F.struct("*").alias("doc")), field, "text", F.col("doc"))
    return tagged.filter("predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near copies (four-word shingles, four bits): the one with the smallest id."""
    return simhash_anchors.drop_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand anywhere else as well; n_chars follows. Rows of which nothing is left go."""
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    cut = suffix_dedup.cut_passages(docs.withColumns({"_before": F.length("text"), "_blank": blank}), "text", PASSAGE_BYTES)
    n_chars = F.when(F.length("text") != F.col("_before"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.filter(F.col("_blank") | F.col("text").rlike(r"\S")).withColumn("n_chars", n_chars).select(*docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target shares of sources, languages and topics; a row that is drawn several times is repeated."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("doc")))
    drawn = mixed.filter("_sampled").select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return drawn.select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit integers) and whether decoding gives the text back."""
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = vocabulary.round_trip(docs.select("doc_id", "source", "lang", "text"))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "lang", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixture", sample_mixture),
    ("tokens", encode),
]

#: A trained field and suffix sorting are beyond SQL; tests hold near copies and repeats against brute force, toxicity against planted spans only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
