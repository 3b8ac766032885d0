"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import embedding_dedup, fingerprints, language_id, merkle, mixing, prefix_trie, sharding, simhash_anchors, suffix_dedup, toxicity, warc_zip
from jobtide.llm.byte_bpe import Vocabulary
from jobtide.llm.common import fold, staged, staging_path, table
from jobtide.llm.word_bpe import WordVocabulary


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_zip.new_folder(spark)
    archives = warc_zip.archive_pages(table(spark, sf_dir, "pages"), folder)
    return warc_zip.read_archives(archives, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = vocabulary.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchors.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.withColumns({c: fingerprints.as_hex(c) for c in ("fingerprint", "edited_fingerprint")})


def op5_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), "text", F.col("doc_id"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_path(spark, "slots")
    rows, _ = sharding.shard_documents(table(spark, sf_dir, "documents"), folder=folder)
    # The stored map is edited for one more shard; next_shard is where a row goes then.
    edited = sharding.rebalance_stored(spark, folder, shards=9)
    return sharding.placed(rows, edited, "next_shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    field = toxicity.fit(*toxicity.labelled_sample(docs.filter("NOT held_out"), table(spark, sf_dir, "labels")))
    return toxicity.tag(docs, field, "text", F.col("doc_id"), F.col("held_out")).drop("spans")


def op8_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("_tokens").cast("long").alias("n_tokens"), F.col("_source").alias("source_group"), F.col("_lang").alias("lang_group"),
        F.col("_topic").alias("topic"), F.round("_weight", 6).alias("weight"), F.round("_expected", 6).alias("expected"),
        F.col("_copies").alias("copies"),
    )


def op9_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    dictionaries = language_id.learn(docs.filter("NOT held_out"), "text", "lang")
    return language_id.classify(docs, "text", dictionaries, F.col("doc_id"), F.col("held_out"))


def op11_path_copying(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.document_manifest(table(spark, sf_dir, "documents"))
    root = F.lit(manifest.root).cast("string")
    return manifest.versions().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(prefix_trie.lent_beginnings(turns))


def op13_pair_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = WordVocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    return vocabulary.encode(table(spark, sf_dir, "documents"), "text", F.col("doc_id"), decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_warc_zip": op1_warc_zip,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_simhash_anchors": op3_simhash_anchors,
    "op4_simhash_blocks": op4_simhash_blocks,
    "op5_suffix_sort": op5_suffix_sort,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_toxicity_crf": op7_toxicity_crf,
    "op8_raking": op8_raking,
    "op9_itq_embeddings": op9_itq_embeddings,
    "op10_language_id": op10_language_id,
    "op11_path_copying": op11_path_copying,
    "op12_burst_trie": op12_burst_trie,
    "op13_pair_tree": op13_pair_tree,
}
SQL: dict[str, str] = {"op8_raking": mixing.mixing_sql(), "op11_path_copying": merkle.manifest_sql(), "op12_burst_trie": prefix_trie.trie_sql()}
