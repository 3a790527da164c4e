"""The registered queries of this subpackage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import centroids, chat, decontamination, exact_dedup, html_text, language, manifest, mixing, ngram_join, oracles, quality, rules, sharding, toxicity
from gleaner.llm.common import fold, keep, table

SHARDS = 40


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), keep_text=False)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the labels outside of the held-out third."""
    return quality.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.with_length(html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


#: A conversation whose texts are control strings of a common template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    added = json.dumps({"messages": [{"role": role, "content": CONTROL_TEXT} for role in ("user", "assistant")]})
    records = rows.select("conv_id", record.alias("record")).unionByName(spark.range(1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(added).alias("record")))
    return chat.read_back(chat.format_turns(chat.canonical_turns(records)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep(mixing.numbered(mixing.measured(table(spark, sf_dir, "documents"))))
    mixed = mixing.with_copies(rows, mixing.mix_plan(rows))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(rules.measure(table(spark, sf_dir, "documents")))
    failed = ~rules.passes("base")
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*base, failed.alias("base_failed"), (~failed & rules.passes("v1")).alias("kept"), "fail_bits")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = [sharding.text_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")]
    # Whole rows are placed; size and checksum are taken of the texts that come out.
    placed = sharding.external_shuffle(docs, SHARDS, by=[F.col("doc_id"), *digests])
    return placed.select("doc_id", *digests, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))
    return toxicity.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "expected_severity", "grade")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(fold("doc_id", 5) != 0))
    return language.predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.classes(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, manifest.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = manifest.manifest(docs, presented={"text": tampered})
    proof = F.sha2(manifest.siblings_text(F.col("path")), 256)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_html_text": op2_html_text,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_rules": op5_rules,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_centroids": op11_centroids,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_manifest": op13_manifest,
}
#: DuckDB SQL of those that SQL can express in reasonable time.
ORACLES = {"op3_chat": oracles.CHAT, "op5_rules": oracles.RULES, "op6_decontamination": oracles.DECONTAMINATION, "op7_ngram_join": oracles.NGRAM_JOIN, "op11_centroids": oracles.CENTROIDS, "op12_exact_dedup": oracles.EXACT_DEDUP, "op13_manifest": oracles.MANIFEST}
