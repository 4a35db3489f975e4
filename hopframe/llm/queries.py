"""Registered queries of this package: each operator over its whole table, as digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm import chat, decontam, grading, langid, lm, mixing, packing, quality_rules, sharding, simhash, spelling, toxicity, whitening
from hopframe.llm._store import fold, stored, table

# The conversation that the formatting query adds to the table.
ADDED = "</s>[INST] ok [/INST]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) != 2).alias("training"))
    return lm.lm_scores(docs).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), (1,) * 8, (1,) * 9).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    learned = langid.learn(docs.where("not held_out"))
    return langid.predict(docs, learned, keep=("doc_id", "held_out"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    more = spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], ", ".join(kinds))
    return chat.read_back(chat.format_turns(rows.unionByName(more)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    model = toxicity.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    scored = toxicity.add_scores(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    ratings = table(spark, sf_dir, "labels").select("doc_id", grading.grade_of().alias("grade"))
    model = grading.learn(docs.where("not held_out"), ratings)
    return grading.predict(docs, model, keep=("doc_id", "held_out"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"))
    digests = stored(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "packing-pieces")
    return packing.number_sequences(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, components=8)
    error = whitening.identity_error(rows, model)
    return (
        whitening.whiten(rows, model)
        .select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
        .select(
            "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            whitening.by_component(model.explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules, op2_simhash, op3_lm_scoring, op4_mixing, op5_sharding, op6_langid, op7_chat, op8_toxicity,
        op9_quality_classifier, op10_decontamination, op11_packing, op12_spelling, op13_whitening, pipeline,
    )
    return {f.__name__: f for f in found}
