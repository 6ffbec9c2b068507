"""One query per operator of this package, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, classlm, decontam, divergence, language, licenses, mixing, neardup, pii, quality, spelling, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    """The words that a mix with weights 3, 1, 2 takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark, sf_dir):
    """The language of every text, learned from the rows that are not held out."""
    held_out = language.remainder(3) == 1
    rows = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return language.identify(rows, learn_from=~held_out, keep=("doc_id", "held_out"))


def op3_near_duplicates(spark, sf_dir):
    """Components of documents whose sets of 3-word shingles are 85 % alike."""
    return neardup.cluster(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_personal_data(spark, sf_dir):
    """Personal data in plain sight and disguised, as spans of the source text."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    """License phrases and notices found by diagonal voting."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_nearest(spark, sf_dir):
    """The 20 nearest vectors of every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = ann.search(vectors, vectors.filter("id % 20 = 0"))
    return found.select("query_id", "rank", "vec_id", "score")


def op7_class_bigrams(spark, sf_dir):
    """Log10 probability of every text by single tokens and by the class-based model, learned from nine tenths."""
    held_out = language.remainder(10) == 0
    rows = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return classlm.score(rows, learn_from=~held_out, keep=("doc_id", "held_out"))


def op8_edited_token_counts(spark, sf_dir):
    """Token counts of every text, and again after four edits: words put in, taken out, replaced and added at the end."""
    n = F.char_length("text")
    put = lambda start, stop, text: F.struct(start.alias("start"), stop.alias("stop"), text.alias("text"))
    fifth = (n / 5).cast("int")
    edits = F.array(
        put(fifth, fifth, F.lit(" as noted,")),
        put(fifth * 2, fifth * 2 + 12, F.lit("")),
        put(fifth * 3, fifth * 3 + 4, F.upper(F.substring("text", 1, 9))),
        put(n + 99, n + 99, F.lit("\nSee above.")),
    )
    built = tokens.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    built = built.withColumn("edits", edits).withColumn("tokens_before", F.col("n_tokens")).withColumn("chars_before", n)
    after = tokens.edit(built)
    return after.select(
        "doc_id",
        F.col("tokens_before").alias("n_tokens"),
        F.coalesce("chars_before", F.lit(0)).alias("n_chars"),
        F.col("n_tokens").alias("n_tokens_edited"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars_edited"),
        "encoded_chars",
    )


def op9_decontaminate(spark, sf_dir):
    """Which documents quote benchmark items, word changes tolerated."""
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))


def op10_prefix_target(spark, sf_dir):
    """Digests of the formatted conversations, read back from the examples: contexts, trained replies, and all turns."""
    planted = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    added = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turns(given.unionByName(added)))


def op11_source_divergence(spark, sf_dir):
    """How far the sources of each language are apart, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    """Words of all texts with the more frequent spelling that each may stand for."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark, sf_dir):
    """The quality of every text, learned from the labelled rows that are not held out."""
    held_out = language.remainder(3) == 1
    rows = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return quality.score(rows, table(spark, sf_dir, "labels"), learn_from=~F.col("held_out"), keep=("doc_id", "held_out"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_license_scan": op5_license_scan,
    "op6_nearest": op6_nearest,
    "op7_class_bigrams": op7_class_bigrams,
    "op8_edited_token_counts": op8_edited_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_prefix_target": op10_prefix_target,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES = {"op1_mix_sources": mixing.SQL, "op9_decontaminate": decontam.SQL, "op10_prefix_target": chat.SQL, "op11_source_divergence": divergence.SQL}
