"""The queries of the training-data operators, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import language, licenses, line_dedup, media, mixing, ngram_join, phrases, pieces, quality, runs, sharding, suffixes, tokens
from lodestrata.llm.common import WORD, documents
from lodestrata.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), kept.alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), percent=90, size=3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.train(language.sampled_rows(docs, ~held_out, "doc_id", "text", "lang"))
    return language.identify_language(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = pieces.DEFAULT_MODEL) -> DataFrame:
    model = pieces.load_model(model_path)
    coded = pieces.encode_pieces(documents(spark, sf_dir).select("doc_id", "text"), model)
    back = pieces.decode_pieces(coded, model)
    ids = F.col("piece_ids")
    return back.select(
        "doc_id", F.size(ids).cast("long").alias("n_pieces"), pieces.byte_pieces(ids, model).cast("long").alias("n_byte_pieces"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir), share=1.5, weights=(3, 1, 2), most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole documents are shuffled and written; sizes and sums are of the rows that stand in the shards
    placed = sharding.sharded(documents(spark, sf_dir), "doc_id", n_shards=40)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = placed.select("doc_id", (F.length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, sf_dir), length=400)
    # what is left as text too; a character that a stretch cuts in two is replaced there, but not in the digest
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode_media(media.encode_media(documents(spark, sf_dir)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a tenth of the documents, by a hash of their ids, become periodic from some word on
    h, text, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.coalesce("text", F.lit("")), F.size
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        first = g % n(words)
        return F.array_join(runs.with_period(words, first, 1 + F.floor((n(words) - first) / (3 + g % 8))), " ")

    # F.transform binds the words to a name, so that they are made once
    made = F.when((h % 10 == 0) & text.rlike(WORD), F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), periodic)[0]).otherwise(text)
    found = runs.periodic_runs(documents(spark, sf_dir), [F.col("doc_id")], made)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokens.load_model(model_path)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    found = tokens.token_counts(documents(spark, sf_dir), [F.col("doc_id"), size], F.col("text"), model)
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), F.col("text"), F.col("lang"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_license_scan, op4_ngram_join, op5_language_id, op6_sentencepiece, op7_mix_sources, op8_external_shuffle, op9_suffix_dedup, op10_png_media, op11_periodic_runs, op12_token_counts, op13_phrases)}
