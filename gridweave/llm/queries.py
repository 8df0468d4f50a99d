"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .centroid_clustering import clusters
from .centroid_clustering import oracle_sql as clusters_sql
from .jaccard_join import near_duplicates
from .jaccard_join import oracle_sql as jaccard_sql
from .license_scan import license_matches
from .license_scan import oracle_sql as license_sql
from .line_dedup import dedup_lines, oracle_ctes
from .mixing import mixed
from .permutation_index import nearest
from .bilstm_crf import KINDS
from .pii import BASE, personal_data
from .quality_gbt import quality_rules
from .quality_qda import quality_scores
from . import simhash_dedup
from .token_alignment import alignments
from .token_output import read_tokens, write_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["phrase"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__gw_lines").alias("n_lines"), F.col("__gw_gone").alias("n_removed"), "text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_table(spark, sf_dir, "documents"))
    of = lambda k: lambda s: s["kind"] == k
    text = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}")

    def listed(spans):
        by_kind = (F.array_sort(F.transform(F.filter(spans, of(k)), lambda s: F.struct(s["start"], s["end"]))) for k in KINDS)
        return F.array_join(F.concat(*(F.transform(a, text(k)) for k, a in zip(KINDS, by_kind, strict=True))), ",")

    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_tokens(spark, write_tokens(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_quality_classifier, op4_line_dedup, op5_mixing, op6_personal_data, op7_jaccard_join, op8_nearest_neighbours, op9_bpe, op10_token_output, op11_simhash_dedup, op12_centroid_clustering, op13_token_alignment)}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op4_line_dedup": f"WITH {oracle_ctes()} SELECT doc_id, n_lines, n_removed, text FROM deduped",
    "op7_jaccard_join": jaccard_sql(),
    "op12_centroid_clustering": clusters_sql(),
}
