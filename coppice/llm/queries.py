"""Queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import conversations, decontaminate, fingerprints, language, licenses, line_dedup, manifest, mixing, setsketch, sharding, url_filter
from coppice.llm.jaccard_join import jaccard_components
from coppice.llm.token_files import read_tokens, write_tokens
from coppice.plans.materialize import scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path, with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, by text models fitted to a bounded sample of documents of known language."""
    return language.identify_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), sharding.layout(40))


#: The rules to judge by.
RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages are those whose path names a labelled document; bad: of low quality or toxic."""
    pages = read(spark, sf_dir, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    named = pages.select(host.alias("host"), F.regexp_extract(path, "^/[a-z]+/([0-9]{1,18})", 1).alias("n"))
    named = named.where("n != ''").select("host", F.col("n").cast("long").alias("doc_id"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter.judge(pages, named.join(labels, "doc_id").select("host", "bad"), RULES)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language; of each row whose crc32 of the id is a multiple of 7 a copy with one character more is checked."""
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return manifest.manifest(read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": more})


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), every=rows)


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_manifest": op11_manifest,
    "op12_conversations": op12_conversations,
    "op13_setsketch": op13_setsketch,
}
