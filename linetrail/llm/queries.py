"""One query for each operator, over its whole table with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embedding_dedup, exact_dedup, fingerprints, language_id, line_dedup, manifest, mixing, ngram_join, packing, secrets, token_files, url_filter
from .common import lower_az, scratch, table
from .oracles import DIVERGENCE, MERKLE
from .registry import ORACLES, QUERIES, query
from .tokens import token_path

__all__ = ["ORACLES", "QUERIES"]


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, token_path())
    return token_files.read_documents(spark, path)


@query("token_access")
def token_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last token of every document by look-ups in the files of ``op1_token_files``."""
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, token_path())
    n = F.col("n_tokens")
    wanted = token_files.read_documents(spark, path) \
        .select("doc_id", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(n / 2).cast("long"), n - 1))).alias("i"))
    return token_files.read_tokens(spark, path, wanted)


@query("op3_block_naming", """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select doc_id, t, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g""")
def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = secrets.scan(docs, secrets.train(docs))

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(a):
        return F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return spans.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS),
                        F.sha2(joined(of(*secrets.KINDS[:3])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def fold(of: str = "doc_id"):
    """Remainder by 4 of the checksum of an id as text."""
    return F.crc32(F.col(of).cast("string")) % 4


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, fold() != 2)
    return language_id.classify(docs.select("doc_id", "text"), model) \
        .select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_table(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, *model[:2], block_from=model[2]).select("page_id", "host", "path", "rule", "verdict", "score")


MIX_TARGETS = {
    "source": {"src0": 0.08, "src1": 0.05, "src2": 0.05, mixing.OTHER: 0.82},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.14, "es": 0.1, mixing.OTHER: 0.05},
    "topic": {"prose": 0.93, "table": 0.04, "symbols": 0.01, "shouting": 0.02},
}
MIX_SHARE = 0.6


def mix_columns() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_columns(), MIX_TARGETS, MIX_SHARE, shrink=True)


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_tokens", F.translate("cell", "\x1f", "/").alias("cell"), "probability", "kept", "met")


@query("mixing_shares")
def mixing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every value that ``op7_mixing`` rakes to."""
    return mixing.shares(table(spark, sf_dir, "documents"), mix_columns(), MIX_TARGETS, MIX_SHARE, shrink=True)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), token_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query("op6_embedding_dedup")
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_divergence", DIVERGENCE)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edit_audit(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op13_manifest", MERKLE)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
                      manifest.leaf_hash(*(lower_az(F.col(c)) if c == "text" else F.col(c) for c in manifest.LEAF_COLUMNS)))
    rows = manifest.proofs(docs, carry={"tampered": tampered})
    rows = rows.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("levels")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("levels")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
