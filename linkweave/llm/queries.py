"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, embedding_dedup, html_extract, language_id, merkle, ngram_join, packing, pii, quality, spelling, sql, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_bucket(3) == 1, F.lit(False))
    prototypes = language_id.train(docs.where(~held))
    return language_id.identify(docs, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"), ngram_join.Config(width=4, percent=85))


URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP3_SQL = r"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), u as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(action, rhost, rpath) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best as (
  select u.page_id, u.host, u.path, rhost || rpath as rule, action,
    row_number() over (partition by u.page_id order by length(rhost) desc nulls last, length(rpath) desc) as k
  from u left join rules on (u.host = rhost or u.host like '%.' || rhost) and starts_with(u.path, rpath)
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(action, 'allow') as verdict from best where k = 1
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held = F.coalesce(_bucket(4) == 2, F.lit(False))
    model = toxicity.train(docs, labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).drop("redacted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, quality.fit(docs, trusted))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = {"text": F.translate("text", ASCII_UPPER, ASCII_LOWER)}
    made = merkle.manifest(_table(spark, sf_dir, "documents"), changed=lowered, when=_bucket(3) == 0)
    return made.withColumnRenamed("ordinal", "doc_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = spelling.Config()
    return spelling.variants(spelling.count_words(_table(spark, sf_dir, "documents"), cfg, misspelt=31), cfg)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(_table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLES = {"op3_url_filter": OP3_SQL, "op11_merkle": sql.merkle(), "op12_spelling": sql.SPELLING, "op13_substring_dedup": sql.SUBSTRING}
