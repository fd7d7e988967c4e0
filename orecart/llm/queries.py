"""The corpus operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orecart.llm import ann, bpe, langid, lm, minhash, neighbours, packing, toxicity, urls, warc
from orecart.llm.common import Scratch

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "warc").path("archives")
    warc.write_warc(read(spark, sf_dir, "pages"), archives)
    return warc.read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(read(spark, sf_dir, "embeddings"), 0.98)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"), 20)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lm_score": op2_lm_score,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_neighbours": op5_neighbours,
    "op6_ann": op6_ann,
    "op7_minhash": op7_minhash,
    "op8_url_rules": op8_url_rules,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        with p as (select page_id, sha1(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
        o as (select d, n, max(page_id) as first from p where n >= 1000 group by d, n)
        select page_id, n::bigint as payload_bytes, d as payload_digest,
               case when n >= 1000 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> first then first end as refers_to
        from p left join o using (d, n)""",
    "op8_url_rules": f"""
        with r(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
        u as (select page_id,
                     coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                     coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') as path from pages),
        m as (select page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule,
                     arg_max(verdict, length(r.host || r.path)) as verdict
              from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by page_id)
        select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') as verdict from u left join m using (page_id)""",
}
