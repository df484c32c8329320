"""Thin queries over the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .decontaminate import contaminated
from .embeddings import embedding_groups
from .fill_in_middle import fill_in_middle, restored
from .forced_bpe import bpe_encode_decode
from .licenses import find_licenses
from .lines import line_dedup
from .passages import repeated_passages
from .sentencepiece_bpe import encode_decode
from .simhash import simhash_groups
from .token_counts import token_counts
from .turns import damage, digests, repair
from .warc import archive_pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_read(spark, sf_dir, "documents"), words=1)
    return out.select("doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(_read(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "archive", "place", "rank")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_read(spark, sf_dir, "embeddings"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(_read(spark, sf_dir, "conversations"))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_read(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_embeddings": op10_embeddings,
    "op11_conversations": op11_conversations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_bpe": op13_bpe,
}

#: DuckDB SQL of the queries that SQL can express at the size of whole tables.
ORACLE_SQL: dict[str, str] = {
    "op12_fill_in_middle": r"""
    with units as (
      select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
      from documents),
    picked as (
      select doc_id, t, u, len(u) as n,
        ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 50 then 'plain'
          when ('0x' || substr(h, 25, 8))::bigint % 100 < 80 then 'spm' else 'psm' end as form
      from units),
    cut as (
      select doc_id, t, n, form, coalesce(array_to_string(u[1:least(a, b)], ''), '') as p,
        coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') as m, coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') as s
      from picked)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
      sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
      sha256(t) as restored_sha256
    from cut""",
}
