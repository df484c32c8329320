"""Corpus cleaning in stages; each stage's rows are written and read again.

The stages, in order, and what each decides:

* language ID: documents without a language go (no letters, or words that the
  field spreads over languages with no share of 0.4);
* line dedup: lines that match an earlier line go, and documents of which
  nothing but white space is left with them;
* SimHash near-dedup: one document of each group stays;
* benchmark decontamination: documents that hold a benchmark item go;
* SentencePiece: the ids of what is left, and the texts decoded from them.

Null and empty texts have no letters and go in the first stage, as does a text
without words.  Rows with a null id keep their lines, stay in the two stages
that follow, and are encoded.  Rows that repeat an id count as one document
where rows are compared: they go together.  Of equal documents and lines that
with the smallest id stays, and within a text the first line.  Very long texts
go through whole: the field and the encoder read them in pieces, lines are
compared piece by piece.  Columns other than those of documents are dropped,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid
from tessella.llm._core import save
from tessella.llm.decontaminate import decontaminate
from tessella.llm.lines import line_dedup
from tessella.llm.sentencepiece_bpe import encode_decode
from tessella.llm.simhash import simhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.learn(docs))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs.select(*COLUMNS), words=1)
    left = out.where("removed_lines = 0 or text rlike '[^ \\\\t-\\\\r]'")
    return left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs.select(*COLUMNS))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("simhash_near_dedup", remove_copies),
    ("benchmark_decontamination", remove_leaks),
    ("sentencepiece", encode),
]

#: Hashing, exact encoding and tiling cannot be stated in SQL; the tests hold
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
