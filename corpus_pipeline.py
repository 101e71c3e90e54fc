"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir), and deletes at its begin what the stage before, whose result has been written and
is read as docs, wrote in between; so a process runs one pipeline at a time. Toxic documents go, repeated passages are cut out, one of each
group of near copies stays, documents that hold a benchmark item go, and what is left is packed into
sequences. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import fresh_path, scratch, table
from fathom.llm.decontaminate import clean
from fathom.llm.linededup import dedup_lines
from fathom.llm.packing import pack_texts
from fathom.llm.simhash import near_duplicates
from fathom.llm.toxicity import drop_toxic
from fathom.shared import discard, made


_between: list[int] = [0, 0]


def stage(f: Callable) -> Callable:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_between)
        begin = made()
        out = f(spark, docs, sf_dir)
        _between[:] = begin, made()
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the models, the fingerprints or the tokenizer; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages write in between is deleted at the end."""
    out = fresh_path(spark, "packed")
    _between[:] = made(), made()
    with scratch(spark):
        docs = table(spark, sf_dir, "documents")
        for k, (name, step) in enumerate(STAGES):
            path = out if k == len(STAGES) - 1 else fresh_path(spark, f"stage-{name}")
            step(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        _between[:] = made(), made()
    return docs
