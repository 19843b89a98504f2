"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.

What a stage stores on its way is deleted when a later stage begins: its output
has been written by then. So the disk holds the scratch of one stage at a time.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import bpe, language, mixing, recompression, simhash
from rankflow.llm.common import parquet_stage
from rankflow.session import release_scratch, scratch_scope

_left = threading.local()       # by stage: what its last run has stored, per thread that runs stages


def _stage(number: int):
    """A stage that releases the scratch of those before it."""
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            made = _left.__dict__.setdefault("made", {})
            for earlier in [n for n in made if n < number]:
                release_scratch(spark, made.pop(earlier))
            with scratch_scope() as new:
                out = fn(spark, docs, sf_dir)
            made.setdefault(number, []).extend(new)
            return out
        return run
    return deco


@_stage(0)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a missing ``lang`` is filled in."""
    found = language.identify(docs, language.fit(docs), prefix="_")
    return found.filter(~F.col("_rejected")).select(
        *[F.coalesce("lang", "_lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


@_stage(1)
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours."""
    return simhash.keep_one(docs)


@_stage(2)
def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; the others keep their text as
    it is, white space included. A document of which nothing is left stays, empty."""
    found = recompression.repeated_substrings(docs, carry=list(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return found.withColumn("text", text).select(
        *[F.col("text") if c == "text" else F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias(c)
          if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


@_stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order: a row each time that a document is taken."""
    return mixing.mix_documents(docs)


@_stage(4)
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_duplicates),
          ("substring_dedup", drop_repeated_substrings), ("mix_sources", mix_sources), ("byte_level_bpe", tokenize)]

ORACLE_SQL = None   # no stage but the mix can be said in SQL; tests/llm has a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The rows of all stages but the last two
    are deleted when the next ones are written; the result reads those of the
    last but one."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with scratch_scope() as written:
            docs = parquet_stage(out, f"pipeline-{name}")
        release_scratch(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
