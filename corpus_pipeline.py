"""A corpus pipeline: toxicity, near-dedup, suffix-array dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as
the ``docs`` of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.llm.bpe import encode_documents
from reviewlab.llm.mixing import mix_sources
from reviewlab.llm.simhash import near_duplicates
from reviewlab.llm.suffix_dedup import remove_repeats
from reviewlab.llm.toxicity import fit, score_toxicity
from reviewlab.scale import cut_lineage, lookup_join
from reviewlab.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns that stages read or write by name.
NAMED = ("doc_id", "text", "lang", "source", "n_chars")


def own_names(stage: Stage) -> Stage:
    """``stage`` with all further columns of ``docs`` under names of their own, so that none meets one that it makes."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in NAMED else f"_further{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)
    return run


@own_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on their labels, does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep=tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


@own_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, then of the least digest of all columns.

    A missing id is above every other one. Of rows alike in all columns any one is the same.
    """
    keyed = docs.withColumn("_key", row_key(docs))
    groups = cut_lineage(near_duplicates(keyed, "_key"))
    others = cut_lineage(groups.where("_key != component_id").select("_key").distinct())
    again = cut_lineage(groups.where("_key = component_id").groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1"))
    numbered = keyed.withColumn("_row", F.monotonically_increasing_id())
    first = lookup_join(numbered, others, ["_key"], ["_row"], "left_anti")
    marked = lookup_join(first, again, ["_key"], ["_row"], "left")
    one = marked.where("_n > 1").groupBy("_key").agg(*[F.any_value(c).alias(c) for c in docs.columns])
    return marked.where("_n IS NULL").select(*docs.columns).unionByName(one.select(*docs.columns))


def row_key(docs: DataFrame) -> Column:
    """A key of each row that sorts by doc_id, missing ones last, then by an MD5 of all columns."""
    digests = [F.md5(F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))) for c in docs.columns]
    # With its sign turned, a number sorts like its bytes.
    known = F.concat(F.lit("00"), F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-2**63))), 16, "0"))
    return F.unhex(F.concat(F.coalesce(known, F.lit("01")), F.md5(F.concat(*digests))))


@own_names
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which nothing is left go."""
    kept = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    left = remove_repeats(docs, keep=kept).where("n_removed = 0 OR n_removed < n_bytes")
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


@own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and mixed to the weights of their sources."""
    return mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("mixing", mix), ("bpe", encode)]

#: Compression dictionaries, suffix arrays and merges are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
