"""A training-corpus pipeline of five stages over the ``documents`` table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents, and each works on all rows that
its predecessor kept:

1. quality: documents that fail the base rules or a certified cutoff go (labels from sf_dir).
2. near_dedup: of each component of near-duplicates the smallest doc_id stays.
3. decontaminate: documents with a passage of the benchmark go (benchmark from sf_dir).
4. mix: sources are mixed to their target weights; a document appears as often as drawn.
5. shard: every row gets the shard that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.decontaminate import decontaminate
from sievelake.llm.entries import SHARD_BYTES, oracle_sql
from sievelake.llm.minhash import near_duplicates
from sievelake.llm.mixing import mix_sources
from sievelake.llm.quality import keep_good
from sievelake.llm.sharding import assign_shards
from sievelake.llm.store import materialize, release, written

SQL = oracle_sql()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents only: others go, whatever their names, and one that is missing is null."""
    there = {c.lower() for c in docs.columns}
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c) if c in there else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep.

    Null and empty texts fail the base rules and go; a null lang is the stratum 'und'; rows with a
    null doc_id are judged but teach nothing; each of repeated rows is judged; very long texts are
    measured whole; of cutoffs that gain the same the most lenient is used; an empty table gives
    no rows, empty labels certify nothing.
    """
    return keep_good(_as_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one document of each component of near-duplicates (the smallest doc_id, so there are no ties), and all rows without an id or words.

    Null and empty texts and null ids are linked with nothing and stay; all rows of a kept doc_id
    stay, those of another go; very long texts are read whole; an empty table gives no rows.
    """
    docs = _as_documents(docs)
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an occurrence of a benchmark window, whatever their doc_id: each is judged by its own text.

    Null and empty texts have no words and stay; items without an id are searched too; each of
    repeated rows is judged; very long texts are searched whole; an empty table gives no rows, an
    empty benchmark takes none.
    """
    rows = materialize(_as_documents(docs).select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "decontaminate-rows")
    found = decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the target weights of their sources, in a global random order.

    A null source is a source of its own; rows with a null doc_id share one draw, as do rows that
    repeat a doc_id; texts pass unread, null, empty or long; copies are not numbered; an empty
    table gives no rows.
    """
    return mix_sources(_as_documents(docs)).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard; copies of a document share one.

    A null doc_id is one id; null and empty texts have no bytes; rows of one id stay together even
    if they exceed the limit; an empty table gives no rows.
    """
    return assign_shards(_as_documents(docs), SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's rows are written to the shared folder and read again.

    What a stage wrote for itself, and the rows it read, go once its own rows are written.
    """
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(begin, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


def _over(name: str, table: str) -> str:
    """The statement of a query, over another table of documents."""
    return re.sub(r"\bdocuments\b", table, SQL[name])


#: The same stages in DuckDB, from the statements of their operators.
ORACLE_SQL: str | None = f"""
WITH s1 AS MATERIALIZED (SELECT documents.* FROM documents JOIN ({SQL["op2_quality_rules"]}) q USING (doc_id) WHERE q.kept),
s2 AS MATERIALIZED (SELECT s1.* FROM s1 JOIN ({_over("op6_minhash_near_dedup", "s1")}) q USING (doc_id) WHERE q.kept),
s3 AS MATERIALIZED (SELECT s2.* FROM s2 JOIN ({_over("op10_decontamination", "s2")}) q USING (doc_id) WHERE NOT q.contaminated),
s4 AS MATERIALIZED (SELECT doc_id, text, lang, source, n_chars FROM ({_over("op7_source_mixing", "s3")}))
SELECT * FROM ({_over("op9_extendible_sharding", "s4")})
"""
