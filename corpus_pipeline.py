"""Pipeline over the table of documents.

Each stage works on all rows its predecessor kept, read again from the file they were written to: quality rules drop
documents, line dedup takes repeated runs of lines out of texts, near-dedup keeps the first document of each group,
packing cuts and places what is left. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from tidekeep.llm import queries
from tidekeep.session import materialize


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        queries.ready(spark)
        return work(docs)
    return stage


STAGES = [
    ("quality_rules", _stage(queries.quality_stage)),
    ("line_dedup", _stage(queries.line_stage)),
    ("near_dedup", _stage(queries.near_stage)),
    ("packing", _stage(queries.packed)),
]
#: SQL can't express the ids of the tokenizer; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
