"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run()
writes each result as a Parquet table in the shared folder and rereads it, so a stage starts
from files that survive a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import decontam, packing, quality, secret_scan, simhash
from spanweave.llm.common import staged, table

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontam.stage),
    ("secrets", secret_scan.stage),
    ("packing", packing.stage),
]

#: SQL can't express the fitted models, the edit distances and the tokenizer.  The near-duplicate
#: and decontamination stages are tested against brute-force versions, masking against known
#: secrets, packing against the tokenizer's own ids, quality against labels; the whole run has
#: no independent version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
