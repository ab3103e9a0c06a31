"""The training-data pipeline over `documents`: five stages, each of which works on all that its predecessor kept.

1. quality: documents that the gradient-boosted trees reject (score below QUALITY) go.
2. near-duplicates: one document of each group of linked texts stays (five-word shingles, similarity 0.8 or more); where ids
   repeat, each text is a document of its own.
3. decontamination: documents with enough benchmark words inside whole benchmark windows go.
4. secrets: secret spans are replaced by a mark, and n_chars follows the text.
5. tokens: texts are encoded; the text returned is the one that the ids decode to.

Every stage but the last returns the columns of its input. Null texts are empty texts; texts of any length go through whole; rows without a doc_id stay in all
stages unless the first or third rejects their text or the second keeps another such row of their group; empty tables give
empty tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, decontaminate, neardup, quality, secrets
from quernel.llm.common import stored, table
from quernel.llm.queries import tokenizer_path

#: Score below which a document is rejected.
QUALITY = 0.3

#: Trees, signatures and tokens aren't SQL; the stages are tested against plain versions of themselves.
ORACLE_SQL: str | None = None


#: The columns of documents; all others ride along under names that nothing in a stage has.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def guarded(stage: Stage) -> Stage:
    """A stage whose input's extra columns can have any names. Those that have the names of its outputs give way."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = {c: f"__extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(extra), sf_dir)
        gone = [new for old, new in extra.items() if old in out.columns]
        return out.drop(*gone).withColumnsRenamed({new: old for old, new in extra.items() if new not in gone})

    return run


@guarded
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score="_score").where(F.col("_score") >= QUALITY).drop("_score")


@guarded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated_rows(docs)


@guarded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


@guarded
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


@guarded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, tokenizer_path()).drop("text")
    back = bpe.decode(encoded, tokenizer_path(), text="text")
    return back.withColumn("n_tokens", F.size("ids").cast("bigint")).select(*docs.columns, "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
