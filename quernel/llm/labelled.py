"""The labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from, at most: those with the smallest hashes of their ids.
LABELLED = 20_000
#: One part in FOLDS of the ids is held out.
FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS. A null id counts as the empty text's crc32, 0: held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def training(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, limit: int = LABELLED) -> DataFrame:
    """(_id, text, y) of at most `limit` labelled documents that aren't held out. Ids with labels 0 and 1 that contradict
    each other, and null labels, are left out; an id counts once, with the text whose hash is smallest if its rows differ."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("_most")).where("y = _most")
    chosen = known.where(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(limit).select("_id", F.col("y").cast("int").alias("y"))
    # at most `limit` rows of two numbers: small whatever the tables
    found = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).select("_id", "text", "y")
