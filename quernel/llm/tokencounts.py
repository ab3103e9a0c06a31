"""Token counts by source, language and tokenizer version, maintained by signed changes.

A rollup is a folder of batches. A batch holds what it adds to the totals, a row for each group: documents and
tokens, either of which may be negative. Totals are the sums over all batches, so inserts, deletes and revised counts
never read the documents that came before. A batch is written under a name of its own and moved to its place when it
is whole; a batch whose place is taken was committed before, and committing it again changes nothing.

Compaction sums batches into a snapshot that also lists their names, so that they stay known. It first claims the next
snapshot's number by a file that only one can create; it then lists the batches once, and the sums and the names are of exactly
those. What lands later is the next one's. Batches that a snapshot holds are skipped by all readers; they are removed by the
compaction after it, once it has read that snapshot back, so that whoever listed them before can still read them.

Tokenizer versions are regular expressions, counted by DataFrame functions, and the byte-level BPE of a vocabulary file.

Edge cases. A null text is the empty text and has no tokens; texts of any length count whole; null sources and languages are
groups of their own; repeated documents count each time; groups whose documents and tokens come to nothing leave the totals; an
empty batch is a batch, and an empty table gives empty totals. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import remove

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"
#: Seconds after which a claim whose compaction never ended may be taken over.
STALE = 6 * 3600
#: Tokenizers that need no vocabulary: what each version takes as a token.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}


#: The version that a vocabulary file counts.
BPE = "byte-bpe-50k"


def tokens(text: Column, tokenizer: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[tokenizer]), F.lit(0))).cast("bigint")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes for new documents: rows of KEYS and n_tokens."""
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("n_tokens").cast("bigint").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes for documents that go: rows of KEYS and the n_tokens that were counted."""
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("d_docs"), (-F.col("n_tokens")).cast("bigint").alias("d_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes for documents counted anew: rows of KEYS, old_tokens and n_tokens."""
    return counts.select(*KEYS, F.lit(0).cast("bigint").alias("d_docs"), (F.col("n_tokens") - F.col("old_tokens")).cast("bigint").alias("d_tokens"))


class Rollup:
    """The totals that live below `path`, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/batches"))
        self._fs.mkdirs(self._path(f"{self.path}/snapshots"))

    def _names(self, below: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/{below}")) if not x.getPath().getName().startswith("."))

    def _snapshot(self) -> int:
        """The newest snapshot's number; 0 if there is none."""
        return max((int(n) for n in self._names("snapshots") if n.isdigit()), default=0)

    def _at(self, number: int) -> str:
        return f"{self.path}/snapshots/{number:08d}"

    def _held(self, number: int, names: list[str]) -> set[str]:
        """Those of the names that a snapshot holds."""
        if not number or not names:
            return set()
        listed = self.spark.createDataFrame([(n,) for n in names], "name string")
        return {r[0] for r in self.spark.read.schema("name string").parquet(f"{self._at(number)}/names").join(F.broadcast(listed), "name", "left_semi").collect()}

    def _moved(self, staged: str, place: str) -> bool:
        """Moves a whole folder to a place that is free; False, and the folder goes, if another was there first."""
        if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(staged), self._path(place)):
            remove(self.spark, staged)
            return False
        nested = self._path(f"{place}/{staged.rpartition('/')[2]}")
        if self._fs.exists(nested):  # the store moved it into the one that won
            self._fs.delete(nested, True)
            return False
        return True

    def _created(self, path: str) -> bool:
        """Creates an empty file, which only one of many callers achieves."""
        if self._fs.getScheme() == "file":
            return self.spark.sparkContext._jvm.java.io.File(self._path(path).toUri().getPath()).createNewFile()
        try:
            return self._fs.createNewFile(self._path(path))
        except Exception as e:  # stores differ in how they refuse
            if self._fs.exists(self._path(path)):
                return False
            raise e

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch's name is made of letters, digits, _ and -")
        place = f"{self.path}/batches/{batch}"
        if self._fs.exists(self._path(place)) or self._held(self._snapshot(), [batch]):
            return False
        staged = f"{self.path}/.staged-{batch}-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(staged)
        # where two commits of a batch race, one move finds the place taken: the other's content is the same
        return self._moved(staged, place)

    def _sums(self, number: int, batches: list[str]) -> DataFrame:
        """Totals of a snapshot and of batches that it doesn't hold."""
        paths = [f"{self.path}/batches/{b}" for b in batches] + ([f"{self._at(number)}/totals"] if number else [])
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs != 0 or d_tokens != 0")

    def _fresh(self, number: int) -> list[str]:
        listed = self._names("batches")
        held = self._held(number, listed)
        return [b for b in listed if b not in held]

    def totals(self) -> DataFrame:
        number = self._snapshot()
        return self._sums(number, self._fresh(number)).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})

    def compact(self) -> bool:
        """Sums all batches into a snapshot; False if another compaction is at work."""
        base = self._snapshot()
        claim = f"{self.path}/snapshots/.claim-{base + 1:08d}"
        if not self._created(claim):
            if self._fs.exists(self._path(claim)) and time.time() - self._fs.getFileStatus(self._path(claim)).getModificationTime() / 1000 < STALE:
                return False
            remove(self.spark, claim)
            if not self._created(claim):
                return False
        try:
            if self._snapshot() != base:  # another ended between the look and the claim
                return False
            listed = self._names("batches")
            held = self._held(base, listed)
            fresh = [b for b in listed if b not in held]
            staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
            self._sums(base, fresh).write.parquet(f"{staged}/totals")
            names = self.spark.createDataFrame([(b,) for b in fresh], "name string")
            if base:
                names = names.unionByName(self.spark.read.schema("name string").parquet(f"{self._at(base)}/names"))
            names.write.parquet(f"{staged}/names")
            done = self._moved(staged, self._at(base + 1))
        finally:
            remove(self.spark, claim)
        # what the snapshot before this one holds was read back from it just now
        for b in sorted(held) if done else ():
            remove(self.spark, f"{self.path}/batches/{b}")
        for number in range(1, base):
            remove(self.spark, self._at(number))
        return done


def counted(docs: DataFrame, tokenizer: str, text: str = "text", source: str = "source", lang: str = "lang", kept: tuple[str, ...] = ()) -> DataFrame:
    """A row of KEYS and n_tokens for each document, and columns that are `kept`."""
    return docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens(F.col(text), tokenizer).alias("n_tokens"), *kept)


def all_counts(docs: DataFrame, vocabulary: str, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(source, lang, and a column of counts for each of TOKENIZERS and for BPE) of each document, in one pass over the texts."""
    own = docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"), *[tokens(F.col(text), t).alias(t) for t in TOKENIZERS])
    return bpe.count(own, vocabulary, "_text", BPE).drop("_text")


def rows(counts: DataFrame, tokenizer: str, n_tokens: str, old_tokens: str | None = None) -> DataFrame:
    """Rows of KEYS, n_tokens and old_tokens from columns of `all_counts`."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{n_tokens}`").alias("n_tokens"), F.col(f"`{old_tokens or n_tokens}`").alias("old_tokens"))
