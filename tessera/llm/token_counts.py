"""Token counts by source, language and tokenizer version, maintained by deltas.

Every change to a document is a signed row: an insert adds its count, a delete
takes it away, a revision adds the difference.  A batch's rows are summed to
one row for each key and added to a running table of totals; a log entry under
the batch's name then makes the new table the current one.  A batch whose entry
stands is not added again, and one that broke off before its entry left the old
table current.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, file_system, plain_text, shared_dir, table, written
from tessera.llm.tokens import default_path, part_ids

KEYS = ("source", "lang", "tokenizer_version")
LOG = "version long, batch string, totals string"
#: Files of the log beyond which they become one.
COMPACTED = 64
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def with_token_counts(docs: DataFrame, tokenizer: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; null text has none."""
    path = tokenizer or default_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = part_ids(path)
        for texts in batches:
            yield pd.Series([len(cache.ids(t)) // 4 for t in texts], dtype="int64")

    return docs.withColumn(name, count(plain_text()))


def inserts(counts: DataFrame, version: str, count: str = "n_tokens") -> DataFrame:
    """Signed rows of new documents."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(1).alias("n_docs"), F.col(count).alias("n_tokens"))


def deletes(counts: DataFrame, version: str, count: str = "n_tokens") -> DataFrame:
    """Signed rows of documents that go."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(-1).alias("n_docs"), (-F.col(count)).alias("n_tokens"))


def revisions(counts: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Signed rows of documents whose count is corrected."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(0).alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share, and the log of the batches that made them.  One writer at a time.

    The log is a folder of files, one for each commit, that appear by renaming;
    what a lost writer leaves behind is no entry.  Beyond COMPACTED files they
    are put together to one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def files(self) -> list:
        """The log's files, oldest first."""
        fs, at = file_system(self.spark, f"{self.path}/log")
        if not fs.exists(at):
            return []
        return sorted((f.getPath() for f in fs.listStatus(at) if f.isFile() and f.getPath().getName().endswith(".json")), key=lambda p: p.getName())

    def log(self) -> DataFrame:
        """(version, batch, totals) of each commit: the batch's name, and the folder of the totals after it."""
        files = [str(p.toString()) for p in self.files()]
        return self.spark.read.schema(LOG).json(files).distinct() if files else self.spark.createDataFrame([], LOG)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) after the last commit, without keys whose documents are all gone.

        Null is a key like any other; before any commit there are no rows.
        """
        last = self.log().orderBy(F.desc("version")).first()
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{last['totals']}") if last else self.spark.createDataFrame([], TOTALS)

    def put(self, entries: DataFrame, name: str) -> None:
        """``entries`` as one file of the log, there as a whole or not at all; a second writer of the same name fails."""
        aside = f"{self.path}/entry-{uuid.uuid4().hex}"
        entries.coalesce(1).write.json(aside)
        fs, at = file_system(self.spark, aside)
        (made,) = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
        target = file_system(self.spark, f"{self.path}/log/{name}.json")[1]
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(made, target):
            raise FileExistsError(f"another writer has committed {name}")
        fs.delete(at, True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows to the totals, unless it is in them already; whether it was added.

        An empty batch is logged like any other.  The totals before the last
        ones are deleted, so that a reader of the last ones is not disturbed.
        """
        log = self.log()
        if not log.filter(F.col("batch") == batch).isEmpty():
            return False
        past = log.orderBy(F.desc("version")).limit(2).collect()
        both = changes.select(*KEYS, "n_docs", "n_tokens").unionByName(self.totals())
        sums = both.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        name, version = f"totals-{uuid.uuid4().hex}", past[0]["version"] + 1 if past else 1
        sums.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.path}/{name}")
        self.put(self.spark.createDataFrame([(version, batch, name)], LOG), f"{version:012d}")
        if len(past) > 1:
            fs, at = file_system(self.spark, f"{self.path}/{past[1]['totals']}")
            fs.delete(at, True)
        self.compact()
        return True

    def compact(self) -> None:
        """Put the log's files together once there are many; entries that stand twice meanwhile count once."""
        old = self.files()
        if len(old) > COMPACTED:
            self.put(self.log(), f"{old[-1].getName().removesuffix('.json')}-all")
            for at in old:
                file_system(self.spark, at.toString())[0].delete(at, True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all ``documents`` after three commits and a replay.

    Documents arrive with counts guessed from their length; the word BPE's real
    counts revise them; then later copies of a text are deleted, by real counts,
    under both versions.  Null text counts as empty; of equal texts the smallest
    doc_id stays, a null one always, and so do rows that repeat it; an empty
    table gives no rows.
    """
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    guess = F.ceil(F.length(plain_text()) / 4).cast("long")
    counted = with_token_counts(docs.select("doc_id", "source", "lang", plain_text().alias("text"), guess.alias("guess"), F.md5(plain_text()).alias("digest")))
    counts = written(counted.drop("text"), "token-counts")
    first = written(counts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-copies")
    later = written(counts.join(first, "digest").filter("doc_id > first_id").drop("first_id"), "later-copies")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1-arrived", inserts(counts, "guess-4", "guess").unionByName(inserts(counts, "word-bpe-49k", "guess")))
    rollup.commit("2-counted", revisions(counts, "word-bpe-49k", "guess", "n_tokens"))
    rollup.commit("3-copies", deletes(later, "guess-4", "guess").unionByName(deletes(later, "word-bpe-49k", "n_tokens")))
    rollup.commit("2-counted", revisions(counts, "word-bpe-49k", "guess", "n_tokens"))  # delivered twice
    return rollup.totals()
