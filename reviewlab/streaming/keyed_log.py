"""A table of one row per key that grows by micro-batches: merged base, newer epochs, and a manifest.

Each batch writes its rows to a folder of its own, so a repeated batch replaces what it wrote before.
After ``every`` epochs all of them are merged with the base into a new base, in hash parts of the key,
and a manifest file then names it. Readers take the base of the newest manifest and the epochs after it, so
they read one merged table and at most ``every`` small ones, and never half a base. Only epochs before the current
batch are merged: a batch that is repeated finds the table as it was before it. The former base and what it
was merged from stay until the next merge, for readers that are under way.

Nothing is held in a streaming state store; what grows is a table on shared storage.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class KeyedLog:
    """``merge`` turns rows of (key, values.., epoch) into one row (key, values..) per key, and may be applied again."""

    def __init__(self, spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame], DataFrame],
                 every: int = 16, parts: int = 64):
        self.spark, self.path, self.key, self.merge, self.every, self.parts = spark, path, key, merge, every, parts

    # -------------------------------------------------------------- files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, folder: str, prefix: str, done: str | None = "_SUCCESS") -> list[int]:
        """Numbers of the entries ``prefix<number>`` that are complete."""
        fs, at = self._fs(folder)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        numbers = sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())
        return [n for n in numbers if done is None or fs.exists(self._fs(f"{folder}/{prefix}{n}/{done}")[1])]

    def _remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def merged_upto(self) -> int:
        """The last epoch that is in the base, -1 without one."""
        return max(self._numbers(f"{self.path}/manifest", "upto-", None), default=-1)

    def epochs(self, before: int | None = None) -> list[int]:
        """Complete epochs after the base."""
        upto = self.merged_upto()
        return [n for n in self._numbers(self.path, "epoch=") if n > upto and (before is None or n < before)]

    def _base(self, upto: int) -> str:
        return f"{self.path}/base/upto-{upto}"

    def _manifest(self, upto: int) -> str:
        return f"{self.path}/manifest/upto-{upto}"

    # ------------------------------------------------------------- reading

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def rows(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """Rows of base and newer epochs, not yet merged, with their epoch; of some hash parts only, if named."""
        upto, tables = self.merged_upto(), []
        if upto >= 0:
            # A base without rows has no files to tell its columns.
            known = T.StructType.fromJson(json.loads(self.spark.read.text(self._manifest(upto)).first()[0]))
            base = self.spark.read.schema(known).parquet(self._base(upto))
            base = base if parts is None else base.where(F.col(PART).isin(parts))
            tables.append(base.drop(PART).withColumn("epoch", F.lit(upto).cast("long")))
        newer = self.epochs(before)
        if newer:
            delta = self.spark.read.parquet(*[f"{self.path}/epoch={n}" for n in newer])
            number = F.regexp_extract("_metadata.file_path", r"/epoch=(\d+)/", 1).cast("long")
            delta = delta.withColumn("epoch", number)
            tables.append(delta if parts is None else delta.where(self.part().isin(parts)))
        return reduce(DataFrame.unionByName, tables) if tables else None

    def read(self) -> DataFrame | None:
        """One row per key; None before anything was written."""
        rows = self.rows()
        return None if rows is None else self.merge(rows)

    # ------------------------------------------------------------- writing

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Put the rows of a batch in its place, after merging what came before if that is due."""
        self.compact(epoch)
        rows.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def compact(self, before: int) -> None:
        """Merge the epochs before this one into a new base, once there are ``every`` of them."""
        due = self.epochs(before)
        if len(due) < self.every:
            return
        former, upto = self.merged_upto(), due[-1]
        merged = self.merge(self.rows(before)).withColumn(PART, self.part())
        merged.repartition(PART).sortWithinPartitions(PART, self.key).write.mode("overwrite").partitionBy(PART).parquet(self._base(upto))
        # Written aside and renamed: a manifest that can be seen is whole.
        fs, aside = self._fs(f"{self.path}/manifest/writing")
        out = fs.create(aside, True)
        out.writeBytes(merged.schema.json())
        out.close()
        fs.rename(aside, self._fs(self._manifest(upto))[1])
        for n in self._numbers(self.path, "epoch=", None):
            if n <= former:
                self._remove(f"{self.path}/epoch={n}")
        for n in self._numbers(f"{self.path}/base", "upto-", None):
            if n < former:
                self._remove(self._base(n))


def last_value(key: str, value: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps the value of the highest epoch."""
    return lambda rows: rows.groupBy(key).agg(F.max_by(value, "epoch").alias(value))


def sum_of(key: str, value: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that adds values up."""
    return lambda rows: rows.groupBy(key).agg(F.sum(value).alias(value))


def once(key: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps each key once."""
    return lambda rows: rows.select(key).distinct()
