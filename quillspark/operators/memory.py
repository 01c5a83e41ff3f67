"""A translation memory that grows: runs of tables bucketed by text.

Each append is one small run, its texts once each, dealt into the buckets of their hash and sorted. A look-up deals its own
texts out once and merge-joins them with every run bucket by bucket, so that the memory is never shuffled, however large
it is. When there are ``MOST_RUNS`` runs they are merged into one, which shuffles the memory once in so many appends. The
last write of a text wins.

Tables are named ``<name>_run_<number>`` in the session's catalogue; a run that is not written to its end has no table and
counts for nothing, and a merge drops the old runs only after the new one is there (until then the newest write of a text is
still the one that wins)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.inference import FAILURE, factory_of, translate_texts

#: Runs that are merged when one more would come.
MOST_RUNS = 8


@dataclass(frozen=True)
class Memory:
    """``buckets`` is fixed for the life of a memory: about its expected size over that of a task. ``folder`` is where the
    tables' files go (the cluster's shared storage)."""

    spark: SparkSession
    name: str
    folder: str
    buckets: int = 64

    def runs(self) -> list[str]:
        """Tables of the memory, oldest first."""
        numbered = ((int(m[1]), t.name) for t in self.spark.catalog.listTables() if (m := re.fullmatch(re.escape(self.name) + r"_run_(\d+)", t.name)))
        return [table for _, table in sorted(numbered)]

    def _write(self, rows: DataFrame) -> None:
        """One more run, of dealt rows."""
        last = self.runs()[-1:]
        number = int(last[0].rpartition("_")[2]) + 1 if last else 0
        table = f"{self.name}_run_{number}"
        rows.write.option("path", f"{self.folder}/{table}").bucketBy(self.buckets, "text").sortBy("text").saveAsTable(table)

    def append(self, rows: DataFrame) -> None:
        """Add ``text, translation, at``; of a text's rows the last counts (of equal times the greatest translation). Null
        texts and failed translations are not kept."""
        good = rows.where(F.col("text").isNotNull() & ~F.coalesce(F.startswith("translation", F.lit(FAILURE)), F.lit(False)))
        if len(self.runs()) >= MOST_RUNS:
            self.compact()
        self._write(self._dealt(good))

    def _joined(self, left: DataFrame, tables: Iterable[str], how: str) -> DataFrame:
        """``left(text, m)`` with the newest of its own and each run's ``(at, translation)``."""

        def add(rows: DataFrame, table: str) -> DataFrame:
            run = self.spark.table(table).select("text", F.struct("at", "translation").alias("_m"))
            return rows.join(run.hint("merge"), "text", how).select("text", F.greatest("m", "_m").alias("m"))

        return reduce(add, tables, left)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The last row of each text, in the buckets of a run."""
        once = rows.repartition(self.buckets, "text").groupBy("text").agg(F.max(F.struct("at", "translation")).alias("m"))
        return once.select("text", "m.translation", "m.at")

    def rows(self) -> DataFrame:
        """``text, translation, at`` of every text; shuffles the memory once. (The text is made anew, as a union of tables
        of like buckets is else taken for one of these buckets, though its parts are read apart, and texts come twice.)"""
        every = reduce(DataFrame.unionByName, map(self.spark.table, self.runs()))
        return self._dealt(every.withColumn("text", F.concat("text", F.lit(""))))

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self.runs()
        if len(old) > 1:
            self._write(self.rows())
            for table in old:
                self.spark.sql(f"DROP TABLE {table}")

    def lookup(self, texts: DataFrame) -> DataFrame:
        """``text, translation, at`` of each distinct text; null where the memory has none. Only ``texts`` are shuffled."""
        wanted = texts.select("text").where("text IS NOT NULL").repartition(self.buckets, "text").distinct()
        found = self._joined(wanted.withColumn("m", F.lit(None).cast("struct<at:timestamp,translation:string>")), self.runs(), "left")
        return found.select("text", "m.translation", "m.at")

    def translate(self, texts: DataFrame, model: str) -> DataFrame:
        """``text, translation, hit`` of each distinct text, from the memory or, where it has none, from the model; the
        rows come from one pass. Pass the misses to ``append`` to keep them."""
        factory = factory_of(model)
        found = self.lookup(texts).select("text", "translation", F.col("at").isNotNull().alias("hit"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            translate = translate_texts(factory)
            for frame in frames:
                missing = ~frame["hit"].astype(bool)
                frame.loc[missing, "translation"] = translate(frame.loc[missing, "text"].tolist())
                yield frame

        return found.mapInPandas(run, "text string, translation string, hit boolean")

    def forget(self) -> None:
        """Drop the tables; their files stay in ``folder``."""
        for table in self.runs():
            self.spark.sql(f"DROP TABLE {table}")

