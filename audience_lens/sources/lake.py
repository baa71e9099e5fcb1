"""Layers in partitions, with one manifest a run for all of them.

A run writes the partitions it has touched into folders of its own. Its manifest, a file that is created once, names for
every table the folder that holds each partition; from then on readers see all tables of the run, and until then none. So
profile and actions are always of one run, a run that stops half-way leaves nothing that is read, and what no kept
manifest names is cleared by the next run that ends. Of two runs that start from the same one, the second to end is
refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audience_lens.sources import commits

KEPT = 2  # runs that stay readable
WRITE = "write"
WHOLE = "part"  # partition of a table that is always written whole
PACKED = {"compression": "zstd"}


class Snapshot:
    """The tables of one run. A table's entry has its ``column``, ``schema``, ``parts`` (partition to write) and
    ``writes`` (partitions that each write has made)."""

    def __init__(self, spark: SparkSession, root: str, number: int, content: dict) -> None:
        self.spark, self.root, self.number = spark, root, number
        self.tables: dict[str, dict] = content["tables"]
        self.marks: dict[str, int] = content["marks"]

    def folder(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def has(self, name: str) -> bool:
        return name in self.tables

    def nothing(self, name: str) -> DataFrame:
        """No rows, in the columns of a table."""
        return self.spark.createDataFrame([], T.StructType.fromJson(self.tables[name]["schema"])).drop(WHOLE)

    def table(self, name: str) -> DataFrame:
        """A table of this run. Filters on its partition column prune partitions.

        Names have no slashes, so that every table is a folder of ``data``."""
        entry = self.tables[name]
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["parts"]:
            return self.nothing(name)
        live: dict[str, list[str]] = {}
        for part, write in entry["parts"].items():
            live.setdefault(write, []).append(part)
        paths = [f"{self.folder(name)}/{WRITE}={write}" for write in live]
        whole = T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())])
        rows = self.spark.read.schema(whole).option("basePath", self.folder(name)).parquet(*paths)
        if any(len(parts) < entry["writes"][write] for write, parts in live.items()):
            rows = rows.filter(reduce(lambda a, b: a | b, [
                (F.col(WRITE) == write) & (F.lit(True) if len(parts) == entry["writes"][write] else F.col(entry["column"]).isin(parts))
                for write, parts in live.items()]))
        return rows.select(*[n for n in schema.names if n != WHOLE])


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _runs(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in commits.names(self.spark, f"{self.root}/runs") if n.endswith(".json")]

    def _manifest(self, number: int) -> str:
        return f"{self.root}/runs/{number:010d}.json"

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The tables of a run, by default of the newest; none before the first one."""
        if number is None:
            number = max(self._runs(), default=0)
        content = commits.read_once(self.spark, self._manifest(number)) if number else {"tables": {}, "marks": {}}
        return Snapshot(self.spark, self.root, number, content)

    def begin(self) -> Run:
        base = self.snapshot()
        return Run(self, base.number, {"tables": dict(base.tables), "marks": dict(base.marks)})

    def clear(self) -> None:
        """Removes manifests beyond the last ``KEPT``, and writes and partitions that no kept one names."""
        numbers = sorted(self._runs())
        for old in numbers[:-KEPT]:
            commits.remove(self.spark, self._manifest(old))
        named: dict[tuple[str, str], set[str]] = {}
        whole: set[tuple[str, str]] = set()
        for name, entry in ((n, e) for number in numbers[-KEPT:] for n, e in self.snapshot(number).tables.items()):
            for part, write in entry["parts"].items():
                named.setdefault((name, write), set()).add(f"{entry['column']}={part}")
            whole |= {(name, w) for w, n in entry["writes"].items() if n == len(named.get((name, w), ()))}
        for name in commits.names(self.spark, f"{self.root}/data"):
            for folder in commits.names(self.spark, f"{self.root}/data/{name}"):
                key, path = (name, folder.partition("=")[2]), f"{self.root}/data/{name}/{folder}"
                if key not in named:
                    commits.remove(self.spark, path)
                elif key not in whole:
                    for part in commits.names(self.spark, path):
                        if "=" in part and part not in named[key]:
                            commits.remove(self.spark, f"{path}/{part}")


_STAGED = "staged"


class Run(Snapshot):
    """A run in the making: reads its own writes, and shows them to others with ``commit``."""

    def __init__(self, lake: Lake, base: int, content: dict) -> None:
        super().__init__(lake.spark, lake.root, base + 1, content)
        self.lake = lake
        self._staged: dict[int, str] = {}

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written until ``release``, at most for the length of the run, for results that are read more than once."""
        path = f"{self.folder(_STAGED)}/{WRITE}={uuid.uuid4().hex}"
        df.write.options(**PACKED).parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path)
        self._staged[id(rows)] = path
        return rows

    def release(self, rows: DataFrame) -> None:
        """Removes what ``staged`` has written for these rows, which nothing reads any more."""
        commits.remove(self.spark, self._staged.pop(id(rows)))

    def replace(self, name: str, df: DataFrame, column: str, touched: Iterable[str], sort: Iterable[str] = (),
                options: dict[str, str] | None = None) -> list[str]:
        """Puts the rows of ``df`` in place of the partitions ``touched``; ``df`` may have others, which are new.
        Returns the partitions that it has rows in.

        ``column`` is text that can stand in a path. A touched partition without rows is empty from now on. Rows are
        dealt by partition, and a large partition to several tasks; with ``sort`` files are ordered, so that row groups
        can be skipped. ``options`` go to the Parquet writer.
        """
        write = uuid.uuid4().hex
        ordered = df.select(*[c for c in df.columns if c != column], column)
        folder = f"{self.folder(name)}/{WRITE}={write}"
        dealt = ordered if column == WHOLE else ordered.hint("rebalance", column)
        if sort:
            dealt = dealt.sortWithinPartitions(column, *sort)
        dealt.write.options(**(PACKED | (options or {}))).partitionBy(column).parquet(folder)
        made = [n.partition("=")[2] for n in commits.names(self.spark, folder) if n.startswith(f"{column}=")]
        old = self.tables.get(name, {"parts": {}, "writes": {}})
        gone = set(touched) | set(made)
        parts = {p: w for p, w in old["parts"].items() if p not in gone} | {p: write for p in made}
        writes = {w: n for w, n in old["writes"].items() if w in set(parts.values())} | {write: len(made)}
        self.tables[name] = {"column": column, "schema": ordered.schema.jsonValue(), "parts": parts, "writes": writes}
        return made

    def rewrite(self, name: str, df: DataFrame) -> None:
        """Puts ``df`` in place of a whole table."""
        old = self.tables.get(name, {"parts": {}})
        self.replace(name, df.withColumn(WHOLE, F.lit("all")), WHOLE, old["parts"])

    def commit(self, marks: dict[str, int]) -> int:
        """Shows all writes at once; a RuntimeError if another run has ended since this one began."""
        content = {"tables": self.tables, "marks": self.marks | marks}
        if not commits.create_once(self.spark, self.lake._manifest(self.number), content):
            raise RuntimeError(f"run {self.number} has been made by another writer")
        self.lake.clear()
        return self.number
