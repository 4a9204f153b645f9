"""Tables of a manifest as DataFrames; only footers are read until an action runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from relweave.sources.manifest import Manifest
from relweave.sources.rowgroups import evenly_spaced, row_group_sizes

__all__ = ["RelationalDataset", "evenly_spaced", "in_row_groups", "named", "row_group_sizes", "with_position"]


def named(column: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


class RelationalDataset:
    def __init__(self, spark: SparkSession, manifest: Manifest, root: str):
        self.spark, self.manifest, self.root = spark, manifest, root
        self._tables: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}.parquet"

    def has_table(self, name: str) -> bool:
        return name in self.manifest.tables

    def table_names(self) -> list[str]:
        return list(self.manifest.tables)

    def table(self, name: str) -> DataFrame:
        """Lazy scan, one DataFrame a table. Unknown names fail before any file is touched."""
        if not self.has_table(name):
            raise KeyError(f"no table {name!r}; there are {', '.join(self.manifest.tables)}")
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(self.path(name))
        return self._tables[name]

    def exists(self, name: str) -> bool:
        """Whether the table's file can be read."""
        try:
            self.table(name)
        except AnalysisException:
            return False
        return True

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def columns_df(self) -> DataFrame:
        rows = [(t, i, c) for t in self.manifest.tables for i, c in enumerate(self.columns(t))]
        return self.spark.createDataFrame(rows, "table_name string, ordinal int, column_name string")

    def rows(self, name: str, column: str, value: object) -> DataFrame:
        """Rows where column equals value; a null is equal to nothing."""
        known = self.columns(name)
        if column not in known:
            raise KeyError(f"{column!r} is no column of {name}: {', '.join(known)}")
        return self.table(name).where(named(column) == F.lit(value))

    def entity(self, name: str, key: object) -> Row:
        """The row that a primary key stands for; none, or several, are errors."""
        self.table(name)
        if (column := self.manifest.tables[name].primary_key) is None:
            raise ValueError(f"rows of {name} cannot be looked up without a primary key")
        match self.rows(name, column, key).take(2):
            case [row]:
                return row
            case []:
                raise KeyError(f"{key!r} is no {column} of {name}")
            case _:
                raise ValueError(f"{column} {key!r} of {name} is not unique")


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """df with each row's place in its file."""
    return df.withColumn(name, F.col("_metadata.row_index"))


def in_row_groups(df: DataFrame, sizes: list[int], groups: list[int], name: str = "position") -> DataFrame:
    """Rows of a single file whose position falls into the chosen row groups."""
    starts = [sum(sizes[:g]) for g in groups]
    keep = F.lit(False)
    for g, start in zip(groups, starts, strict=True):
        keep = keep | F.col(name).between(start, start + sizes[g] - 1)
    return df.where(keep)
