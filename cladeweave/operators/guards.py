"""Checks of inputs that fail early and name what is wrong."""

from __future__ import annotations

import shutil
import time

from pyspark.sql import DataFrame, SparkSession

#: Columns of a taxonomic classification that the annotation of trees needs (fixed values).
CONSTRAINT_COLUMNS = ("Genus", "Specie_name", "Clade", "Subfam", "Family", "Annot_level_1", "Annot_level_2", "Annot_level_3", "Annot_level_4")


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], name: str = "table") -> DataFrame:
    """``df``, or ``ValueError`` with the columns that it lacks."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{name} lacks the columns {', '.join(absent)}")
    return df


def require_constraint_columns(constraints: DataFrame) -> DataFrame:
    return require_columns(constraints, CONSTRAINT_COLUMNS, "the constraints table")


def require_path(spark: SparkSession, path: str, folder: bool | None = None) -> str:
    """``path`` in any file system that Spark reads, or ``FileNotFoundError``; ``folder`` asks for its kind."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kind = {True: "folder", False: "file", None: "path"}[folder]
    if not system.exists(at) or (folder is not None and system.getFileStatus(at).isDirectory() != folder):
        raise FileNotFoundError(f"missing {kind}: {path}")
    return path


def require_program(program: str) -> str:
    """Where a program stands, or ``FileNotFoundError``."""
    found = shutil.which(program)
    if found is None:
        raise FileNotFoundError(f"program not found: {program}")
    return found


class RunLog:
    """Time-stamped messages of a run, written as one small text file."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def write(self, *parts: object) -> str:
        self.lines.append(f"[{time.strftime('%Y-%m-%d %H:%M:%S')}] " + "".join(map(str, parts)))
        return self.lines[-1]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, line) for k, line in enumerate(self.lines)]
        spark.createDataFrame(rows, "ord long, value string").coalesce(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)
