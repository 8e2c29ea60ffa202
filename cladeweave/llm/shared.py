"""The shared folder, lineage cuts and small helpers that several operators need."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a missing id: larger than any other.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without the setting a session in one process (tests) gets a temporary folder; any other session
    raises, because no folder is known that all its executors see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        require(spark.sparkContext.master.startswith("local["), "set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder once and read it from there.

    A written table has its true size.  A checkpoint would keep the estimate of the plan that made it,
    and these estimates multiply at every join of an iteration until the numbers alone fill the driver.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "table")
    bound_batches(spark)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


#: Spark removes the shuffle files of a statement when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, as it is read from the table alone.

    Otherwise they stay until the driver happens to collect its garbage, next to those of later steps.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote.  Everything made of them must have been written before."""
    for table in tables:
        if path := getattr(table, "_cut_path", None):
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``: texts and sets are long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).upper().rstrip("B")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives its worker's free memory back at the end: workers outlive their task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stored tables."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str | Column, folds: int = 5) -> Column:
    """crc32 of the decimal id modulo ``folds``; a null id counts as an empty text."""
    text = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % F.lit(folds)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many ``_`` added as it takes to differ from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bitmap_bits(ids: int) -> int:
    """Bits of a place in a bitmap of so many ids: about 16 places an id, from 1 MB to 32 MB; beyond some hundred million ids it grows crowded."""
    return min(28, max(23, (16 * ids).bit_length()))


def split_by_ids(docs: DataFrame, key: Column, ids: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows of ``docs`` whose ``key`` is not in the first column of ``ids``; those that may be in it, with
    their key in one more column; and that column's name.

    A bitmap of ``2**bits`` places over hashed ids (``bitmap_bits``) is broadcast as a
    table of words, so nothing is shuffled; a crowded bitmap lets more rows count as possible.
    """
    name, word, held = fresh(docs.columns, "drop_id", "drop_word", "drop_bits")
    one = ids.select(F.col(ids.columns[0]).cast("long").alias(name)).where(F.col(name).isNotNull())
    place = F.pmod(F.xxhash64(name), F.lit(1 << bits))
    low = f"cast(pmod(xxhash64({name}), {1 << bits}) % 64 as int)"
    words = one.select(F.shiftright(place, 6).alias(word), F.expr(f"shiftleft(1L, {low})").alias("bit"))
    words = F.broadcast(words.groupBy(word).agg(F.bit_or("bit").alias(held)))
    marked = docs.withColumn(name, key).withColumn(word, F.shiftright(place, 6)).join(words, word, "left")
    hit = F.col(name).isNotNull() & F.coalesce(F.expr(f"shiftright({held}, {low}) & 1") == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~hit).select(*columns), marked.where(hit).select(*columns, name), name


def keep_decided(docs: DataFrame, id_col: str, text_col: str, decided: DataFrame, keys: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``docs`` with the rows that ``decided(id, key, kept)`` names dropped, or one row of each name kept.

    A row's name is its id, ``LAST_ID`` if it has none, and the key that ``keys`` makes of its text, so an
    id that stands at several texts or is missing decides nothing alone.  Rows without an entry stay; those
    that a bitmap of ids excludes pass without a shuffle, and only the others get keys.  Most of these have an
    entry.  Names without texts tell which have none, and only rows that a bitmap of these names lets pass are
    joined with their texts.
    """
    decided = cut(decided)
    free, rest, name = split_by_ids(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), decided, bitmap_bits(decided.count()))
    key, kept = fresh(rest.columns, "text_key", "is_kept")
    decided = decided.toDF(name, key, kept)
    at, columns = docs.columns.index(text_col), [F.col(f"`{c}`") for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(key, keys(b.column(at)))

    keyed = rest.mapInArrow(lean(run), T.StructType([*rest.schema.fields, decided.schema[key]]))
    both = [name, key]

    def named(names: DataFrame) -> DataFrame:
        hashed = cut(names.select(F.xxhash64(*both, F.lit(1)).alias("name")).distinct())
        _, maybe, extra = split_by_ids(keyed, F.xxhash64(*both, F.lit(1)), hashed, bitmap_bits(hashed.count()))
        return maybe.drop(extra)

    undecided = named(keyed.select(*both).join(decided, both, "left_anti"))
    out = free.union(undecided.join(decided, both, "left_anti").select(*columns))
    if decided.where(kept).isEmpty():
        return out
    # Rows of one name may be very many (those without id and of one text): each task drops its repeats before the join.
    once = named(decided.where(kept)).dropDuplicates(both)
    return out.union(once.join(decided.where(kept), both, "left_semi").select(*columns))


#: Keys that more than this share of all rows have are joined by a table that is sent.
HEAVY_SHARE = 1e-5


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join (``inner`` or ``left``) of ``left`` with ``right``, whose ``key`` is unique and whose ``rows`` counts its rows in ``left``.

    Keys with more than ``HEAVY_SHARE`` of the ``total`` rows of ``left`` are at most ``1 / HEAVY_SHARE``, so
    their table may be sent, and the other keys are none that fill a task.
    """
    least = max(2, int(total * HEAVY_SHARE))
    heavy = F.broadcast(right.where(F.col(rows) > least))
    light = left.join(heavy.select(key), key, "left_anti").join(right.where(F.col(rows) <= least), key, how)
    return left.join(heavy, key).unionByName(light)


def require(ok: bool, message: str) -> None:
    """Raise ``ValueError`` unless ``ok``."""
    if not ok:
        raise ValueError(message)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def bits_for(size: int) -> int:
    """Bits that hold every id below ``size``."""
    return max(1, math.ceil(math.log2(size))) if size > 1 else 1
