"""Exact deduplication with a log-structured merge index over text digests.

* **Memtable and flush.**  While documents are scanned, each task keeps a table digest to (smallest
  id, count) of bounded size.  A full table is flushed to the shared folder as a run: rows sorted by
  digest, under a run number and a level.  A group of copies leaves a task as a few rows.
* **Compaction.**  Runs are tiered.  ``FAN_IN`` runs of a level, or fewer, are merged in one pass over
  their sorted digests into a run of the next level, in which the smallest identifier and the sum of
  counts stay.  A merge sees a digest once for each of its runs, so a group that holds a third of all
  rows is no hot key.  Digests are cut into shards (ranges of their first bytes) that are merged apart;
  compaction ends when each shard has one run.
* **Filter.**  Each last run has a Bloom filter of the digests that it holds more than once, sized by
  their number.  A document asks the filter of its digest's shard first; if that says no, it is unique.
  Where all filters together would be too large to send, documents go to the runs without asking.
* **Byte verification.**  The normalised texts of a hit are compared byte by byte: within a task with
  the first text under the digest, then the first texts of all tasks by digest, those of large groups in
  two steps (salted by task, then by digest).  Groups whose texts differ (a digest collision) are grouped again by their texts.

Defined results: a null text is an empty text; equal rows are copies of each other; a null id is
larger than any other id; an id may repeat; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm.shared import LAST_ID, cut, discard, join_counted, keep_decided, lean
from cladeweave.llm.spans import mix64

#: Entries of a memtable, and bytes of texts that a task holds for comparison.
MEMTABLE_ROWS = 1 << 16
HELD_BYTES = 16 << 20
#: Runs that one merge takes, and entries of a shard.
FAN_IN = 16
SHARD_ROWS = 1 << 20
#: Copies from which on the texts of a group are compared in two steps.
LARGE_GROUP = 1 << 12
#: Bytes of all filters that are sent to the executors.
FILTER_BYTES = 16 << 20
_ODD = re.compile(rb"[\x09-\x0D]|\x20{2}")
_RUN = re.compile(rb"[\x20\x09-\x0D]+")
U = np.uint64


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space."""
    return _RUN.sub(b" ", text) if _ODD.search(text) else text


def _digest(text: bytes, bits: int) -> bytes:
    """SHA-256 of a text; fewer ``bits`` only make collisions, for tests."""
    full = hashlib.sha256(text).digest()
    return full if bits == 256 else ((int.from_bytes(full[:8], "big") >> (64 - bits)) << (64 - bits)).to_bytes(8, "big")


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield normalise(x.as_buffer().to_pybytes() if x.is_valid else b"")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


RUNS = "run long, digest binary, keep_id long, n long"


def flush_runs(docs: DataFrame, id_col: str, text_col: str, bits: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Level 0: ``run, digest, keep_id, n``; each run is one flushed memtable, sorted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, table = TaskContext.get().partitionId() << 32, {}

        def flush() -> pa.RecordBatch:
            keys = sorted(table)
            return pa.record_batch(
                [pa.array(np.full(len(keys), number)), pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64())],
                names=["run", "digest", "keep_id", "n"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                doc_id = LAST_ID if doc_id is None else doc_id
                entry = table.get(d := _digest(text, bits))
                if entry is None:
                    table[d] = [doc_id, 1]
                    if len(table) >= memtable_rows:
                        yield flush()
                        number, table = number + 1, {}
                else:
                    entry[0], entry[1] = min(entry[0], doc_id), entry[1] + 1
        if table:
            yield flush()

    return _columns(docs, id_col, text_col).mapInArrow(lean(run), RUNS)


def _places(digests: list[bytes], bits: int) -> list[np.ndarray]:
    """Two places of a Bloom filter of ``2**bits`` bits; the first bytes, which name the shard, are left out."""
    keys = np.frombuffer(b"".join(d[-8:] for d in digests), dtype="<u8").astype(U)
    mask = U((1 << bits) - 1)
    return [mix64(keys) & mask, mix64(keys ^ U(0xA0761D6478BD642F)) & mask]


class RunFilter:
    """A Bloom filter with eight bits or more for each of its digests."""

    def __init__(self, digests: list[bytes]):
        self.bits = max(6, (8 * len(digests)).bit_length())
        self.words = np.zeros(1 << self.bits >> 6, dtype=U)
        for p in _places(digests, self.bits):
            np.bitwise_or.at(self.words, (p >> U(6)).astype(np.int64), U(1) << (p & U(63)))

    def has(self, digests: list[bytes]) -> np.ndarray:
        keep = np.ones(len(digests), dtype=bool)
        for p in _places(digests, self.bits):
            keep &= (self.words[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) != 0
        return keep

    def to_bytes(self) -> bytes:
        return self.words.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> RunFilter:
        out = cls.__new__(cls)
        out.words = np.frombuffer(raw, dtype=U)
        out.bits = (len(out.words) << 6).bit_length() - 1
        return out


def shard_of(digest: bytes, shards: int) -> int:
    """The range of first bytes that a digest lies in."""
    return (int.from_bytes(digest[:4], "big") * shards) >> 32


def _shard_column(shards: int):
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.shiftright(first * F.lit(shards), 32).cast("int")


def _merge(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Sorted ``shard, run, digest, keep_id, n`` to one row for each digest of a run.

    For the last runs only digests that occur more than once are kept, and a row with the run's filter
    (in the place of a digest, with ``n = 0``) follows each run.
    """
    names = ["shard", "run", "digest", "keep_id", "n"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    place, digest, keep, n = None, None, 0, 0
    out: list[tuple] = []
    hits: list[bytes] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def entry() -> None:
        if digest is not None and (n > 1 or not last):
            out.append((*place, digest, keep, n))
            if last:
                hits.append(digest)

    def close() -> None:
        entry()
        if last and place is not None and hits:
            out.append((*place, RunFilter(hits).to_bytes(), None, 0))
            hits.clear()

    for b in batches:
        for shard, run, d, i, m in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if place != (shard, run):
                close()
                place, digest = (shard, run), None
            if d == digest:
                keep, n = min(keep, i), n + m
                continue
            entry()
            digest, keep, n = d, i, m
            if len(out) >= 1 << 14:
                yield batch()
                out.clear()
    close()
    if out:
        yield batch()


def compact(runs: DataFrame, fan_in: int = FAN_IN, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """``shard, run, digest, keep_id, n`` of the last runs, with their filters, and the number of shards.

    ``runs`` are merged level by level, ``fan_in`` of each shard at a time, until each shard has one run.
    There are as many shards as shuffle partitions, or more for ``shard_rows`` entries each.
    """
    about = runs.agg(F.count("*"), F.countDistinct("run")).first()
    shards, left = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-about[0] // shard_rows)), about[1]
    level = runs.withColumn("shard", _shard_column(shards))
    while True:
        merges = max(1, -(-left // fan_in))
        tier = level.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(merges)))
        dealt = tier.select("shard", "run", "digest", "keep_id", "n").repartition("shard", "run").sortWithinPartitions("shard", "run", "digest")
        last = merges == 1
        merged = cut(dealt.mapInArrow(lean(lambda batches, last=last: _merge(batches, last)), f"shard int, {RUNS}"))
        discard(level)
        if last:
            return merged, shards
        level, left = merged, merges


def _hits(docs: DataFrame, id_col: str, text_col: str, bits: int, memtable_rows: int, fan_in: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """``digest, keep_id, n`` of the groups, and per document ``doc_id, text_sha256, digest, body, clash``.

    ``digest`` is null for documents whose digest the filters exclude; ``body`` holds the first text that
    a task has under a digest.
    """
    runs = cut(flush_runs(docs, id_col, text_col, bits, memtable_rows))
    index, shards = compact(runs, fan_in, shard_rows)
    discard(runs)
    stored = index.where("n = 0").select("shard", "digest")
    size = stored.agg(F.sum(F.length("digest"))).first()[0] or 0
    sent = None
    if size <= FILTER_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in stored.collect()})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: RunFilter.from_bytes(raw) for s, raw in sent.value.items()} if sent is not None else None
        first: dict[bytes, bytes] = {}
        held = 0
        for b in batches:
            texts = list(_texts(b.column(1)))
            digests = [_digest(t, bits) for t in texts]
            maybe = np.ones(len(texts), dtype=bool)
            if filters is not None:
                maybe[:] = False
                of = np.array([shard_of(d, shards) for d in digests], dtype=np.int64)
                for s in np.unique(of).tolist():
                    if s in filters:
                        at = np.flatnonzero(of == s)
                        maybe[at] = filters[s].has([digests[k] for k in at])
            bodies, clash = [], []
            for d, t, m in zip(digests, texts, maybe, strict=True):
                known = first.get(d) if m else None
                if m and known is None:
                    if held + len(t) > HELD_BYTES:
                        first, held = {}, 0
                    first[d], held = t, held + len(t)
                bodies.append(t if m and (known is None or known != t) else None)
                clash.append(known is not None and known != t)
            shown = digests if bits == 256 else [_digest(t, 256) for t in texts]
            yield pa.record_batch(
                [b.column(0), pa.array([d.hex() for d in shown], pa.string()), pa.array([d if m else None for d, m in zip(digests, maybe, strict=True)], pa.binary()), pa.array(bodies, pa.binary()), pa.array(clash, pa.bool_())],
                names=["doc_id", "text_sha256", "digest", "body", "clash"],
            )

    asked = _columns(docs, id_col, text_col).mapInArrow(lean(look_up), "doc_id long, text_sha256 string, digest binary, body binary, clash boolean")
    return index.where("n > 1").select("digest", "keep_id", "n"), cut(asked)


def _verified(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """``digest, same`` of every hit: whether all texts under it are the same bytes."""
    bodies = asked.where("body IS NOT NULL").select("digest", "body", "clash", F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"))
    ends = [F.min("body").alias("low"), F.max("body").alias("high"), F.max("clash").alias("clash")]
    # One row in LARGE_GROUP at most, so it may be sent.  Texts of the other groups are shuffled once.
    large = F.broadcast(hits.where(F.col("n") >= LARGE_GROUP).select("digest"))
    part = bodies.join(large, "digest", "left_semi").groupBy("digest", "salt").agg(*ends)
    whole = part.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("clash").alias("clash"))
    whole = whole.unionByName(bodies.join(large, "digest", "left_anti").groupBy("digest").agg(*ends))
    return whole.select("digest", ((F.col("low") == F.col("high")) & ~F.col("clash")).alias("same")).join(hits.select("digest"), "digest", "left_semi")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256,
    memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``kept`` is true for the row with the smallest id of each group; of rows that repeat that id, or of
    groups without any id, it is true for all, and ``deduplicate`` keeps one of them.
    """
    hits, asked = _hits(docs, id_col, text_col, digest_bits, memtable_rows, fan_in, shard_rows)
    checked = cut(_verified(asked, hits))
    named = cut(asked.select("doc_id", "text_sha256", "digest"))
    discard(asked)  # its texts are compared
    maybe = named.where("digest IS NOT NULL")
    unique = named.where("digest IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).alias("n"), "text_sha256")
    sound = cut(hits.join(checked.where("same"), "digest", "left_semi"))
    # Documents that the filters let pass without a hit are unique, too.
    found = join_counted(maybe, sound, "digest", "n", sound.agg(F.sum("n")).first()[0] or 0, "left")
    collided = checked.where("NOT same").select("digest")
    if collided.isEmpty():
        return _shaped(unique).unionByName(_shaped(found))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(_texts(b.column(1)))
            rows = [b.column(0), pa.array([_digest(t, 256).hex() for t in texts]), pa.array([_digest(t, digest_bits) for t in texts], pa.binary()), pa.array(texts, pa.binary())]
            yield pa.record_batch(rows, names=["doc_id", "text_sha256", "digest", "body"])

    texts = _columns(docs, id_col, text_col).mapInArrow(lean(again), "doc_id long, text_sha256 string, digest binary, body binary")
    clash = cut(texts.join(collided, "digest", "left_semi"))
    regrouped = clash.groupBy("digest", "body").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("keep_id"), F.count("*").alias("n"))
    found = found.join(collided, "digest", "left_anti")
    return _shaped(unique).unionByName(_shaped(found)).unionByName(_shaped(clash.join(regrouped, ["digest", "body"])))


def _shaped(found: DataFrame) -> DataFrame:
    keep = F.coalesce(F.nullif("keep_id", F.lit(LAST_ID)), F.when(F.col("keep_id").isNull(), F.col("doc_id")))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("doc_id", F.lit(LAST_ID)).eqNullSafe(F.coalesce(keep, F.lit(LAST_ID))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts: the one with the smallest id.

    Rows are told apart by id and text digest, so no other text goes with a copy of the same id.  Of rows
    that share the smallest id and the text, and of groups without any id, one row stays.
    """
    number = F.coalesce("doc_id", F.lit(LAST_ID)).alias("id")
    groups = exact_groups(docs, id_col, text_col).where("group_size > 1").groupBy(number, "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    decided = groups.where("NOT kept OR n > 1").select("id", "text_sha256", "kept")
    return keep_decided(docs, id_col, text_col, decided, lambda texts: pa.array([_digest(t, 256).hex() for t in _texts(texts)], pa.string()))
