"""Token-id files with fixed-width bit packing.

File format (little endian)::

    magic   8 bytes  b"BITPACK2"
    payload          blocks of ``BLOCK_IDS`` ids, ``bits`` bits each, least significant first, every block
                     padded to a byte
    docs    documents x (int64 doc_id, int64 start inside the file)
    blocks  blocks x uint64 byte offset of the block inside the payload
    trailer 6 uint64 bits per id, ids per block, ids, documents, blocks, bytes of the payload; then the magic

A block always starts at a byte, so any block can be unpacked alone with vectorised numpy: that
gives random access.  Files follow one another in ascending ``doc_id`` order.

Encoding runs where the documents are scanned; only packed ids travel to the writers, ranged by
``doc_id``.  A writer streams its rows: a block goes to the file when it is full, so a task holds one block
and the file's document table.  It writes to a name of its own and then moves the file, so a repeated task
leaves one file; the rows that come back to Spark are a manifest.  The number of files follows from the
number of characters (``FILE_CHARS`` for each, at least as many files as there are shuffle partitions).
The bounds between files come from a sample of ``SAMPLED`` ids for each file; an id that stands at
several bounds, because very many rows have it, is dealt over the files between them.

Defined results: a null text is an empty text and has only the end id.  A null ``doc_id`` sorts
first and is stored as the smallest long.  Rows that repeat are stored as often as they occur, in any
order.  An empty table gives no file.  Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeweave.llm.shared import bits_for, ceil_div, lean, new_folder

MAGIC = b"BITPACK2"
BLOCK_IDS = 1 << 16
TABLE_ENTRIES = 1_000_000
NO_ID = -(1 << 63)
#: Characters of text for each file, ids that are sampled for each file, and files at most.
FILE_CHARS = 1 << 28
SAMPLED = 50
MOST_FILES = 100_000

#: The pre-tokenisation rule of the byte-level vocabulary, for texts whose characters all stand in
#: ``_KNOWN`` (letters and digits of ASCII and Latin, where the classes are the same everywhere).
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_KNOWN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, least significant first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> places & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The ``n`` ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others follow from 256 on in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class TokenTable:
    """The tokenizers library behind a bounded table of distinct pre-tokens.

    Byte-level BPE never merges across pre-tokens, so ids of a text are the ids of its pre-tokens,
    and the library's model segments each new pre-token once.  Texts with other characters than
    ``_KNOWN`` allows, or with the text of a special token, go to the library whole.
    """

    def __init__(self, file: str, entries: int = TABLE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.model = self.lib.model
        self.size = self.lib.get_vocab_size()
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.entries, self.table = entries, {}
        probe = "It's  a tést\n\n of 12'll ***tables  "
        self.by_table = self.lib.normalizer is None and self._split(probe) == self._library(probe)

    def _library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _miss(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        made = array("H" if self.width == "<u2" else "I", [t.id for t in tokens]).tobytes()
        if len(piece) <= 48:
            if len(self.table) >= self.entries:
                self.table.clear()
            self.table[piece] = made
        return made

    def _split(self, text: str) -> bytes:
        get, miss = self.table.get, self._miss
        return b"".join([get(p) or miss(p) for p in _SPLIT.findall(text)])

    def raw(self, text: str) -> bytes:
        """Ids of a text, as the library gives them without special tokens added, as integers of ``width``."""
        if not self.by_table or _KNOWN.search(text) or any(s in text for s in self.special):
            return self._library(text)
        return self._split(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype=self.width).astype(np.uint32)


_tables: dict[str, TokenTable] = {}


def token_table(file: str) -> TokenTable:
    if file not in _tables:
        _tables[file] = TokenTable(file)
    return _tables[file]


def file_bounds(docs: DataFrame, id_col: str, text_col: str, files: int | None = None) -> np.ndarray:
    """Ascending ids between files, from the sizes of texts and a sample of ids that is bounded by the number of files."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"))
    if files is None:
        chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
        files = max(ceil_div(chars, FILE_CHARS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = min(max(files, 1), MOST_FILES)
    rows = ids.count()
    share = min(1.0, files * SAMPLED / max(1, rows))
    found = np.sort((ids if share == 1 else ids.sample(False, share, 7)).toArrow().column(0).to_numpy())
    return found[[len(found) * k // files for k in range(1, files)]] if len(found) else found


def encode_packed(docs: DataFrame, tokenizer_file: str, bits: int, end_id: int, id_col: str, text_col: str, bounds: np.ndarray) -> DataFrame:
    """``file_no, doc_id, n, packed``: the ids of each text with the end id, packed, and the file they go to."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = token_table(tokenizer_file), 0
        width = np.dtype(table.width).itemsize
        end = np.array([end_id], dtype=table.width).tobytes()
        for b in batches:
            ids = b.column(0).to_numpy()
            low, high = np.searchsorted(sent.value, ids, "left"), np.searchsorted(sent.value, ids, "right")
            place = low + (done + np.arange(len(ids))) % (high - low + 1)
            done += len(ids)
            rows, n, first, held = [], [], 0, 0
            for k, text in enumerate(b.column(1)):
                rows.append(table.raw(text.as_py() or "") + end)
                n.append(len(rows[-1]) // width)
                held += len(rows[-1])
                if held >= 1 << 22 or k == b.num_rows - 1:
                    if bits != 8 * width:
                        rows = [pack(np.frombuffer(r, table.width), bits) for r in rows]
                    columns = [pa.array(place[first : k + 1].astype(np.int32)), b.column(0).slice(first, k + 1 - first), pa.array(n, pa.int64()), pa.array(rows, pa.binary())]
                    yield pa.record_batch(columns, names=["file_no", "doc_id", "n", "packed"])
                    rows, n, first, held = [], [], k + 1, 0

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "file_no int, doc_id long, n long, packed binary")


class _Writer:
    """Streams one file's ids into packed blocks."""

    def __init__(self, to, bits: int):
        self.to, self.bits, self.docs, self.offsets = to, bits, array("q"), array("Q")
        self.waiting, self.held, self.ids, self.bytes = [], 0, 0, 0
        to.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.extend((doc_id, self.ids))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            flat = np.concatenate(self.waiting)
            full = len(flat) // BLOCK_IDS * BLOCK_IDS
            for lo in range(0, full, BLOCK_IDS):
                self._block(flat[lo : lo + BLOCK_IDS])
            self.waiting, self.held = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.bytes)
        self.bytes += len(raw)
        self.to.write(raw)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        self.to.write(np.array(self.docs, "<i8").tobytes())
        self.to.write(np.array(self.offsets, "<u8").tobytes())
        self.to.write(np.array([self.bits, BLOCK_IDS, self.ids, len(self.docs) // 2, len(self.offsets), self.bytes], "<u8").tobytes())
        self.to.write(MAGIC)


class TokenFile:
    """Random access to one token file through any random-access stream."""

    def __init__(self, stream):
        self.s = stream
        stream.seek(0, 2)
        end = stream.tell() - 56
        assert end >= 8 and self._at(0, 8) == MAGIC and self._at(end + 48, 8) == MAGIC, "not a token file"
        self.bits, self.block_ids, self.ids, docs, blocks, payload = (int(x) for x in np.frombuffer(self._at(end, 48), "<u8"))
        table = np.frombuffer(self._at(8 + payload, docs * 16), "<i8").reshape(-1, 2)
        self.doc_ids, self.starts = table[:, 0], np.append(table[:, 1], self.ids)
        self.offsets = np.frombuffer(self._at(8 + payload + docs * 16, blocks * 8), "<u8").astype(np.int64)
        self.payload = 8

    def _at(self, at: int, n: int) -> bytes:
        self.s.seek(at)
        return self.s.read(n)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.ids - k * self.block_ids)
        return unpack(self._at(self.payload + int(self.offsets[k]), ceil_div(n * self.bits, 8)), self.bits, n)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi - 1`` of the file."""
        if lo >= hi:
            return np.empty(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        flat = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return flat[lo - first * self.block_ids : hi - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Write token files below ``folder`` (a URI that every executor can open).

    Returns the manifest ``file_no, file, ids, documents``, one row for each file, with files
    numbered in ascending ``doc_id`` order.
    """
    bits = bits_for(token_table(tokenizer_file).size)
    bounds = file_bounds(docs, id_col, text_col, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, out = TaskContext.get(), None
        system, path = _open(folder)
        name = f"{path}/part-{context.partitionId():06d}.ids"
        own = f"{name}.{context.taskAttemptId()}"
        for b in batches:
            for d, n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    to = system.open_output_stream(own)
                    out = _Writer(to, bits)
                out.add(d, unpack(packed.as_buffer(), bits, n))
        if out is None:
            return
        out.close()
        to.close()
        system.move(own, name)
        yield pa.record_batch([pa.array([context.partitionId()]), pa.array([f"{folder}/part-{context.partitionId():06d}.ids"]), pa.array([out.ids]), pa.array([len(out.docs) // 2])], names=["file_no", "file", "ids", "documents"])

    return (
        encode_packed(docs, tokenizer_file, bits, end_id, id_col, text_col, bounds)
        .repartitionById(len(bounds) + 1, "file_no")
        .sortWithinPartitions("doc_id")
        .select("doc_id", "n", "packed")
        .mapInArrow(lean(run), "file_no long, file string, ids long, documents long")
    )


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read every file of a manifest: ``doc_id, start, n_tokens, ids_crc32`` of each document.

    ``start`` needs the ids of all files before: the manifest has one short row a file, so its
    running sum is made on the driver and travels as a column.
    """
    spark = manifest.sparkSession
    files = sorted(manifest.select("file_no", "file", "ids").collect())
    before, rows = 0, []
    for _, file, ids in files:
        rows.append((file, before))
        before += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = _open(file)
                with system.open_input_file(path) as stream:
                    f = TokenFile(stream)
                    k, docs = 0, len(f.doc_ids)
                    while k < docs:
                        hi = max(k + 1, int(np.searchsorted(f.starts, f.starts[k] + 4 * BLOCK_IDS, "right")) - 1)
                        hi = min(hi, docs)
                        flat = f.read(int(f.starts[k]), int(f.starts[hi])).astype("<u4")
                        cuts = (f.starts[k : hi + 1] - f.starts[k]).tolist()
                        raw = memoryview(flat.tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cuts, cuts[1:], strict=False)]
                        yield pa.record_batch(
                            [pa.array(f.doc_ids[k:hi], mask=f.doc_ids[k:hi] == NO_ID), pa.array(f.starts[k:hi] + base), pa.array(np.diff(f.starts[k : hi + 1])), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        k = hi

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "file string, base long").repartition(len(rows))
    return listed.mapInArrow(run, schema)


def store_and_read(spark: SparkSession, docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder and read them back."""
    manifest = write_files(docs, new_folder(spark, "token-ids"), tokenizer_file, end_id)
    return read_digests(manifest)
