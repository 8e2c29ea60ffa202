"""SentencePiece encoding and decoding through a table of distinct chunks.

If no piece of a model has a white-space marker after another character, no piece crosses the
start of a run of markers.  A text is then the concatenation of chunks (markers and the characters
up to the next marker), and the ids of a text are the ids of its chunks in order.  Each task
keeps a bounded table of the chunks it has seen: a chunk is segmented by the library once,
and ids, their decimal digits and the decoded surface are joined back by position.

Defined results: a null text is an empty text; an empty text has only the end id and decodes to an
empty text.  Repeated rows, null ids and extra columns pass through; a column of the name that is to be
added is an error, so nothing is overwritten.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeweave.llm.shared import lean, require

MARK = "▁"
TABLE_ENTRIES = 300_000
CHUNK_CHARS = 200


class ChunkCodec:
    """Encoder and decoder of one model; exact for every text.

    ``table_entries`` bounds the chunk table (it is emptied when full); chunks longer than
    ``CHUNK_CHARS`` are never kept.  A model whose pieces do cross markers is used without table.
    """

    def __init__(self, model_file: str, table_entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = self.sp.normalize("  a  b ﬁ ") == f"{MARK * 3}a{MARK * 2}b ﬁ{MARK}"
        self.separable = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.mark_ids = [self.sp.piece_to_id(MARK)]
        self.separable &= pieces[self.mark_ids[0]] == MARK
        self.end = self.sp.eos_id()
        self.entries = table_entries
        self.table: dict[str, tuple[bytes, int, str, bytes]] = {}
        self.segmented = 0

    def chunks(self, text: str) -> list[str]:
        """The chunks of the normalised text, without their first marker."""
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def _entry(self, chunk: str) -> tuple[bytes, int, str, bytes]:
        """Decimal digits, number, surface and 32-bit words of a chunk's ids."""
        self.segmented += 1
        ids = self.sp.encode(chunk) if chunk else self.mark_ids
        made = (b"".join(b" %d" % i for i in ids), len(ids), " " + self.sp.decode(ids), np.array(ids, "<i4").tobytes())
        if len(chunk) <= CHUNK_CHARS:
            if len(self.table) >= self.entries:
                self.table.clear()
            self.table[chunk] = made
        return made

    def parts(self, text: str) -> list[tuple[bytes, int, str, bytes]]:
        get = self.table.get
        return [get(c) or self._entry(c) for c in self.chunks(text)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text and the end id."""
        return np.frombuffer(self.packed(text)[0], "<i4").tolist()

    def packed(self, text: str | None) -> tuple[bytes, str]:
        """Ids of the text and the end id as 32-bit words, and the text that they decode to."""
        if not text or not self.separable:
            ids = [*(self.sp.encode(text) if text else ()), self.end]
            return np.array(ids, "<i4").tobytes(), self.decode(ids)
        parts = self.parts(text)
        words = b"".join([p[3] for p in parts]) + np.array([self.end], "<i4").tobytes()
        return words, "".join([p[2] for p in parts])[1:]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of their decimal digits, digest of the decoded text."""
        if not text or not self.separable:
            ids = self.encode(text)
            decimal, n, surface = " ".join(map(str, ids)).encode(), len(ids), self.decode(ids)
        else:
            parts = self.parts(text)
            decimal = b"".join([p[0] for p in parts])[1:] + b" %d" % self.end
            n = sum([p[1] for p in parts]) + 1
            surface = "".join([p[2] for p in parts])[1:]
        return n, hashlib.sha256(decimal).hexdigest(), hashlib.sha256(surface.encode()).hexdigest()


_codecs: dict[str, ChunkCodec] = {}


def codec(model_file: str) -> ChunkCodec:
    """The worker's codec of a model."""
    if model_file not in _codecs:
        _codecs[model_file] = ChunkCodec(model_file)
    return _codecs[model_file]


def _task(model_file: str, run: Callable[[ChunkCodec, pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over parts of batches; its chunk table is emptied at the end, as workers outlive their tasks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        try:
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    yield run(c, b.slice(lo, 512))
        finally:
            c.table.clear()

    return lean(over)


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_ids(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text (end id included) as an array of ints in column ``out``."""
    require(out not in docs.columns, f"the documents have a column {out} already")
    at = docs.columns.index(text_col)

    def run(c: ChunkCodec, part: pa.RecordBatch) -> pa.RecordBatch:
        ids = _lists([c.packed(t)[0] for t in part.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return docs.mapInArrow(_task(model_file, run), T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_ids(docs: DataFrame, model_file: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the library's text for each array of ids; a null array decodes to empty text."""
    require(out not in docs.columns, f"the documents have a column {out} already")
    at = docs.columns.index(ids_col)

    def run(c: ChunkCodec, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [c.decode([int(i) for i in x or ()]) for x in part.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return docs.mapInArrow(_task(model_file, run), T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def encode_and_decode(docs: DataFrame, model_file: str, text_col: str = "text", ids_out: str = "token_ids", text_out: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and with the library's text for these ids, in one pass."""
    for out in (ids_out, text_out):
        require(out not in docs.columns, f"the documents have a column {out} already")
    at = docs.columns.index(text_col)

    def run(c: ChunkCodec, part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [c.packed(t) for t in part.column(at).to_pylist()]
        texts = pa.array([text for _, text in rows], pa.string())
        return pa.RecordBatch.from_arrays([*part.columns, _lists([ids for ids, _ in rows]), texts], names=[*part.schema.names, ids_out, text_out])

    added = [T.StructField(ids_out, T.ArrayType(T.IntegerType())), T.StructField(text_out, T.StringType())]
    return docs.mapInArrow(_task(model_file, run), T.StructType([*docs.schema.fields, *added]))


def round_trip_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(c: ChunkCodec, part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [c.digest(t) for t in part.column(1).to_pylist()]
        n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_task(model_file, run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
