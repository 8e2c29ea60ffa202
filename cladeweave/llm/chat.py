"""Chat formatting by columnar byte assembly.

Template (control strings are fixed values of this format)::

    <s>                                   begin of a conversation
    <<SYS>>\\n ... \\n<</SYS>>\\n\\n           system turn
    [INST] ... [/INST]                    user turn
    [OUT] ... </s>                        assistant turn; its text is under the loss mask
    [ROLE=name] ... [/ROLE]               any other role

Inside texts a backslash is written before every backslash and before the first byte of every
control string, which is reversible and leaves no control string of a text readable as one.

Assembly: all texts of a batch are escaped in one buffer, segment lengths (headers, contents,
footers) and cumulative offsets are computed in numpy, and one scatter copies headers and contents
into a single preallocated buffer, which becomes an Arrow string array.  The loss mask is a list of
(start, length) in code points.

Defined results: turns are ordered by ``turn`` (nulls first), then role, then text; a null role or
text is an empty one; rows that repeat are turns that repeat; a null conversation id is a conversation
of its own; an empty table has no conversations; other columns are not read.  A conversation is one row
and one string, so one of 2 GB or more is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm import spans

#: Fixed values of the template.
BEGIN = b"<s>"
PARTS = {
    "system": (b"<<SYS>>\n", b"\n<</SYS>>\n\n"),
    "user": (b"[INST] ", b" [/INST]"),
    "assistant": (b"[OUT] ", b" </s>"),
}
OTHER = (b"[ROLE=", b"] ", b" [/ROLE]")
CONTROL = (b"<s>", b"</s>", b"<<SYS>>", b"<</SYS>>", b"[INST]", b"[/INST]", b"[OUT]", b"[ROLE=", b"[/ROLE]")
BATCH_BYTES = 1 << 20
_TOKEN = re.compile(
    r"(?s)(?P<esc>\\.)|(?P<begin><s>)|(?P<head><<SYS>>\n|\[INST\] |\[OUT\] |\[ROLE=(?:[^\\\]]|\\.)*\] )|(?P<foot>\n<</SYS>>\n\n| \[/INST\]| </s>| \[/ROLE\])"
)
_ROLES = {"<<SYS>>\n": "system", "[INST] ": "user", "[OUT] ": "assistant"}


def escape(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a buffer with escapes, and their new offsets."""
    mark = buf == 0x5C
    n = len(buf)
    for word in CONTROL:
        k = len(word)
        if n < k:
            continue
        at = np.flatnonzero(buf[: n - k + 1] == word[0])
        for j in range(1, k):
            at = at[buf[at + j] == word[j]]
        row = np.searchsorted(offs, at, "right") - 1
        mark[at[at + k <= offs[row + 1]]] = True
    before = np.cumsum(mark)
    out = np.full(n + (int(before[-1]) if n else 0), 0x5C, dtype=np.uint8)
    out[np.arange(n) + before] = buf
    return out, offs + np.concatenate(([0], before))[offs]


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def _escape_one(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return escape(raw, np.array([0, len(raw)]))[0].tobytes().replace(b"]", b"\\]")


def assemble(begins: np.ndarray, roles: list[str], texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Format conversations whose turns start at rows ``begins`` (the last entry is the row count).

    Returns the formatted strings and, for each, starts and lengths of the loss mask.
    """
    content, offs = escape(*spans.text_buffers(texts))
    pool = bytearray(BEGIN)
    place: dict[str, tuple[int, int, int, int]] = {}
    for role in dict.fromkeys(roles):
        head, foot = PARTS.get(role) or (OTHER[0] + _escape_one(role) + OTHER[1], OTHER[2])
        place[role] = (len(pool), len(head), len(pool) + len(head), len(foot))
        pool += head + foot
    base = len(pool)
    source = np.concatenate((np.frombuffer(bytes(pool), dtype=np.uint8), content))
    n = len(roles)
    parts = np.array([place[r] for r in roles], dtype=np.int64).reshape(n, 4)
    # Segments in order: for each turn a begin mark (first turns only), header, content, footer.
    first = np.zeros(n, dtype=np.int64)
    first[begins[:-1]] = len(BEGIN)
    start = np.stack((np.zeros(n, np.int64), parts[:, 0], base + offs[:-1], parts[:, 2]), axis=1).ravel()
    length = np.stack((first, parts[:, 1], np.diff(offs), parts[:, 3]), axis=1).ravel()
    target = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(int(target[-1]), dtype=np.uint8)
    out[spans.ranges(target[:-1], length)] = source[spans.ranges(start, length)]
    rows = target[4 * begins]
    formatted = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(rows.astype(np.int64).tobytes()), pa.py_buffer(out)])
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    loss = np.array([r == "assistant" for r in roles], dtype=bool)
    lo, hi = points[target[2:-1:4]], points[target[3::4]]
    mask_at = np.concatenate(([0], np.cumsum(np.bincount(owner[loss], minlength=len(begins) - 1)))).astype(np.int32)
    starts = (lo - points[rows[owner]])[loss] if n else np.empty(0, np.int64)
    return formatted, pa.ListArray.from_arrays(mask_at, pa.array(starts, pa.int64())), pa.ListArray.from_arrays(mask_at, pa.array((hi - lo)[loss], pa.int64()))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, loss_start, loss_length``: one row for each conversation.

    Turns are grouped by a shuffle on the conversation and sorted within partitions, so a task
    streams through its turns and holds about ``BATCH_BYTES`` of text or one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(0).to_pylist()
            begins = np.array([0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)])
            if not last:
                begins = begins[:-1]  # the last conversation may go on
            if len(begins) > 1:
                done = table.slice(0, int(begins[-1]))
                formatted, starts, lengths = assemble(begins, done.column(1).to_pylist(), done.column(2))
                keys = pa.array([ids[k] for k in begins[:-1]], pa.int64())
                yield pa.record_batch([keys, formatted.cast(pa.string()), starts, lengths], names=["conv_id", "formatted", "loss_start", "loss_length"])
            rest = table.slice(int(begins[-1]))
            held, size = ([] if last else rest.to_batches()), 0

        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                held.append(b.slice(lo, 2048))
                size += held[-1].get_total_buffer_size() * held[-1].num_rows // max(b.num_rows, 1)
                if size >= BATCH_BYTES:
                    yield from flush(False)
        if held:
            yield from flush(True)

    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(turn).cast("long").alias("turn")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(run, "conv_id long, formatted string, loss_start array<long>, loss_length array<long>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    found, role, at = [], None, 0
    for m in _TOKEN.finditer(formatted):
        if m["head"] is not None and role is None:
            role = _ROLES.get(m["head"]) or unescape(m["head"][len("[ROLE=") : -2])
            if m["head"].startswith("[ROLE="):
                role = unescape(m["head"][len("[ROLE=") : -2])
            at = m.end()
        elif m["foot"] is not None and role is not None:
            found.append((role, unescape(formatted[at : m.start()])))
            role = None
    return found


def read_back(chats: DataFrame) -> DataFrame:
    """Digests read from formatted conversations alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            out: list[tuple] = []
            for conv, text, starts, lengths in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                turns, told = parse(text), hashlib.sha256()
                for role, body in turns:
                    told.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescape(text[s : s + n]) for s, n in zip(starts, lengths, strict=True))
                out.append((conv, len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(run, schema)
