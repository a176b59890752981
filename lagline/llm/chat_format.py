"""Chat formatting by columnar byte assembly.

The turns of a batch become one Arrow buffer: segment lengths and cumulative offsets
are computed in numpy, and headers and contents are copied by scatter indices into a
preallocated array. Turns are range-partitioned by (conversation, turn), so a
conversation of any length spreads over tasks; the output has a row per
conversation and segment, and segments in order concatenate to the conversation.

Template, per turn: `<|im_start|>` role `\\n` text `<|im_end|>\\n`. Inside roles and
texts, `<` + k backslashes + `|` gets one backslash more, so no control string
can arise there; reading takes it away again.

Defined results: null role or text counts as empty; a role's newlines are escaped too
(`\\n` as `<\\n`: a role never ends early). A null conversation is one conversation; a
null turn sorts first. Equal turns are ordered by role and text. The loss mask
covers the texts of the roles in `loss_roles`. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import id_array, ids, runs, text_buffer
from ._store import partitions, ship

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_CONST = np.frombuffer((START + MIDDLE + END).encode(), np.uint8)
_SCHEMA = "conv_id bigint, part bigint, first_turn bigint, n_turns bigint, text string, loss_start array<int>, loss_length array<int>"
#: Formatted bytes of a segment at most, but for single turns above it.
SEGMENT = 1 << 20


def escape(col: pa.Array, role: bool = False) -> pa.Array:
    col = pc.replace_substring_regex(pc.fill_null(col.cast(pa.string()), ""), r"<(\\*)\|", r"<\1\\|")
    if role:
        col = pc.replace_substring_regex(pc.replace_substring_regex(col, r"<(\\*)n", r"<\1\\n"), r"\n", r"<n")
    return col


def unescape(text: str, role: bool = False) -> str:
    if role:
        text = re.sub(r"<(\\*)n", lambda m: "\n" if not m[1] else "<" + m[1][1:] + "n", text)
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns; each turn's begin and end; where its text begins; all in bytes."""
    role_buf, role_offs = text_buffer(roles)
    text_buf, text_offs = text_buffer(texts)
    source = np.concatenate((_CONST, role_buf, text_buf))
    n = len(roles)
    a, b = len(START), len(MIDDLE)
    begin = np.empty((n, 5), np.int64)  # where each segment lies in the source
    begin[:, 0], begin[:, 2], begin[:, 4] = 0, a, a + b
    begin[:, 1] = len(_CONST) + role_offs[:-1]
    begin[:, 3] = len(_CONST) + len(role_buf) + text_offs[:-1]
    lens = np.empty((n, 5), np.int64)
    lens[:, 0], lens[:, 2], lens[:, 4] = a, b, len(END)
    lens[:, 1], lens[:, 3] = np.diff(role_offs), np.diff(text_offs)
    to = np.concatenate(([0], np.cumsum(lens.ravel())))
    out = np.empty(to[-1], np.uint8)
    # A slice of turns at a time, so that the indices (8 bytes a byte) stay small.
    edges = to[::5]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + SEGMENT, "right")) - 1)
        lo, hi = to[5 * i], to[5 * j]
        shift = begin[i:j].ravel() - to[5 * i : 5 * j]
        out[lo:hi] = source[np.arange(lo, hi) + np.repeat(shift, lens[i:j].ravel())]
        i = j
    return out, edges, to[3::5][:n], to[4::5][:n]


def _format(loss_roles: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, turn = ids(batch.column(0)), ids(batch.column(1))
            roles, texts = batch.column(2), batch.column(3)
            out, edges, lo, hi = assemble(escape(roles, True), escape(texts))
            under = pc.is_in(pc.fill_null(roles, ""), pa.array(loss_roles, pa.string())).to_numpy(zero_copy_only=False)
            chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))  # code points before each byte
            cut = runs(conv)
            big = np.flatnonzero((edges[:-1] // SEGMENT)[1:] != (edges[:-1] // SEGMENT)[:-1]) + 1
            cut = np.union1d(cut, big)
            starts, lengths = [], []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                own = np.flatnonzero(under[i:j]) + i
                starts.append(chars[lo[own]] - chars[edges[i]])
                lengths.append(chars[hi[own]] - chars[lo[own]])
            offs = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in starts]))), pa.int32())
            listed = lambda xs: pa.ListArray.from_arrays(offs, pa.array(np.concatenate(xs), pa.int32()))  # noqa: E731, B023
            text = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(edges[cut].astype(np.int32)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays(
                [id_array(conv[cut[:-1]]), pa.array(np.zeros(len(cut) - 1), pa.int64()), id_array(turn[cut[:-1]]), pa.array(np.diff(cut), pa.int64()), text, listed(starts), listed(lengths)],
                names=["conv_id", "part", "first_turn", "n_turns", "text", "loss_start", "loss_length"],
            )

    return run


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of formatted conversations: conv_id, part (orders a conversation's segments), first_turn, n_turns, text, and the loss mask's spans in code points of text."""
    spark = turns.sparkSession
    ship(spark)
    src = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    dealt = src.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    out = dealt.mapInArrow(_format(loss_roles), _SCHEMA)
    return out.withColumn("part", F.monotonically_increasing_id())


def parse(text: str):
    """(role, text) of each turn of formatted text."""
    for turn in text.split(END)[:-1]:
        role, _, body = turn.removeprefix(START).partition(MIDDLE)
        yield unescape(role, True), unescape(body)


def _digest(batches):
    """Streams segments sorted by conversation and part; holds two hash states, whatever a conversation's length."""
    now, state = None, None

    def row():
        n, every, chars, loss, size = state
        return (now, n, every.hexdigest(), chars, loss.hexdigest(), size)

    def table(rows):
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        arrays = [id_array(np.array(cols[0], np.int64)), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        out = []
        conv = ids(batch.column(0))
        for i, (text, starts, lengths) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
            if state is None or conv[i] != now:
                if state is not None:
                    out.append(row())
                now, state = int(conv[i]), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for a, n in zip(starts, lengths, strict=True):
                body = unescape(text[a : a + n])
                state[2] += len(body)
                state[3].update(body.encode())
            state[4] += len(text)
        if out:
            yield table(out)
    if state is not None:
        yield table([row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation is sequential, so its segments meet in one
    task; they stream through it.
    """
    ship(formatted.sparkSession)
    rows = formatted.select("conv_id", "text", "loss_start", "loss_length", "part").repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return rows.drop("part").mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
