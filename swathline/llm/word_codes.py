"""Words of Arrow string columns as 64-bit codes, by whole columns in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, about; a longer text is worked on by itself.
CHUNK_BYTES = 4 << 20
#: Bytes that are coded at once: arrays of 64-bit numbers per byte of text stay this much times eight.
SLICE_BYTES = 1 << 19

BASE = 0x9E3779B97F4A7C15
_draw = np.random.default_rng(20)
BYTE = _draw.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

WORD, SPACE, BREAK = 0, 1, 2


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of ``BASE``, or of its inverse, modulo 2^64."""
    name = "inverse" if inverse else "plain"
    if name not in _powers or len(_powers[name]) < n:
        by = np.full(max(n, SLICE_BYTES + 1), pow(BASE, -1, 2**64) if inverse else BASE, dtype=np.uint64)
        by[0] = 1
        _powers[name] = np.multiply.accumulate(by)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]`` that doesn't depend on where it lies."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    inside = (total[ends] - total[starts]) * powers(len(values) + 1, inverse=True)[starts]
    return mixed(inside + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass(slots=True)
class Coded:
    """Words of some rows in order: ``codes``, the byte span of each in ``data``, and where each row's words begin and end."""

    data: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # rows[i]:rows[i + 1] are the words of row i
    breaks: np.ndarray  # True where a word is the first of its row or follows a break

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte whether it belongs to words, parts them, or ends a piece."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(spaces)] = SPACE
    kind[list(breaks)] = BREAK
    return kind


def coded(texts: pa.Array, kind: np.ndarray, lower: bool = False, salt: np.ndarray | None = None) -> Coded:
    """Codes of the words of a string column without NULLs. ``lower`` folds A-Z; ``salt``, one number per row, makes the words
    of rows with different salts different."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, dtype=np.uint8)
    bounds = offsets - offsets[0]
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    parts, row, done = [], 0, 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1)
        part = coded_slice(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row], kind)
        codes, starts, ends, rows, breaks = part
        parts.append((codes, starts + bounds[row], ends + bounds[row], rows[:-1] + done, breaks))
        row, done = end, done + len(codes)
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return Coded(data, none.astype(np.uint64), none, none, np.zeros(1, dtype=np.int64), none.astype(bool))
    codes, starts, ends, rows, breaks = (np.concatenate(x) for x in zip(*parts))
    rows = np.r_[rows, done]
    if salt is not None:
        codes = codes + np.repeat(salt.astype(np.uint64), np.diff(rows))
    return Coded(data, mixed(codes), starts, ends, rows, breaks)


def coded_slice(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    of = kind[data]
    inside = of == WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[:-1][np.diff(bounds) > 0]
    first[edge] = inside[edge]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=total[1:])
    codes = (total[ends] - total[starts]) * powers(len(data) + 1, inverse=True)[starts]
    rows = np.searchsorted(starts, bounds)
    parted = np.zeros(len(starts), dtype=bool)
    parted[rows[:-1][np.diff(rows) > 0]] = True
    stops = np.flatnonzero(of == BREAK)
    if len(stops):
        after = np.searchsorted(starts, stops)
        parted[after[after < len(starts)]] = True
    return codes, starts, ends, rows, parted


def filled(column: pa.Array, value) -> pa.Array:
    return pc.fill_null(column, value)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes of text; NULL texts become empty."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        batch = batch.set_column(at, text, filled(batch.column(at), "").cast(pa.large_string()))
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(at).buffers()[1], dtype=np.int64)[batch.column(at).offset :][: batch.num_rows + 1]))
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, done + most - size, side="right")))
            held.append(batch.slice(begin, end - begin))
            size += int(sizes[end - 1]) - done
            begin, done = end, int(sizes[end - 1])
            if size >= most or begin < batch.num_rows:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
