"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a maximal run of bytes of a class. Texts are read as UTF-8 bytes straight from the Arrow
buffer, so nothing is decoded. Word and window hashes are polynomials modulo 2**64 over random
symbol values with a final mix: equal sequences always get equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK_BYTES = 1 << 21  # texts handled at once in a task; a longer text is a chunk of its own
_BLOCK = 1 << 20  # bytes hashed at once, so a very long text needs no arrays of its size


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_SPACE = byte_class(lambda b: b not in _SPACES)
LETTER = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
PUNCTUATION = NOT_SPACE & ~LETTER
NOT_NEWLINE = byte_class(lambda b: b != 0x0A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _symbols(seed: int) -> np.ndarray:
    steps = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(steps + np.uint64(seed * 1_000_003 + 1)))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(0x5851F42D4C957F2B)
_WORD_POWERS = _Powers(0x2545F4914F6CDD1B)


@dataclass
class Words:
    """Words of consecutive texts: byte range of each, and where each text's words begin."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each text, with the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 0, cuts: tuple[int, ...] = ()):
        """64-bit hash of every word; with ``cuts``, a list that adds hashes of its first bytes."""
        outs = [np.empty(len(self.starts), np.uint64) for _ in (0, *cuts)]
        values = _symbols(seed)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _BLOCK, "right")))
            size = int(self.ends[to - 1] - low)
            up, down = _BYTE_POWERS.get(size + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(values[self.buffer[low : low + size]] * up[:size], out=total[1:])
            s = self.starts[at:to] - low
            for out, cut in zip(outs, (None, *cuts)):
                e = self.ends[at:to] - low
                e = e if cut is None else np.minimum(e, s + cut)
                out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            at = to
        outs = [mix(out) for out in outs]
        return outs if cuts else outs[0]

    def windows(self, k: int) -> np.ndarray:
        """Positions at which ``k`` consecutive words of one text begin."""
        last = np.repeat(self.first[1:], self.counts)
        return np.flatnonzero(np.arange(len(self.starts)) + k <= last)

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(words: np.ndarray, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Hash of the ``k`` words from each position of ``at``; ``k`` may differ by position."""
    up, down = _WORD_POWERS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[at + k] - total[at]) * down[at] + np.asarray(k, np.uint64))


def least_grams(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of every text, and of each the place of its smallest k-gram hash, the rightmost of equals."""
    n = len(hashes)
    last = np.repeat(first[1:], np.diff(first))
    begin = np.flatnonzero(np.arange(n) + window <= last)
    if not len(begin):
        return begin, begin
    least, place = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.arange(n)
    at = np.flatnonzero(np.arange(n) + k <= last)
    least[at] = window_hashes(hashes, at, k)

    def widen(shift: int) -> None:
        nonlocal least, place
        better = least[shift:] <= least[: n - shift]
        least = np.where(better, least[shift:], least[: n - shift])
        place = np.where(better, place[shift:], place[: n - shift])

    width, span = window - k + 1, 1
    while span < width:
        shift = min(span, width - span)
        widen(shift)
        n, span = n - shift, span + shift
    return begin, place[begin]


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the k-grams that are the smallest of a window: equal windows keep equal k-grams."""
    return np.unique(least_grams(hashes, first, k, window)[1])


def text_buffer(column: pa.Array | pa.ChunkedArray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return (raw if fold is None else fold[raw]), offsets - offsets[0]


def split_words(buffer: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of the byte class within each text."""
    flag = inside[buffer]
    begin, end = flag.copy(), flag.copy()
    begin[1:] &= ~flag[:-1]
    end[:-1] &= ~flag[1:]
    full = np.flatnonzero(np.diff(offsets))
    a, b = offsets[full], offsets[full + 1] - 1
    begin[a[flag[a]]] = True
    end[b[flag[b]]] = True
    starts = np.flatnonzero(begin)
    return Words(buffer, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def words_of(column, inside: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None) -> Words:
    return split_words(*text_buffer(column, fold), inside)


def split_kinds(buffer: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters and digits, and runs of punctuation, as separate words in text order."""
    kind = np.where(LETTER, 1, np.where(PUNCTUATION, 2, 0)).astype(np.uint8)[buffer]
    begin, end = kind > 0, kind > 0
    differs = kind[1:] != kind[:-1]
    begin[1:] &= differs
    end[:-1] &= differs
    full = np.flatnonzero(np.diff(offsets))
    a, b = offsets[full], offsets[full + 1] - 1
    begin[a[kind[a] > 0]] = True
    end[b[kind[b] > 0]] = True
    starts = np.flatnonzero(begin)
    return Words(buffer, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive bounds."""
    return np.diff(np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))[bounds])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece stay near ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs_to_mask(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions covered by any of the half-open ranges."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def mask_to_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lists(values, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if kind is None else pa.array(values, kind))


def annotate(docs: DataFrame, keep: list[str], fields: str, start: Callable[[], Callable[[pa.RecordBatch], list]], text: str = "text", read: Sequence[str] = ()) -> DataFrame:
    """The kept columns and new ones that a task computes from pieces of batches.

    ``start`` runs once per task and returns the function from a piece to the new columns. The piece
    holds the kept columns, the text and those of ``read``. A kept column of a new column's name gives
    way to it; one that must stay is carried inside a struct.
    """
    new = T._parse_datatype_string(fields)
    made = {f.name.lower() for f in new.fields}
    keep = [c for c in keep if c.lower() not in made]
    schema = T.StructType([docs.schema[c] for c in keep] + new.fields)
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for piece in chunks(batches, text):
            found = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(step(piece), kinds)]
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + found, schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text, *read])]).mapInArrow(run, schema)
