"""Best-fit packing of tokenised documents into sequences, improved by swaps (operator 10).

Documents are tokenised and cut into pieces in one pass that keeps lengths and digests only. Pieces
are dealt into groups of bounded size. A group is packed best fit first, longest piece first; then a
local search exchanges pieces between underfull sequences until no exchange raises the sum of squared
fills, so nearly empty sequences drain and vanish. What stays underfull is pooled over groups and
packed once more.

Nulls and empty texts are documents of the end token alone. Repeated rows are packed once each. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import settle, table
from motoquant.llm.words import LOWER, Words, byte_class, chunks, mix, runs_to_mask, split_words, text_buffer

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 32_768
VOCABULARY = "word_bpe_49k.json"
KNOWN_UNITS = 2_000_000  # tokenised units a worker remembers; forgetting costs time only


# Fixed value: byte-level models show a byte as a character, printable bytes as themselves.
_SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
BYTE_SPELLING = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}

# Kinds of bytes in plain words: the vocabulary cuts runs of letters, single digits and runs of the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(256) if b not in (0x20, *range(0x09, 0x0E))]] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
# Words with other bytes (controls, apostrophes, "<" of special tokens, characters past U+00FF) are not cut here.
_ODD = byte_class(lambda b: b < 0x21 and b not in (0x20, *range(0x09, 0x0E)) or b in (0x27, 0x3C, 0x7F) or b >= 0xC0 and b != 0xC3)


class WordTokenizer:
    """Token ids of whole texts through a memory of tokenised units.

    For tokenizers that drop white space, lower-case, and cut letters, digits and the rest apart. In
    words of ASCII and accented Latin-1 letters these cuts are made on the bytes and each distinct
    part goes to the model once. Every other word takes the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = KNOWN_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.forget()

    def forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def units(column) -> tuple[Words, np.ndarray]:
        """Parts of plain words, whole other words, and which are the latter."""
        raw, offsets = text_buffer(column)
        words = split_words(raw, offsets)
        after = np.concatenate(([False], raw[:-1] == 0xC3))
        odd = _ODD[raw] | after & ((raw == 0x97) | (raw == 0xB7)) | (raw >= 0x80) & (raw < 0xC0) & ~after
        count = np.concatenate(([0], np.cumsum(odd)))
        whole = count[words.ends] > count[words.starts]
        inside = runs_to_mask(len(raw), words.starts[whole], words.ends[whole]) if whole.any() else None
        low = LOWER[raw] + np.where(after & (raw >= 0x80) & (raw < 0x9F), 0x20, 0).astype(np.uint8)
        kind = _KIND[raw]
        begin = (kind == 2) & (kind > 0)
        begin[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
        if inside is not None:
            low[inside] = raw[inside]
            begin[inside] = False
        begin[words.starts] = True
        starts = np.flatnonzero(begin)
        owner = np.searchsorted(words.starts, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(raw)), words.ends[owner])
        return Words(low, starts, ends, np.searchsorted(starts, offsets)), whole[owner]

    def tokens(self, unit: bytes, whole: bool) -> list[int]:
        text = unit.decode("utf-8", "replace")
        if whole:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        spelled = text if text.isascii() else "".join(BYTE_SPELLING[b] for b in unit)
        return [t.id for t in self.tokenizer.model.tokenize(spelled)]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, and where each text's ids begin."""
        units, whole = self.units(column)
        code, distinct = pd.factorize(units.hashes())
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(~(self.known[np.minimum(at, len(self.known) - 1)] == distinct) if len(self.known) else np.ones(len(distinct), bool))
        if len(new):
            if len(self.known) + len(new) > self.limit:
                self.forget()
                new = np.arange(len(distinct))
            sample = np.empty(len(distinct), np.int64)
            sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            found = [self.tokens(units.word(i), whole[i]) for i in sample[new]]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            known = np.concatenate((self.known, distinct[new]))
            self.slot = np.concatenate((self.slot, np.arange(len(found)) + len(self.begin) - 1))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))))
            order = np.argsort(known, kind="stable")
            self.known, self.slot = known[order], self.slot[order]
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][code]
        sizes = self.begin[slot + 1] - self.begin[slot]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.begin[slot] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[units.first]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: only documents longer than the capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = WordTokenizer(tokenizer), 0
        task = TaskContext.get().partitionId()
        for batch in chunks(batches):
            ids, begin = encoder.encode(batch.column("text"))
            out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "crc": []}
            for row in range(batch.num_rows):
                own = np.append(ids[begin[row] : begin[row + 1]], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    for name, value in (("row", row), ("piece", piece), ("start", start), ("length", len(cut)), ("crc", zlib.crc32(cut.tobytes()))):
                        out[name].append(value)
            n = len(out["row"])
            deal = mix(np.arange(seen, seen + n, dtype=np.uint64) + (np.uint64(task) << np.uint64(40))).view(np.int64)
            seen += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()),
                 pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), pa.array(deal)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that still takes it."""
    bin_of = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # room sizes that some bin has, ascending
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        else:
            room, b, n = capacity, n, n + 1
        bin_of[i] = b
        if room := room - size:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(b)
    return bin_of


def swap_search(lengths: np.ndarray, bin_of: np.ndarray, capacity: int) -> np.ndarray:
    """Exchanges between underfull bins that raise the sum of squared fills, until none is left.

    A donor gives one or two pieces, ``s`` tokens, and takes back a piece of ``y`` tokens or nothing
    (``y`` = 0). For the receiver, let ``rest`` be its fill without ``y``. The exchange fits if
    ``rest + s <= capacity``, and changes the sum by 2 * (s - y) * (rest + s - donor), so it counts if
    ``y < s`` and ``rest + s > donor``. ``least`` has the smallest ``y`` of every ``rest``, so one sliding
    minimum over it tells of every ``s`` at once whether the donor has an exchange. Donors come emptiest
    first, and the search ends when a sweep over all underfull bins exchanges nothing.
    """
    bin_of = bin_of.copy()
    n, none = int(bin_of.max()) + 1 if len(bin_of) else 0, 4 * capacity
    fill = np.bincount(bin_of, weights=lengths, minlength=n).astype(np.int64).tolist()
    held: list[dict[int, list[int]]] = [{} for _ in range(n)]  # by bin: size, pieces of that size
    for i, (b, size) in enumerate(zip(bin_of.tolist(), lengths.tolist())):
        held[b].setdefault(size, []).append(i)
    offers: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # by rest: y, bin, its stamp
    least = np.full(capacity + 1, none, np.int64)
    stamp = [0] * n
    ramp = np.arange(1, capacity + 1)

    def offer(b: int) -> None:
        if 0 < fill[b] < capacity:
            for y in (0, *held[b]):
                heapq.heappush(offers[fill[b] - y], (y, b, stamp[b]))
                least[fill[b] - y] = offers[fill[b] - y][0][0]

    def withdraw(b: int) -> None:
        stamp[b] += 1
        for y in (0, *held[b]):
            heap = offers[fill[b] - y]
            while heap and heap[0][2] != stamp[heap[0][1]]:
                heapq.heappop(heap)
            least[fill[b] - y] = heap[0][0] if heap else none

    def move(size: int, source: int, to: int) -> None:
        i = held[source][size].pop()
        if not held[source][size]:
            del held[source][size]
        held[to].setdefault(size, []).append(i)
        bin_of[i] = to
        fill[source] -= size
        fill[to] += size

    def given(donor: int) -> tuple[int, ...] | None:
        """Sizes the donor can give: its longest such piece, else the heaviest such pair."""
        width = capacity - fill[donor]
        low, reach = least, 1
        while 2 * reach <= width:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        sizes = np.sort(np.fromiter(held[donor], np.int64, len(held[donor])))
        able = sizes[low[fill[donor] - sizes + 1] < sizes]
        if len(able):
            return (int(able[-1]),)
        twice = np.array([len(held[donor][size]) > 1 for size in sizes.tolist()], bool)
        a, b = np.triu_indices(len(sizes), 1)
        a, b = np.concatenate((sizes[a], sizes[twice])), np.concatenate((sizes[b], sizes[twice]))
        able = np.flatnonzero(low[fill[donor] - a - b + 1] < a + b)
        if not len(able):
            return None
        at = able[(a + b)[able].argmax()]
        return int(a[at]), int(b[at])

    def drain(donor: int) -> bool:
        """Exchange until the donor has none; true if there was any."""
        changed = False
        withdraw(donor)
        while fill[donor] and (out := given(donor)):
            s = sum(out)
            window = least[fill[donor] - s + 1 : capacity - s + 1]
            rest = fill[donor] - s + 1 + int(((s - window) * ramp[: len(window)]).argmax())
            y, to, _ = offers[rest][0]
            withdraw(to)
            for size in out:
                move(size, donor, to)
            if y:
                move(y, to, donor)
            offer(to)
            changed = True
        offer(donor)
        return changed

    for b in range(n):
        offer(b)
    while any([drain(b) for b in sorted(range(n), key=fill.__getitem__) if 0 < fill[b] < capacity]):
        pass
    return bin_of


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _pack_groups(rows: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["deal", "piece"], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy(np.int64)
        bin_of = swap_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bin_of, kind="stable")
        part, bins, sizes = part.iloc[order], bin_of[order], lengths[order]
        before = np.cumsum(sizes) - sizes
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        group = int(part["pack_group"].iloc[0])
        return part[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
            sequence_id=(level << 58) + (group << 32) + bins, offset=offset, fill=np.bincount(bins, weights=sizes).astype(np.int64)[bins],
        )

    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("deal", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, PACKED)


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Sequence and offset of every piece.

    Groups hold ``group_pieces`` pieces on average whatever the size of the input. The second level
    takes every piece of a sequence that is less than 99 percent full.
    """
    groups = max(1, -(-rows.count() // group_pieces))
    first = settle(_pack_groups(rows, groups, 0, capacity), "packed")
    if groups == 1:
        return first.drop("fill")
    full = F.col("fill") >= 0.99 * capacity
    rest = first.filter(~full)
    again = max(1, -(-rest.count() // group_pieces))
    rest = rest.withColumn("deal", F.xxhash64("sequence_id", "offset")).drop("sequence_id", "offset", "fill")
    return first.filter(full).unionByName(_pack_groups(rest, again, 1, capacity)).drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenise, cut and pack; one row per piece."""
    return pack(settle(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, group_pieces)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_vocabulary())
