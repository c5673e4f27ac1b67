"""Packing by minimum bin slack.

A document's ids are cut at multiples of the capacity: each full piece is a sequence of its own, and the rest, shorter
than the capacity, is packed whole with others. A sequence is filled by its longest waiting piece and then by the
multiset of waiting lengths that comes closest to what is left: a dynamic program over a bitset holds every sum that
lengths, taken in descending order and as often as they wait, can reach; it stops once the exact sum is reached, and
stepping back through the bitsets gives the counts of each length.

Only lengths decide, and pieces are cut before they are packed, so a map task packs the pieces of its own partition
and nothing shuffles. A task packs once WINDOW pieces wait, and forgets words beyond KNOWN_BYTES, so its memory is
bounded; what lies in the last sequences of a window is the only padding. Sequence ids hold the partition and a count, so a task that is run again gives the
same ids.

Nulls and edge cases: a null text is an empty one and has the end id alone; a null doc_id passes through; repeated
rows are packed one by one; ties in length go in order of arrival; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_file
from .common import released, table

CAPACITY = 2048
END_ID = 1
#: Pieces that wait in a map task before it packs them.
WINDOW = 50_000
#: Bytes of words and their ids that a task remembers, what Python's own objects take included.
KNOWN_BYTES, KNOWN_COST = 96 << 20, 180
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once.

    The file's steps are: NFC, white space to a space, lower case, then words by a pattern. For texts of Latin letters
    those steps are run here and only words not met before go to the library; any other text goes to it whole."""

    #: Code points for which NFC changes nothing and lower case stays below U+0180.
    PLAIN = re.compile("[\\x00-įı-ſ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .bpe import latin_pattern

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        #: The pattern of the file; a fixed value of the format.
        self.words = latin_pattern(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not self.PLAIN.fullmatch(text) or self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, words = self.known, self.words.findall(text.lower())
        new = set(words).difference(known)
        if new:
            cost = sum(map(len, new)) + KNOWN_COST * len(new)
            if self.held + cost > KNOWN_BYTES:
                known.clear()
                self.held, new = 0, set(words)
            self.held += cost
            self._learn(list(new))
        out = b"".join([known[w] for w in words])
        for w in new:
            if len(w) > 64:
                del known[w]
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes new words as one text, a space apart; the library tells which word each id comes from."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
        if len(word) and word[-1] == len(words) - 1:
            cuts = np.searchsorted(word, np.arange(len(words) + 1)) * 4
            data, cuts = ids.tobytes(), cuts.tolist()
            self.known.update(zip(words, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
        else:
            for w, x in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
                self.known[w] = np.array(x.ids, "<u4").tobytes()


def fullest(lengths: list[int], waiting: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths, which descend, whose sum comes closest to room from below."""
    reach, whole, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, lot = min(waiting[length], room // length), 1
        while left:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= (reach << (length * lot)) & whole
            left -= lot
            lot *= 2
        if reach >> room & 1:
            break
    total, counts = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + lot
            total -= length * lot
    return counts


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of numbers into sizes, each of which fits the capacity."""
    queues: dict[int, deque] = defaultdict(deque)
    for i, size in enumerate(sizes):
        queues[size].append(i)
    waiting = {size: len(q) for size, q in queues.items()}
    lengths, out = sorted(waiting, reverse=True), []
    while lengths:
        most = lengths[0]
        waiting[most] -= 1
        counts = fullest([x for x in lengths if waiting[x]] if len(lengths) < 64 else _some(lengths, waiting), waiting, capacity - most)
        counts[most] = counts.get(most, 0) + 1
        waiting[most] += 1
        out.append([queues[size].popleft() for size, n in counts.items() for _ in range(n)])
        for size, n in counts.items():
            waiting[size] -= n
            if not waiting[size]:
                lengths.remove(size)
    return out


class _some(list):
    """Lengths that wait still, found as they are asked for."""

    def __init__(self, lengths: list[int], waiting: dict[int, int]):
        super().__init__(lengths)
        self.waiting = waiting

    def __iter__(self):
        return (x for x in super().__iter__() if self.waiting[x])


def _packer(tokenizer_path: str, capacity: int, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = WordIds(tokenizer_path), int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 32
        full, rest = [], []

        def rows(packed: bool) -> pa.RecordBatch:
            nonlocal sequence, full, rest
            out, full = full, []
            if packed:
                for members in pack([r[2] for r in rest], capacity):
                    offset = 0
                    for i in members:
                        out.append((*rest[i], sequence, offset))
                        offset += rest[i][2]
                    sequence += 1
                rest = []
            columns = list(zip(*out)) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = ids_of(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    row = (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                    if length == capacity:
                        full.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        rest.append(row)
            if len(rest) >= window or len(full) >= window:
                yield rows(len(rest) >= window)
        yield rows(True)

    return released(run)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, capacity, end_id, window), SCHEMA)


def op4_minimum_bin_slack_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file("word_bpe_49k.json"))
