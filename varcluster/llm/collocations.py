"""Phrase collocation mining: phrases that stand more often than their parts would by chance, counted with double-array tries.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Everything is per language.

1. Words are counted. Then candidates are found level by level by the Apriori rule: a phrase of k words can only stand LEAST
   times if both phrases of k - 1 words in it do. Tasks learn which those are from a bit table of FILTER_BITS, whatever
   the data: a set bit may also stand for another phrase, so nothing is lost and only more may come through. Of levels
   below the longest only hashes are counted, to set bits: of KEPT bits, in order, as differences packed by block and range, of
   which two phrases may share one, which again lets only more through. A last pass spells out each phrase of a block that is
   left, once, with its count there, and one with a sum of LEAST is a candidate.
2. Candidates are dealt by hash into tries of about TRIE_BYTES: states are phrases' beginnings, edges are words, and a state's
   successor by word w is place base + w of one array, if `check` there names the state. Each trie is built in a task;
   TOGETHER of them are broadcast (their size is bounded) and given up again after their pass over the texts, which cuts a
   block into words once for all of them.
3. In a pass every position of a block of text holds a state; numpy advances all of them by their next word, level by level,
   drops those without a successor, and counts accepting states by bincount. Counts of all blocks are summed.
4. Counts meet those of the parts of each cut by joins; scores are integer division of decimals, so they are exact while
   1000000 * a * a fits 38 digits. Candidates covered by a longer one go; the first of each language are taken in two
   steps, so no task ranks a language.

Passes grow with the number of candidates: one for each TOGETHER times TRIE_BYTES of them.

Nulls and edge cases: a null text is empty; a null language is `und`; a null id does not matter, nor do ids at all: repeated
rows count each; ties in rank go by count and then by phrase, as bytes; a very long text is read in blocks, whose phrases
over the border are counted once; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import copy
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, release, released, shuffle_partitions, table

LONGEST, LEAST, KEEP = 3, 10, 2000
COVERED_PERCENT = 50
SCALE = 1_000_000
NO_LANG = "und"
#: Bits of the table of phrases that may be extended.
FILTER_BITS = 1 << 26
#: Bytes of phrases in one trie, with their overhead; words of a block of text.
TRIE_BYTES, PHRASE_COST = 16 << 20, 16
BLOCK_WORDS = 1 << 21
#: Tries that share a pass over the texts.
TOGETHER = 8
#: Bits of a hash that are counted, and words of the texts for each range of them that meets in one group.
KEPT = 40
RANGE_WORDS = 1 << 21
#: Phrases of a trie whose counts travel as one row.
COUNTED = 1 << 16
#: A text is cut into words so many bytes at a time.
SLICE_BYTES = 1 << 20
#: Rows of a language are ranked in so many shares first.
SHARES = 64

#: A-Z become small; piece borders become 0xFF, which UTF-8 never holds, and tabs spaces.
_BORDER = b"\xff"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _BORDER * 10 + b" ")
COUNTS = "lang string, phrase string, n long"
#: Rows that a task sends at once.
SENT = 1 << 17
#: Where a state without successors stands: far before any place.
NOWHERE = -(1 << 31)
#: Bits of the low digit of a word's number.
DIGIT = 10
LOW = (1 << DIGIT) - 1
#: Places of an array that are looked at together when it is filled.
WINDOW = 2048


def slices(data: bytes) -> Iterator[bytes]:
    """Stretches of about SLICE_BYTES that end where a word does."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        cut = max(data.rfind(b" ", at + 1, at + SLICE_BYTES), data.rfind(_BORDER, at + 1, at + SLICE_BYTES))
        if cut < 0:  # a word longer than that
            ends = [x for x in (data.find(b" ", at + SLICE_BYTES), data.find(_BORDER, at + SLICE_BYTES)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield data[at:cut]
        at = cut
    yield data[at:]


class _Numbers(dict):
    """Numbers of a language's words, given as they come; all languages of a block share the lists."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({_BORDER: 0})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.langs.append(self.lang)
        self[word] = n = len(self.words)
        return n


class _Known(dict):
    """Numbers of words that have one; others have 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Block:
    """ids: the words of many texts by number, 0 between pieces and for words without one; words, langs: by number - 1;
    fresh: whether a phrase may end here, which it may not in words that a block repeats from the one before."""

    def __init__(self, parts: list[np.ndarray], stale: list[tuple[int, int]], words: list[bytes], langs: list[str]):
        self.ids, self.words, self.langs = np.concatenate(parts), words, langs
        self.fresh = np.ones(len(self.ids), bool)
        for start, n in stale:
            self.fresh[start : start + n] = False

    def renumbered(self, known: dict[str, _Known]) -> "Block":
        """The same places with the numbers of those words that have one."""
        out = copy.copy(self)
        none = _Known()
        numbers = (known.get(lang, none)[w] for w, lang in zip(self.words, self.langs))
        out.ids = np.concatenate([np.zeros(1, np.int32), np.fromiter(numbers, np.int32, len(self.words))])[self.ids]
        return out

    def spelled(self, at: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of the phrases at these places."""
        words = pa.array(self.words, pa.binary())
        parts = [words.take(pa.array(self.ids[at + k] - 1)) for k in range(size)]
        text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if size > 1 else parts[0]
        return pa.array(self.langs, pa.string()).take(pa.array(self.ids[at] - 1)), text.cast(pa.string())


def blocks(batches: Iterator[pd.DataFrame], overlap: int, known: dict[str, _Known] | None = None, times: int = 1) -> Iterator[Block]:
    """The texts of batches of (lang, text) as blocks of about `times` BLOCK_WORDS. A text cut in two brings its last `overlap` words
    along. known: the numbers of those words that have one; without it, all are numbered anew in each block."""
    words, langs = [], []
    numbers: dict[str, _Numbers] = {}
    parts, stale, size = [], [], 0
    border = np.zeros(1, np.int32)
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if known is not None and lang not in known:
                continue
            tail: list[bytes] = []
            for piece in slices(text.encode("utf-8", "replace").translate(_FOLD)):
                if known is not None:
                    own = known[lang]
                elif lang in numbers:
                    own = numbers[lang]
                else:
                    own = numbers[lang] = _Numbers(lang, words, langs)
                found = tail + piece.replace(_BORDER, b" \xff ").split()
                ids = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
                if tail:
                    parts.append(border)
                    stale.append((size + 1, len(tail)))
                    size += 1
                parts.append(ids)
                size += len(ids)
                tail = found[-overlap:] if overlap else []
                if size >= times * BLOCK_WORDS:
                    yield Block([*parts, border], stale, words, langs)
                    words, langs, numbers, parts, stale, size = [], [], {}, [], [], 0
            parts.append(border)
            size += 1
    if size:
        yield Block([*parts, border], stale, words, langs)


def word_hashes(words: list[bytes], langs: list[str]) -> np.ndarray:
    """64 bits of each word and its language."""
    seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace")) for lang in set(langs)}
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[lang]) for w, lang in zip(words, langs)), np.uint64, len(words))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of phrases and one more word each."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = (h & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def allowed(block: Block, size: int, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size from 2 on, the places and hashes of its phrases whose shorter ones are, level by level, all in the table."""
    ids = block.ids
    own = np.concatenate([np.zeros(1, np.uint64), word_hashes(block.words, block.langs)])
    word = _set(table, own)
    word[0] = False
    h = own[ids]
    gram, may = h, word[ids]  # of each place, the phrase of the last level and whether it may grow
    for level in range(2, size + 1):
        at = np.flatnonzero(may[:-1] & may[1:])
        at = at[at + level <= len(ids)]
        found = _longer(gram[at], h[at + level - 1])
        yield level, at, found
        if level < size:
            gram, may = np.zeros(len(ids), np.uint64), np.zeros(len(ids), bool)
            gram[at], may[at] = found, _set(table, found)


def _counted(block: Block, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct phrase among these places first stands, and how often it does."""
    code, first = block.ids[at].astype(np.int64), None
    for k in range(1, size):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code << 32 | block.ids[at + k]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def phrases_of(block: Block, size: int, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size from 2 on, where each distinct phrase first stands and how often it does, if it may be a candidate."""
    for level, at, found in allowed(block, size, table):
        kept = block.fresh[at + level - 1]
        if level < size:
            kept &= _set(table, found)
        yield level, *_counted(block, at[kept], level)


def _as_pandas(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.to_pandas()


def _sent(block: Block, size: int, at: np.ndarray, n: np.ndarray, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(at), SENT):
        part = slice(a, a + SENT)
        columns = [*block.spelled(at[part], size), pa.array(n[part], pa.int64()), *[pa.array(x[part], pa.int64()) for x in more.values()]]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", *more])


def counted_words(texts: DataFrame) -> DataFrame:
    """COUNTS of words, with h, their hash; texts: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(_as_pandas(batches), 0, times=4):  # words are counted in little memory
            n = np.bincount(block.ids, minlength=len(block.words) + 1)[1:]
            first = np.zeros(len(n) + 1, np.int64)
            first[block.ids[::-1]] = np.arange(len(block.ids))[::-1]
            yield from _sent(block, 1, first[1:], n, h=word_hashes(block.words, block.langs).view(np.int64))

    rows = texts.mapInArrow(released(run), f"{COUNTS}, h long").repartition("lang", "phrase")  # a block has sent each word once
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("h").alias("h"))


def _by_place(h: np.ndarray, bits: int) -> np.ndarray:
    """KEPT bits of hashes, those of their place in a table of so many bits first."""
    low = bits.bit_length() - 1
    return (h & np.uint64(bits - 1)) << np.uint64(KEPT - low) | (h >> np.uint64(low)) & np.uint64((1 << KEPT - low) - 1)


def pack_counts(h: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct numbers in order and their counts: differences, byte by byte, compressed."""
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    apart = planes(np.diff(h).astype("<u8"))
    used = np.flatnonzero(apart.any(axis=1))
    width = int(used[-1]) + 1 if len(used) else 0
    raw = struct.pack("<qQq", len(h), int(h[0]), width) + apart[:width].tobytes() + planes(n.astype("<u4")).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size, first, width = struct.unpack_from("<qQq", raw)
    apart = np.zeros((8, size - 1), np.uint8)
    apart[:width] = np.frombuffer(raw, np.uint8, width * (size - 1), 24).reshape(width, size - 1)
    h = np.full(size, first, np.uint64)
    h[1:] += np.cumsum(np.ascontiguousarray(apart.T).view("<u8")[:, 0], dtype=np.uint64)
    n = np.frombuffer(raw, np.uint8, 4 * size, 24 + width * (size - 1)).reshape(4, size)
    return h, np.ascontiguousarray(n.T).view("<u4")[:, 0].astype(np.int64)


def frequent_bits(texts: DataFrame, size: int, table: np.ndarray, least: int, words: int) -> DataFrame:
    """(slot, word): the bits of phrases of so many words that stand LEAST times, by hash, of those whose shorter ones are in the
    table; of a table like it. words: how many the texts have."""
    spark, bits = texts.sparkSession, 8 * len(table)
    shared = spark.sparkContext.broadcast(table)
    ranges = max(shuffle_partitions(spark), -(-words // RANGE_WORDS))
    edges = np.array([-(-(k << KEPT) // ranges) for k in range(ranges)], np.uint64)
    shift = np.uint64(KEPT + 1 - bits.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(_as_pandas(batches), size - 1):
            for level, at, found in allowed(block, size, shared.value):
                if level == size:
                    h, n = np.unique(_by_place(found[block.fresh[at + level - 1]], bits), return_counts=True)
                    cuts = [*np.searchsorted(h, edges).tolist(), len(h)]
                    kept = [(k, pack_counts(h[a:b], np.minimum(n[a:b], least))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                    yield pa.RecordBatch.from_pydict({"range": pa.array([k for k, _ in kept], pa.int32()), "data": pa.array([d for _, d in kept], pa.binary())})

    def often(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_counts(d) for d in group["data"]]
        h, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        by = np.argsort(h, kind="stable")
        h, n = h[by], n[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        place = np.unique(h[first][np.add.reduceat(n, first) >= least] >> shift)
        slot, starts = np.unique(place >> np.uint64(6), return_index=True)
        word = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), starts) if len(place) else place
        del parts, h, n, by
        release()
        return pd.DataFrame({"slot": slot.astype(np.int64), "word": word.view(np.int64)})

    return texts.mapInArrow(released(run), "range int, data binary").groupBy("range").applyInPandas(often, "slot long, word long")


def counted_phrases(texts: DataFrame, size: int, table: np.ndarray) -> DataFrame:
    """COUNTS of the phrases of two to so many words that may be candidates."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(_as_pandas(batches), size - 1, times=2):  # fewer blocks spell fewer phrases twice
            for level, at, n in phrases_of(block, size, shared.value):
                yield from _sent(block, level, at, n)

    # a block has sent each phrase once: sums before the shuffle would take memory and save little
    return texts.mapInArrow(released(run), COUNTS).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bits_of(hashes: DataFrame, bits: int) -> DataFrame:
    """(slot, word): the bits of the hashes h in a table of so many."""
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    return hashes.select(F.shiftright(bit, 6).alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("word"))


def bit_table(rows: DataFrame, bits: int) -> np.ndarray:
    """A table of so many bits, as bytes, in which those of (slot, word) are set. Its rows are no more than a word of 64 bits each."""
    rows = rows.groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[rows["slot"].to_numpy()] = rows["word"].to_numpy()
    return table.view(np.uint8)


class Trie:
    """A double array over numbered words. The state after one word is the word's number; any other is a place of the array.
    An edge by a word is two by its digits, number >> DIGIT and the rest, so successors of a state lie close together. State s
    is followed by digit d at place base[s] + d if check there is s; accept: the number of the phrase that ends in a state, -1
    for none. words: numbers of the words, by language."""

    def __init__(self, langs: list[str], phrases: list[str]):
        self.words: dict[str, _Known] = {}
        longest, count = 0, 0
        spelled = []
        for lang, phrase in zip(langs, phrases):
            own = self.words.setdefault(lang, _Known())
            ids = []
            for w in phrase.encode().split(b" "):
                n = own.get(w)
                if n is None:
                    count += 1
                    n = own[w] = count
                ids.append(n)
            spelled.append(ids)
            longest = max(longest, len(ids))
        size = np.array([len(x) for x in spelled], np.int64)
        ids = np.zeros((len(spelled), max(longest, 1)), np.int64)
        for k in range(longest):
            has = size > k
            ids[has, k] = [x[k] for x in spelled if len(x) > k]
        self._used, self._check, self._filled = np.ones(count + 1, bool), np.full(count + 1, -1, np.int64), np.full(count // WINDOW + 1, WINDOW)
        self._filled[-1] = count % WINDOW + 1
        state, ends = ids[:, 0].copy(), np.where(size == 1, ids[:, 0], -1)
        bases: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, longest):
            rows = np.flatnonzero(size > k)
            for digit in (ids[rows, k] >> DIGIT, ids[rows, k] & LOW):
                edges, which = np.unique(state[rows] << 32 | digit, return_inverse=True)
                parents, children = edges >> 32, edges & 0xFFFFFFFF
                places = self._place(parents, children)
                bases.append((parents, places - children))
                state[rows] = places[which]
            last = rows[size[rows] == k + 1]
            ends[last] = state[last]
        n = len(self._used)
        self.base, self.check, self.accept = np.full(n, NOWHERE, np.int32), self._check.astype(np.int32), np.full(n, -1, np.int32)
        for parents, base in bases:
            self.base[parents] = base
        self.accept[ends] = np.arange(len(ends))
        self.size = len(ends)
        del self._used, self._check, self._filled

    def _grown(self, n: int) -> None:
        more = n - len(self._used)
        if more > 0:
            more += n >> 2
            self._used, self._check = np.append(self._used, np.zeros(more, bool)), np.append(self._check, np.full(more, -1, np.int64))
            self._filled = np.append(self._filled, np.zeros((len(self._used) - 1) // WINDOW + 1 - len(self._filled), np.int64))

    def _place(self, parents: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Places for edges in order of parent and child: those of one parent have the distances of its children. Parents of many
        children go first; lone children fill what is left."""
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(starts, len(parents)))
        places = np.empty(len(parents), np.int64)
        for g in np.argsort(-counts, kind="stable").tolist():
            if counts[g] == 1:
                break
            own = slice(starts[g], starts[g] + counts[g])
            ahead = children[own] - children[starts[g]]
            found, window = -1, -1
            while found < 0:  # windows so full that no place in them is likely to fit are passed over
                ahead_of = np.flatnonzero(self._filled[window + 1 :] <= WINDOW * min(0.6, 4 / len(ahead)))
                window += 1 + int(ahead_of[0]) if len(ahead_of) else len(self._filled) - window
                self._grown((window + 1) * WINDOW + int(ahead[-1]) + 1)
                free = np.flatnonzero(~self._used[window * WINDOW : (window + 1) * WINDOW]) + window * WINDOW
                a, chunk = 0, 16  # most fit early on
                while a < len(free) and found < 0:
                    fits = ~self._used[free[a : a + chunk, None] + ahead].any(axis=1)
                    if fits.any():
                        found = int(free[a + fits.argmax()])
                    a, chunk = a + chunk, 8 * chunk
            places[own] = found + ahead
            self._take(places[own], parents[starts[g]])
        lone = starts[counts == 1]
        self._grown(len(self._used) + max(0, len(lone) - int((~self._used).sum())))
        places[lone] = np.flatnonzero(~self._used)[: len(lone)]
        self._take(places[lone], parents[lone])
        return places

    def _take(self, places: np.ndarray, parents: np.ndarray | int) -> None:
        self._used[places] = True
        self._check[places] = parents
        np.add.at(self._filled, places // WINDOW, 1)

    def count(self, block: Block) -> np.ndarray:
        """How often each phrase ends where it may: all positions advance by a word at a time."""
        ids, out = block.ids, np.zeros(self.size, np.int64)
        at, state = np.flatnonzero(ids), ids[np.flatnonzero(ids)].astype(np.int64)
        step = 0
        while len(at):
            done = self.accept[state]
            done = done[(done >= 0) & block.fresh[at + step]]
            if len(done):
                out += np.bincount(done, minlength=self.size)
            step += 1
            inside = at + step < len(ids)
            at, state = at[inside], state[inside]
            more = (ids[at + step] > 0) & (self.base[state] > NOWHERE)
            at, state = at[more], state[more]
            for digit in (lambda w: w >> DIGIT, lambda w: w & LOW):
                place = self.base[state].astype(np.int64) + digit(ids[at + step])
                ok = (place >= 0) & (place < len(self.check))
                at, state, place = at[ok], state[ok], place[ok]
                ok = self.check[place] == state
                at, state = at[ok], place[ok]
        return out

    def packed(self) -> bytes:
        out = io.BytesIO()
        words = [(lang, own) for lang, own in self.words.items()]
        spelled = {f"w{i}": np.frombuffer(b" ".join(own), np.uint8) for i, (_, own) in enumerate(words)}
        numbers = {f"n{i}": np.fromiter(own.values(), np.int32, len(own)) for i, (_, own) in enumerate(words)}
        np.savez(out, langs=np.array([lang for lang, _ in words], str), base=self.base, check=self.check, accept=self.accept, size=self.size, **spelled, **numbers)
        return zstandard.ZstdCompressor(level=3).compress(out.getvalue())

    @classmethod
    def unpacked(cls, data: bytes) -> "Trie":
        got = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)))
        trie = cls.__new__(cls)
        trie.base, trie.check, trie.accept, trie.size = got["base"], got["check"], got["accept"], int(got["size"])
        trie.words = {str(lang): _Known(zip(got[f"w{i}"].tobytes().split(b" "), got[f"n{i}"].tolist())) for i, lang in enumerate(got["langs"])}
        return trie


def tries_of(candidates: DataFrame, trie_bytes: int = TRIE_BYTES) -> tuple[DataFrame, int]:
    """(trie, at, lang, phrase, data) and the number of tries: a row for each candidate with its trie and its number there, and
    one for each trie with its data."""
    total = candidates.agg(F.sum(F.octet_length("phrase") + PHRASE_COST).alias("n")).first()["n"] or 0
    n = -(-total // trie_bytes)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lang", "phrase"])
        data = Trie(frame["lang"].tolist(), frame["phrase"].tolist()).packed()
        number = int(frame["trie"].iloc[0])
        rows = pd.DataFrame({"trie": number, "at": np.arange(len(frame)), "lang": frame["lang"].to_numpy(), "phrase": frame["phrase"].to_numpy(), "data": None})
        return pd.concat([rows, pd.DataFrame({"trie": [number], "at": [-1], "lang": [None], "phrase": [None], "data": [data]})])

    dealt = candidates.select("lang", "phrase", F.pmod(F.xxhash64("lang", "phrase"), F.lit(max(n, 1))).cast("int").alias("trie"))
    return dealt.groupBy("trie").applyInPandas(build, "trie int, at int, lang string, phrase string, data binary"), n


def summed(group: pd.DataFrame) -> pd.DataFrame:
    """(trie, at, n) of packed counts (trie, first, data) of the same phrases of a trie."""
    first, total = int(group["first"].iloc[0]), np.zeros(COUNTED, np.int64)
    for data in group["data"]:
        at, n = unpack_counts(data)
        total[at.astype(np.int64) - first] += n
    at = np.flatnonzero(total)
    return pd.DataFrame({"trie": int(group["trie"].iloc[0]), "at": at + first, "n": total[at]})


def counted_by_tries(texts: DataFrame, candidates: DataFrame, longest: int, trie_bytes: int = TRIE_BYTES, together: int = TOGETHER) -> DataFrame:
    """COUNTS of the candidates (lang, phrase), one pass over texts for so many tries."""
    spark = texts.sparkSession
    tries, n = tries_of(candidates, trie_bytes)
    tries = materialise(tries, "tries")
    found = None
    for start in range(0, n, together):
        shared = []
        for number in range(start, min(start + together, n)):
            data = tries.where((F.col("trie") == number) & (F.col("at") == -1)).select("data").toArrow()["data"]
            if len(data):  # else no candidate has this hash
                shared.append((number, spark.sparkContext.broadcast(data[0].as_py())))
            del data
        if not shared:
            continue

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            totals: dict[int, np.ndarray] = {}
            for block in blocks(batches, longest - 1):
                for number, packed in shared:
                    trie = Trie.unpacked(packed.value)
                    own = trie.count(block.renumbered(trie.words))
                    totals[number] = totals[number] + own if number in totals else own
                    del trie
            for number, total in totals.items():
                for first in range(0, len(total), COUNTED):
                    at = np.flatnonzero(total[first : first + COUNTED]) + first
                    if len(at):
                        yield pd.DataFrame({"trie": [number], "first": [first], "data": [pack_counts(at.astype(np.uint64), total[at])]})

        sums = texts.mapInPandas(released(run), "trie int, first int, data binary").groupBy("trie", "first").applyInPandas(summed, "trie int, at int, n long")
        part = materialise(sums, "trie-counts")
        for _, packed in shared:
            packed.destroy()  # its counts are written
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], COUNTS)
    return tries.where("at >= 0").join(found, ["trie", "at"]).select("lang", "phrase", "n")


def scored(counts: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of counts (lang, phrase, n): the cut of lowest score, of equal ones the first. parts:
    COUNTS of everything that a cut can leave."""
    words = F.split("phrase", " ")
    joined = lambda w: F.array_join(w, " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), joined(F.slice(words, F.lit(1), k)).alias("first"), joined(F.slice(words, k + 1, F.size(words))).alias("rest"))))
    cuts = counts.select("lang", "phrase", F.col("n").alias("a"), cut.alias("c")).select("lang", "phrase", "a", "c.*")
    left, right = (parts.select("lang", F.col("phrase").alias(on), F.col("n").alias(n)) for on, n in (("first", "l"), ("rest", "r")))
    rows = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumns({"above": F.lit(SCALE).cast("decimal(7,0)") * (wide("a") * wide("a")), "below": wide("l") * wide("r")}).withColumn("score", F.expr("above div below"))
    best = rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(counts: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """counts (lang, phrase, n) without those that lie in a longer one that stands so many percent as often."""
    words, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    longer = counts.where(size > 2).select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("more")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    return counts.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("more") * 100 < F.col("n") * percent, F.lit(True))).drop("more")


def best_of(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """The first of each language with their rank: of each share of a language first, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= keep).drop("rank", "share")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, keep: int = KEEP, bits: int = FILTER_BITS, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    words = materialise(counted_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.where(F.col("n") >= least)
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    table = bit_table(bits_of(often, bits), bits)
    for size in range(2, longest):
        table |= bit_table(frequent_bits(texts, size, table, least, total), bits)
    candidates = materialise(counted_phrases(texts, longest, table).where(F.col("n") >= least).select("lang", "phrase"), "phrases")
    counts = materialise(counted_by_tries(texts, candidates, longest, trie_bytes).where(F.col("n") >= least), "phrase-counts")
    rows = best_of(scored(uncovered(counts), often.drop("h").unionByName(counts)), keep)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
