"""What the operators share: tables, the shared folder, and hashes of words and windows over whole batches of text."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written as materialise

__all__ = ["Words", "canonical", "free_name", "hot_join", "in_few_tasks", "materialise", "mix", "pieces", "released", "shuffle_partitions", "sliding_min", "table", "text_key"]

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers of the hash that a worker keeps; longer runs of bytes make their own and drop them.
POWERS = 3 << 19
_powers: list[np.ndarray] = []
#: Words of a very long text are looked at so many bytes at a time.
PIECE_BYTES = 1 << 19
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of df has, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: A key is hot if it holds more than one row in so many: there are no more hot keys than that.
HOT = 1_000


def hot_join(rows: DataFrame, found: DataFrame, on: str, often: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with found, which has one row per value of `on` and, in `often`, how many rows hold it. Hot values, which
    are few by their definition, are broadcast, so that their rows stay where they are; the others meet by a shuffle."""
    is_hot = F.col(often) * HOT > total
    hot = F.broadcast(found.where(is_hot).drop(often))
    rest = rows.join(F.broadcast(found.where(is_hot).select(on)), on, "left_anti").join(found.where(~is_hot).drop(often), on, how)
    return rows.join(hot, on).unionByName(rest)


#: Rows of intermediate results that are worth a task of their own.
TASK_ROWS = 50_000


def in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, which has about so many narrow rows, in tasks of TASK_ROWS, and one for each core at least. Else each shuffle
    partition would be a task and a file, however few rows there are."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers) and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, POWERS), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= POWERS:
        _powers[:] = made
    return made[0], made[1]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: a worker waits for its next task with little more than its code."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(run: Callable[[Iterator], Iterator], *clears: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """A function of batches that clears what it kept, and gives memory back, when its task ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for clear in (*clears, _powers.clear):
                clear()
            release()

    return task


class Words:
    """The words of many documents as one byte buffer: words one space apart, documents one newline apart.

    Only documents with a word may be given. A run of words of one document is a slice of the buffer, so the
    hash of any run comes from two prefix sums."""

    def __init__(self, docs: list[bytes]):
        self.data = b"\n".join(docs)
        buf = np.frombuffer(self.data, np.uint8)
        up, self._down = _tables(len(buf) + 1)
        gaps = np.flatnonzero((buf == 32) | (buf == 10))
        self.starts = np.concatenate([np.zeros(1, np.int64), gaps + 1])
        self.ends = np.concatenate([gaps, np.full(1, len(buf), np.int64)])
        self.doc = np.concatenate([np.zeros(1, np.int64), np.cumsum(buf[gaps] == 10)])
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def first_words(self) -> np.ndarray:
        """The number of the first word of each document."""
        return np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]]))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def run_hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all runs of `width` words within one document, and the runs' hashes."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return first, self.hashes(self.starts[first], self.ends[first + width - 1])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done, out = 1, a
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def canonical(text: str | None) -> bytes:
    """The words of a text, one space apart, in UTF-8; lone surrogates, which no UTF-8 file holds, become '?'."""
    if not text:
        return b""
    data = text.encode("utf-8", "replace").translate(_SPACES)
    if b"  " in data:
        letter = np.frombuffer(data, np.uint8) != 32
        letter[1:] |= letter[:-1].copy()  # the first space of a run stays
        data = np.frombuffer(data, np.uint8)[letter].tobytes()
    return data.strip(b" ")


def pieces(doc: bytes, width: int, limit: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, words) of stretches of about `limit` bytes of a canonical text, each of which repeats the
    last width - 1 words of the one before: every run of `width` words lies in exactly one."""
    limit, at, number = limit or PIECE_BYTES, 0, 0
    while len(doc) - at > limit:
        cut = doc.rfind(b" ", at, at + limit)
        n = doc.count(b" ", at, cut) + 1 if cut > 0 else 0
        if n < width:  # words as long as pieces
            cut, n = at - 1, width
            for _ in range(width):
                cut = doc.find(b" ", cut + 1)
                if cut < 0:
                    break
            if cut < 0:
                break
        yield number, doc[at:cut]
        for _ in range(width - 1):
            cut = doc.rfind(b" ", at, cut)
        at, number = cut + 1, number + n - width + 1
    yield number, doc[at:]


def text_key(text_col: str) -> "F.Column":
    """32 bits of a text's hash: tells rows apart that share an id."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 32).cast("long")
