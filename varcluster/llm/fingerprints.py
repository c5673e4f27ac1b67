"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text: each byte's random number, added to twice the hash before, so that a hash
depends on the last 32 bytes alone. A chunk ends where the hash has seven zero bits, from NORMAL bytes on where five
are enough (normalised chunking), and at MAX bytes at last; as MIN is 32, no hash that counts looks beyond its own
chunk. A shift of the text moves its chunks along. The fingerprint is the set of chunk digests with their lengths,
in order of digest; likeness is the share of a fingerprint's bytes whose chunks the other one holds.

`with_next` puts documents in descending order of id without a global sort in one task: a pass over the ids alone
gives ranges (one row per range comes to the driver), rows go to their range once, and the first row of each range
also goes to the range before it, where it follows the last. A task streams over its sorted ranges.

Nulls and edge cases: a null text is empty and has an empty fingerprint; an empty fingerprint is like another one only
if that is empty too; a row with a null id has no next document: its text is not edited, edited columns and near_*
are null; rows that share an id follow each other in the order of a hash of their texts; a table of one row is its own
next; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _tables, mix, released, shuffle_partitions, table

MIN, NORMAL, MAX = 32, 64, 256
STRICT, LOOSE = 0xFE000000, 0xF8000000
#: Texts are cut in blocks of so many characters.
BLOCK = 1 << 18
GEAR = np.random.default_rng(32).integers(0, 1 << 32, 256, np.uint32)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ITEM = np.dtype([("digest", ">u8"), ("length", ">u2")])


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The hash at each byte over itself and 31 before, by doubling the window five times."""
    h = GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct chunks as (digest, length), in order."""
    data = b"".join(texts)
    if not data:
        return [np.zeros(0, _ITEM)] * len(texts)
    buf = np.frombuffer(data, np.uint8)
    h = gear_hashes(buf)
    loose_at = np.flatnonzero((h & np.uint32(LOOSE)) == 0)
    strict = (loose_at[(h[loose_at] & np.uint32(STRICT)) == 0] + 1).tolist()
    loose = (loose_at + 1).tolist()
    cuts, counts, at = [0], [], 0
    find = bisect.bisect_left
    strict.append(1 << 62), loose.append(1 << 62)
    for text in texts:
        end, n = at + len(text), len(cuts)
        while end - at > MIN:
            cut = strict[find(strict, at + MIN)]
            if cut >= at + NORMAL:
                cut = min(loose[find(loose, at + NORMAL)], at + MAX)
            at = min(cut, end)
            cuts.append(at)
        if at < end:
            at = end
            cuts.append(at)
        counts.append(len(cuts) - n)
    up, down = _tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    edge = np.array(cuts)
    digest, length = mix((sums[edge[1:]] - sums[edge[:-1]]) * down[edge[:-1]]), np.diff(edge)
    out, a = [], 0
    for n in counts:
        d, first = np.unique(digest[a : a + n], return_index=True)
        items = np.empty(len(d), _ITEM)
        items["digest"], items["length"] = d, length[a : a + n][first]
        out.append(items)
        a += n
    return out


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes whose chunks b holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    da, db = a["digest"].astype(np.uint64), b["digest"].astype(np.uint64)
    at = np.minimum(np.searchsorted(db, da), len(db) - 1)
    lengths = a["length"].astype(np.int64)
    return float(lengths[db[at] == da].sum() / lengths.sum())


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) as ranges in descending order: (part, follower, doc_id, text), where a follower closes its
    part: it stands there for the last row's next alone. Partitions hold whole parts, in order."""
    spark = docs.sparkSession
    n = 4 * shuffle_partitions(spark)
    ids = docs.where("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id")
    ranges = sorted(tuple(r) for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).select("low", "high").collect())
    lows, highs = (np.array([r[i] for r in ranges], np.int64) for i in (0, 1))

    @F.pandas_udf("array<int>")
    def parts(ids: pd.Series) -> pd.Series:
        if not len(lows):
            return pd.Series([[-1]] * len(ids))
        x = ids.fillna(0).astype(np.int64).to_numpy()
        part = np.searchsorted(lows, x, "right") - 1
        return pd.Series([[-1] if null else [p, (p + 1) % len(lows)] if i == highs[p] else [p] for i, p, null in zip(x.tolist(), part.tolist(), ids.isna().tolist())])

    placed = docs.select("doc_id", "text", F.posexplode(parts("doc_id")).alias("follower", "part"))
    return placed.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "follower", F.desc("doc_id"), F.xxhash64("text"))


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []  # (doc_id, text, is follower); the last one's next has not come yet
    size = 0

    def done(rows: list[tuple], alone: bool = False) -> pa.RecordBatch:
        """Results for all rows but the last; alone: for one row without a next one."""
        raw = [t.encode() for _, t, _ in rows]
        edits = [] if alone else [(t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode() for (_, t, _), (_, u, _) in zip(rows, rows[1:])]
        prints = fingerprints(raw + edits)
        own, edited = prints[: len(rows)], prints[len(rows) :]
        columns: list[list] = [[] for _ in range(7)]
        for i in range(len(rows) if alone else len(rows) - 1):
            values = (rows[i][0], len(rows[i][1]), None, own[i].tobytes().hex(), None, None, None)
            if not alone:
                values = (*values[:2], hashlib.sha256(edits[i]).hexdigest(), values[3], edited[i].tobytes().hex(), containment(own[i], edited[i]), containment(own[i], own[i + 1]))
            for c, v in zip(columns, values):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    for batch in batches:
        for part, follower, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "follower", "doc_id", "text"))):
            text = text or ""
            if part < 0:
                yield done([(doc, text, False)], True)
                continue
            if waiting and waiting[-1][2]:
                if follower:  # rows that share the id of the follower: the first stands for them
                    continue
                if len(waiting) > 1:
                    yield done(waiting)
                waiting, size = [], 0
            waiting.append((doc, text, bool(follower)))
            size += len(text)
            if size >= BLOCK and len(waiting) > 1:
                yield done(waiting)
                waiting, size = waiting[-1:], 0
    if len(waiting) > 1:
        yield done(waiting)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness; see the module."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_next(rows).mapInArrow(released(_fingerprint_rows), SCHEMA)


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
