"""Substring dedup by super-k-mers.

A window is 13 consecutive words of one document. Each window has a minimiser: the least hash of its word triples.
Consecutive windows with the same minimiser form a super-k-mer, which travels as one packed string of words to the
bucket of its minimiser, so that all occurrences of a window meet there. A bucket sorts its windows by hash, compares
the bytes of those with equal hashes, and finds for each distinct window the smallest doc_id it starts in; the words
of its other windows are ranges to remove. Ranges go back to their documents by doc_id.

Before strings travel, a map task keeps each distinct string once, with its smallest doc_id: further local documents
with that string are already known to lose its words. So a passage that a third of all documents share reaches its
bucket once a task, not once a document. Strings of one bucket are compressed together. Map tasks flush at a fixed
number of bytes, what Python's own objects take included, and give their memory back when they end. A very long text is
looked at in pieces that overlap by 12 words, so hashes take a fixed space whatever its length.

A pass before that counts the bytes of super-k-mers in CELLS cells of minimisers, with map-side sums. Buckets are as many
as BUCKET_BYTES asks for, and a multiple of spark.sql.shuffle.partitions at least. Where a cell alone would fill a
bucket (lines of one template, with distinct words around it), its windows travel one by one to the bucket of their own
hash, which equal windows share; so no bucket grows with one minimiser, whatever its share of the corpus.

Nulls and edge cases: a null text has no words; a row whose doc_id is null takes no part and keeps all its words;
documents of fewer than 13 words keep them all; rows with equal doc_id never remove each other's words, however often
they are repeated (rows that share an id but not the text are told apart by 32 bits of the text's hash); an empty
table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, canonical, free_name, mix, pieces, release, released, shuffle_partitions, sliding_min, text_key

WINDOW = 13
GRAM = 3
#: Words are hashed in blocks of so many bytes of text, and packed strings leave a map task at so many bytes.
BLOCK_BYTES = 1 << 20
FLUSH_BYTES = 48 << 20
#: Rows whose texts are Python objects at once, and bytes of packed strings that leave together.
ROWS, SENT_BYTES = 256, 1 << 20
#: What a string, a further place of one, and a local range take in Python beside their own bytes.
STRING_COST, PLACE_COST, LOCAL_COST = 330, 72, 220
#: Minimisers are counted in so many cells; strings of so many bytes make a bucket.
CELLS = 1 << 14
BUCKET_BYTES = 4 << 20


def _pack(strings: list[bytes], owners: np.ndarray, keys: np.ndarray, firsts: np.ndarray) -> bytes:
    """owners, keys, firsts: doc_id, text key and first word of each string. Ids are stored as differences."""
    head = struct.pack("<q", len(strings))
    ids = np.diff(owners, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    body = b"\n".join(strings)
    return zstandard.ZstdCompressor(level=3).compress(head + ids + keys.astype("<u4").tobytes() + firsts.astype("<i4").tobytes() + body)


def _unpack(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", raw)
    at = 8
    owners = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8")[:, 0])
    keys = np.frombuffer(raw, "<u4", n, at + 8 * n)
    firsts = np.frombuffer(raw, "<i4", n, at + 12 * n)
    return raw[at + 16 * n :], owners, keys, firsts


def _cell(minimiser: np.ndarray) -> np.ndarray:
    return (mix(minimiser ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(CELLS)).astype(np.int64)


def _super_kmers(words: Words, window: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimiser of each window, and the first and last windows of super-k-mers; windows of hot cells stand alone."""
    n = len(words) - window + 1
    gram = min(GRAM, window)
    grams = words.hashes(words.starts[: len(words) - gram + 1], words.ends[gram - 1 :])
    least = sliding_min(grams, window - gram + 1)
    inside = words.doc[:n] == words.doc[window - 1 :]
    alone = hot[_cell(least)] if hot is not None and hot.any() else np.zeros(n, bool)
    new = (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) | alone[1:]
    return least, np.flatnonzero(inside & np.concatenate([[True], new])), np.flatnonzero(inside & np.concatenate([new | ~inside[1:], [True]]))


class _Sender:
    """Collects the super-k-mers of a map task."""

    def __init__(self, buckets: int, window: int, hot: np.ndarray):
        self.buckets, self.window, self.hot = buckets, window, hot
        self.clear()

    def clear(self) -> None:
        self.strings: dict[bytes, list] = {}
        self.bytes, self.local = 0, []

    def add(self, ids: list[int], keys: list[int], offsets: list[int], docs: list[bytes]) -> None:
        words = Words(docs)
        least, first, ends_run = _super_kmers(words, self.window, self.hot)
        own = np.where(self.hot[_cell(least[first])], words.hashes(words.starts[first], words.ends[first + self.window - 1]), least[first])
        base = words.first_words()
        doc = words.doc[first]
        data, known = words.data, self.strings
        rows = zip(words.starts[first].tolist(), words.ends[ends_run + self.window - 1].tolist(), (mix(own) % np.uint64(self.buckets)).tolist(), doc.tolist(), (first - base[doc] + np.array(offsets)[doc]).tolist(), (ends_run - first).tolist())
        for s, e, bucket, d, at, more in rows:
            text = data[s:e]
            seen = known.get(text)
            if seen is None:
                known[text] = [bucket, ids[d], keys[d], at]
                self.bytes += e - s + STRING_COST
            elif seen[1] == ids[d]:
                seen += (keys[d], at)
                self.bytes += PLACE_COST
            elif seen[1] < ids[d]:
                i, k, a, b = self.local[-1] if self.local else (None, None, 0, 0)
                if (i, k) == (ids[d], keys[d]) and a <= at <= b:  # windows that stand alone follow each other
                    self.local[-1] = (i, k, a, max(b, at + more + self.window))
                else:
                    self.local.append((ids[d], keys[d], at, at + more + self.window))
                    self.bytes += LOCAL_COST
            else:
                self.local += [(seen[1], seen[i], seen[i + 1], seen[i + 1] + more + self.window) for i in range(2, len(seen), 2)]
                self.bytes += LOCAL_COST
                known[text] = [bucket, ids[d], keys[d], at]

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        strings = sorted(self.strings.items(), key=lambda x: x[1][0])
        local = self.local
        self.clear()
        at = np.fromiter((v[0] for _, v in strings), np.int64, len(strings))
        cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(strings)]
        for a, b in zip(cuts, cuts[1:]):
            part = sorted(((v[0], v[1], v[i], v[i + 1], k) for k, v in strings[a:b] for i in range(2, len(v), 2)), key=lambda r: r[1])
            strings[a:b] = [None] * (b - a)
            yield part[0][0], 0, _pack([r[4] for r in part], np.array([r[1] for r in part], np.int64), np.array([r[2] for r in part], np.int64), np.array([r[3] for r in part], np.int64))
        if local:
            out = np.array(local, np.int64)
            yield int(out[0, 0] % self.buckets), 1, zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(out.T).tobytes())


def _blocks(batch: pd.DataFrame, window: int) -> Iterator[tuple[list[int], list[int], list[int], list[bytes]]]:
    """Ids, keys, word offsets and words of (pieces of) documents that have a window, BLOCK_BYTES at a time."""
    ids, keys, offsets, docs, size = [], [], [], [], 0
    for i, k, text in zip(batch["id"].tolist(), batch["key"].tolist(), batch["text"]):
        doc = canonical(text)
        if doc.count(b" ") + 1 < window:
            continue
        for offset, piece in pieces(doc, window):
            ids.append(i), keys.append(k), offsets.append(offset), docs.append(piece)
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield ids, keys, offsets, docs
                ids, keys, offsets, docs, size = [], [], [], [], 0
    if docs:
        yield ids, keys, offsets, docs


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS).to_pandas()


def _weigh(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS)
        for batch in _few(batches):
            for *_, docs in _blocks(batch, window):
                words = Words(docs)
                least, first, last = _super_kmers(words, window)
                total += np.bincount(_cell(least[first]), words.ends[last + window - 1] - words.starts[first], CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells].astype(np.int64))], ["cell", "bytes"])

    return released(run)


def _send(buckets: int, window: int, hot: np.ndarray):
    def flushed(sender: _Sender) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["bucket", "kind", "data"])
        for row in sender.flush():
            rows.append(row)
            size += len(row[2])
            if size >= SENT_BYTES:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, window, hot)
        for batch in _few(batches):
            for block in _blocks(batch, window):
                sender.add(*block)
                if sender.bytes >= FLUSH_BYTES:
                    yield from flushed(sender)
        if sender.strings:
            yield from flushed(sender)

    return released(run)


def _later_windows(data: bytes, owner: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks windows whose bytes also are a window of a smaller owner. Sorts by hash, then compares bytes."""
    order = np.lexsort((owner, h))
    sh, so = h[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))
    run = np.repeat(head, np.diff(np.append(head, len(sh))))
    later = np.flatnonzero(np.arange(len(sh)) != run)
    mark = np.zeros(len(h), bool)
    if not len(later):
        return mark
    a, b = order[later], order[run[later]]
    equal = np.fromiter((data[s:e] == data[t:f] for s, e, t, f in zip(start[a].tolist(), end[a].tolist(), start[b].tolist(), end[b].tolist())), bool, len(a))
    mark[a] = equal & (so[later] > so[run[later]])
    for r in set(run[later[~equal]].tolist()):  # two windows share a hash: group that run by its bytes
        members = order[r : r + int((run == r).sum())].tolist()
        least: dict[bytes, int] = {}
        for m in members:
            least.setdefault(data[start[m] : end[m]], owner[m])  # members come by owner
        for m in members:
            mark[m] = owner[m] > least[data[start[m] : end[m]]]
    return mark


def _windows(blobs: list[bytes], window: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings as one, and of each window: word number in its string, string, byte range, hash. Hashed in blocks."""
    found, block, size, strings, offset = [], [], 0, 0, 0
    for i, blob in enumerate(blobs):
        block.append(blob)
        size += len(blob) + 1
        if size >= BLOCK_BYTES or i + 1 == len(blobs):
            words = Words(block)
            first, h = words.run_hashes(window)
            string = words.doc[first]
            found.append(((first - words.first_words()[string]).astype(np.int32), string + strings, words.starts[first] + offset, words.ends[first + window - 1] + offset, h))
            strings += int(words.doc[-1]) + 1
            offset += size
            block, size = [], 0
    return b"\n".join(blobs), *(np.concatenate([f[i] for f in found]) for i in range(5))


def _count(window: int):
    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        ranges = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64).reshape(4, -1) for x in bucket["data"][bucket["kind"] == 1]]
        parts = [_unpack(x) for x in bucket["data"][bucket["kind"] == 0]]
        if parts:
            data, at, string, start, end, h = _windows([p[0] for p in parts], window)
            owners, keys, firsts = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3))
            mark = _later_windows(data, owners[string], start, end, h)
            at, string = at[mark], string[mark]
            if len(at):
                opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (string[1:] != string[:-1])]))
                closes = np.append(opens[1:], len(at)) - 1
                s = string[opens]
                ranges.append(np.stack([owners[s], keys[s], firsts[s] + at[opens], firsts[s] + at[closes] + window]))
        out = np.concatenate(ranges, axis=1) if ranges else np.zeros((4, 0), np.int64)
        return pd.DataFrame({"id": out[0], "key": out[1], "span": (out[2] << 32) | out[3]})

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        out = count(bucket)
        release()
        return out

    return run


def _kept(doc: bytes, spans) -> tuple[int, int, bytes]:
    """Words, words removed and the words left of a canonical text."""
    n = doc.count(b" ") + 1 if doc else 0
    if spans is None or not len(spans):
        return n, 0, doc
    gaps = np.flatnonzero(np.frombuffer(doc, np.uint8) == 32)
    edge = np.zeros(n + 1, np.int32)
    spans = np.asarray(spans, np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, spans & 0xFFFFFFFF, -1)
    stay = (np.cumsum(edge)[:-1] == 0).astype(np.int8)
    turns = np.flatnonzero(np.diff(stay, prepend=0, append=0))
    opens, closes = turns[::2], turns[1::2]  # runs of words that stay
    starts = np.where(opens == 0, 0, gaps[np.maximum(opens, 1) - 1] + 1) if len(gaps) else np.zeros(len(opens), np.int64)
    ends = np.where(closes == n, len(doc), gaps[np.minimum(closes, n - 1) - 1]) if len(gaps) else np.full(len(closes), len(doc))
    return n, n - int(stay.sum()), b" ".join([doc[s:e] for s, e in zip(starts.tolist(), ends.tolist())])


def _apply(text_at: str, spans_at: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            passed = [c for c in whole.schema.names if c != spans_at]
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                texts, spans = batch.column(text_at).to_pylist(), batch.column(spans_at)
                left = [_kept(canonical(text), spans[i].values.to_numpy() if spans[i].is_valid else None) for i, text in enumerate(texts)]
                n_words, n_removed, kept = zip(*left)
                new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *new], [*passed, *names])

    return released(run)


def packed_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(bucket, kind, data) of rows (id, key, text)."""
    weight = np.zeros(CELLS)
    for r in rows.mapInArrow(_weigh(window), "cell int, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect():
        weight[r["cell"]] = r["bytes"]
    hot = weight > max(BUCKET_BYTES, 4 * weight.mean())  # from 16 GB of strings on, all cells are large
    # a window that travels alone has all its words, of which a super-k-mer of many windows has each once
    most = weight[~hot].sum() + window * weight[hot].sum()
    buckets = max(4 * shuffle_partitions(rows.sparkSession), -int(-most // BUCKET_BYTES))
    return rows.mapInArrow(_send(buckets, window, hot), "bucket long, kind int, data binary")


def removal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, key, spans): for each document that loses words, ranges of word numbers as start << 32 | end."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    found = packed_windows(rows, window).groupBy("bucket").applyInPandas(_count(window), "id long, key long, span long")
    return found.groupBy("id", "key").agg(F.collect_list("span").alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text: its words outside windows that also start in a document of smaller id."""
    names = [free_name(docs, n) for n in ("n_words", "n_removed", "kept_text")]
    own = {c: free_name(docs, f"{c}_") for c in ("id", "key", "spans")}
    row_key = free_name(docs, "row_key")
    spans = removal_spans(docs, id_col, text_col, window).select(*(F.col(a).alias(b) for a, b in own.items()))
    keyed = docs.withColumn(row_key, text_key(text_col))
    joined = keyed.join(spans, (F.col(id_col).cast("long") == F.col(own["id"])) & (F.col(row_key) == F.col(own["key"])), "left").drop(own["id"], own["key"], row_key)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.StringType())])
    return joined.mapInArrow(_apply(text_col, own["spans"], names), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows; for tests."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in split:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = {a + j for a in range(len(w) - window + 1) if least[tuple(w[a : a + window])] < i for j in range(window)}
        kept = b" ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
