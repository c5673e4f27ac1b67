"""N-gram Jaccard join by MinHash banding: links documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A document becomes the set of its shingles (64-bit hashes of five consecutive words; a shorter document with a word
   has one shingle, all its words) and a signature of minima. Documents with equal sets form one class of copies,
   named by a 128-bit digest of the set; from here on only the class travels, with the text of its smallest id.
2. Signatures are cut into bands. Rows and bands are chosen by `bands_for` so that a pair at the threshold shares a
   band with the target probability. Band hashes shuffle; each links its members to its least member, a star instead
   of all pairs. The components of these links hold every candidate pair.
3. Pairs that share a band are verified on the full sets, by products of incidence matrices. That is the rule everywhere,
   whatever else they stand among; groups, which know their size beforehand, only say where a pair is looked at:
   - a component of up to CHUNK classes is one group, many to a task;
   - in a larger one, which weak links may have run together, a band with up to CHUNK classes is a group; of bands with the same members one stays, and a pair counts in the least band it shares;
   - the classes of larger bands (one text with many small changes) are cut into chunks ordered by set size; pairs of
     chunks, less those too unlike in size to link, are separate groups, so one hot group spreads over many tasks.
   Groups send back a count of links and a local root for each class, never pairs.
4. Counts add up; local roots of cut components are joined by connected components once more.

Result: one row per document with id, class_id (smallest id it is linked with, over any number of links) and n_links
(other documents linked directly, copies included). A document is an id with a set of shingles.

Nulls and edge cases: a null or empty text links to nothing and is its own class; a row with a null id takes no part
and has no row in the result; rows that repeat both id and text are one document, and an id with several texts has a
row for each, whose links and classes are its own; ties have the smallest id; a very long text is hashed in pieces, and
its set is held whole by the task that signs or verifies it (8 bytes a word); an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, canonical, hot_join, in_few_tasks, materialise, mix, pieces, release, released, shuffle_partitions, table, text_key
from .graph import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares a band with this probability at least.
RECALL = 0.999
ROWS = 7
#: Classes that are compared in one group.
CHUNK = 512
BLOCK_BYTES = 1 << 20
#: Texts whose shingles a task holds at once while it signs them.
SLICE = 1_000


def bands_for(threshold: float, rows: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found: dict[int, list[np.ndarray]] = {}
    docs, at, size = [], [], 0

    def flush() -> None:
        words = Words(docs)
        base = np.append(words.first_words(), len(words))
        first, h = words.run_hashes(width)
        cut = np.searchsorted(first, base)
        for k, i in enumerate(at):
            if base[k + 1] - base[k] < width:
                own = words.hashes(words.starts[base[k] : base[k] + 1], words.ends[base[k + 1] - 1 : base[k + 1]])
            else:
                own = np.unique(h[cut[k] : cut[k + 1]])
            found.setdefault(i, []).append(own)

    for i, text in enumerate(texts):
        doc = canonical(text)
        if not doc:
            continue
        for _, piece in pieces(doc, width):
            docs.append(piece), at.append(i)
            size += len(piece)
            if size >= BLOCK_BYTES:
                flush()
                docs, at, size = [], [], 0
    if docs:
        flush()
    none = np.zeros(0, np.uint64)
    return [none if i not in found else found[i][0] if len(found[i]) == 1 else np.unique(np.concatenate(found[i])) for i in range(len(texts))]


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def band_hashes(shingles: np.ndarray, rows: int, bands: int) -> np.ndarray:
    a, b = _multipliers(rows * bands)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(rows * bands, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = np.multiply.outer(a, x[i : i + 4096])
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(bands, rows).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(rows: int, bands: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.iloc[start : start + SLICE]
                sets = shingle_sets(part["text"].tolist(), width)
                signs = [band_hashes(s, rows, bands) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pd.DataFrame({"id": part["id"], "text_key": part["text_key"], "key": [_set_key(s) for s in sets], "size": [len(s) for s in sets], "bands": signs})

    return released(run)


def _links(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """A boolean matrix: which of sets links to which of other (or of sets)."""
    both = sets + (other or [])
    sizes = np.array([len(s) for s in both])
    doc = np.repeat(np.arange(len(both)), sizes)
    values, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    doc, column = doc[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    n = len(sets)
    meet = np.zeros((n, len(both) - n if other else n), np.float32)
    step = max(256, (8 << 20) // len(both))
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        x = np.zeros((len(both), step), np.float32)
        x[doc[a:b], column[a:b] - low] = 1
        meet += x[:n] @ (x[n:] if other else x).T
    left, right = sizes[:n, None], sizes[None, n:] if other else sizes[None, :]
    return meet >= threshold * (left + right - meet) - 1e-4


def _local_roots(links: np.ndarray) -> np.ndarray:
    """The first row that each one reaches through a symmetric matrix of links."""
    n = len(links)
    root, left = np.full(n, -1, np.int64), np.ones(n, bool)
    for i in range(n):
        if left[i]:
            front = np.zeros(n, bool)
            front[i] = True
            seen = front.copy()
            while front.any():
                front = links[front].any(axis=0) & ~seen
                seen |= front
            root[seen] = i
            left &= ~seen
    return root


def _met_before(band: int, bands: list, core: list) -> np.ndarray:
    """Pairs that are compared elsewhere: in a smaller band that both have, or in their core."""
    n = len(bands)
    owner = np.repeat(np.arange(n), [len(b) for b in bands])
    value = np.concatenate(bands) if n else np.zeros(0, np.int64)
    owner, value = owner[value < band], value[value < band]
    met = np.zeros((n, n), bool)
    if len(value):
        names, column = np.unique(value, return_inverse=True)
        has = np.zeros((n, len(names)), np.float32)
        has[owner, column] = 1
        met = has @ has.T > 0
    of = np.unique(["" if c is None else c.hex() for c in core], return_inverse=True)[1]
    known = np.array([c is not None for c in core])
    return met | (known[:, None] & (of[:, None] == of[None, :]))


def _in_one_band(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of left share a band with which of right; a band's hash stands at the same place of every signature."""
    out = np.zeros((len(left), len(right)), bool)
    for a, b in zip(np.stack(left).T, np.stack(right).T):
        out |= a[:, None] == b[None, :]
    return out


def _verify(threshold: float, width: int):
    def group(rows: pd.DataFrame, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        side, within = rows["side"].to_numpy(), bool(rows["within"].iloc[0])
        bands, band = [np.asarray(b, np.int64) for b in rows["bands"]], rows["band"].iloc[0]
        if within:
            links = _links(sets, None, threshold)
            np.fill_diagonal(links, False)
            links &= _in_one_band(bands, bands) if pd.isna(band) else ~_met_before(int(band), bands, rows["core"].tolist())
        else:
            links = np.zeros((len(rows), len(rows)), bool)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                of = lambda x, at: [x[i] for i in at]
                links[np.ix_(a, b)] = _links(of(sets, a), of(sets, b), threshold) & _in_one_band(of(bands, a), of(bands, b))
                links |= links.T
        return links @ rows["copies"].to_numpy(), _local_roots(links)

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(rows["text"].tolist(), width)
        own = [_set_key(s) == k for s, k in zip(sets, rows["key"])]  # an id may come with other texts
        rows = rows.assign(at=np.arange(len(rows)))[own]
        out = [pd.DataFrame({"key": pd.Series(dtype=object), "links": pd.Series(dtype=np.int64), "root": pd.Series(dtype=object), "whole": pd.Series(dtype=bool)})]
        for (_, whole), part in rows.groupby(["group", "whole"], sort=False):
            part = part.drop_duplicates("key").sort_values("key")
            n, root = group(part, [sets[i] for i in part["at"]])
            keys = part["key"].to_numpy()
            out.append(pd.DataFrame({"key": keys, "links": n.astype(np.int64), "root": keys[root], "whole": whole}))
        return pd.concat(out[1:] or out)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = verify(rows)
        release()
        return out

    return run


def _cut(large: DataFrame, threshold: float) -> DataFrame:
    """large with `to`, the groups that each class goes to.

    Sizes fall into steps of 1 / threshold: linked sets are in the same step or in neighbouring ones. A step of a
    core is cut into chunks by a hash of the key; each pair of chunks of one step, and of neighbours, is a group."""
    stepped = large.withColumn("step", F.floor(F.log("size") / math.log(1 / threshold)).cast("int"))
    counts = stepped.groupBy("root", "step").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    above = counts.select("root", (F.col("step") - 1).alias("step"), F.col("chunks").alias("above"))
    below = counts.select("root", (F.col("step") + 1).alias("step"), F.col("chunks").alias("below"))
    cut = stepped.join(counts, ["root", "step"]).join(above, ["root", "step"], "left").join(below, ["root", "step"], "left").withColumn("k", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    group = lambda step, cross, i, j, side: F.struct(step.alias("step"), F.lit(cross).alias("cross"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(0))), lambda j: j < F.coalesce(F.col(n), F.lit(0)))
    k, step = F.col("k"), F.col("step")
    return cut.withColumn(
        "to",
        F.concat(
            F.transform(numbers("chunks"), lambda j: group(step, False, F.least(k, j), F.greatest(k, j), k > j)),
            F.transform(numbers("above"), lambda j: group(step, True, k, j, F.lit(0))),
            F.transform(numbers("below"), lambda j: group(step - 1, True, j, k, F.lit(1))),
        ),
    )


def _as_group(rows: DataFrame, **own: Column) -> DataFrame:
    """rows with what a group needs beside its texts; a group that is not `shared` has a place of its own."""
    plain = {"whole": F.lit(True), "shared": F.lit(True), "side": F.lit(0), "within": F.lit(True), "core": F.lit(None).cast("binary"), "band": F.lit(None).cast("long")}
    return rows.withColumns({**plain, **own}).select("rep", "key", "copies", "group", "bands", *plain)


def _compare_large(large: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Groups for the members of large components: (key, rep, copies, band, bands, core) for each band of up to CHUNK of them,
    and (key, rep, copies, root, to, bands) for the cores, the components of larger bands."""
    banded = materialise(large.select("key").join(classes.select("key", "bands"), "key").select("key", F.explode("bands").alias("band")), "large-bands")
    total = banded.count()
    bands = materialise(in_few_tasks(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark")).where("n > 1"), total), "band-sizes")
    stars = hot_join(banded, bands.where(F.col("n") > CHUNK).select("band", "n", "least"), "band", "n", total)
    cores = materialise(in_few_tasks(connected_components(stars.select(F.col("key").alias("a"), F.col("least").alias("b"))), total), "cores").select(F.col("id").alias("key"), F.col("root").alias("core"))
    one_each = bands.where(F.col("n") <= CHUNK).groupBy("n", "mark").agg(F.min("band").alias("band")).select("band")
    small = banded.join(one_each, "band").join(cores, "key", "left")
    of_one_core = small.groupBy("band").agg(F.min("core").alias("low"), F.max("core").alias("high"), (F.count("core") == F.count("*")).alias("every")).where("every and low = high")
    small = materialise(in_few_tasks(small.join(of_one_core.select("band"), "band", "left_anti"), total), "small-bands")
    own = small.groupBy("key").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    facts = large.select("key", "rep", "copies", "size", F.col("bands").alias("all_bands"))
    groups = facts.drop("all_bands").join(own, "key").join(cores, "key", "left").select("key", "rep", "copies", "core", "bands", F.explode("bands").alias("band"))
    return groups, _cut(facts.join(cores.withColumnRenamed("core", "root"), "key"), threshold).select("key", "rep", "copies", "root", "to", F.col("all_bands").alias("bands"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, width: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links) as the module says; keyed: one row for each text of an id, with text_key, 32 bits of its hash."""
    spark = docs.sparkSession
    bands, parts = bands_for(threshold, rows, recall), shuffle_partitions(spark)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(texts.select("*", text_key("text").alias("text_key")).mapInPandas(_sign(rows, bands, width), "id long, text_key long, key binary, size long, bands array<long>"), "signatures")
    filled = signed.where("key is not null")
    documents = filled.select("id", "key").distinct()
    named = documents.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(named.join(filled.groupBy("key").agg(F.first("bands").alias("bands"), F.first("size").alias("size")), "key"), "classes")
    facts = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    n_classes, n_documents = facts[0], facts[1]

    banded = classes.select("key", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = hot_join(banded, materialise(in_few_tasks(least, n_classes * bands), "bands"), "band", "n", n_classes * bands).where("key <> least")
    candidates = materialise(in_few_tasks(connected_components(stars.select(F.col("key").alias("a"), F.col("least").alias("b"))), n_classes), "candidates").select(F.col("id").alias("key"), F.col("root").alias("group"))

    sizes = candidates.groupBy("group").agg(F.count("*").alias("n")).withColumn("often", F.col("n"))
    members = materialise(in_few_tasks(hot_join(candidates, sizes, "group", "often", n_classes).join(classes.select("key", "rep", "copies", "size", "bands"), "key"), n_classes), "members")
    large = members.where(F.col("n") > CHUNK)
    some_large = not large.isEmpty()
    verdict = "key binary, links long, root binary, whole boolean"
    groups = _as_group(members.where(F.col("n") <= CHUNK))
    if some_large:
        in_bands, cores = _compare_large(large, classes, threshold)
        in_bands = _as_group(in_bands, whole=F.lit(False), core=F.col("core"), band=F.col("band"), group=F.col("band").cast("string").cast("binary"))
        cores = cores.withColumn("to", F.explode("to"))
        pairs = _as_group(cores, whole=F.lit(False), shared=F.lit(False), side=F.col("to.side"), within=~F.col("to.cross") & (F.col("to.i") == F.col("to.j")), group=F.concat(F.col("root"), F.concat_ws("|", "to.step", "to.cross", "to.i", "to.j").cast("binary")))
        groups = groups.union(in_bands).union(pairs)
    place = F.when(F.col("shared"), F.pmod(F.xxhash64("group"), F.lit(8 * parts))).otherwise(F.xxhash64("group"))
    sent = texts.join(groups.hint("shuffle_merge"), F.col("id") == F.col("rep")).withColumn("g", place).drop("id", "rep", "shared")  # texts are read and shuffled once
    checked = materialise(sent.repartition(parts, "g").groupBy("g").applyInPandas(_verify(threshold, width), verdict), "verified")
    found = checked.where("whole").select("key", "links", "root")
    if some_large:
        counts = checked.where("not whole").groupBy("key").agg(F.sum("links").alias("links"))
        roots = connected_components(checked.where("not whole and key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
        found = found.union(counts.join(roots.withColumnRenamed("id", "key"), "key", "left").select("key", "links", F.coalesce("root", "key").alias("root")))
    judged = materialise(in_few_tasks(classes.select("key", "rep", "copies").join(found, "key", "left").select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")), n_classes), "classes-judged")
    ids = judged.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    of_key = hot_join(judged, ids, "root", "n", n_classes).select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies"))
    asked = filled.select("id", "text_key", "key").distinct() if keyed else documents
    extra = ["text_key"] if keyed else []
    linked = hot_join(asked, materialise(in_few_tasks(of_key, n_classes), "links-of-classes"), "key", "copies", n_documents).select(F.col("id").alias("doc_id"), "class_id", "n_links", *extra)
    empty = signed.where("key is null").select("id", *extra).distinct()
    return linked.union(empty.select("id", "id", F.lit(0).cast("long"), *extra))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(docs: list[tuple[int, str | None]], threshold: float = THRESHOLD, width: int = SHINGLE) -> list[tuple[int, int, int]]:
    """The same by comparing all pairs of sets of word tuples; for tests."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().split()
        s = frozenset(tuple(w[a : a + width]) for a in range(len(w) - width + 1)) or frozenset({tuple(w)} if w else ())
        sets[i, s] = s
    where: dict[tuple, list[tuple]] = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    links: dict[tuple, set[tuple]] = {}
    for i, s in sets.items():
        meet: dict[tuple, int] = {}
        for g in s:
            for j in where[g]:
                meet[j] = meet.get(j, 0) + 1
        links[i] = {j for j, n in meet.items() if j != i and n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9}
    out, seen = [], {}
    for i in sorted(sets, key=lambda k: k[0]):
        if i not in seen:
            stack = [i]
            seen[i] = i[0]
            while stack:
                for j in links[stack.pop()]:
                    if j not in seen:
                        seen[j] = i[0]
                        stack.append(j)
        out.append((i[0], seen[i], len(links[i])))
    return out
