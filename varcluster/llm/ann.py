"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A vector's direction is coded as a sum of one full-dimensional codeword from each of several codebooks, found by beam search: the
beam keeps the sums nearest to the direction after each codebook. With the code go a stored norm, the ratio of the
vector's norm to its sum's, and the error, how far the vector lies from what its code stands for. A query's inner products
with all codewords are a lookup table; a code's score is the sum of one entry per codebook, times the stored norm. Long vectors
are the nearest ones, so directions are coded: errors are then in proportion to the norm, however unequal norms are.

The best SHORTLIST codes of a query are reranked by the inner product of the original vectors, in double precision, and with
them every code whose score could be among the best k: by no more than `margin` times the error that is usual for it, error times
norm of the query by the root of the dimensions, it falls short of the k-th score. The margin is measured on a second
sample, which the codebooks have not seen: what MARGIN_RECALL of its neighbours need, and half as much again. So a shortlist is as long as
the rows ask for, and has no other bound.

Codebooks are fitted on the driver to a bounded sample, the MAX_TRAINING vectors of smallest hash of the id: each begins
as the k-means of the residuals of those before it, then codes and the words of all books are fitted in turns, the words
by one least-squares problem. Every vector is coded.

Codes lie in inverted lists, one for each of about total / CODE_BLOCK coarse cells (MAX_CELLS at most); a query reads the
lists of the cells whose centres have the largest inner products with it. How many is measured: the least number that finds
CELL_RECALL of the sample's own neighbours, for SAMPLE_QUERIES queries. Where vectors have structure that is a few cells,
so work does not grow as queries times vectors; where they have none, all. A list of more than CODE_BLOCK codes is cut by a
hash, queries are dealt into blocks, and each block and piece is one group with a bounded number of rows, which sends back
one row per query with its best SHORTLIST codes. A code travels once for each block of queries. The shortlist fetches its
vectors by a join, and nothing whole passes one task or the driver.

Equal vectors are one class, of its smallest id; classes are coded and searched, so that copies take one place of a
shortlist. The k + 1 best classes of a query are then expanded to their k + 1 smallest ids each, which is all of them
that can be returned.

Measured (see README): on the given vectors, which are close to random directions, cells that hold half of all vectors find
0.89 of the neighbours, so there every list is read.

Nulls and edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
null ids or vectors whose length is not the commonest one; rows that repeat an id count once, by their first vector in
order; ties go to the smaller id; if there are fewer candidates than asked for, all are returned; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, released, shuffle_partitions, table

BOOKS, WORDS, BEAM, REFITS = 24, 64, 4, 1
MAX_TRAINING = 16_384
K, SHORTLIST = 20, 400
#: Rows of a block of queries at most, and of a block of codes; queries whose lookup tables are held at once.
QUERY_BLOCK, CODE_BLOCK, TABLES = 4_096, 65_536, 256
#: Coarse cells at most, the share of neighbours that the cells read must hold, and the queries by which that is measured.
MAX_CELLS, CELL_RECALL, SAMPLE_QUERIES = 1_024, 0.98, 256
#: The share of neighbours that the margin must keep, and by what it is widened.
MARGIN_RECALL, WIDER = 0.99, 1.5


@dataclass
class Codebooks:
    """words[m, k]: codeword k of book m."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM, block: int = 2048) -> np.ndarray:
        """Codes of the rows of x, by beam search: after each book the beam keeps the residuals of least norm."""
        books, size, dim = self.words.shape
        words = self.words.astype(np.float32)
        norms = np.einsum("mkd,mkd->mk", words, words)
        out = np.zeros((len(x), books), np.uint8)
        for start in range(0, len(x), block):
            rest = x[start : start + block, None].astype(np.float32)
            n = len(rest)
            rows, cost, codes = np.arange(n)[:, None], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
            for m in range(books):
                total = (cost[:, :, None] + norms[m] - 2 * (rest.reshape(-1, dim) @ words[m].T).reshape(n, -1, size)).reshape(n, -1)
                keep = min(beam, total.shape[1])
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
                cost, parent, word = total[rows, best], best // size, best % size
                rest = rest[rows, parent] - words[m][word]
                codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            out[start : start + n] = codes[np.arange(n), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _kmeans(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        member = (near[:, None] == np.arange(size)).astype(np.float32)
        count = member.sum(0)
        centres[count > 0] = (member.T @ x)[count > 0] / count[count > 0, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres) - 2 * x @ centres.T).argmin(1)


def refitted(model: Codebooks, x: np.ndarray, codes: np.ndarray) -> Codebooks:
    """All codewords together, by least squares, for codes that stay: what makes the books additive rather than residual."""
    books, size, dim = model.words.shape
    at = codes.astype(np.int64) + np.arange(books) * size  # places of the ones in each row of the design matrix
    gram = np.zeros((books * size, books * size))
    for m in range(books):
        for k in range(m, books):
            block = np.bincount(codes[:, m].astype(np.int64) * size + codes[:, k], minlength=size * size).reshape(size, size)
            gram[m * size : (m + 1) * size, k * size : (k + 1) * size] = block
            gram[k * size : (k + 1) * size, m * size : (m + 1) * size] = block.T
    right = np.zeros((books * size, dim))
    np.add.at(right, at.ravel(), np.repeat(x, books, axis=0))
    old = model.words.reshape(books * size, dim)
    step = np.linalg.solve(gram + np.eye(len(gram)), right - gram @ old)  # towards the old words where the data leave a choice
    return Codebooks((old + step).reshape(books, size, dim))


def fit(x: np.ndarray, books: int = BOOKS, size: int = WORDS, seed: int = 7, refits: int = REFITS) -> Codebooks:
    """Each book begins as the k-means of what the books before it leave; then codes and words are fitted in turns, the
    words of all books at once."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    rest, words = x.astype(np.float32), []
    for _ in range(books):
        centres = _kmeans(rest, size, rng)
        rest = rest - centres[nearest_centre(rest, centres)]
        words.append(centres)
    model = Codebooks(np.array(words))
    for _ in range(refits):
        model = refitted(model, x, model.encode(x))
    return model


def usable(vector: Column) -> Column:
    """Not null, with finite components only, not all zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0)


@dataclass
class Cells:
    """Centres of coarse cells, and how many of them a query reads."""

    centres: np.ndarray
    probes: int

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        return nearest_centre(x.astype(np.float32), self.centres)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q.astype(np.float32) @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def fit_cells(x: np.ndarray, number: int, k: int = K, recall: float = CELL_RECALL, seed: int = 11) -> Cells:
    """Cells of the sample x, and the probes that find the wanted share of its neighbours."""
    number = max(1, min(number, len(x)))
    cells = Cells(_kmeans(x.astype(np.float32), number, np.random.default_rng(seed)), number)
    if number == 1:
        return cells
    asked = x[:SAMPLE_QUERIES]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = max(1, min(k, len(x) - 1))
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    cell, order = cells.of_vectors(x)[best], cells.of_queries(asked)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(number)[None, :].repeat(len(asked), 0), axis=1)
    met = np.sort(np.take_along_axis(place, cell, axis=1).ravel())  # how far down its query's list each neighbour's cell is
    return Cells(cells.centres, int(met[min(len(met) - 1, int(np.ceil(recall * len(met))))]) + 1)


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def coded(model: Codebooks, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, ratios and errors of the rows of x, none of which is zero."""
    codes = model.encode(directions(x))
    sums = model.decode(codes)
    length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
    ratio = np.sqrt(np.einsum("ij,ij->i", x, x)) / np.where(length > 0, length, 1)
    return codes, ratio, np.sqrt(((x - sums * ratio[:, None]) ** 2).sum(axis=1))


def usual_error(error: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the score of a vector with this error for the query q, if errors have no direction."""
    return error * (np.sqrt(q @ q) / np.sqrt(len(q)))


def measured_margin(model: Codebooks, x: np.ndarray, k: int = K) -> float:
    """Usual errors by which the true neighbours in the sample x fall short of the k-th score, at the wanted share, widened."""
    k = min(k, len(x) - 1)
    if k < 1:
        return WIDER
    codes, ratio, error = coded(model, x)
    y = model.decode(codes) * ratio[:, None]
    short = []
    for i, q in enumerate(x[:SAMPLE_QUERIES]):
        score, true = y @ q, x @ q
        score[i] = true[i] = -np.inf
        best = np.argpartition(-true, k - 1)[:k]
        short.append((np.partition(score, len(x) - k)[len(x) - k] - score[best]) / np.maximum(usual_error(error[best], q), 1e-300))
    return float(WIDER * max(1.0, np.quantile(np.concatenate(short), MARGIN_RECALL)))


def _coded(model: Codebooks, cells: Cells):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["vector"].tolist(), float)
                codes, ratio, error = coded(model, x)
                yield pd.DataFrame({"id": batch["id"], "cell": cells.of_vectors(x), "code": [c.tobytes() for c in codes], "ratio": ratio, "error": error})

    return released(run)


def _probed(cells: Cells):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cells=list(cells.of_queries(np.array(batch["vector"].tolist(), float))))

    return released(run)


def _search(model: Codebooks, shortlist: int, k: int, margin: float):
    books = len(model.words)

    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(codes):
            ids, ratio, error = codes["id"].to_numpy(), codes["ratio"].to_numpy(np.float32), codes["error"].to_numpy()
            code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), books)
            order = np.argsort(ids)
            ids, ratio, error, code = ids[order], ratio[order], error[order], code[order].T.copy()
            names = queries["id"].tolist()
            for start in range(0, len(queries), TABLES):
                q = np.array(queries["vector"].iloc[start : start + TABLES].tolist(), float)
                tables = np.einsum("qd,mkd->qmk", q, model.words, optimize=True).astype(np.float32)
                for i in range(len(q)):
                    score = tables[i, 0][code[0]]
                    for m in range(1, books):
                        score += tables[i, m][code[m]]
                    score *= ratio
                    keep = min(shortlist + 1, len(score))
                    best = np.argpartition(-score, keep - 1)[:keep]
                    reach = score + margin * usual_error(error, q[i])
                    if len(score) > k + 1:  # the k-th but for the query itself
                        best = np.union1d(best, np.flatnonzero(reach >= np.partition(score[best], keep - k - 1)[keep - k - 1]))
                    best = best[np.argsort(-score[best], kind="stable")]
                    out.append((names[start + i], ids[best], score[best].astype(float), reach[best].astype(float)))
        column = lambda i, kind: pd.Series([r[i] for r in out], dtype=kind)
        return pd.DataFrame({"query_id": column(0, np.int64), "vec_ids": column(1, object), "estimates": column(2, object), "reaches": column(3, object)})

    return run


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, `queries` being a condition on `id`."""
    spark = vectors.sparkSession
    shortlist = max(shortlist, k)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not lengths:
        return spark.createDataFrame([], result)
    rows = materialise(rows.where(F.size("vector") == lengths[0]["dim"]), "vectors")
    same = Window.partitionBy("vector")
    members = rows.withColumn("at", F.row_number().over(same.orderBy("id"))).where(F.col("at") <= k + 1)
    members = materialise(members.withColumn("class", F.min("id").over(same)), "vector-classes")
    classes = members.where("at = 1").select("id", "vector")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(2 * MAX_TRAINING).select("vector").toPandas()
    both = np.array(sample["vector"].tolist(), float)
    x = both[:MAX_TRAINING]
    model, cells = fit(directions(x)), fit_cells(x, min(MAX_CELLS, -(-total // CODE_BLOCK)), k)
    margin = measured_margin(model, both[-MAX_TRAINING:][::-1], k)
    del sample, both

    asked = rows.where(queries)
    n_queries, parts = asked.count(), shuffle_partitions(spark)
    block = min(QUERY_BLOCK, max(256, -(-n_queries // (2 * parts))))
    query_blocks = max(1, -(-n_queries // block))
    stored = materialise(classes.mapInPandas(_coded(model, cells), "id long, cell int, code binary, ratio double, error double"), "codes")
    # lists of a cell, no more than MAX_CELLS rows: how many pieces each is cut into
    pieces = {r["cell"]: -(-r["n"] // CODE_BLOCK) for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cuts = F.broadcast(spark.createDataFrame(sorted(pieces.items()), "cell int, pieces long"))
    codes = stored.join(cuts, "cell").select("cell", F.pmod(F.xxhash64("id"), "pieces").alias("piece"), "id", "code", "ratio", "error").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    probing = asked.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q")).mapInPandas(_probed(cells), "id long, vector array<double>, q int, cells array<int>")
    blocks = probing.select("id", "vector", "q", F.explode("cells").alias("cell")).join(cuts, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    found = blocks.groupBy("q", "cell", "piece").cogroup(codes.groupBy("q", "cell", "piece")).applyInPandas(_search(model, shortlist, k, margin), "query_id long, vec_ids array<long>, estimates array<double>, reaches array<double>")
    each = F.transform(F.arrays_zip("estimates", "vec_ids", "reaches"), lambda x: F.struct(x["estimates"].alias("estimate"), (-x["vec_ids"]).alias("minus"), x["reaches"].alias("reach")))
    short = found.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list(each)), asc=False).alias("all")).withColumn("least", F.get("all", F.lit(k))["estimate"])
    short = short.select("query_id", F.explode(F.filter("all", lambda x, i: (i <= shortlist) | (x["reach"] >= F.col("least")))).alias("s")).select("query_id", (-F.col("s.minus")).alias("vec_id"))
    with_vectors = short.join(classes.select(F.col("id").alias("vec_id"), F.col("vector").alias("other")), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("own")), "query_id")
    product = F.aggregate(F.zip_with("own", "other", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = with_vectors.select("query_id", "vec_id", product.alias("score"))
    first = lambda n: F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id")))), 1, n).alias("top")
    best = scored.groupBy("query_id").agg(first(k + 1)).select("query_id", F.explode("top").alias("t")).select("query_id", F.col("t.vec_id").alias("class"), (-F.col("t.minus")).alias("score"))
    every = best.join(members.select("class", F.col("id").alias("vec_id")), "class").where("vec_id <> query_id")
    ranked = every.groupBy("query_id").agg(first(k)).select("query_id", F.posexplode("top").alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.minus")).alias("score"))


def op6_additive_quantisation_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
