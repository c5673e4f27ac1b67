"""Protein structures: PDB text inside tar files, and its atoms."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .annotation import local_path


#: Bytes of a header and unit of padding in a tar file; fixed values of the format.
BLOCK = 512
#: Bytes of members that one task reads.
SPLIT = 64 << 20


def tar_members(spark: SparkSession, tars: str, split: int = SPLIT) -> DataFrame:
    """(path, name, start, size, part) of the files in tars that are no mmCIF: their places in bytes, found by hopping from header to
    header, so that no task reads a tar whole. part: members of a tar that are read together."""
    paths = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tars).select("path").collect()]

    def index(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for path in frame["path"]:
                found, part, held = [], 0, 0
                with tarfile.open(local_path(path), "r:") as tar:
                    for m in tar:
                        if m.isfile() and not m.name.endswith("cif.gz"):
                            if held and held + m.size > split:
                                part, held = part + 1, 0
                            held += m.size
                            found.append((path, m.name, m.offset_data, m.size, part))
                        tar.members = []  # else tarfile remembers all headers
                        if len(found) >= 10_000:
                            yield pd.DataFrame(found, columns=["path", "name", "start", "size", "part"])
                            found = []
                yield pd.DataFrame(found, columns=["path", "name", "start", "size", "part"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(index, "path string, name string, start long, size long, part int")


def read_pdb_lines(spark: SparkSession, tars: str, split: int = SPLIT) -> DataFrame:
    """(file, line) of the gzipped PDB members of tar files; members in mmCIF are passed over.

    Tars on a mounted folder are read by byte ranges of their members, many tasks to a tar of any size, and no more than a member
    is held at once. Of other stores, each tar of up to 2 GB is one task, which streams over its members."""

    def lines_of(name: str, raw: bytes) -> pd.DataFrame:
        text = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        return pd.DataFrame({"file": name, "line": text.decode("latin-1").splitlines()})

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in batch.groupby("path", sort=False):
                with open(local_path(path), "rb") as f:
                    for r in rows.sort_values("start").itertuples(index=False):
                        f.seek(r.start)
                        yield lines_of(r.name, f.read(r.size))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and not m.name.endswith("cif.gz"):
                            yield lines_of(m.name, tar.extractfile(m).read())

    files = spark.read.format("binaryFile").load(tars)
    first = files.select("path").first()
    if first is not None and first["path"].startswith("file:"):
        members = written(tar_members(spark, tars, split), "tar-members")
        parts = members.select("path", "part").distinct().count()
        return members.repartition(max(1, parts), "path", "part").mapInPandas(ranges, "file string, line string")
    return files.select("content").mapInPandas(whole, "file string, line string")


def residues_of(lines: DataFrame) -> DataFrame:
    """(file, chain, residue_num, residue, x, y, z, copies) of the carbonyl carbon of each residue; columns are fixed."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = lines.where(F.col("line").startswith("ATOM") & (cut(13, 4) == "C"))
    rows = atoms.select("file", F.substring("line", 22, 1).alias("chain"), cut(23, 4).cast("int").alias("residue_num"), F.substring("line", 18, 3).alias("residue"), *[cut(31 + 8 * i, 8).cast("double").alias(c) for i, c in enumerate("xyz")])
    return rows.groupBy("file", "chain", "residue_num").agg(F.first("residue").alias("residue"), *[F.first(c).alias(c) for c in "xyz"], F.count("*").alias("copies"))


#: Characters of an id by which names are looked up; shorter ids are looked up whole.
GRAM = 4


def files_of_ids(files: DataFrame, ids: DataFrame, gram: int = GRAM) -> DataFrame:
    """(file, protein_id) wherever an id stands anywhere in a file's name; files (file), ids (protein_id), each once.

    Names and ids meet by a run of characters: an id by that one of its own runs which is rarest among ids, a name by all of its
    runs, once each; pairs that share it are looked at in full. An id shorter than a run meets the runs of its own length."""
    named = ids.select("protein_id").where("protein_id <> ''").distinct()
    runs = lambda text, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k) if isinstance(k, int) else k)))
    size = F.least(F.length("protein_id"), F.lit(gram))
    own = named.select("protein_id", size.alias("size"), F.explode(F.when(F.length("protein_id") >= gram, runs(F.col("protein_id"), gram)).otherwise(F.array("protein_id"))).alias("run"))
    often = own.groupBy("run").agg(F.count("*").alias("often"))
    keyed = own.join(often, "run").groupBy("protein_id", "size").agg(F.min(F.struct("often", "run")).alias("rarest")).select("protein_id", F.col("rarest.run").alias("run"))
    every = F.flatten(F.array(*[F.when(F.length("file") >= k, runs(F.col("file"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, gram + 1)]))
    cut = files.select("file").distinct().withColumn("run", F.explode(every))
    return cut.join(keyed, "run").where(F.col("file").contains(F.col("protein_id"))).select("file", "protein_id")


def structures_of_genes(residues: DataFrame, proteins: DataFrame) -> DataFrame:
    """(gene, chain, coords, n_chains, whole) from residues and proteins (gene, protein_id).

    A file is a gene's if its name holds one of the ids; a gene with several files has no structure. A residue seen
    twice is an error. coords: array<struct<residue_num, x, y, z>> in order; whole: numbers run from 1 without a gap."""
    found = files_of_ids(residues.select("file"), proteins).join(proteins, "protein_id").select("gene", "file").distinct()
    single = found.groupBy("gene").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").select("gene", "file")
    checked = residues.withColumn("residue_num", F.when(F.col("copies") > 1, F.raise_error(F.concat(F.lit("an atom is seen twice in "), "file")).cast("int")).otherwise(F.col("residue_num")))
    rows = checked.join(single, "file").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("residue_num", "x", "y", "z"))).alias("coords"), F.countDistinct("chain").alias("n_chains"))
    return rows.withColumn("whole", without_gap(F.transform("coords", lambda c: c["residue_num"]), 1))


def without_gap(numbers: Column, first: int) -> Column:
    """Whether sorted numbers run from the first one on without a gap or a repeat."""
    return F.coalesce((F.array_min(numbers) == first) & (F.array_max(numbers) == first + F.size(numbers) - 1) & (F.size(F.array_distinct(numbers)) == F.size(numbers)), F.lit(False))
