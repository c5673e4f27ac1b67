import gzip
import io
import random
import tarfile

import pytest
from models import TWO_EXONS, frame, mirrored
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from varcluster.functions import coding as C
from varcluster.operators.sites import drawn, site_table, with_prefix_sums
from varcluster.sources.annotation import fasta_index, genome_builds, primary, read_fasta, read_fasta_regions, read_transcripts
from varcluster.sources.rates import read_genome_rates, read_rate_store, without_rates, write_rate_store
from varcluster.sources.structures import files_of_ids, read_pdb_lines, tar_members


def test_stored_rates_are_read_by_bin(spark, tmp_path):
    rates = spark.range(0, 5_000_000, 500).selectExpr("if(id % 1000 = 0, '1', '2') chrom", "cast(id as int) pos", "'A' ref", "'C' alt", "id * 1e-9 mu")
    write_rate_store(rates, str(tmp_path / "store"))
    transcripts = spark.createDataFrame([("chr1", 1_000_000, 1_100_000), ("chr1", 4_900_000, 4_900_100), ("3", 5, 9)], "chrom string, start int, end int")
    got = read_rate_store(spark, str(tmp_path / "store"), transcripts)
    bins = sorted({r[0] for r in got.select(F.floor(F.col("pos") / (1 << 20))).distinct().collect()})
    assert bins == [0, 1, 4] and got.select("chrom").distinct().collect()[0][0] == "1"
    want = rates.where("chrom = '1' and floor(pos / 1048576) in (0, 1, 4)")
    assert got.select("chrom", "pos", "mu").exceptAll(want.select("chrom", "pos", "mu")).isEmpty() and got.count() == want.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bin" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(got.inputFiles()) == 10  # of the relation; the scan lists three
    assert without_rates(transcripts, rates) == ["3"]
    assert read_rate_store(spark, str(tmp_path / "store"), transcripts.limit(0)).count() == 0


def test_the_last_file_counts_and_regions_start_after_their_first_base(spark, tmp_path):
    for name, mu in (("b", 0.1), ("a", 0.2)):
        (tmp_path / f"{name}.vcf").write_text(f"##x\nchr1\t110\t.\tA\tC\t.\t.\tMR={mu}\n1\t111\t.\tTG\tCA,G\t.\t.\tMR=0.5\n")
    paths = [str(tmp_path / "b.vcf"), str(tmp_path / "a.vcf")]
    assert {(r["pos"], r["alt"]): r["mu"] for r in read_genome_rates(spark, paths).collect()} == {(110, "C"): 0.2, (111, "C"): 0.5}
    assert {(r["pos"], r["alt"]): r["mu"] for r in read_genome_rates(spark, paths[::-1]).collect()}[110, "C"] == 0.1
    rates = spark.createDataFrame([("1", p, a, 1.0) for p in (110, 112) for a in "ACGT"], "chrom string, pos int, alt string, mu double")
    late = tuple(110 if i == 4 else 0 if i == 11 else [(110, 119), (160, 179)] if i == 7 else TWO_EXONS[10][20:] if i == 10 else v for i, v in enumerate(TWO_EXONS))
    got = {r["bp"] for r in site_table(frame(spark, late), rates, genome=True).where("mu > 0").collect()}
    assert got == {112}
    assert {r["bp"] for r in site_table(frame(spark, TWO_EXONS), rates, genome=True).where("mu > 0").collect()} == {110, 112}


def add(tar, name, text):
    data = gzip.compress(text.encode())
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def test_tars_are_read_by_ranges_of_members(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for t in range(2):
        with tarfile.open(tmp_path / f"{t}.tar", "w") as tar:
            for i in range(15):
                name = f"AF-{t}-{i}{'-' + 'x' * 120 if i % 5 == 0 else ''}.pdb.gz"
                want[name] = [f"ATOM {rng.random()}" for _ in range(rng.randrange(1, 400))]
                add(tar, name, "\n".join(want[name]))
                add(tar, name.replace("pdb", "cif"), "no")
    members = tar_members(spark, str(tmp_path), split=8_000)
    assert members.count() == 30 and members.select("path", "part").distinct().count() > 6
    rows = read_pdb_lines(spark, str(tmp_path), split=8_000)
    got = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    assert {r["line"] for r in rows.collect()} == {x for v in want.values() for x in v}


def test_a_tar_beyond_two_gigabytes(spark, tmp_path):
    """Sparse on disk: headers are hopped over, and only the small member's bytes are read."""
    with tarfile.open(tmp_path / "big.tar", "w") as tar:
        add(tar, "first.pdb.gz", "ATOM 1")
    size = (tmp_path / "big.tar").stat().st_size
    hole = tarfile.TarInfo("huge.cif.gz")
    hole.size = 3 << 30
    with open(tmp_path / "big.tar", "r+b") as f:
        f.seek(1024)
        f.write(hole.tobuf())
        f.seek(1024 + 512 + hole.size)
        data = gzip.compress(b"ATOM 2")
        info = tarfile.TarInfo("last.pdb.gz")
        info.size = len(data)
        f.write(info.tobuf() + data + b"\0" * (512 - len(data)) + b"\0" * 1024)
    assert size < 20_000 and (tmp_path / "big.tar").stat().st_size > 3 << 30
    assert sorted((r["name"], r["start"]) for r in tar_members(spark, str(tmp_path / "big.tar")).collect()) == [("first.pdb.gz", 512), ("last.pdb.gz", 1024 + 1024 + (3 << 30))]
    assert sorted(tuple(r) for r in read_pdb_lines(spark, str(tmp_path / "big.tar")).collect()) == [("first.pdb.gz", "ATOM 1"), ("last.pdb.gz", "ATOM 2")]


def test_ids_inside_file_names(spark):
    rng = random.Random(2)
    ids = sorted({"".join(rng.choice("AB1") for _ in range(rng.randrange(1, 8))) for _ in range(60)})
    files = sorted({"AF-" + "".join(rng.choice("AB1-") for _ in range(rng.randrange(0, 14))) for _ in range(120)} | {"", "A"})
    found = files_of_ids(spark.createDataFrame([(f,) for f in files * 2], "file string"), spark.createDataFrame([(i,) for i in [*ids, "", ids[0]]] + [(None,)], "protein_id string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f, i) for f in files for i in ids if i in f)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_sums_and_draws_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(0, 9)) for i in range(3000)] + [("b", 5, 2), ("b", 90_000, 3), ("b", -7, 1), ("c", 0, 0), (None, 3, 4)]
    df = spark.createDataFrame(rows, "g string, at long, w long").repartition(7)
    sums = with_prefix_sums(df, ("g",), ("at",), "w", width=100)
    assert sums.columns == ["g", "at", "w", "cumulative"]
    want, total = [], {}
    for g, at, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total[g] = total.get(g, 0) + w
        want.append((g, at, w, total[g]))
    assert sorted(map(str, (tuple(r) for r in sums.collect()))) == sorted(map(str, want))
    draws = [(g, k, rng.uniform(1e-9, total[g])) for g in ("hot", "b") for k in range(200)] + [("c", 0, 0.5)]
    got = {(r["g"], r["k"]): r["at"] for r in drawn(sums, spark.createDataFrame(draws, "g string, k int, u double"), "g", "at", width=100).collect()}
    assert got == {(g, k): next(a for n, a, w, c in want if n == g and c - w < u <= c) for g, k, u in draws if u <= total[g]}


def test_codon_info(spark):
    def of(model, bp):
        info = C.codon_info(F.col("bp"), F.col("exons"), F.col("cds"), F.col("strand"), F.col("cds_seq"))
        return tuple(frame(spark, model).withColumn("bp", F.lit(bp)).select(info.alias("i")).first()["i"])

    want = {110: (0, "ATG", 0, 0, "M", 0), 111: (1, "ATG", 1, 0, "M", 0), 112: (2, "ATG", 2, 0, "M", 0), 113: (3, "TCC", 0, 1, "S", 0), 122: (9, None, None, None, None, 3)}
    for bp, info in want.items():
        assert of(TWO_EXONS, bp) == info and of(mirrored(TWO_EXONS), 1000 - bp) == info
    for bp in (50, 95, 171):
        with pytest.raises(PySparkException, match="outside the coding sequence"):
            of(TWO_EXONS, bp)
    with pytest.raises(PySparkException, match="no codon"):
        of(tuple("NTG" + v[3:] if i == 9 else v for i, v in enumerate(TWO_EXONS)), 110)


def test_builds_and_primary_chromosomes(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("##description: annotation of the human genome (GRCh38), version 39\n##x\nchr1\tH\tgene\t3\t20\t.\t+\t.\tx\n")
    assert genome_builds(spark, str(tmp_path / "a.gtf")) == ["grch38"]
    rows = spark.createDataFrame([("chr1",), ("X",), ("chrM",), ("KI270728.1",)], "chrom string")
    assert sorted(r[0] for r in primary(rows).collect()) == ["X", "chr1"]


def test_command_line_with_stored_rates_and_old_names(spark, tmp_path):
    from test_jobs import GENOME, GTF

    from varcluster.jobs import cli

    (tmp_path / "a.gtf").write_text("##GRCh38\n" + GTF)
    (tmp_path / "a.fa").write_text(">chr1\n" + GENOME + "\n")
    (tmp_path / "g.tsv").write_text("NEW\tT1\n")
    (tmp_path / "alias.tsv").write_text("NEW\tA\nNEW\tZZ\n")
    (tmp_path / "r.vcf").write_text("".join(f"1\t{p}\t.\tN\t{a}\t.\t.\tMR=1;GR=0.001\n" for p in range(1, 28) for a in "ACGT"))
    cli.main(["rate-store", "--rates", str(tmp_path / "r.vcf"), "--rates-tag", "GR", "--out", str(tmp_path / "store")])
    common = ["--gencode", str(tmp_path / "a.gtf"), "--fasta", str(tmp_path / "a.fa"), "--genes", str(tmp_path / "g.tsv"), "--aliases", str(tmp_path / "alias.tsv"), "--out", "x"]
    run = lambda *more: cli.run(spark, cli.parser().parse_args(["rates", *common, *more])).collect()
    stored = run("--rates-format", "store", "--rates", str(tmp_path / "store"), "--genome-build", "GRCh38")
    read = run("--rates-format", "genome", "--rates", str(tmp_path / "r.vcf"), "--rates-tag", "GR")
    assert [tuple(r) for r in stored] == [tuple(r) for r in read] and stored[0]["transcript_id"] == "A" and stored[0]["missense_rate"] > -3
    with pytest.raises(ValueError, match="grch38, not grch37"):
        run("--genome-build", "grch37")


@pytest.mark.parametrize("step, end", [(7, "\n"), (64, "\r\n"), (1 << 20, "\n")])
def test_fasta_by_index(spark, tmp_path, step, end):
    rng = random.Random(step)
    want = {f"chr{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((0, 1, 60, 61, 333, 120))}
    width = {name: 20 + 7 * i for i, name in enumerate(want)}
    text = "".join(f">{name} about it{end}" + "".join(seq[i : i + width[name]] + end for i in range(0, len(seq), width[name])) for name, seq in want.items())
    (tmp_path / "g.fa").write_bytes(text.encode())
    index = fasta_index(spark, str(tmp_path / "g.fa"), step)
    assert {r["chrom"]: r["length"] for r in index.collect()} == {k: len(v) for k, v in want.items()}
    regions = spark.createDataFrame([("4", 95, 105), ("chr4", 330, 400), ("3", -5, 3), ("9", 1, 5)], "chrom string, start int, end int")
    got = {(r["chrom"], r["chunk"]): r["seq"] for r in read_fasta_regions(spark, index, regions, chunk=50).collect()}
    assert got == {(c, k): want[c][k * 50 : k * 50 + 50] for c, k in (("chr4", 1), ("chr4", 2), ("chr4", 6), ("chr3", 0))}
    every = {(r["chrom"], r["chunk"]): r["seq"] for r in read_fasta(spark, str(tmp_path / "g.fa"), 50).collect()}
    assert all(every[k] == v for k, v in got.items())


def test_fasta_of_uneven_lines_has_no_index(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(PySparkException, match="differ in length"):
        fasta_index(spark, str(tmp_path / "g.fa")).collect()


def test_transcripts_of_some_genes(spark, tmp_path):
    from test_jobs import GENOME, GTF

    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "a.fa").write_text(">chr1\n" + "\n".join(GENOME[i : i + 5] for i in range(0, len(GENOME), 5)) + "\n")
    paths = str(tmp_path / "a.gtf"), str(tmp_path / "a.fa")
    every = {r["tx"]: r for r in read_transcripts(spark, *paths).collect()}
    some = read_transcripts(spark, *paths, genes=spark.createDataFrame([("A",), ("NONE",)], "gene string")).collect()
    assert [r["tx"] for r in some] == ["T1.2"] and some[0] == every["T1.2"]
