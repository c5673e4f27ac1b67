import gzip
import io
import tarfile

import pytest
from models import ONE_EXON, TWO_EXONS, frame, uniform_rates
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from varcluster.jobs.api import cluster, cluster_structure, gene_rates, transcripts_with_variants
from varcluster.operators.cover import counts_per_transcript, greedy_cover, held_variants, most_held
from varcluster.sources.annotation import read_fasta, read_gtf, read_transcripts, transcripts_of
from varcluster.sources.rates import in_region, kmer_length, read_context_rates, read_genome_rates
from varcluster.sources.structures import read_pdb_lines, residues_of, structures_of_genes
from varcluster.sources.variants import grouped_variants, read_gene_list, read_variants, with_previous_symbols


def variants(spark, *rows):
    return spark.createDataFrame(list(rows), "gene string, chrom string, pos int, cls string")


def of_rank(model, tx, rank, **changes):
    names = ("gene", "tx", "tx_rank", "chrom", "start", "end", "strand", "exons", "cds", "cds_seq", "gseq", "goffset", "canonical")
    return tuple((dict(zip(names, model)) | {"tx": tx, "tx_rank": rank, "canonical": rank == 0} | changes)[n] for n in names)


def test_variant_table(spark, tmp_path):
    p = tmp_path / "v.tsv"
    p.write_text("gene\tchr\tpos\tcq\ttype\nA\t1\t5\tmissense_variant\tSNV\nA\t1\t5\tmissense_variant\tSNV\nA\t1\t9\tstop_gained\tSNV\nA\t1\t7\tframeshift_variant\tDENOVO-INDEL\n.\t1\t7\tstop_gained\tSNV\nB\t1\tNA\tstop_gained\tSNV\nC\t1\t3\tsynonymous_variant\tSNV\n")
    got = {r["gene"]: (r["pos"], r["missense"], r["nonsense"]) for r in grouped_variants(read_variants(spark, str(p))).collect()}
    assert got == {"A": ([5, 9], [2, 0], [0, 1]), "C": ([], [], [])}
    with_indels = {r["gene"]: (r["pos"], r["nonsense"]) for r in grouped_variants(read_variants(spark, str(p), False)).collect()}
    assert with_indels["A"] == ([5, 7, 9], [0, 1, 1])


def test_gene_list_and_previous_symbols(spark, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text("hgnc\tenst\tlength\tcount\nA\tT1\t3\t2\nB\tT2\t4\t1\n")
    assert sorted(map(tuple, read_gene_list(spark, str(p)).collect())) == [("A", "T1"), ("B", "T2")]
    known = spark.createDataFrame([("A",), ("OLD",)], "gene string")
    aliases = spark.createDataFrame([("B", "OLD"), ("A", "OLD")], "symbol string, previous string")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    assert sorted(map(tuple, with_previous_symbols(wanted, known, aliases).collect()), key=str) == [("A", "A"), ("B", "OLD"), ("C", None)]


def test_rates(spark, tmp_path):
    rates = read_context_rates(spark)
    assert rates.count() == 192 and kmer_length(rates) == 3
    p = tmp_path / "r.txt"
    p.write_text("from to mu_snp\nAAAAA AACAA 1e-8\n")
    assert kmer_length(read_context_rates(spark, [str(p)])) == 5
    p.write_text("AAAAA AACAA 1e-8\nAAA ACA 1e-8\n")
    with pytest.raises(ValueError):
        kmer_length(read_context_rates(spark, str(p)))
    v = tmp_path / "x.vcf"
    v.write_text("##x\n#CHROM\nchr1\t10\t.\tA\tC\t.\t.\tMR=0.1;GR=0.5\n1\t11\t.\tA\tC,G\t.\t.\tGR=1;MR=0.2\n1\t11\t.\tA\tC\t.\t.\tMR=0.3\n")
    got = read_genome_rates(spark, str(v))
    assert sorted(map(tuple, got.collect())) == [("1", 10, "A", "C", 0.1), ("1", 11, "A", "C", 0.3)]
    assert in_region(got, "chr1", 10, 11).count() == 1
    assert sorted(map(tuple, read_genome_rates(spark, str(v), "GR").collect())) == [("1", 10, "A", "C", 0.5), ("1", 11, "A", "C", 1.0)]


GTF = """##x
chr1\tH\tgene\t3\t20\t.\t+\t.\tgene_id "g"; gene_name "A";
chr1\tH\ttranscript\t3\t20\t.\t+\t.\tgene_id "g"; transcript_id "T1.2"; gene_name "A"; transcript_type "protein_coding"; tag "basic"; tag "appris_principal_1";
chr1\tH\texon\t3\t20\t.\t+\t.\tgene_id "g"; transcript_id "T1.2"; gene_name "A"; transcript_type "protein_coding";
chr1\tH\tCDS\t5\t10\t.\t+\t0\tgene_id "g"; transcript_id "T1.2"; gene_name "A"; transcript_type "protein_coding";
chr1\tH\tstop_codon\t11\t13\t.\t+\t0\tgene_id "g"; transcript_id "T1.2"; gene_name "A"; transcript_type "protein_coding";
chr1\tH\ttranscript\t3\t20\t.\t-\t.\tgene_id "h"; transcript_id "T2.1"; gene_name "B"; transcript_type "protein_coding";
chr1\tH\texon\t3\t8\t.\t-\t.\tgene_id "h"; transcript_id "T2.1"; gene_name "B"; transcript_type "protein_coding";
chr1\tH\texon\t12\t20\t.\t-\t.\tgene_id "h"; transcript_id "T2.1"; gene_name "B"; transcript_type "protein_coding";
chr1\tH\tCDS\t12\t14\t.\t-\t0\tgene_id "h"; transcript_id "T2.1"; gene_name "B"; transcript_type "protein_coding";
chr1\tH\ttranscript\t3\t20\t.\t+\t.\tgene_id "n"; transcript_id "T3.1"; gene_name "N"; transcript_type "lincRNA";
chr1\tH\texon\t3\t8\t.\t+\t.\tgene_id "n"; transcript_id "T3.1"; gene_name "N"; transcript_type "lincRNA";
"""
GENOME = "NNACATGCCCTAAGGATTACAGATTACA"


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_annotation(spark, tmp_path, chunk, monkeypatch):
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "a.fa").write_text(">chr0 x\nAC\n>chr1 y\n" + "\n".join(GENOME[i : i + 5] for i in range(0, len(GENOME), 5)) + "\n")
    genome = read_fasta(spark, str(tmp_path / "a.fa"), chunk)
    parts = sorted((r["chrom"], r["chunk"], r["seq"]) for r in genome.collect())
    assert "".join(s for c, _, s in parts if c == "chr1") == GENOME and all(len(s) <= chunk for _, _, s in parts)
    from varcluster.sources.annotation import with_sequences

    rows = {r["tx"]: r for r in with_sequences(transcripts_of(read_gtf(spark, str(tmp_path / "a.gtf"))), genome, chunk=chunk).collect()}
    assert set(rows) == {"T1.2", "T2.1"}
    one, two = rows["T1.2"], rows["T2.1"]
    assert (one["exons"], one["cds"], one["cds_seq"], one["goffset"], one["canonical"]) == ([(3, 20)], [(5, 13)], "ATGCCCTAA", 2, True)
    assert one["gseq"] == GENOME[: 20 + 10] and two["cds_seq"] == "CTT"
    assert read_transcripts(spark, str(tmp_path / "a.gtf"), str(tmp_path / "a.fa")).count() == 2


def test_cover(spark):
    left = of_rank(TWO_EXONS, "LEFT", 0, exons=[(100, 119)], cds=[(110, 119)], end=119)
    right = of_rank(TWO_EXONS, "RIGHT", 1, exons=[(160, 179)], cds=[(160, 170)], start=160)
    twin = of_rank(TWO_EXONS, "TWIN", 2, exons=[(160, 179)], cds=[(160, 170)], start=160)
    grouped = grouped_variants(variants(spark, ("G", "1", 111, "missense"), ("G", "1", 162, "missense"), ("G", "1", 162, "nonsense")))
    held = held_variants(frame(spark, left, right, twin), grouped)
    assert sorted((r["tx"], r["len"], r["n"]) for r in counts_per_transcript(held).collect()) == [("LEFT", 10, 1), ("RIGHT", 11, 2), ("TWIN", 11, 2)]
    got = [(r["tx"], r["n"], r["pos"], r["missense"], r["nonsense"]) for r in greedy_cover(held, grouped).orderBy("tx_rank").collect()]
    assert got == [("LEFT", 1, [111], [1], [0]), ("RIGHT", 2, [162], [1], [1]), ("TWIN", 2, [], [], [])]
    assert sorted(r["tx"] for r in most_held(counts_per_transcript(held)).collect()) == ["RIGHT", "TWIN"]
    far = grouped_variants(variants(spark, ("G", "1", 5, "missense")))
    assert greedy_cover(held_variants(frame(spark, left), far), far).count() == 0
    rows = transcripts_with_variants(variants(spark, ("G", "1", 111, "missense")), frame(spark, left, right), minimal=False)
    assert [tuple(r) for r in rows.collect()] == [("G", "LEFT", 10, 1), ("G", "RIGHT", 11, 0)]
    assert [tuple(r) for r in transcripts_with_variants(variants(spark, ("G", "1", 111, "missense")), frame(spark, left, right), minimal=True).collect()] == [("G", "LEFT", 10, 1)]


def test_cluster(spark):
    rows = variants(spark, ("H", "1", 5, "missense"), ("H", "1", 5, "missense"), ("G", "1", 111, "missense"), ("X", "1", 1, "missense"), ("X", "1", 1, "missense"), ("S", "1", 4, None))
    got = [tuple(r) for r in cluster(rows, frame(spark, ONE_EXON, TWO_EXONS), read_context_rates(spark), iterations=10_000).collect()]
    assert [r[:4] for r in got] == [("H", "missense", 2, "0.0"), ("H", "nonsense", 0, "nan")]
    assert 0 < got[0][4] < 0.04 and got[1][4] is None
    far = variants(spark, ("H", "1", 5, "missense"), ("H", "1", 58, "missense"))
    assert [tuple(r) for r in cluster(far, frame(spark, ONE_EXON), read_context_rates(spark), iterations=2_000).collect()][0][3:] == ("53.0", 1.0)


def test_cluster_in_two_transcripts(spark):
    left = of_rank(TWO_EXONS, "LEFT", 0, exons=[(100, 119)], cds=[(110, 119)], end=119)
    right = of_rank(TWO_EXONS, "RIGHT", 1, exons=[(160, 179)], cds=[(160, 170)], start=160, cds_seq="CAAAGCCTGAG", gseq=TWO_EXONS[10][60:], goffset=10)
    rows = variants(spark, ("G", "1", 111, "missense"), ("G", "1", 113, "missense"), ("G", "1", 166, "missense"))
    got = [tuple(r) for r in cluster(rows, frame(spark, left, right), uniform_rates(spark), iterations=2_000).collect()]
    assert got[0][:4] == ("G", "missense", 3, "2.0,nan") and 0 < got[0][4] < 1


def pdb(n, chain="A", skip=()):
    line = "ATOM  {:5d}  {:<3s} MET {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00 90.00           C"
    return "\n".join(line.format(i, atom, chain, i, i, i, i) for i in range(1, n + 1) if i not in skip for atom in ("CA", "C")) + "\nEND\n"


def tar(path, **files):
    with tarfile.open(path, "w") as t:
        for name, text in files.items():
            data = gzip.compress(text.encode())
            for member in (f"AF-{name}-F1.pdb.gz", f"AF-{name}-F1.cif.gz"):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))


def test_structures(spark, tmp_path):
    tar(tmp_path / "s.tar", P1=pdb(18), P2=pdb(9) + pdb(9, "B"), P3=pdb(18, skip=(4,)), P4=pdb(18), P4X=pdb(3))
    residues = residues_of(read_pdb_lines(spark, str(tmp_path / "s.tar")))
    ids = spark.createDataFrame([("H", "P1"), ("TWO", "P2"), ("GAP", "P3"), ("MANY", "P4")], "gene string, protein_id string")
    found = structures_of_genes(residues, ids)
    got = {r["gene"]: (len(r["coords"]), r["n_chains"], r["whole"]) for r in found.collect()}
    assert got == {"H": (18, 1, True), "TWO": (18, 2, False), "GAP": (17, 1, False)}
    rows = variants(spark, ("H", "1", 6, "missense"), ("H", "1", 12, "missense"), ("GAP", "1", 6, "missense"), ("GAP", "1", 6, "missense"), ("MANY", "1", 6, "missense"), ("MANY", "1", 6, "missense"))
    models = frame(spark, *[of_rank(ONE_EXON, "T", 0, gene=g) for g in ("H", "GAP", "MANY")])
    out = [tuple(r) for r in cluster_structure(rows, models, read_context_rates(spark), found, iterations=2_000).collect()]
    assert [r[:4] for r in out] == [("GAP", "missense", 2, "nan"), ("GAP", "nonsense", 0, "nan"), ("H", "missense", 2, "3.5"), ("H", "nonsense", 0, "nan")]
    assert out[0][4] is None and 0 < out[2][4] < 1
    with pytest.raises(PySparkException):
        structures_of_genes(residues.withColumn("copies", F.lit(2)), ids).collect()


def test_gene_rates(spark):
    second = of_rank(TWO_EXONS, "TEST2.1", 1)
    odd = of_rank(TWO_EXONS, "ODD", 0, gene="ODD", cds_seq="ATGT")
    listed = spark.createDataFrame([("G", "TEST"), ("ODD", "ODD"), ("NONE", "X")], "symbol string, transcript_id string")
    both = spark.createDataFrame([("G", "TEST"), ("G", "TEST2")], "symbol string, transcript_id string")
    models = frame(spark, TWO_EXONS, second, odd)
    got = {r["transcript_id"]: r for r in gene_rates(listed, models, uniform_rates(spark)).collect()}
    import math

    assert got["G"]["length"] == 20 and got["G"]["missense_rate"] == pytest.approx(math.log10(2.45e-5)) and got["G"]["frameshift_rate"] == pytest.approx(math.log10(5e-7 * 1.25))
    assert got["ODD"]["missense_rate"] is None and got["ODD"]["chrom"] == "1" and got["NONE"]["chrom"] is None
    twice = gene_rates(both, models, uniform_rates(spark)).first()
    assert twice["missense_rate"] == pytest.approx(math.log10(2.45e-5))  # bases that the first transcript codes for are masked
    assert twice["splice_lof_rate"] == pytest.approx(math.log10(2 * 6e-6))  # shared splice sites are not


def test_samplers_are_appended(spark):
    from varcluster.operators.sites import append_samplers

    columns = "gene string, tx string, consequence string, bp int, ref string, alt string, mu double"
    a, b = spark.createDataFrame([("A", "t", "missense", 5, "A", "C", 1.0), ("A", "t", "missense", 9, "A", "C", 5.0)], columns), spark.createDataFrame([("A", "t", "missense", 2, "A", "G", 4.0)], columns)
    assert [(r["bp"], r["cumulative"]) for r in append_samplers(a, b).orderBy("cumulative").collect()] == [(5, 1.0), (9, 6.0), (2, 10.0)]
    assert a.count() == 2
    with pytest.raises(Exception, match="single base"):
        append_samplers(a, b.withColumn("alt", F.lit("GT"))).collect()


def test_batches_and_symbols(spark):
    from varcluster.sources.variants import many_missense

    rows = spark.createDataFrame([("A", "missense_variant")] * 2 + [("B", "missense_variant"), ("B", "stop_lost"), ("C", "stop_gained")], "gene string, consequence string")
    assert [r[0] for r in many_missense(rows).collect()] == ["A"]
    known, aliases = spark.createDataFrame([("OLD1",), ("OLD2",), ("X",)], "gene string"), spark.createDataFrame([("NEW", "OLD1"), ("NEW", "OLD2"), ("X", "OLD1"), ("Y", "OLD2")], "symbol string, previous string")
    of = lambda *names: sorted(map(tuple, with_previous_symbols(spark.createDataFrame([(n,) for n in names], "symbol string"), known, aliases).collect()))
    assert of("X", "Y") == [("X", "X"), ("Y", "OLD2")]
    with pytest.raises(Exception, match="several previous symbols"):
        of("NEW")
