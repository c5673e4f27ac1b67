import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"


def test_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    from varcluster.jobs.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as from '{DATA}/{t}'")
    for name in sorted(ORACLE_SQL):
        a, b = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
        assert sorted(a.columns) == sorted(b.columns), name
        plain = lambda x: sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in x[sorted(x.columns)].itertuples(index=False))
        assert plain(a) == plain(b), name


def test_nothing_else_imports_the_subpackage():
    code = "import sys; import varcluster.jobs.queries, varcluster.jobs.cli, varcluster.streaming.gates; print([m for m in sys.modules if m.startswith('varcluster.llm')])"
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "[]"


def test_stream(spark, tmp_path):
    from varcluster.sources.variants import COLUMNS
    from varcluster.streaming.gates import counted_genes, genes_to_test

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("A\t1\t5\tmissense_variant\tSNV\nA\t1\t6\tstop_gained\tSNV\nB\t1\t6\tstop_gained\tSNV\n")
    stream = spark.readStream.schema(COLUMNS).option("sep", "\t").csv(str(tmp_path / "in"))
    q = genes_to_test(counted_genes(stream)).writeStream.outputMode("complete").format("memory").queryName("gates").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("gates").collect()] == [("A", 1, 1)]


def test_command_line(spark, tmp_path):
    from test_jobs import GENOME, GTF

    from varcluster.jobs import cli

    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "a.fa").write_text(">chr1\n" + GENOME + "\n")
    (tmp_path / "g.tsv").write_text("hgnc\tenst\nA\tT1\n")
    (tmp_path / "v.tsv").write_text("gene\tchr\tpos\tcq\ttype\nA\t1\t5\tmissense_variant\tSNV\n")
    common = ["--gencode", str(tmp_path / "a.gtf"), "--fasta", str(tmp_path / "a.fa"), "--genome-build", "GRCh38"]
    cli.main(["rates", *common, "--genes", str(tmp_path / "g.tsv"), "--out", str(tmp_path / "rates")])
    row = spark.read.csv(str(tmp_path / "rates"), sep="\t", header=True).first()
    assert row["transcript_id"] == "A" and row["length"] == "8" and row["splice_lof_rate"] == "NA"
    args = cli.parser().parse_args(["transcripts", *common, "--de-novos", str(tmp_path / "v.tsv"), "--minimise-transcripts", "--out", "x"])
    assert [tuple(r) for r in cli.run(spark, args).collect()] == [("A", "T1.2", 9, 1)]
