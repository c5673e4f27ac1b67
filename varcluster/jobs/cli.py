"""Command line: python -m varcluster.jobs.cli {cluster,cluster-structure,transcripts,rates,rate-store} ...

Reads variant, annotation, sequence, rate and structure files by Spark and writes a tab-separated table to a folder, with
NA for what is missing."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.annotation import genome_builds, read_transcripts
from ..sources.rates import read_context_rates, read_genome_rates, read_rate_store, without_rates, write_rate_store
from ..sources.structures import read_pdb_lines, residues_of, structures_of_genes
from ..sources.variants import read_gene_list, read_variants, with_previous_symbols
from ..storage import remove_all
from . import api


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--out", required=True, help="folder for the result")
    common.add_argument("--gencode", required=True, help="annotation, GTF")
    common.add_argument("--fasta", required=True, help="genome sequence")
    common.add_argument("--indexed-fasta", action="store_true", help="the sequence lies on a mounted folder in lines of one length: read the chunks of the input's genes alone")
    common.add_argument("--rates", nargs="*", help="mutation rates; the default ones by trinucleotide if left out")
    common.add_argument("--rates-format", default="context", choices=["context", "genome", "store"], help="by sequence context, by genome position in VCF, or as rate-store has written them")
    common.add_argument("--rates-tag", default="MR", help="INFO entry of rates by genome position")
    common.add_argument("--genome-build", type=str.lower, choices=["grch37", "grch38"], help="an error if the annotation names another one")
    common.add_argument("--aliases", help="table of symbols and previous symbols, tab-separated, for genes that the annotation has under an old name")
    common.add_argument("--log", help="file for messages; standard error if left out")
    p = argparse.ArgumentParser(prog="varcluster")
    jobs = p.add_subparsers(dest="job", required=True)
    cluster = jobs.add_parser("cluster", parents=[common])
    cluster.add_argument("--in", dest="input", required=True)
    structure = jobs.add_parser("cluster-structure", parents=[common])
    structure.add_argument("--in", dest="input", required=True)
    structure.add_argument("--structures", required=True, help="tar files of PDB structures")
    structure.add_argument("--proteins", required=True, help="table of genes and protein ids, tab-separated")
    transcripts = jobs.add_parser("transcripts", parents=[common])
    transcripts.add_argument("--de-novos", dest="input", required=True)
    mode = transcripts.add_mutually_exclusive_group(required=True)
    mode.add_argument("--all-transcripts", action="store_true")
    mode.add_argument("--minimise-transcripts", action="store_true")
    rates = jobs.add_parser("rates", parents=[common])
    rates.add_argument("--genes", required=True)
    store = jobs.add_parser("rate-store", help="genome rates of VCF files, written in bins so that other jobs read a few")
    store.add_argument("--rates", nargs="+", required=True)
    store.add_argument("--rates-tag", default="MR")
    store.add_argument("--out", required=True)
    return p


LOG = logging.getLogger("varcluster")


def read_rates(spark: SparkSession, args: argparse.Namespace, transcripts: DataFrame) -> tuple[DataFrame, bool]:
    """Rates, and whether they go by genome position."""
    if args.rates_format == "context":
        return read_context_rates(spark, args.rates or None), False
    if not args.rates:
        raise ValueError("rates by genome position need --rates")
    rates = read_rate_store(spark, args.rates[0], transcripts) if args.rates_format == "store" else read_genome_rates(spark, args.rates, args.rates_tag)
    for chrom in without_rates(transcripts, rates):
        LOG.warning("no rates on chromosome %s", chrom)
    return rates, True


def wanted_genes(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """The genes of the input, old names included, by which a FASTA file with an index is read; None if it has none."""
    if not args.indexed_fasta:
        return None
    rows = read_gene_list(spark, args.genes).select(F.col("symbol").alias("gene")) if args.job == "rates" else read_variants(spark, args.input).select("gene")
    if args.aliases:
        rows = rows.union(spark.read.csv(args.aliases, sep="\t", schema="symbol string, previous string").select("previous"))
    return rows


def with_known_names(spark: SparkSession, args: argparse.Namespace, rows: DataFrame, name: str, transcripts: DataFrame) -> DataFrame:
    """rows with the annotation's name of each gene where it has only a previous one."""
    if not args.aliases:
        return rows
    aliases = spark.read.csv(args.aliases, sep="\t", schema="symbol string, previous string")
    found = with_previous_symbols(rows.select(F.col(name).alias("symbol")).distinct(), transcripts.select("gene").distinct(), aliases)
    renamed = rows.join(found.withColumnsRenamed({"symbol": "_symbol", "gene": "_gene"}), F.col(name) == F.col("_symbol"), "left")
    return renamed.withColumn(name, F.coalesce("_gene", name)).select(*rows.columns)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.genome_build:
        named = genome_builds(spark, args.gencode)
        if named and args.genome_build not in named:
            raise ValueError(f"the annotation is of {', '.join(named)}, not {args.genome_build}")
    transcripts = read_transcripts(spark, args.gencode, args.fasta, wanted_genes(spark, args))
    if args.job == "rates":
        rates, genome = read_rates(spark, args, transcripts)
        return api.gene_rates(with_known_names(spark, args, read_gene_list(spark, args.genes), "symbol", transcripts), transcripts, rates, genome)
    variants = with_known_names(spark, args, read_variants(spark, args.input), "gene", transcripts)
    if args.job == "transcripts":
        return api.transcripts_with_variants(variants, transcripts, args.minimise_transcripts)
    rates, genome = read_rates(spark, args, transcripts)
    if args.job == "cluster":
        return api.cluster(variants, transcripts, rates, genome)
    proteins = spark.read.csv(args.proteins, sep="\t", schema="gene string, protein_id string")
    return api.cluster_structure(variants, transcripts, rates, structures_of_genes(residues_of(read_pdb_lines(spark, args.structures)), proteins), genome)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(filename=getattr(args, "log", None), level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(f"varcluster {args.job}").getOrCreate()
    LOG.info("%s: %s", args.job, vars(args))
    if args.job == "rate-store":
        write_rate_store(read_genome_rates(spark, args.rates, args.rates_tag), args.out)
        return
    rows = run(spark, args)
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in rows.columns]).write.csv(args.out, sep="\t", header=True)
    remove_all(spark)


if __name__ == "__main__":
    main()
