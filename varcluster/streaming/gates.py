"""Variants as they arrive: which genes have enough of them to be tested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.variants import usable_variants


def counted_genes(rows: DataFrame, exclude_indels: bool = True) -> DataFrame:
    """(gene, missense, nonsense) over a stream (or table) of variant rows; write it in update or complete mode. The state
    is two counts a gene."""
    of = lambda cls: F.count(F.when(F.col("cls") == cls, 1)).alias(cls)
    return usable_variants(rows, exclude_indels).groupBy("gene").agg(of("missense"), of("nonsense"))


def genes_to_test(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("missense") + F.col("nonsense") >= least)
