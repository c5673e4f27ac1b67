"""Filter interaction audit: what each of a few filters removes at each place of every order, by a Gray-code walk over subsets.

1. A document becomes its failure mask, a bit per filter that it fails, from columns alone. Whether an identical text has
   a smaller id is found over the table as a whole: slim rows (id, part, mask, digest) are written, the least id of each
   digest with several rows is counted by partial aggregates, and joined back; digests with more than a thousandth of all
   rows are broadcast (there are no more than a thousand), so a hot text spreads over all tasks.
2. Documents are summed by part and mask: 2 ** filters cells a part, whatever the number of documents.
3. Subsets of filters are walked in Gray-code order: each step toggles one filter. Every cell keeps how many active filters
   it fails; a cell whose counter leaves or reaches zero takes its documents from, or gives them back to, the running
   survivors. The survivors of all subsets (32 for five filters) are stored, for all parts of a batch at once.
4. A step of an order is the difference of two stored states: survivors of the filters before it and with it. So are failures
   (nothing against the filter alone) and unique failures (all others against all). Shapley sums go over all orders.

Nulls and edge cases: a null text is empty; a null part is the empty string; a null id has no smaller id and is none's
smaller id; rows that repeat an id and its text are documents each and none is a copy of the other; labels that repeat an
id count if any says so, null labels and ids without a label say nothing; very long texts are looked at whole, one at a
time; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise, table

FILTERS = "ABCDE"
FEW_WORDS = 200
DISTINCT_PERCENT, UPPER_PERCENT = 50, 2
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Failure conditions that a text decides alone, A to D, in order; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < FEW_WORDS, distinct * 100 < n * DISTINCT_PERCENT, upper.cast("long") * 100 > F.length(text).cast("long") * UPPER_PERCENT, F.rlike(text, F.lit(SYMBOLS))]


def mask_of(failures: Sequence[Column]) -> Column:
    """Bit i is set if condition i holds."""
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)]
    return sum(bits[1:], bits[0]).cast("int")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row of docs, for FILTERS."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask_of(text_failures(F.col(text_col))).alias("mask"), digest.alias("digest"))
    slim = materialise(slim, "filter-masks")
    firsts = slim.groupBy("digest").agg(F.count("*").alias("often"), F.min("id").alias("least")).where("often > 1")
    firsts = materialise(firsts, "filter-copies")
    rows = hot_join(slim, firsts, "digest", "often", slim.count(), "left")
    copy = F.coalesce(F.col("least") < F.col("id"), F.lit(False))
    return rows.select("id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).cast("int").alias("mask"))


def cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and those that are toxic."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def survivors(counts: np.ndarray, filters: int) -> np.ndarray:
    """counts[..., mask] -> what survives each subset of filters, [..., subset]: a walk that toggles one filter at a time."""
    size = 1 << filters
    failing = np.zeros(size, np.int64)  # active filters that a cell fails
    masks = np.arange(size)
    has = [(masks >> f & 1).astype(bool) for f in range(filters)]
    states = np.zeros(counts.shape[:-1] + (size,), np.int64)
    running, subset = counts.sum(axis=-1), 0
    states[..., 0] = running
    for step in range(1, size):
        f = (step & -step).bit_length() - 1  # the bit in which Gray codes of step - 1 and step differ
        subset ^= 1 << f
        if subset >> f & 1:
            gone = has[f] & (failing == 0)
            failing[has[f]] += 1
            running = running - counts[..., gone].sum(axis=-1)
        else:
            failing[has[f]] -= 1
            running = running + counts[..., has[f] & (failing == 0)].sum(axis=-1)
        states[..., subset] = running
    return states


def _steps(filters: str):
    """All orders and steps as arrays: text, step, filter, subset before, subset with it."""
    text, step, which, before = [], [], [], []
    for order in permutations(range(len(filters))):
        subset = 0
        for k, f in enumerate(order):
            text.append("".join(filters[i] for i in order)), step.append(k + 1), which.append(f), before.append(subset)
            subset |= 1 << f
    which, before = np.array(which), np.array(before)
    return np.array(text, object), np.array(step, np.int32), which, before, before | 1 << which


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """RESULT from cells (part, mask, n, good, toxic): a row per part, order of filters and step."""
    size = 1 << len(filters)
    kinds = ("n", "good", "toxic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, step, which, before, after = _steps(filters)
        everything = size - 1
        for batch in batches:
            for part, found in zip(batch["part"], batch["cells"]):
                counts = np.zeros((len(kinds), size), np.int64)
                for c in found:
                    counts[:, c["mask"]] += [c[k] for k in kinds]
                kept, good, toxic = survivors(counts, len(filters))
                removed = kept[before] - kept[after]
                fails = (kept[0] - kept[1 << np.arange(len(filters))])[which]
                alone = (kept[everything ^ (1 << np.arange(len(filters)))] - kept[everything])[which]
                shapley = np.zeros(len(filters), np.int64)
                np.add.at(shapley, which, removed)
                yield pd.DataFrame({"part": part, "filter_order": text, "step": step, "kept": kept[after], "removed": removed, "redundant": fails - removed, "unique_fails": alone, "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after], "shapley": shapley[which]})

    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *kinds)).alias("cells"))  # a row per mask at most
    return packed.mapInPandas(run, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(failure_masks(docs), labels))


def op12_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
