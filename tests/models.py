"""Hand-built transcripts."""

SCHEMA = "gene string, tx string, tx_rank int, chrom string, start int, end int, strand string, exons array<struct<s:int,e:int>>, cds array<struct<s:int,e:int>>, cds_seq string, gseq string, goffset int, canonical boolean"
TWO_EXONS = ("G", "TEST", 0, "1", 100, 179, "+", [(100, 119), (160, 179)], [(110, 119), (160, 170)], "ATGTCCATAACCAAAGCCTGA", "CCTCCAGATTCACGGGAAGCATGTCCATAAGTAGGGAGATATTTGGTGCTCTCATTTGTGGAGACTCTAGCCAAAGCCTGAGTCATGCGTACCATAGATAG", 10, True)
ONE_EXON = ("H", "TEST1", 0, "1", 0, 70, "+", [(5, 58)], [(5, 58)], "ATGTGGGCTCCACCAGCAGCAATCATGGGATGGGCCCACCAAGAAGGTGGGTAA", "GGGGGATGTGGGCTCCACCAGCAGCAATCATGGGATGGGCCCACCAAGAAGGTGGGTAACCAGGCCCC", 0, True)
NO_SEQUENCE = ("T", "test1", 0, "1", 10, 100, "+", [(10, 20), (30, 40), (90, 100)], [(30, 40), (90, 95)], "", "", 0, True)


def mirrored(model: tuple, length: int = 1000) -> tuple:
    """The model on the other strand of a chromosome read backwards."""
    gene, tx, rank, chrom, start, end, _, exons, cds, cds_seq, gseq, goffset, canonical = model
    flip = lambda x: sorted((length - e, length - s) for s, e in x)
    far = len(gseq) - goffset - (end - start + 1)  # bases beyond end
    return (gene, tx, rank, chrom, length - end, length - start, "-", flip(exons), flip(cds), cds_seq, gseq[::-1].translate(str.maketrans("ACGT", "TGCA")), far, canonical)


def frame(spark, *models):
    return spark.createDataFrame(list(models), SCHEMA)


def uniform_rates(spark, k: int = 3, mu: float = 5e-7):
    from itertools import product

    rows = [("".join(x), "".join(x[: k // 2]) + b + "".join(x[k // 2 + 1 :]), mu) for x in product("ACGT", repeat=k) for b in "ACGT" if b != x[k // 2]]
    return spark.createDataFrame(rows, "kmer_from string, kmer_to string, mu double")
