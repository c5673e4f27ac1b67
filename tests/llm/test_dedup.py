import pytest

from varcluster.llm import jaccard_join as J
from varcluster.llm import substring_dedup as S
from varcluster.llm.graph import connected_components

SCHEMA = "doc_id long, text string"


def dedup(df):
    import hashlib

    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in S.substring_dedup(df).collect()), key=str)


@pytest.mark.parametrize("flush", [1, 32 << 20])
def test_substring_dedup(spark, awkward, flush, monkeypatch):
    monkeypatch.setattr(S, "FLUSH_BYTES", flush)
    df = spark.createDataFrame(awkward, SCHEMA).repartition(5)
    assert dedup(df) == sorted(S.brute_force(awkward), key=str)


def test_substring_dedup_of_repeated_and_odd_rows(spark, awkward, clash_columns):
    assert dedup(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, awkward[-1][1]), (2, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m n"), (2, "other words entirely"), (None, "a b c d e f g h i j k l m n"), (7, "z a b c d e f g h i j k l m y")]
    got = dedup(spark.createDataFrame(rows, SCHEMA))
    assert sorted((i, w, n) for i, w, n, _ in got if i) == [(1, 1, 0), (2, 3, 0), (2, 14, 0), (2, 14, 0), (7, 15, 13)]
    assert [(w, n) for i, w, n, _ in got if i is None] == [(14, 0)]
    wide = spark.createDataFrame([(1, "a b", *[1] * len(clash_columns))], f"doc_id long, text string, {', '.join(f'{c} int' for c in clash_columns)}")
    out = S.substring_dedup(wide)
    assert out.columns[: len(wide.columns)] == wide.columns and out.first()["_kept_text"] == "a b"


def test_a_hot_minimiser_is_spread_over_buckets(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "BUCKET_BYTES", 20_000)
    rng = random.Random(4)
    rows = [(i, " ".join(f"served in 17 ms by host {rng.randrange(10**6)}" for _ in range(30))) for i in range(100)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(210))) for i in range(200)] + [(500 + i, rows[i][1] + " end") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert dedup(df) == sorted(S.brute_force(rows), key=str)
    held: dict[int, int] = {}
    for r in S.packed_windows(df.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("key"), "text")).where("kind = 0").collect():
        held[r["bucket"]] = held.get(r["bucket"], 0) + len(S._unpack(r["data"])[0])
    assert max(held.values()) < 0.03 * sum(held.values())


def test_windows_of_one_hash_are_told_apart():
    import numpy as np

    data = b"aa bb"
    mark = S._later_windows(data, np.array([1, 2, 3]), np.array([0, 3, 0]), np.array([2, 5, 2]), np.array([7, 7, 7], np.uint64))
    assert mark.tolist() == [False, False, True]


@pytest.mark.parametrize("chunk", [2, 512])
def test_jaccard_join(spark, awkward, chunk, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", chunk)
    df = spark.createDataFrame(awkward, SCHEMA).repartition(3)
    assert sorted(map(tuple, J.jaccard_join(df).collect())) == sorted(J.brute_force(awkward))


def test_jaccard_join_of_odd_rows(spark):
    assert J.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (4, "")]
    wide = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", id int, key int")
    assert sorted(map(tuple, J.jaccard_join(wide).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_an_id_with_several_texts_keeps_every_link(spark):
    rows = [(1, "x a b c d e"), (1, "y a b c d f g"), (2, "x a b c d e"), (3, "y a b c d f g"), (4, "y a b c d f g h"), (4, None), (2, "z")]
    got = J.jaccard_join(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(J.brute_force(rows)) and (2, 1, 1) in map(tuple, got.collect())
    keyed = J.jaccard_join(spark.createDataFrame(rows, SCHEMA), keyed=True)
    assert len({(r["doc_id"], r["text_key"]) for r in keyed.collect()}) == len(rows)


def test_chains_of_weak_links_are_compared_in_bands(spark, monkeypatch):
    """Texts that share much run together into one component; large bands become cores."""
    import random

    monkeypatch.setattr(J, "CHUNK", 6)
    rng = random.Random(9)
    rows, words = [], [f"w{rng.randrange(500)}" for _ in range(60)]
    for i in range(80):
        rows.append((i, " ".join(words)))
        for _ in range(1 + i % 2):
            words[rng.randrange(60)] = f"y{rng.randrange(500)}"
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    for i in range(100, 130):
        rows.append((i, " ".join([*base[: rng.randrange(120)], f"z{i % 9}", *base[60:]])))
    assert sorted(map(tuple, J.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(J.brute_force(rows))


def test_which_pairs_count_does_not_depend_on_what_else_is_there(spark, monkeypatch):
    """With few bands many linked pairs share none: they count nowhere, in whatever group they stand."""
    import random

    rng = random.Random(4)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(150)] = f"z{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    df, found = spark.createDataFrame(rows, SCHEMA), []
    for chunk in (512, 20, 5):
        monkeypatch.setattr(J, "CHUNK", chunk)
        found.append(sorted(map(tuple, J.jaccard_join(df, rows=12, recall=0.05).collect())))
    assert found[0] == found[1] == found[2] != sorted(J.brute_force(rows))
    links = {i: n for i, _, n in J.brute_force(rows)}
    assert all(n <= links[i] for i, _, n in found[0]) and any(n > 0 for _, _, n in found[0])


def test_pieces_hold_every_run_once():
    import random

    from varcluster.llm.common import canonical, pieces

    rng = random.Random(2)
    assert [canonical(t) for t in (None, "", " \t ", "a  b\n\nc ", "é x\x1cy")] == [b"", b"", b"", b"a b c", "é x\x1cy".encode()]
    for width in (1, 2, 5, 13):
        for limit in (1, 7, 40, 300):
            doc = b" ".join(b"w" * rng.randrange(1, 9) + str(i).encode() for i in range(60))
            words, runs = doc.split(), []
            for number, piece in pieces(doc, width, limit):
                own = piece.split()
                assert own == words[number : number + len(own)]
                runs += range(number, number + len(own) - width + 1)
            assert runs == list(range(60 - width + 1))


def test_long_texts_in_pieces(spark, awkward, monkeypatch):
    from varcluster.llm import common

    monkeypatch.setattr(common, "PIECE_BYTES", 300)
    texts = [t for _, t in awkward]
    cut = J.shingle_sets(texts)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(cut, J.shingle_sets(texts), strict=True))


def test_bands_reach_the_recall():
    bands = J.bands_for(0.8, J.ROWS, J.RECALL)
    assert 1 - (1 - 0.8**J.ROWS) ** bands >= J.RECALL > 1 - (1 - 0.8**J.ROWS) ** (bands - 1)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 2), (9, 9), (None, 4), (7, 8), (8, 7), (500, 100)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in [*range(100, 161), 500]}, 1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_stop_at_stars_and_write_few_files(spark, monkeypatch):
    """No round only finds that nothing changes, and a round's tasks go by its rows, not by shuffle partitions."""
    from varcluster import storage
    from varcluster.llm import graph

    written = []

    def at(df, name):
        out = storage.written_at(df, name)
        written.append((name, len(out[0].inputFiles())))
        return out

    monkeypatch.setattr(graph, "written_at", at)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stars = spark.createDataFrame([(i, i % 5) for i in range(5, 300)] * 2, "a long, b long")
        assert {(r["id"], r["root"]) for r in connected_components(stars).collect()} == {(i, i % 5) for i in range(300)}
        assert [name for name, _ in written] == ["links"]
        written.clear()
        path = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
        assert {r["root"] for r in connected_components(path).collect()} == {0}
        assert len(written) > 1 and all(files <= spark.sparkContext.defaultParallelism for _, files in written[1:])
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_few_texts_are_objects_at_once(spark, monkeypatch):
    """A task turns no whole Arrow batch into Python objects, in any of its three passes over texts."""
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(S, "canonical", lambda text, own=S.canonical: (seen.append(text), own(text))[1])
    rows = 20 * S.ROWS
    batch = pa.RecordBatch.from_pydict({"id": list(range(rows)), "key": [0] * rows, "text": [f"a{i} b" for i in range(rows)], "spans": pa.array([None] * rows, pa.list_(pa.int64()))})
    first = next(S._apply("text", "spans", ["n_words", "n_removed", "kept_text"])(iter([batch])))
    assert first.num_rows == len(seen) == S.ROWS and first.column("kept_text").to_pylist() == batch.column("text").to_pylist()[: S.ROWS]
    assert max(len(x) for x in S._few(iter([batch]))) == S.ROWS
