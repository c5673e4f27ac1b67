import corpus_pipeline as P
from varcluster.llm import jaccard_join as J
from varcluster.llm import substring_dedup as S


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.selectExpr("*", "1 as predicted", "2 as kept_text", "3 as n_removed", "4 as secret_spans", "5 as id")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = P.materialise(stage(spark, extra, sf_dir), "test-stage")
        assert out.columns == extra.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "ngram_jaccard_join":
            brute = J.brute_force(list(before.items()))
            assert set(after) == {i for i, root, _ in brute if i == root} and all(after[i] == before[i] for i in after)
        elif name == "substring_dedup":
            assert set(after) == set(before)
            for i, _, removed, _ in S.brute_force(list(before.items())):
                assert (after[i] == before[i]) == (removed == 0)
        elif name == "secret_scan":
            assert set(after) == set(before) and all(after[i] == before[i] or "[secret]" in after[i] for i in before)
        else:
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert sum((i in after) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def small(spark, folder, rows, labels):
    folder.mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_run_of_odd_rows_by_brute_force(spark, tmp_path):
    """Nulls, empty texts, repeated rows, one id with two texts, copies, shared passages and secrets; no label: all are kept."""
    import random

    from tokenizers import Tokenizer

    from varcluster.llm.bpe import tokenizer_file

    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passage, copy = words(40), words(80)
    texts = [(1, None), (2, ""), (3, " \n "), (4, copy), (5, copy), (6, copy + " end"), (7, words(30) + " " + passage), (8, passage + " " + words(30)), (9, "password = hunter2hunter and more"), (9, "another text of nine"), (10, words(3000)), (10, None), (11, "é中 x"), (None, "no id")]
    rows = [(i, t, "en", None, None) for i, t in texts]
    where = small(spark, tmp_path / "some", [*rows, rows[8], rows[3]], [])
    got = P.run(spark, where).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    count = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    size = lambda t: len(count.encode(t or "", add_special_tokens=False).ids) + 1
    kept = dict(texts)
    assert 5 not in tokens and 6 not in tokens  # copies of 4
    assert sum(n for _, n, _ in tokens[4]) == 2 * size(copy)  # a row that repeats id and text stays with the other
    assert tokens[10][0][2] in (size(kept[10]), size(texts[10][1]))
    later = " ".join(texts[7][1].split()[40:])
    assert {d for _, _, d in tokens[8]} == {size(later)} and {d for _, _, d in tokens[7]} == {size(texts[6][1])}
    assert {d for _, _, d in tokens[9]} == {size("[secret] and more"), size("another text of nine")}
    assert {d for _, _, d in tokens[1]} == {1} and {d for _, _, d in tokens[2]} == {1} and {d for _, _, d in tokens[None]} == {size("no id")}
    for sequence in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_empty_tables(spark, tmp_path):
    assert P.run(spark, small(spark, tmp_path / "none", [], [])).count() == 0
    assert P.run(spark, small(spark, tmp_path / "labelled", [], [(1, 1, 0)])).count() == 0
