import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from varcluster.llm import collocations as C


def brute(rows, longest=3, least=10, keep=2000, percent=50):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        found = {p: a for p, a in n.items() if len(p) >= 2 and a >= least}
        covered = {q for p, a in found.items() for k in range(2, len(p)) for q in (p[i : i + k] for i in range(len(p) - k + 1)) if 100 * a >= percent * n[q]}
        ranked = []
        for p, a in found.items():
            if p not in covered:
                cuts = [(C.SCALE * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string"), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def sample(rng, n):
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(80)):
            words += rng.choice([["New", "york", "city"], ["the"], ["of", "the"], [f"w{rng.randrange(12)}"], ["a", "a", "a"], ["été"], [","], ["\n"], ["\t "], ["x.y"]])
        rows.append((" ".join(words), rng.choice(["en", "fr", None])))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = sample(rng, 60) + [(None, "en"), ("", "en"), (" \t\n.", None), ("lone", "zz"), ("the of " * 400, "fr"), (None, None)]
    rows += [rows[0]] * 4
    assert mined(spark, rows) == brute(rows)
    monkeypatch.setattr(C, "BLOCK_WORDS", 50)
    monkeypatch.setattr(C, "SLICE_BYTES", 40)
    for options in ({"longest": 4, "least": 4, "trie_bytes": 300}, {"longest": 2, "keep": 5}, {"bits": 64, "least": 7}):
        assert mined(spark, rows, **options) == brute(rows, **{k: v for k, v in options.items() if k in ("longest", "least", "keep")})


def test_empty_table(spark):
    assert mined(spark, [("only few words", "en")]) == []
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_blocks_repeat_what_a_border_cuts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc,") for _ in range(rng.randrange(200))) for _ in range(8)] + ["x" * 100 + " a b c"]
    frame = lambda: iter([pd.DataFrame({"lang": "l", "text": texts})])
    want = Counter()
    for t in texts:
        for piece in t.split(","):
            w = piece.split()
            want.update(" ".join(w[i : i + 3]) for i in range(len(w) - 2))
    for words, size in ((1 << 20, 1 << 20), (7, 1 << 20), (1 << 20, 11), (13, 9), (1, 1)):
        monkeypatch.setattr(C, "BLOCK_WORDS", words)
        monkeypatch.setattr(C, "SLICE_BYTES", size)
        got, all_bits = Counter(), np.full(8, 255, np.uint8)
        for block in C.blocks(frame(), 2):
            for level, at, n in C.phrases_of(block, 3, all_bits):
                if level == 3:
                    for phrase, k in zip(block.spelled(at, 3)[1].to_pylist(), n.tolist()):
                        got[phrase] += k
        assert got == want
        trie = C.Trie.unpacked(C.Trie(["l"] * len(want), sorted(want)).packed())
        total = sum((trie.count(b) for b in C.blocks(frame(), 2, trie.words)), np.zeros(trie.size, np.int64))
        assert dict(zip(sorted(want), total.tolist())) == want


def test_double_array():
    """Every phrase is found by its own number, and no other is."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    phrases = sorted({" ".join(rng.choice(words[: rng.choice((3, 3000))]) for _ in range(rng.randrange(1, 4))) for _ in range(4000)} | {f"hub {w}" for w in words})
    trie = C.Trie(["l"] * len(phrases), phrases)
    whole = {" ".join(p.split()[: k + 1]) for p in phrases for k in range(1, len(p.split()))}
    half = {(" ".join(p.split()[:k]), trie.words["l"][p.split()[k].encode()] >> C.DIGIT) for p in phrases for k in range(1, len(p.split()))}
    assert (trie.check >= 0).sum() == len(whole) + len(half)  # a place for each beginning, and for its last word's first digit
    others = [" ".join(rng.choice([*words, "hub"]) for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    lone = lambda p: C.Block([np.array([trie.words["l"].get(w, 0) for w in p.encode().split()] + [0], np.int32)], [(0, len(p.split()) - 1)], [], [])
    for p in phrases + others:
        ends = trie.count(lone(p))
        whole = phrases.index(p) if p in phrases else -1
        assert (ends[whole] == 1) if whole >= 0 else True
        assert all(p.endswith(phrases[i]) for i in np.flatnonzero(ends))


def test_scores_are_exact(spark):
    a, big = 3_000_000_000_000, 4_000_000_000_007
    counts = spark.createDataFrame([("l", "x y", a)], C.COUNTS)
    parts = spark.createDataFrame([("l", "x", big), ("l", "y", a + 1)], C.COUNTS)
    row = C.scored(counts, parts).first()
    assert row["score"] == C.SCALE * a * a // (big * (a + 1)) and (row["l"], row["r"]) == (big, a + 1)
    ties = spark.createDataFrame([("l", "x y z", 10)], C.COUNTS)
    parts = spark.createDataFrame([("l", "x", 20), ("l", "y z", 10), ("l", "x y", 10), ("l", "z", 20)], C.COUNTS)
    assert tuple(C.scored(ties, parts).select("l", "r", "score").first()) == (20, 10, 500_000)


def test_equals_its_sql(spark, sf_dir):
    import duckdb

    from varcluster.llm.oracles import collocations_sql

    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({collocations_sql()})").fetchall())
    assert sorted(tuple(r) for r in C.op13_phrase_collocations(spark, sf_dir).collect()) == want and len(want) > 500


@pytest.mark.parametrize("text", ["", "abc", "a b", " a  b ", "a" * 50, "a " * 40])
def test_slices_lose_nothing(text, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 10)
    got = list(C.slices(text.encode()))
    assert b"".join(got).decode() == text and [w for s in got for w in s.split()] == text.encode().split()


def test_packed_counts_come_back():
    rng = np.random.default_rng(1)
    for h in (np.array([7]), np.array([0, 1 << 40]), np.unique(rng.integers(0, 1 << 40, 5000)), np.arange(300)):
        n = rng.integers(1, 1 << 30, len(h))
        got = C.unpack_counts(C.pack_counts(h.astype(np.uint64), n))
        assert got[0].tolist() == h.tolist() and got[1].tolist() == n.tolist()
    h = np.sort(rng.integers(0, 1 << C.KEPT, 1 << 18)).astype(np.uint64)
    assert len(C.pack_counts(h, np.ones(len(h), int))) < 3.5 * len(h)  # rows of a hash and a count took 11 bytes


def test_tries_share_a_pass(spark, monkeypatch):
    """Words are cut once for many tries: passes over the texts do not grow with every trie."""
    rng = random.Random(7)
    rows = sample(rng, 40)
    passes, written = [], C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: (passes.append(name), written(df, name))[1])
    assert mined(spark, rows, least=2, trie_bytes=2000) == brute(rows, least=2)
    tries = C.tries_of(spark.createDataFrame([(lang, p) for lang, ranked in [("und", {w for _, _, w, *_ in brute(rows, least=2, percent=10**9)})] for p in ranked], "lang string, phrase string"), 2000)[1]
    assert tries > 1 and passes.count("trie-counts") == 1
