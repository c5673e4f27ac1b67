import os
import random

import pytest

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    return DATA


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and blank texts, very long ones, repeats, near and exact copies, shared passages."""
    rng = random.Random(5)
    passage, base = sentence(rng, 60), sentence(rng, 200).split()
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, sentence(rng, 13)), (5, None)]
    rows = rows[:-1]
    for i in range(10, 30):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(200)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(i, sentence(rng, rng.randrange(5, 90)) + " " + passage + "\n" + sentence(rng, 20)) for i in range(30, 42)]
    rows += [(50, "a " * 3000), (51, sentence(rng, 20_000)), (52, "é中\U0001f600  x\x1cy"), (53, "a " * 3000), (54, "x" * 50_000)]
    return rows


@pytest.fixture(scope="session")
def clash_columns():
    """Names that operators use themselves."""
    return ["id", "key", "bucket", "spans", "n_words", "kept_text", "row_key", "score", "predicted", "held_out", "labels", "base_spans", "row", "ids", "parts0", "words", "hits", "n_removed", "secret_spans", "n_live", "class_id"]
