"""Where near duplicates once took more disk than a multiple of the input: a case for F1 of FINDINGS_r02.md."""

import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from conftest import rows

from corpuslane.llm import near_duplicates
from corpuslane.session import shared_dir


def test_unlike_texts_of_few_words_are_no_candidates(spark, monkeypatch):
    """Their bands meet by chance, more often than in proportion; only similar pairs may leave the task where they meet."""
    rng = random.Random(3)
    nouns, verbs = ([f"{x}{k}" for k in range(n)] for x, n in (("noun", 24), ("verb", 9)))
    clause = lambda: f"the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)}"
    items = [(k, " ".join(clause() for _ in range(16))) for k in range(2500)]
    for k in range(50):
        w = items[k * 40][1].split()
        w[rng.randrange(len(w))] = "changed"
        items.append((10_000 + k, " ".join(w)))
    table = spark.createDataFrame(items, "row_id long, text string").repartition(4)
    want = [(k * 40, 10_000 + k) for k in range(50)]
    real, seen = near_duplicates._verified, []
    monkeypatch.setattr(near_duplicates, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    assert rows(near_duplicates.pairs(table)) == want
    assert max(seen) <= 2 * len(want)
    monkeypatch.setattr(near_duplicates, "TEXTS_A_PASS", 600)
    assert rows(near_duplicates.pairs(table)) == want
    assert not list(Path(urlparse(shared_dir(spark)).path).glob("signatures-*"))


def test_sketches_drop_no_similar_pair():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 30, 90, 150, 250, 300, 3000):
        for threshold in (0.5, 0.8):
            share = int(np.ceil(2 * n * threshold / (1 + threshold)))  # of 2 x n runs, so many common give the similarity
            x = rng.integers(0, 2**63, (200, 2 * n), dtype=np.uint64)
            a, b = x[:, :n], x[:, n - share :][:, :n]
            own = [near_duplicates.sketches(y.ravel(), np.full(200, n)).T for y in (a, b)]
            runs = np.full(200, min(n, near_duplicates.MANY), np.uint8)
            similar = [len({*p} & {*q}) >= threshold * len({*p} | {*q}) - 1e-9 for p, q in zip(a.tolist(), b.tolist())]
            assert all(similar) and near_duplicates._near(*own, runs, runs, threshold).all()
    x = rng.integers(0, 2**63, 200 * 90, dtype=np.uint64)
    s = near_duplicates.sketches(x, np.full(200, 90)).T
    runs = np.full(100, 90, np.uint8)
    assert not near_duplicates._near(s[:, :100], s[:, 100:], runs, runs, 0.5).any()


def test_hot_in_a_block_or_where_blocks_meet(spark):
    """A key that a later block finds hot empties what was held of it."""
    h, d = np.full(30, 7, np.uint32), np.arange(30, dtype=np.int64)
    blocks = [(0, 0, bytearray(near_duplicates._pack(h, d))), (0, 1, bytearray(near_duplicates._pack(h, d + 100)))]
    got = near_duplicates._meet(spark.createDataFrame(blocks, "part int, kind int, data binary").coalesce(1))
    assert {tuple(r) for r in got.select("kind", "a").collect()} == {(1, k) for k in [*range(30), *range(100, 130)]}
