"""Groups of similar documents against brute force, in a cloud of edited copies and in short texts."""

import random

import numpy as np
import pytest

from docledger.llm import simhash


def shingle_sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets = {i: shingle_sets(t) for i, t in texts.items()}
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for o in ids[:k]:
            a, b = sets[i], sets[o]
            if len(a & b) >= 0.8 * len(a | b):
                a, b = root(i), root(o)
                group[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("leaf, share", [(2000, 20_000), (8, 20_000), (30, 9)])
def test_cloud_of_copies(spark, leaf, share):
    """Copies of one text with up to nine edits, whose similarities go from 0.4 to 1, next to unrelated texts and short ones."""
    rng = random.Random(leaf)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 10)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {200 + i: " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for i in range(150)}
    texts |= {400: "one two", 401: "ONE  two", 402: "", 403: " \n", 404: "one two three"}
    rows = [(i, t) for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id: r.first for r in simhash.similar_groups(spark.createDataFrame([*rows, (7, texts[7]), (None, base[0])], "doc_id long, text string"), leaf=leaf, share=share).collect()}
    want = brute_groups(texts)
    assert set(got) == set(texts)
    assert all(want[i] == want[f] for i, f in got.items())  # no link that is none
    assert len(set(got.values())) <= len(set(want.values())) + 2  # and hardly one lost


def test_distance_follows_similarity():
    """Over 256 bits the fingerprints of sets of similarity 0.8 stay within the radius, and so do their first words."""
    rng = np.random.default_rng(5)
    near = first = 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        a, b = (np.frombuffer(simhash.wide_fingerprint(np.concatenate((both, rng.integers(0, 1 << 63, 20).astype(np.uint64)))), np.uint64) for _ in "ab")
        near += np.bitwise_count(a ^ b).sum() <= simhash.WIDE_RADIUS
        first += np.bitwise_count(a[0] ^ b[0]) < 2 * simhash.PARTS
    print("within the radius:", near / 400, "first word:", first / 400)
    assert near >= 390 and first >= 380


def test_no_rows(spark):
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
