"""The pipeline's near copies against exact Jaccard similarities of all pairs."""

import random

import pytest

import corpus_pipeline as cp
from remitweave.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_survivors(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) / len(a | b) >= least):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


@pytest.mark.parametrize("tile", [4096, 16])
def test_survivors_match_exact_similarity(spark, tile):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(9000)}"
    texts = []
    template = [word() for _ in range(200)]
    for _ in range(60):  # templated documents that share about 60 % of their shingles
        texts.append(template[:150] + [word() for _ in range(50)])
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12):  # copies with ever more changes, on both sides of 0.8
        for _ in range(4):
            base = [word() for _ in range(200)]
            near = list(base)
            for at in rng.sample(range(200), n):
                near[at] = "changed"
            texts += [base, near]
    short = [word() for _ in range(30)]
    texts += [short, short * 2, short * 3, [], ["one"], short[:4]]  # repeats count once
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_survivors(rows)
    assert set(range(60)) <= want
    assert {r["doc_id"] for r in simhash.survivors(docs, **cp.NEAR, tile=tile).collect()} == want
