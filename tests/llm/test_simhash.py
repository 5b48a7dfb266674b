import random
import re

import numpy as np
import pytest
import xxhash

from remitweave.llm import simhash


def brute_fingerprint(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius):
    """rows: (id, fp); the smallest id reachable, nulls last."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], f"{rows[i][1]:016x}", least[find(i)]) for i in range(len(rows))]


def test_fingerprint(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"])[0] == [brute_fingerprint(r["text"], 3)]


@pytest.mark.parametrize("tile", [4096, 8])
def test_matches_brute_force(spark, odd_docs, tile):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):  # chains and stars of links, over all ranges of bits
        f = rng.choice(fps)
        for _ in range(rng.choice([1, 2, 2, 3])):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    distinct = spark.createDataFrame([(f"{f:016x}", 10) for f in set(fps)], "fp string, n_shingles long")
    edges = [(int(r["a"], 16), int(r["b"], 16)) for r in simhash.links(distinct, radius=2, tile=tile).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    rows = sorted((f, f) for f in set(fps))
    want = {i: c for i, _, c in brute_components(rows, 2)}
    from remitweave.llm.components import components

    got = {f: f for f in set(fps)}
    pairs = spark.createDataFrame([(f"{a:016x}", f"{b:016x}") for a, b in edges], "a string, b string")
    got |= {int(r["node"], 16): int(r["root"], 16) for r in components(pairs).collect()}
    assert got == want

    rows = [(r["doc_id"], brute_fingerprint(r["text"], 3)) for r in odd_docs.collect()]
    found = simhash.near_duplicates(odd_docs, tile=tile).collect()
    assert sorted(repr((r["id"], r["fp"], r["component_id"])) for r in found) == sorted(map(repr, brute_components(rows, 2)))


@pytest.mark.parametrize("tile", [4096, 16])
def test_wide_fingerprints_find_close_texts(spark, tile):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((3 * g, " ".join(base)))
        near = list(base)
        near[rng.randrange(300)] = "changed"
        rows.append((3 * g + 1, " ".join(near)))
        rows.append((3 * g + 2, " ".join(f"v{rng.randrange(5000)}" for _ in range(300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.survivors(docs, words_each=5, parts=4, radius=48, min_ratio=0.75, tile=tile).collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}


def test_close_pairs_is_exact():
    a = np.random.default_rng(0).integers(0, 1 << 16, (300, 4), dtype=np.uint64)
    i, j = simhash.close_pairs(a, a, 20)
    full = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full <= 20))))


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.survivors(no_docs).count() == 0
