import random

import pytest

from remitweave.llm import simhash
from remitweave.llm.components import components


@pytest.mark.parametrize("tile", [4096, 40, 8])
def test_few_bits_match_brute_force(spark, tile):
    rng = random.Random(9)
    fps = {0, 1, 3} | {sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4)))) for _ in range(160)}
    distinct = spark.createDataFrame([(f"{f:016x}", 10) for f in fps], "fp string, n_shingles long")
    edges = simhash.links(distinct, radius=2, tile=tile)
    got = {f: f for f in fps} | {int(r["node"], 16): int(r["root"], 16) for r in components(edges).collect()}
    want = {f: f for f in fps}
    for _ in fps:
        new = {f: min(want[g] for g in fps if (f ^ g).bit_count() <= 2) for f in fps}
        if new == want:
            break
        want = new
    assert got == want


def test_low_tile_is_compared():
    fps = [f"{f:016x}" for f in [0, *(1 << b for b in range(64)), *(7 << b for b in range(60))]]
    import numpy as np

    found = simhash.tile_links(fps, np.full(len(fps), 10), np.zeros(len(fps), int), 2, 0.0)
    assert len(found) == len(fps) - 1
