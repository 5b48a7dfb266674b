from test_queries import DATA

from remitweave.plans import reviews, settlements


def test_settlement_checks_write_the_feeds_once(spark, monkeypatch):
    made, begin = [], settlements.Feeds.__init__
    monkeypatch.setattr(settlements.Feeds, "__init__", lambda self, *a, **k: (made.append(a), begin(self, *a, **k))[1])
    reviews.settlement_checks(spark, DATA)
    assert len(made) == 1


def test_a_blind_solve_has_no_anchors(spark, monkeypatch):
    pools, solve = [], reviews.subset_sum.match
    monkeypatch.setattr(reviews.subset_sum, "match", lambda pool: (pools.append(pool), solve(pool))[1])
    reviews.blind_check(spark, DATA)
    assert len(pools) == 1 and pools[0].filter("anchor").isEmpty()
