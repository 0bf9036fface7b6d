import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthcheck.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, g int, score double, rank string"


def by_hand(vectors, positives=5, negatives=5):
    """All pairs, for (vec_id, components, label) of rows that take part, each id once."""
    rows = {}
    for i, v, label in vectors:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        rows[i] = min(rows.get(i, row), row)
    out = set()
    for a, (label, q) in rows.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for i, (_, v) in rows.items() if i != a)
        for p, positive in [(p, i) for p, i in scored if rows[i][0] == label][:positives]:
            fits = [(n, i) for n, i in scored if rows[i][0] != label and 80 * -p <= 100 * -n <= 100 * -p][:negatives]
            out |= {(a, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(fits)}
    return out


def mined(spark, vectors, **settings):
    df = spark.createDataFrame([(i, v, label, 3, 0.5, "x") for i, v, label in vectors], SCHEMA)
    rows = H.mine(H.candidates(df), F.col("vec_id") % 100 == 0, **settings).collect()
    assert len(rows) == len({(r["anchor_id"], r["positive_id"], r["rank"]) for r in rows})
    return {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows}


def cloud(seed, n, width=8, centres=6, spread=0.05):
    chosen = np.random.default_rng(seed)
    middle = chosen.normal(size=(centres, width))
    points = middle[chosen.integers(0, centres, n)] + spread * chosen.normal(size=(n, width))
    return [(k, [float(x) for x in points[k]], int(chosen.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.3, 3.0])
@pytest.mark.parametrize("same", [True, False])
def test_tree_search_equals_all_products(spread, same):
    chosen = np.random.default_rng(3)
    x = np.floor(256 * np.array([v for _, v, _ in cloud(5, 700, spread=spread)]))
    labels, ids = chosen.integers(0, 3, 700), chosen.permutation(700)
    lifted, top2 = H.augmented(x)
    tree = H.cover_tree(lifted, top2)
    assert sorted(tree.order) == list(range(700))
    members = (ids[tree.order], labels[tree.order], x[tree.order])
    q = members[2][::20]
    low = np.stack([np.full(len(q), -np.inf), np.linspace(-2e5, 2e5, len(q))], axis=1)
    high = np.stack([np.full(len(q), np.inf), low[:, 1] + 6e4], axis=1)
    best = H._Best(low, high, 4)
    H.search(tree, members, (members[0][::20], members[1][::20], q), best, same)
    for a in range(len(q)):
        products = members[2] @ q[a]
        for w in range(2):
            ok = ((members[1] == members[1][::20][a]) == same) & (members[0] != members[0][::20][a])
            ok &= (products >= low[a, w]) & (products <= high[a, w])
            wanted = sorted(zip(-products[ok], members[0][ok]))[:4]
            kept = np.isfinite(best.score[a, w])
            assert list(zip(-best.score[a, w][kept], best.id[a, w][kept])) == wanted


def test_radii_cover_and_bounds_skip_nodes():
    x = np.floor(256 * np.array([v for _, v, _ in cloud(7, 3000, centres=30)]))
    lifted, top2 = H.augmented(x)
    tree = H.cover_tree(lifted, top2)
    for k in range(len(tree.radius)):
        below, waiting = [], [k]
        while waiting:
            node = waiting.pop()
            waiting += range(*tree.kids[node])
            below += range(*tree.span[node])
        assert H._distance(lifted[tree.order[below]], tree.centre[k]).max() <= tree.radius[k] + 1e-6
        assert all(tree.radius[c] <= tree.radius[k] / 2 + 1e-9 for c in range(*tree.kids[k]))
    members = (tree.order, np.zeros(3000, int), x[tree.order])
    best, opened = H._Best(np.full((1, 1), -np.inf), np.full((1, 1), np.inf), 5), []
    H.search(tree, members, (np.array([-1]), np.array([0]), x[:1]), best, True, opened)
    verified = sum(what[1] - what[0] for what, _ in opened if isinstance(what, tuple))
    assert verified < 1500


@pytest.mark.parametrize("spread, group_rows", [(0.0, 50), (0.05, 100), (1.0, 64), (0.05, 10_000)])
def test_rows_equal_all_pairs(spark, spread, group_rows):
    vectors = cloud(11, 420, spread=spread)
    assert mined(spark, vectors, group_rows=group_rows, anchor_rows=2) == by_hand(vectors)


def test_rows_that_take_no_part_ties_and_repeats(spark):
    vectors = cloud(13, 210, width=4)
    odd = [(100, [math.nan, 1.0, 1.0, 1.0], 1), (None, [1.0] * 4, 1), (200, None, 2), (300, [1.0] * 4, None), (301, [1.0, None, 1.0, 1.0], 0),
           (302, [math.inf, 1.0, 1.0, 1.0], 0), (400, [0.0] * 4, 1), (401, [0.0] * 4, 2), (402, [0.0] * 4, 1), (500, [-1.0] * 4, 3), (501, [], 2),
           (502, [9.0], 1), (503, [2.0] * 6, 2)]
    copies = [(1000 + k, [1.0, -1.0, 1.0, 0.5], k % 2) for k in range(130)] + [(1100, [1.0, -1.0, 1.0, 0.5], 0)] * 3 + [(1200, [1.0] * 4, 5), (1200, [0.5] * 4, 5)]
    rows = vectors + odd + copies
    assert mined(spark, rows, group_rows=40) == by_hand(rows)


def test_few_and_no_rows(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(0, [1.0], 1)]) == set()
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == {(0, 1, 1, 2, 65536, 58880)}
