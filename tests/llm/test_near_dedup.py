import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hearthcheck.llm import near_dedup as N
from hearthcheck.llm.common import word_hashes
from tests.llm.conftest import ODD, prose


def edited(text, share, seed):
    pick, words = random.Random(seed), text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def runs(text):
    words = text.lower().split()
    seen, out = defaultdict(int), set()
    for k in range(max(1, len(words) - 4)):
        run = tuple(words[k : k + 5])
        out.add((run, seen[run]))
        seen[run] += 1
    return out


def classes(rows, least=0.8):
    top = {k: k for k, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    held = [(k, runs(t)) for k, t in rows]
    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            if len(x & y) >= least * len(x | y):
                low, high = sorted((root(a), root(b)))
                top[high] = low
    return {k: root(k) for k in top}


def corpus():
    rows = []
    for g in range(25):
        base = prose(g, 60 + 17 * g % 300, 2_000)
        rows.append((100 * g, base))
        rows += [(100 * g + n, edited(base, share, n)) for n, share in enumerate((0.01, 0.02, 0.05, 0.3), 1)]
        rows.append((100 * g + 7, base.upper().replace(" ", ",  ")))
    return rows


def test_classes_equal_brute_force(docs):
    rows = corpus()
    got = N.near_groups(docs(*rows)).collect()
    wanted = classes([(k, t.replace(",  ", " ")) for k, t in rows])
    assert {r.doc_id: r.class_id for r in got} == wanted
    assert {r.doc_id for r in got if r.kept} == set(wanted.values())
    sizes = defaultdict(int)
    for c in wanted.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] for r in got)


def test_large_group_of_copies_and_near_copies(docs, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 4)
    base = prose(5, 150, 2_000)
    rows = [(k, base) for k in range(60)] + [(100 + k, edited(base, 0.012, k)) for k in range(80)] + [(500 + k, prose(900 + k, 80)) for k in range(20)]
    got = {r.doc_id: r.class_id for r in N.near_groups(docs(*rows)).collect()}
    assert got == classes(rows)


def test_many_small_groups_in_one_large_bucket(docs, monkeypatch):
    """Hundreds of texts share a template that fills most sketches; each group of two differs from all others."""
    monkeypatch.setattr(N, "SIDE", 64)
    template, rows = prose(7, 140, 2_000), []
    for g in range(150):
        own = prose(3_000 + g, 40, 2_000)
        rows += [(10 * g, f"{template} {own}"), (10 * g + 1, f"{template} {own} extra{g} words{g}")]
    # a chain: each text is near its neighbours only
    words = prose(5_000, 60, 2_000).split()
    rows += [(9_000 + k, " ".join([template, *(f"new{n}" for n in range(12 * k)), *words[12 * k :]])) for k in range(5)]
    wanted = classes(rows)
    assert len(set(wanted.values())) > 100
    assert {r.doc_id: r.class_id for r in N.near_groups(docs(*rows)).collect()} == wanted


@pytest.mark.parametrize("seed", range(4))
def test_class_counts_bound_the_shared_shingles(seed):
    a, b = prose(seed, 30_000, 3), edited(prose(seed, 30_000, 3), 0.1, seed)
    x, y = (N.labelled(word_hashes(pa.array([t]))[0]) & np.uint64(0xFFFFFFFFFFFFFC00) for t in (a, b))
    (h, e), (i, f) = N.class_counts(x), N.class_counts(y)
    most = np.minimum(np.frombuffer(h, np.uint8), np.frombuffer(i, np.uint8)).sum(dtype=int) + min(e, f)
    assert e > 0 and most >= len(np.intersect1d(x, y))


def test_odd_rows(docs):
    got = N.near_groups(docs(*ODD, (8, "!!!"), (9, "one two"), (10, "One, two!"), (11, "one"))).collect()
    named = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert len(got) == len(ODD) + 4
    assert (named[2], named[1], named[4], named[8], named[5], named[6], named[9], named[10], named[11]) == (1, 1, 4, 4, 5, 5, 9, 9, 11)
    assert [r.class_id for r in got if r.doc_id is None] in ([7, 1], [1, 7])
    assert sum(r.kept for r in got) == len({r.class_id for r in got})
    assert N.near_groups(docs()).collect() == []


def test_one_of_each_keeps_whole_rows(docs):
    table = docs(*ODD, *corpus()[:12])
    kept = N.one_of_each(table)
    assert kept.schema == table.schema
    flags = N.near_groups(table).where("kept").collect()
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in flags)))


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_dynamic_programming(seed):
    pick = random.Random(seed)
    a = prose(seed, 120, 40)
    words = edited(a, 0.02, seed).split()
    cut = pick.randrange(20, 100)
    b = " ".join(words[:cut] + ["extra"] * (seed % 3) + words[cut:]) if seed % 2 else " ".join(words[60:] + words[:60])
    sides = []
    for text in (a, b):
        labels = N.labelled(word_hashes(pa.array([text]))[0])
        order = np.argsort(labels)
        sides.append((labels[order], order))
    x, y = (np.empty_like(s[0]) for s in sides)
    x[sides[0][1]], y[sides[1][1]] = sides[0][0], sides[1][0]
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
    m = table[-1, -1]
    exact = m / (len(x) + len(y) - m)
    got = N.similarity(*sides)
    assert (got >= 0.8) == (exact >= 0.8) and (exact < 0.8 or abs(got - exact) < 1e-12)


def test_sketches_heed_order():
    words = word_hashes(pa.array([prose(3, 200, 2_000)]))[0]
    own = N.order_sketches(N.labelled(words))
    assert len(own) == N.SKETCHES and (own == N.order_sketches(N.labelled(words.copy()))).all()
    turned = np.concatenate([words[100:], words[:100]])
    assert 0 < (own == N.order_sketches(N.labelled(turned))).sum() < N.SKETCHES
