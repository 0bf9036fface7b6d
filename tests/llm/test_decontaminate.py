import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hearthcheck.llm import decontaminate as D
from hearthcheck.llm.common import mixed
from tests.llm.conftest import ODD, prose

ITEMS = "item_id long, text string, lower string, doc_id long"


def items(n=40):
    return [(k, prose(10_000 + k, 16 + k, 3_000).capitalize() + ".", "x", 5) for k in range(n)]


def planted():
    """Clean texts, and texts with an item in the middle, as it is or with every ninth word changed."""
    rows, truth = [], {}
    for k in range(160):
        words = prose(k, 150 + k, 3_000).split()
        if k % 4 == 0:
            item = items()[k // 4][1].split()
            if k % 8 == 0:
                item = [f"z{n}" if n % 9 == 4 else w.upper() for n, w in enumerate(item)]
            words[70:70] = item
            truth[k] = k // 4
        rows.append((k, " ".join(words)))
    return rows, truth


def test_planted_items_are_found_and_clean_texts_left_alone(docs, make):
    rows, truth = planted()
    got = D.contaminated(docs(*rows), make(ITEMS, *items())).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(truth.items())
    assert all(0.6 <= r.overlap <= 1 for r in got)


def test_clean_keeps_whole_rows(docs, make):
    rows, truth = planted()
    table = docs(*rows)
    kept = D.clean(table, make(ITEMS, *items()))
    assert kept.schema == table.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in table.collect() if r.doc_id not in truth)
    assert D.clean(docs(*ODD), make(ITEMS, *items())).count() == len(ODD)


def test_more_items_than_a_block(docs, make, monkeypatch):
    monkeypatch.setattr(D, "MOST_ITEMS", 8)
    rows, truth = planted()
    got = D.contaminated(docs(*rows), make(ITEMS, *items())).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(truth.items())
    assert D.clean(docs(*rows), make(ITEMS, *items())).count() == len(rows) - len(truth)


@pytest.mark.parametrize("answered", [True, False])
def test_short_items_and_paraphrases_of_three_in_five_words_are_all_found(answered):
    """160 items of 8 to 15 words, verbatim or with two in five words changed and the answer near, where vectors say nothing."""
    asked, texts, truth = [], [], set()
    for k in range(160):
        item = prose(20_000 + k, 8 + k % 8, 3_000).split()
        asked.append((k, " ".join(item), f"answer{k}" if answered else None))
        words = prose(30_000 + k, 120, 3_000).split()
        if k % 2 and answered:
            for n in random.Random(k).sample(range(len(item)), int(0.4 * len(item))):
                item[n] = f"other{k}x{n}"
            item.append(f"answer{k}")
        words[53:53] = item
        texts += [" ".join(words), prose(40_000 + k, 150, 3_000)]
        truth.add((2 * k, k))
    counted = np.bincount(D.terms_of(D.word_hashes(pa.array(texts))[0]), minlength=D.TERMS)
    weights = np.log((counted.sum() + 1) / (counted + 0.5)).astype(np.float32)
    block = D._block(pd.DataFrame(asked, columns=["item_id", "lower", "answer"]), weights, np.zeros((D.TERMS, 4), np.float32))
    assert {(r, k) for r, k, _ in D._matches(block, pa.array(texts), D.COSINE)} == truth


def test_odd_rows(docs, make):
    odd_items = make(ITEMS, (1, None, "x", 1), (2, "", "x", 1), (3, "!!!", "x", 1), (4, "tiny probe text", "x", 1), (None, "a b", "x", 1))
    got = D.contaminated(docs(*ODD, (20, "here is a Tiny probe, text!"), (21, "tiny probe of text")), odd_items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(20, 4), (None, None), (7, None)}
    assert D.contaminated(docs(), odd_items).collect() == [] and D.contaminated(docs(*ODD), make(ITEMS)).collect() == []


def test_answer_decides_on_paraphrases(docs, make):
    item = "which river flows through the old town of marlen past seven stone bridges and two mills before it meets the sea"
    asked = make("item_id long, text string, answer string", (1, item, "the Velna"))
    loose = "the river that flows through old marlen past seven bridges of stone and two mills then meets the sea"
    rows = [(1, f"{prose(1, 60)} {loose} it is the velna {prose(2, 60)}"), (2, f"{prose(3, 60)} {loose} it has a name {prose(4, 60)}"), (3, prose(5, 200))]
    assert {r.doc_id for r in D.contaminated(docs(*rows), asked).collect()} == {1}


@pytest.mark.parametrize("seed", range(5))
def test_common_words_equals_dynamic_programming(seed):
    pick = random.Random(seed)
    a, b = ([pick.randrange(6) for _ in range(n)] for n in (30, 45))
    masks = {}
    for n, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << n
    table = np.zeros((31, 46), int)
    for i in range(30):
        for j in range(45):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert D.common_words(masks, 30, b) == table[-1, -1]


def test_retrieval_recall_against_brute_force(docs, make):
    """Of the passages that hold an item word for word, the latent search has to give at least nine in ten."""
    rows, truth = planted()
    block = D.prepared(docs(*rows), make(ITEMS, *items()))[0]
    words, offsets = D.word_hashes(pa.array([t.lower() for _, t in rows]))
    found = {(rows[r][0], block.items[k]["id"]) for some, which, _, _ in D._candidates(block, words, offsets, D.COSINE) for r, k in zip(some, which)}
    assert len(found & set(truth.items())) >= 0.9 * len(truth)


def test_the_basis_is_fitted_on_all_passages(docs, make):
    """Passages without any word of the benchmark's make half of the matrix; with as many rows as passages nothing is lost."""
    texts = [prose(k % 2, 64 * 3, 30) for k in range(60)]
    table = docs(*((k, t) for k, t in enumerate(texts))).select("text").selectExpr("lower(text) as lower")
    weights = D.term_weights(table)
    got = D.latent_basis(table, weights, rank=8, rows=1024)
    matrix = np.zeros((180, D.TERMS))
    terms, passage, value = D._passages(pa.array(texts), weights)
    np.add.at(matrix, (passage, terms), value)
    assert len(set(passage.tolist())) == 180
    assert np.allclose(np.linalg.norm(matrix.reshape(180, -1), axis=1) > 0, True)
    best = np.linalg.svd(matrix, full_matrices=False)[1][:8]
    assert np.allclose(got.T @ got, np.eye(8), atol=1e-3) or np.linalg.matrix_rank(matrix) < 8
    held = np.linalg.norm(matrix @ got) ** 2
    assert held >= 0.9 * (best**2).sum()


def test_words_only_the_documents_have_are_in_the_basis(docs, make):
    """A sample drawn by the benchmark's size saw a few texts of many; now each document's own words are in the basis."""
    rows = [(k, " ".join(f"own{k}x{n % 9}" for n in range(64))) for k in range(40)]
    block = D.prepared(docs(*rows), make(ITEMS, (1, "some benchmark item of more than eight different words here", "x", 1)))[0]
    own = D.terms_of(D.word_hashes(pa.array([t for _, t in rows]))[0]).reshape(40, 64)
    assert (np.linalg.norm(block.vectors[own], axis=2).max(axis=1) > 0.01).all()


@pytest.mark.parametrize("answered", [True, False])
def test_stretches_with_too_few_of_the_rarer_words_are_not_read(answered, monkeypatch):
    """One rare word of an item by itself starts no word check, and no check that would accept is left out."""
    asked = [(k, prose(50_000 + k, 20 + k, 60), "seldom" if answered else None) for k in range(12)]
    texts = []
    for k, item, _ in asked:
        pick, words = random.Random(k), item.split()
        for share in (0.0, 0.2, 0.38, 0.45):
            some = [f"w{n}" if pick.random() < share else w for n, w in enumerate(words)]
            texts.append(f"{prose(60_000 + k, 60, 60)} {' '.join(some)} seldom {prose(70_000 + k, 60, 60)}")
    alone = set(range(len(texts), len(texts) + 12 * 20))
    texts += [f"{prose(80_000 + k, 9, 9_000)} {asked[k % 12][1].split()[k // 12]} {prose(90_000 + k, 9, 9_000)}" for k in range(12 * 20)]
    words, offsets = D.word_hashes(pa.array(texts))
    weights = np.log((len(words) + 1) / (np.bincount(D.terms_of(words), minlength=D.TERMS) + 0.5)).clip(0).astype(np.float32)
    frame = pd.DataFrame(asked, columns=["item_id", "lower", "answer"])
    block = D._block(frame, weights, np.zeros((D.TERMS, 4), np.float32))
    read, found = list(D._stretches(block, words, offsets, D.COSINE)), sorted(D._matches(block, pa.array(texts), D.COSINE))
    monkeypatch.setattr(D, "least_places", lambda ranked, given: 0)
    block = D._block(frame, weights, np.zeros((D.TERMS, 4), np.float32))
    every = list(D._stretches(block, words, offsets, D.COSINE))
    assert len(found) >= 12 and found == sorted(D._matches(block, pa.array(texts), D.COSINE))
    assert len({r for r, *_ in every} & alone) > 40 and not {r for r, *_ in read} & alone


def test_word_hashes_are_those_of_the_words_by_themselves():
    """A word's hash is its polynomial, wherever the word stands in the column."""
    rows = ["ab cd", None, "", "abcd, été—naïve", "cd", "x" * 5_000 + " ab"]
    words, offsets = D.word_hashes(pa.array(rows))
    own = [w for r in rows for w in (r or "").replace(",", " ").replace("—", " ").split()]
    assert np.diff(offsets).tolist() == [2, 0, 0, 3, 1, 2]
    for hashed, word in zip(words.tolist(), own, strict=True):
        value = sum((b + 1) * pow(0x9E3779B97F4A7C15, n, 1 << 64) for n, b in enumerate(word.encode())) % (1 << 64)
        assert D.word_hashes(pa.array([word]))[0].tolist() == [hashed] == mixed(np.array([value], np.uint64)).tolist()
