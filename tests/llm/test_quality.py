import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthcheck.llm import quality as Q
from tests.llm.conftest import LONG, ODD, doc, prose

LABELS = "doc_id long, quality int, toxic int, text string"


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


@pytest.fixture(scope="module")
def texts():
    chosen, out = random.Random(5), []
    for k in range(240):
        good, words = prose(k, 60).split(), prose(k, 60).split()
        bad = [" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 60), " ".join(w + "***" for w in words)]
        out.append((" ".join(good).capitalize() + ".", 1) if chosen.random() < 0.7 else (chosen.choice(bad), 0))
    return out


def test_sum_of_squares_equals_all_pairs():
    chosen = np.random.default_rng(1)
    model = Q.Model(0.3, chosen.normal(size=Q.FEATURES).astype(np.float32), chosen.normal(size=(Q.FEATURES, Q.RANK)).astype(np.float32))
    texts = pa.array(["One two two three.", "", LONG[:300], "A | B\n\nC 12"])
    rows, values, weights = Q.features(texts, pa.array([x.lower() for x in texts.to_pylist()]), pa.array([1, None, 300, 9]))
    got = Q.output(model, rows, values, weights, 4)
    for k in range(4):
        own = [(int(v), float(w)) for r, v, w in zip(rows, values, weights) if r == k]
        wanted = model.bias + sum(model.weight[v] * w for v, w in own)
        for i, (v, w) in enumerate(own):
            wanted += sum(float(model.factor[v] @ model.factor[u]) * w * x for u, x in own[i + 1 :])
        assert got[k] == pytest.approx(wanted, abs=1e-3)


def test_statistics_by_hand():
    text = "Le ÉTÉ a a a 12!\nab | cd"
    found, (rows, _, counts) = Q.statistics(pa.array([text, ""]), pa.array([text.lower(), ""]), pa.array([20, None]))
    size = len(text.encode())
    assert (list(rows), sorted(counts)) == ([0] * 6, [1, 1, 1, 1, 1, 3])
    wanted = {"words": 8, "word_length": 16 / 8, "distinct": 6 / 8, "distinct_runs": 1.0, "top_word": 3 / 8, "echo": 2 / 8,
              "capitals": 4 / size, "digits": 2 / size, "punctuation": 2 / size, "bars": 1 / size, "line_words": 4, "foreign": 4 / size,
              "n_chars": 20, "n_chars_gap": len(text) - 20}
    # accented letters are two bytes each and count as such among a word's characters
    wanted["word_length"] = (len("LeÉTÉaaa12abcd") + 2) / 8
    assert {k: float(v[0]) for k, v in found.items()} == pytest.approx(wanted)
    assert np.isnan(found["n_chars"][1]) and found["words"][1] == 0 and found["capitals"][1] == 0


def test_held_out_documents_are_told_apart(spark, docs, texts):
    df = docs(*[(k, text) for k, (text, _) in enumerate(texts)])
    labels = spark.createDataFrame([(k, good if not held(k) else 1 - good, 0, "x") for k, (_, good) in enumerate(texts)], LABELS)
    model = Q.train(df, labels)
    rows = Q.score(df, model).orderBy("doc_id").collect()
    assert [r["held_out"] for r in rows] == [held(k) for k in range(len(texts))]
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    out = [(r["predicted"], texts[r["doc_id"]][1]) for r in rows if r["held_out"]]
    assert np.mean([a == b for a, b in out]) >= 0.95
    # the same model again, whatever the partitions, and language, source and id are no inputs
    again = Q.train(df.repartition(7), labels.repartition(3))
    assert np.array_equal(model.weight, again.weight) and model.curve == again.curve
    moved = df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1000)
    assert [r["score"] for r in Q.score(moved, model).orderBy("doc_id").collect()] == pytest.approx([r["score"] for r in rows])


def test_odd_rows_and_labels(spark, docs, texts):
    df = docs(*ODD, *[(100 + k, text) for k, (text, _) in enumerate(texts)])
    pairs = [(100 + k, good, 0, "x") for k, (_, good) in enumerate(texts)]
    odd = [(None, 1, 0, "x"), (1, None, 0, "x"), (2, 0, 0, "x"), (6, 1, 0, "x"), (6, 0, 0, "x"), (99_999, 1, 0, "x")]
    model = Q.train(df, spark.createDataFrame(pairs + odd + pairs, LABELS))
    rows = Q.score(df, model).collect()
    assert len(rows) == len(ODD) + len(texts)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[6][0] == by_id[6][1] == by_id[5][0] and len(by_id[None]) == 2
    assert all(0 <= s <= 1 for x in by_id.values() for s in x)


def test_no_labels_one_class_no_rows(spark, docs):
    df = docs((1, "a b"), (2, None))
    none = spark.createDataFrame([], LABELS)
    assert max(r["score"] for r in Q.score(df, Q.train(df, none)).collect()) < 1e-9
    ones = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x")], LABELS)
    assert {r["predicted"] for r in Q.score(df, Q.train(df, ones)).collect()} == {1}
    assert Q.score(docs(), Q.train(docs(), none)).count() == 0
