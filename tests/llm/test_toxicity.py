import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthcheck.llm.common import FOLDS
from hearthcheck.llm import toxicity as T
from hearthcheck.llm.toxicity import clean, score, train
from tests.llm.conftest import ODD, prose

INSULTS = ["grobbard", "snivelor", "quackhead"]
LABELS = "doc_id long, quality int, toxic int, text string, n_words long"


def rows(n=600):
    out = []
    for k in range(n):
        pick = random.Random(k)
        words = prose(k % 400, 40 + k % 50, 60).split() if k % 4 else prose(1, 60, 60).split()
        pick.shuffle(words)
        if k % 5 == 0:
            for _ in range(4):
                words.insert(pick.randrange(len(words)), pick.choice(INSULTS))
        out.append((k, " ".join(words)))
    return out


def labels_of(make, data):
    return make(LABELS, *((k, 1, int(k % 5 == 0), "x", 3) for k, _ in data if k % 3))


@pytest.fixture(scope="module")
def model(spark):
    from tests.llm.conftest import SCHEMA, doc

    data = rows()
    table = spark.createDataFrame([doc(*r) for r in data], SCHEMA)
    marks = spark.createDataFrame([(k, 1, int(k % 5 == 0), "x", 3) for k, _ in data if k % 3], LABELS)
    return train(table, marks)


def test_held_out_rows_are_told_apart(docs, model):
    got = score(docs(*rows()), model).collect()
    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 600 / FOLDS / 2
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97


def test_odd_rows(docs, model):
    got = score(docs(*ODD), model).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    assert {r.doc_id: r.score for r in got}[1] == {r.doc_id: r.score for r in got}[2]
    assert score(docs(), model).collect() == []


def test_clean_keeps_whole_rows(docs, model):
    assert clean(docs(*ODD), model).count() == len(ODD)
    table = docs(*rows())
    kept = clean(table, model)
    assert kept.schema == table.schema
    assert 0 < model.cut <= 0.5
    flagged = {r.doc_id for r in score(table, model).where(F.col("score") >= model.cut).collect()}
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in table.collect() if r.doc_id not in flagged)
    assert len(flagged - {k for k, _ in rows() if k % 5 == 0}) < 6 < len(flagged)


def test_without_labels_of_both_classes(docs, make):
    table = docs(*rows(60))
    none = train(table, make(LABELS))
    assert all(r.score < 1e-6 for r in score(table, none).collect())
    odd = make(LABELS, (None, 1, 1, "x", 1), (4, None, None, "x", 1), (4, 1, 0, "x", 1), (4, 1, 0, "x", 1))
    assert all(r.predicted == 0 for r in score(table, train(table, odd)).collect())


ENDINGS = ["", "ung", "schaft", "heit", "ado", "ette", "ly", "ness"]


def kneser_ney(texts):
    """Gains of all expressions from dicts, for (words, toxic) of the counted texts: {(level, expression): gain}."""
    children = (Counter(), Counter())
    for words, toxic in texts:
        children[toxic].update(set(zip([""] + words[:-1], words)))
    found = {}
    for level, parent_of in enumerate((lambda k: k[1], lambda k: k[:6], lambda k: k[:4], lambda k: "")):
        sums, kinds = (Counter(), Counter()), (Counter(), Counter())
        for c in (0, 1):
            for key, n in children[c].items():
                sums[c][parent_of(key)] += n
                kinds[c][parent_of(key)] += 1
        for key in set(children[0]) | set(children[1]):
            c0, c1, up = children[0][key], children[1][key], parent_of(key)
            p0, p1 = sums[0][up], sums[1][up]
            if c0 + c1 < 2 or not p0 or not p1:
                continue
            share, total = p1 / (p0 + p1), c0 + c1
            if (c1 - total * share) ** 2 / (total * share * (1 - share)) <= T.LEAST_CHI2:
                continue
            q = [(max(n - T.DISCOUNT, 0) + T.DISCOUNT * kinds[c][up] * total / (p0 + p1)) / p for c, (n, p) in enumerate(((c0, p0), (c1, p1)))]
            if abs(math.log(q[1] / q[0])) >= T.LEAST_GAIN:
                found[level, key] = math.log(q[1] / q[0])
        # continuation counts: kinds of pairs per word, their sums per stem above
        children = kinds if level == 0 else sums
    return found


def gain_by_hand(words, found):
    total = 0.0
    for before, word in zip([""] + words[:-1], words):
        total += sum(found.get(x, 0.0) for x in ((0, (before, word)), (1, word), (2, word[:6]), (3, word[:4])))
    return total / max(1, len(words))


def test_gains_equal_those_from_dicts_and_endings_lean_on_their_stem(docs, make):
    data = []
    for k in range(1200):  # few ordinary words, so that no two share their bits; toxic ones of one stem, each with an ending of its own
        pick = random.Random(k)
        words = prose(k % 6, 40, 60).split()
        pick.shuffle(words)
        if k % 5 == 0:
            words[3:3] = [pick.choice(INSULTS)] if k % 2 else ["vrakto" + "".join(pick.choices(ENDINGS, k=3)), "Vrakto" + str(k)]
        data.append((k, " ".join(words)))
    table = docs(*data)
    marks = labels_of(make, data)
    model = train(table, marks, calibration_rows=60)
    share = min(0.25, 60 / marks.where(T.fold() != 0).count())
    out = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    kept_out = {r.doc_id for r in marks.where(out).collect()}
    split = {k: re.findall(r"[^\W_]+", text.lower()) for k, text in data}
    counted = [(split[k], int(k % 5 == 0)) for k, _ in data if k % 3 and zlib.crc32(str(k).encode()) % 5 and k not in kept_out]
    found = kneser_ney(counted)
    assert sorted((level, round(gain, 9)) for (level, _), gain in found.items()) == sorted((r.level, round(r.gain, 9)) for r in model.gains.collect())
    got = {r.doc_id: r.gain for r in T.evidence(table.withColumn("text", F.lower("text")), model, ["doc_id"]).collect()}
    assert got == pytest.approx({k: gain_by_hand(split[k], found) for k, _ in data}, abs=1e-9)
    unseen = docs((1, "vraktoabcdef " + prose(7, 10, 60)), (2, prose(7, 10, 60)))
    scores = {r.doc_id: r.score for r in score(unseen, model).collect()}
    assert scores[1] > 0.5 > scores[2]
