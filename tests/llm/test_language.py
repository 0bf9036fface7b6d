import numpy as np
import pyarrow as pa

from hearthcheck.llm.language import code_points, grams, predict, train
from tests.llm.conftest import ODD

TEXTS = {"en": "the cat sat on the mat and the dog ran off with that hat", "fr": "le chat est sur la table et le chien est parti avec une étoile",
         "de": "der hund ist nicht über die straße gegangen und schläft"}


def rows():
    return [(k, f"{TEXTS[lang]} {k}", lang) for k, lang in enumerate(list(TEXTS) * 30)]


def test_held_out_texts_are_told_apart(docs):
    table = docs(*rows())
    from hearthcheck.llm.common import fold

    table = table.withColumn("held_out", fold() == 0)
    got = predict(table, train(table.where("not held_out"))).collect()
    truth = {k: lang for k, _, lang in rows()}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got) and len(got) == 90
    assert any(r.held_out for r in got)


def test_odd_rows(docs):
    model = train(docs(*rows()))
    from pyspark.sql import functions as F

    got = predict(docs(*ODD, (8, "é"), (9, "42 !")).withColumn("held_out", F.lit(False)), model).collect()
    named = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 2
    assert all(named[k].lang_pred == "und" and named[k].score == 0 for k in (1, 2, 3, 4, 9))
    assert named[8].lang_pred in TEXTS


def test_nothing_learned_and_no_rows(docs):
    from pyspark.sql import functions as F

    model = train(docs((1, "a text", None), (2, None, "en")))
    assert [r.lang_pred for r in predict(docs((3, "word")).withColumn("held_out", F.lit(True)), model).collect()] == ["und"]
    assert predict(docs().withColumn("held_out", F.lit(True)), model).collect() == []


def test_grams_stay_in_their_row():
    points, offsets = code_points(pa.array(["ab", None, "", "é  c"]))
    assert offsets.tolist() == [0, 2, 2, 2, 6]
    for size, wanted in ((1, 4), (2, 3), (3, 0)):
        key, at = grams(points, offsets, size, 1 << 15)
        assert len(key) == wanted and np.all(at < 6)
