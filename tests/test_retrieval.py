import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import as_set
from pyspark.sql import functions as F

from hearthcheck.operators import retrieval as T
from hearthcheck.session import shared_folder

TEXTS = {
    "a": "Table: people\n\nfatherid : the father of the person\n\nmotherid : the mother of the person",
    "b": "Table: homes\n\nroof nature of the roof\nsecond line\n\n\n\nwall nature of the wall",
    "c": "only block of the table",
}


@pytest.fixture
def documents(make):
    return make("source string, text string", *TEXTS.items())


def test_text_is_cleaned(make):
    df = make("t string", (" a  \r\nb\t\r\n\r\n\r\n\r\nc  d ",))
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "a\nb\n\nc\nd"


def test_passages_carry_the_first_line(documents):
    rows = {(r["source"], r["passage_no"]): r["text"] for r in T.passages(documents, "source", "text").collect()}
    assert rows == {
        ("a", 0): "[a] Table: people — fatherid : the father of the person",
        ("a", 1): "[a] Table: people — motherid : the mother of the person",
        ("b", 0): "[b] Table: homes — roof nature of the roof second line",
        ("b", 1): "[b] Table: homes — wall nature of the wall",
        ("c", 0): "[c] only block of the table — only block of the table",
    }


def by_hand(passages, question):
    """Cosines from the formula, one passage at a time."""

    def terms(text):
        words = re.findall(r"\w\w+", text.lower())
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    n = len(passages)
    df = {}
    for text in passages.values():
        for t in set(terms(text)):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items() if k <= 0.9 * n}

    def vector(text):
        v = {}
        for t in terms(text):
            if t in idf:
                v[t] = v.get(t, 0) + idf[t]
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    q = vector(question)
    scores = {key: sum(q.get(t, 0) * w for t, w in vector(text).items()) for key, text in passages.items()}
    return sorted(((round(s, 6), key) for key, s in scores.items() if s > 0), key=lambda p: (-p[0], p[1]))


@pytest.mark.parametrize("block", [T.BLOCK_QUESTIONS, 1])
def test_ranking_equals_the_formula(make, documents, block):
    index = T.build_index(T.passages(documents, "source", "text"))
    passages = {(r["source"], r["passage_no"]): r["text"] for r in index.passages.collect()}
    asked = {1: "what is the father of a person", 2: "nature of the wall", 3: "zzz"}
    questions = make("id int, q string", *asked.items())
    ranked = T.rank_passages(index, questions, "id", "q", k=2, block=block).collect()
    for number, text in asked.items():
        got = [(r["score"], (r["source"], r["passage_no"])) for r in sorted(ranked, key=lambda r: r["rank"]) if r["query_id"] == number]
        assert got == by_hand(passages, text)[:2]


def test_boost_lifts_named_sources(make, documents):
    index = T.build_index(T.passages(documents, "source", "text"))
    questions = make("id int, q string", (1, "nature of the table block"))
    plain = T.rank_passages(index, questions, "id", "q", k=1).first()
    boosted = T.rank_passages(index, questions, "id", "q", k=5, boosted=["b"], boost=9.0).orderBy("rank").first()
    assert plain["source"] == "c" and boosted["source"] == "b"


def test_second_phrasing_only_where_the_first_is_weak(make, documents):
    index = T.build_index(T.passages(documents, "source", "text"))
    questions = make(
        "id int, q string, r string", (1, "zzz", "wall nature"), (2, "wall nature of", "father"), (3, "zzz", "ZZZ ")
    )
    best = T.best_phrasing(index, questions, "id", "q", "r")
    assert as_set(best, "query_id", "phrasing") == {(1, 2), (2, 1)}


def test_saved_index_answers_the_same(spark, make, documents, tmp_path):
    index = T.index_documents(documents)
    index.save(str(tmp_path / "index"))
    loaded = T.PassageIndex.load(spark, str(tmp_path / "index"), index.ids)
    questions = make("id int, q string", (1, "nature of the wall"))
    assert as_set(T.rank_passages(index, questions, "id", "q")) == as_set(T.rank_passages(loaded, questions, "id", "q"))
    context = T.contexts(loaded, T.rank_passages(loaded, questions, "id", "q", k=1)).first()["context"]
    assert context == "- [b] Table: homes — wall nature of the wall"


def test_empty_folder_is_refused(make):
    with pytest.raises(ValueError):
        T.index_documents(make("source string, text string", ("a", "  ")))


def test_no_term_of_a_passage_is_shuffled_by_itself(make, documents):
    """Many blocks, repeated and missing ids: the same weights as by hand, and one row per block and bucket on the way."""
    rows = [*TEXTS.items(), ("a", TEXTS["a"]), (None, "one two\n\nthree four five"), (None, "one two\n\nthree six")]
    cut = T.passages(make("source string, text string", *rows), "source", "text")
    index = T.build_index(cut, block_chars=40)
    assert index.n_blocks > 5
    merged = {}
    for r in cut.collect():
        merged.setdefault((r["source"], r["passage_no"]), []).append(re.findall(r"\w\w+", (r["text"] or "").lower()))
    counts = {k: [t for w in texts for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]] for k, texts in merged.items()}
    df = {t: sum(t in c for c in counts.values()) for c in counts.values() for t in c}
    n = cut.count()
    want = {}
    for key, c in counts.items():
        v = {t: c.count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for t in c if df[t] <= 0.9 * n}
        norm = math.sqrt(sum(x * x for x in v.values()))
        want |= {(*key, t): round(x / norm, 9) for t, x in v.items()}
    got = {(r["source"], r["passage_no"], r["term"]): round(r["weight"], 9) for r in index.postings.collect()}
    assert got == want
    assert as_set(index.idf, "term", "df") == {(t, k) for t, k in df.items() if k <= 0.9 * n}
    assert index.counted.where("_block >= 0").count() <= min(index.n_blocks**2, sum(map(len, counts.values())))
    assert index.counted.where("_block = -1").groupBy("bucket").count().where("count > 1").isEmpty()


def test_weights_write_nothing_and_texts_travel_compressed(spark, make):
    """Passages of one text share a block and are packed there; runs of 64 passages of a long one may part."""
    texts = [(f"s{n}", "\n\n".join(["the same title of every block", *(f"word{n} meets word{k}" for k in range(100))])) for n in range(10)]
    cut = T.passages(make("source string, text string", *texts), "source", "text")
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    index = T.build_index(cut, block_chars=5_000)
    assert index.postings.select("source", "passage_no").distinct().count() == 1000
    assert set(os.listdir(folder)) == before
    packed = index.texts.collect()
    held = [(p["_block"], r["source"], r["passage_no"]) for p in packed for r in T._unpacked(pa.scalar(bytes(p["data"]), pa.binary())).to_pylist()]
    assert len(held) == 1000 and len({b for b, _, _ in held}) > 3
    assert len({(b, s) for b, s, _ in held}) <= 20
    assert sum(len(p["data"]) for p in packed) < sum(len(r["text"]) for r in cut.collect()) / 2


def test_both_phrasings_take_one_pass(make, documents, tmp_path):
    index = T.build_index(T.passages(documents, "source", "text")).save(str(tmp_path / "index"))
    questions = make("id int, q string, r string", (1, "zzz", "wall nature"), (2, "wall nature of", "father"), (None, "wall", "roof"))
    best = T.best_phrasing(index, questions, "id", "q", "r")
    assert best._jdf.queryExecution().analyzed().toString().count("FlatMapCoGroupsInArrow") == 1
    first, second = (as_set(T.rank_passages(index, questions, "id", c)) for c in ("q", "r"))
    plain = ["query_id", "source", "passage_no", "score", "rank"]
    assert as_set(best.where("phrasing = 2"), *plain) == {r for r in second if r[0] == 1}
    assert as_set(best.where("phrasing = 1"), *plain) == {r for r in first if r[0] == 2}


def test_terms_are_packed_without_what_they_share():
    """Lists of sorted terms come back whole, odd ones too, and take less than half of what they took as compressed strings."""
    pick = random.Random(5)
    long = "y" * 70_000
    odd = sorted({"", "a", "ab", "é", "è", "日本", "日曜", "𝒳", long, long + "z", "x" * 300, "x" * 299 + "q", "x" * 400}, key=str.encode)
    usual = sorted({f"{a} {b}" for a, b in (pick.choices([f"w{n}rd" for n in range(900)], k=2) for _ in range(20_000))})
    for terms in ([], ["one"], odd, usual):
        column = pa.array(["left out", *terms], pa.string()).slice(1)
        counts = np.arange(len(terms)) * (1 << 33)
        packed = T._packed_terms(column, counts)
        got, n = T._unpacked_terms(pa.scalar(packed, pa.binary()))
        assert got.to_pylist() == terms and got.type == pa.string() and n.tolist() == counts.tolist()
    ones = np.ones(len(usual), np.int64)
    assert len(T._packed_terms(pa.array(usual), ones)) < len(T._packed(term=pa.array(usual), n=pa.array(ones))) / 2


def test_index_without_a_copy_of_the_passages_answers_the_same(spark, make, documents, tmp_path):
    cut = T.passages(documents, "source", "text")
    T.build_index(cut).save(str(tmp_path / "copied"))
    T.build_index(cut).save(str(tmp_path / "slim"), copy=False)
    assert sorted(os.listdir(tmp_path / "slim")) == ["counted", "settings"]
    copied = T.PassageIndex.load(spark, str(tmp_path / "copied"), ("source", "passage_no"))
    slim = T.PassageIndex.load(spark, str(tmp_path / "slim"), ("source", "passage_no"), cut)
    questions = make("id int, q string", (1, "nature of the wall"), (2, "the father"))
    found = [T.rank_passages(index, questions, "id", "q") for index in (copied, slim)]
    assert as_set(found[0]) == as_set(found[1]) and found[0].count() > 2
    assert as_set(T.contexts(slim, found[1])) == as_set(T.contexts(copied, found[0]))


def test_words_are_those_of_the_pattern(spark, make):
    """Words found in bytes equal those of Spark's pattern, whatever the script, and one character alone is none."""
    pick = random.Random(3)
    signs = [chr(c) for c in (*range(32, 0x250), 0x307, 0x3A3, 0x130, 0x2014, 0x2028, 0xFFFD, 0x65E5, 0x672C, 0x1D4B3, 0x1F600, 0x10FFFF, 0x0660, 0xBD, 0x2160)]
    texts = ["", None, "a", "é", "𝒳", "ΑΣ ΟΔΟΣ", "x y zz", "İstanbul_1 ½½", *("".join(pick.choices(signs, k=60)) for _ in range(400))]
    df = make("n int, text string", *enumerate(texts))
    want = [" ".join(r["w"]) if r["w"] else "" for r in df.select("n", T.words(F.col("text")).alias("w")).orderBy("n").collect()]
    lowered = [r["t"] for r in df.select("n", F.concat(F.lower("text"), F.lit("\n")).alias("t")).orderBy("n").collect()]
    got = T._only_words(pa.array(lowered, pa.string()), T._word_characters(spark))
    assert [x.rstrip(" ") for x in got.to_pylist()] == want


@pytest.mark.parametrize("scores", [T.ROUND_SCORES, 7])
def test_ranking_hands_on_no_terms_of_passages(make, monkeypatch, scores):
    """Passages are scored where they are weighed: few rows leave a block, ties go to the lowest ids, in rounds of any size."""
    monkeypatch.setattr(T, "ROUND_SCORES", scores)
    texts = [(f"s{n:02}", f"title {n % 7}\n\nwall word{n % 5} again\n\nwall word{n % 3}") for n in range(40)]
    index = T.build_index(T.passages(make("source string, text string", *texts), "source", "text"), block_chars=300)
    assert index.n_blocks > 3
    questions = make("id int, q string", (1, "wall word2"), (2, "word4 again"), (3, "title"))
    ranked = T.rank_passages(index, questions, "id", "q", k=4)
    assert "MapInPandas" not in ranked._jdf.queryExecution().analyzed().toString()
    held = {(r["source"], r["passage_no"]): r["text"] for r in index.passages.collect()}
    for number, text in ((1, "wall word2"), (2, "word4 again"), (3, "title")):
        got = [(r["score"], (r["source"], r["passage_no"])) for r in ranked.where(F.col("query_id") == number).orderBy("rank").collect()]
        assert got == by_hand(held, text)[:4]


def test_contexts_shuffle_only_ranked_passages(make):
    """Ids of a narrower type and repeated passages are found; a passage that no ranking names is dropped before the join."""
    index = T.build_index(T.passages(make("source bigint, text string", *((n, f"title {n}\n\nwall word{n} again") for n in range(30)), (3, "title 3\n\nwall word3 again")), "source", "text"))
    ranked = make("query_id int, source int, passage_no bigint, rank int", (1, 3, 0, 2), (1, 5, 0, 1), (2, 40, 0, 1))
    found = T.contexts(index, ranked)
    assert "getbit" in found._jdf.queryExecution().optimizedPlan().toString()
    assert as_set(found) == {(1, "- [5] title 5 — wall word5 again\n- [3] title 3 — wall word3 again\n- [3] title 3 — wall word3 again")}
