import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthcheck.llm import merkle
from tests.llm.conftest import ODD, SCHEMA, doc


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return sha("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def climb(hashes):
    """The top digest, and per node its (left, right) siblings level by level."""
    sides = [[] for _ in hashes]
    below = [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        runs = [range(k, min(k + merkle.FAN, len(hashes))) for k in range(0, len(hashes), merkle.FAN)]
        for run in runs:
            for k in run:
                left, right = "".join(hashes[run[0] : k]), "".join(hashes[k + 1 : run[-1] + 1])
                for node in below[k]:
                    sides[node].append((left, right))
        below = [[n for k in run for n in below[k]] for run in runs]
        hashes = [sha("".join(hashes[k] for k in run)) for run in runs]
    return hashes[0], sides


def by_hand(rows, claim):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    made, subroots = {}, []
    for source in sources:
        mine = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        made[source] = (mine, *climb([leaf_of(r, r[1]) for r in mine]))
        subroots.append(made[source][1])
    root, above = climb(subroots)
    out = []
    for k, source in enumerate(sources):
        mine, subroot, sides = made[source]
        for row, own in zip(mine, sides):
            path = own + above[k]
            folded = leaf_of(row, claim(row))
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], leaf_of(row, row[1]), subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return Counter(out)


def lower_of_some(row):
    return row[1].lower() if row[1] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else row[1]


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(chosen, F.lower("text")).otherwise(F.col("text"))
    return Counter(tuple(r) for r in merkle.proofs(merkle.build(docs, claim)).collect())


CASES = {
    "one row": [doc(1, "Only")],
    "one source of two levels": [doc(k, f"Text {k}") for k in range(40)],
    "a run of one": [doc(k, f"Text {k}") for k in range(17)],
    "lone leaves": [doc(k, f"T{k}", source=f"s{k}") for k in range(5)],
    "three levels, many sources": [doc(k, f"A{k}", source="hot") for k in range(300)] + [doc(1000 + k, f"B{k}", source=f"é{k % 40:02d}") for k in range(90)],
    "odd rows": [doc(*x) for x in ODD] + [doc(8, "X", source=None), doc(9, "Y", lang=None, source=""), doc(9, "Y", lang=None, source="")],
}


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES.keys())
def test_proofs_equal_those_made_by_hand(spark, rows):
    assert found(spark, rows) == by_hand(rows, lower_of_some)


def test_shuffled_ancestors_give_the_same_paths(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = CASES["three levels, many sources"]
    assert found(spark, rows) == by_hand(rows, lower_of_some)


def test_only_changed_texts_fail(spark):
    docs = spark.createDataFrame([doc(k, "same" if k % 3 else "Other") for k in range(60)], SCHEMA)
    rows = merkle.proofs(merkle.build(docs, F.lower("text"))).collect()
    assert {r["doc_id"] for r in rows if not r["verified"]} == set(range(0, 60, 3))


def test_no_rows(spark):
    assert merkle.proofs(merkle.build(spark.createDataFrame([], SCHEMA))).count() == 0
