import re

from pyspark.sql import functions as F

from hearthcheck.llm.mixing import min_cost_flow, mix, mixed_rows, ranked, targets
from tests.llm.conftest import ODD, prose


def rows():
    return [(k, prose(k, 5 + k % 60), "en", [None, "b", "a", "é", "Z"][k % 5]) for k in range(300)]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(table, data):
    got = mix(table, F.array("source")).collect()
    sizes = {}
    for _, text, _, source in data:
        sizes[source] = sizes.get(source, 0) + words(text)
    names = ranked(sizes)
    wanted = targets(sizes, {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}, 1.5, 2)
    taken, least = dict.fromkeys(sizes, 0), {}
    for r in got:
        source = r.pattern[0]
        assert abs(r.target - wanted[source]) < 1e-6 and r.source_size == sizes[source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
        if r.size:
            least.setdefault((source, r.copies), []).append(r.size)
    for source in sizes:
        # less is missing than the smallest document that was left out holds
        low = min((c for s, c in least if s == source), default=0)
        assert 0 <= round(wanted[source]) - taken[source] < max(1, min(least.get((source, low), [0])))
    return got


def test_targets_are_met(docs):
    got = check(docs(*rows()), rows())
    assert sorted(r.doc_id for r in got) == list(range(300))
    again = mix(docs(*rows()).repartition(7), F.array("source")).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(docs):
    check(docs(*ODD), [(*x, "en", "src0") for x in ODD])
    assert mix(docs(), F.array("source")).collect() == []


def test_rows_of_the_mix(docs):
    got = mix(docs(*rows()), F.array("source")).where("copies > 0").selectExpr("doc_id", "copies").collect()
    out = mixed_rows(docs(*rows()), F.array("source"))
    assert out.columns == docs().columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in got for _ in range(r.copies))


def test_water_filling():
    assert targets({"a": 10, "b": 100}, {"a": 3, "b": 1}, 1.5, 2) == {"a": 20.0, "b": 145.0}
    assert targets({"a": 0}, {"a": 1}, 1.5, 2) == {"a": 0.0}
    assert ranked(["é", None, "b", "Z"]) == ["Z", "b", "é", None]


def test_overlapping_sources_share_what_only_one_can_use():
    # the words in both sources go where the source of its own is too small
    flow = min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [10, 20])
    assert flow == [{0: 10}, {1: 10}, {1: 10}]
    # repeats only where the quota needs them
    flow = min_cost_flow([10, 5], [[0], [1]], [4, 9])
    assert flow == [{0: 4}, {1: 9}]
    # a quota above all capacity is filled as far as it goes
    assert min_cost_flow([3], [[0]], [100]) == [{0: 6}]
