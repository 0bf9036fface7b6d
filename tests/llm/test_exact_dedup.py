import hashlib
import random
import re

from hearthcheck.llm.exact_dedup import RadixTrie, common_length, exact_groups, normalised
from tests.llm.conftest import ODD, prose


def expected(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, k))
    out = []
    for text, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((None if m[0] else m[1], None if keep[0] else keep[1], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_equal_brute_force(docs):
    rows = ODD + [(100 + k, prose(k % 7, 30).replace(" ", random.Random(k).choice([" ", "\n", "\t \r"]), 3)) for k in range(60)]
    got = exact_groups(docs(*rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_spilled_subtrees_give_the_same_groups(docs):
    rows = [(k, prose(k % 5, 200)) for k in range(80)]
    got = exact_groups(docs(*rows), trie_bytes=3_000).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)


def test_empty_table(docs):
    assert exact_groups(docs()).collect() == []


def test_trie_holds_every_key():
    pick, trie, keys = random.Random(3), RadixTrie(), {}
    for n in range(3_000):
        key = bytes(pick.choice(b"ab") for _ in range(pick.randint(0, 12)))
        node = trie.node(key)
        node.value = keys.setdefault(key, n)
    assert dict(trie.terminals(trie.root)) == keys
    assert common_length(b"abcd", b"xxabce", 2) == 3
    assert normalised(b"a \x0b\x0c b\xc2\xa0c") == b"a b\xc2\xa0c"
