import random
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hearthcheck.llm.suite import TOKENIZER_FILE
from hearthcheck.llm.token_files import ShardReader, bits_for, encode, pack, read_documents, store_of, unpack, write_ids
from tests.llm.conftest import ODD, prose


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    raw = pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    assert np.array_equal(unpack(raw, 1000, bits), ids)
    assert bits_for(50_257) == 16 and bits_for(2) == 1 and bits_for(1) == 1


def test_cut_units_encode_like_whole_texts():
    tokenizer = Tokenizer.from_file(TOKENIZER_FILE)
    odd = ["a  b", "", " ", "  lead", "x \n\n y  ", "tab\tx y", "<|endoftext|> a<|endoftext|>b", "é b c d", "\x1c a \x1cb", "😀 x  😀",
           "a\x00 b", "don't  I'll 's x.", "1,2, 3.", "Foo, foo. foo, .", "ª, º.", "a\u0085 b", "é. x"]
    for text in odd + [prose(3, 500)]:
        assert np.frombuffer(encode([text], TOKENIZER_FILE)[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_encode_like_the_tokenizer(seed):
    """Odd blanks, marks, letters of all sizes, added tokens; texts next to each other in one column, known units or not."""
    pick = random.Random(seed)
    pieces = ["a", "The", "né", "ß", "😀", "中", ".", ",", "'s", "12", "\n", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f",
              "\u205f", "\u3000", "\u200b", "<|endoftext|>", "\x00", "Ö.", "x,", "é."] + [" "] * 20
    texts = ["".join(pick.choice(pieces) for _ in range(pick.randrange(0, 14))) for _ in range(4000)]
    tokenizer = Tokenizer.from_file(TOKENIZER_FILE)
    wanted = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts, TOKENIZER_FILE)] == wanted


def test_the_smallest_id_is_not_a_missing_one(spark, docs):
    folder = write_ids(docs((-(1 << 63), "a"), (None, "b c"), (None, None), (0, "d")), TOKENIZER_FILE)
    assert [(r.doc_id, r.n_tokens) for r in read_documents(spark, folder).orderBy("start").collect()][2:] == [(-(1 << 63), 2), (0, 2)]


def test_files_give_every_document_back(spark, docs):
    rows = ODD + [(50 - k, prose(k, 40)) for k in range(30)]
    tokenizer = Tokenizer.from_file(TOKENIZER_FILE)
    folder = write_ids(docs(*rows), TOKENIZER_FILE, shard_chars=40_000, block=64)
    got = [tuple(r) for r in read_documents(spark, folder).collect()]
    at, wanted = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    # rows of one id may stand in either order
    plain = lambda rows: sorted(((r[0], r[2], r[3]) for r in rows), key=repr)
    assert plain(got) == plain(wanted)
    assert {r[1] for r in got if r[0] and r[0] > 10} == {r[1] for r in wanted if r[0] and r[0] > 10}


def test_random_access(spark, docs):
    text = prose(1, 900)
    folder = write_ids(docs((1, text), (2, "end")), TOKENIZER_FILE, block=32)
    shard = spark.read.parquet(f"{folder}/manifest").first().shard
    store, root = store_of(f"{folder}/shards")
    reader = ShardReader(store, f"{root}/{shard}")
    ids = Tokenizer.from_file(TOKENIZER_FILE).encode(text, add_special_tokens=False).ids
    assert reader.ids(100, 77).tolist() == ids[100:177] and reader.ids(5, 0).tolist() == []
    assert reader.doc_ids.tolist() == [1, 2]


def test_no_rows(spark, docs):
    assert read_documents(spark, write_ids(docs(), TOKENIZER_FILE)).collect() == []


def test_the_driver_loads_no_tokenizer(spark, docs, monkeypatch):
    monkeypatch.setitem(sys.modules, "tokenizers", None)  # an import fails here, not in tasks
    folder = write_ids(docs((1, "a b"), (2, "end")), TOKENIZER_FILE)
    assert read_documents(spark, folder).count() == 2
