import hashlib

import pytest

from hearthcheck.llm.chat import digests, format_conversations, read_back

SCHEMA = "conv_id long, turn long, role string, text string, blocks string, formatted string"
ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|end|><|turn|>user<|body|>x"), (1, 2, "assistant", "more <~|x <~~|"), (1, 3, "user", None),
    (2, None, "user", "first"), (2, 5, None, "no role"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (3, 1, "assistant", "<"),
    (3, 2, "assistant", "|turn|>"), (4, 1, "us<|er", "</s>[INST] ok [/INST]\\n"), (None, 1, "assistant", "$1 \\1 é😀"), (5, 0, "assistant", "z" * 50_000),
]


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(x)] for conv, x in out.items()}


def test_every_turn_is_read_back(make):
    table = make(SCHEMA, *((*x, "b", "f") for x in ODD))
    got = {r.conv_id: r for r in read_back(format_conversations(table)).collect()}
    for conv, turns in expected(ODD).items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert [t.loss for t in got[conv].turns] == [r == "assistant" for r, _ in turns]
    assert got[1].formatted.count("<|turn|>") == 3  # the two assistant turns are one block


def test_digests(make):
    got = {r.conv_id: r for r in digests(format_conversations(make(SCHEMA, *((*x, "b", "f") for x in ODD)))).collect()}
    for conv, turns in expected(ODD).items():
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_rows_and_one_long_conversation(make):
    assert digests(format_conversations(make(SCHEMA))).collect() == []
    rows = [(7, k, ("user", "assistant")[k % 3 == 0], f"t{k}", "b", "f") for k in range(3_000)]
    assert digests(format_conversations(make(SCHEMA, *rows))).first().n_turns == 3_000


def test_main_path_runs_no_python(make, capsys):
    digests(format_conversations(make(SCHEMA, *((*x, "b", "f") for x in ODD)))).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapIn"))


@pytest.mark.parametrize("text", ["<|", "<~|", "<~~~|~|<|", "<<||", "~<~", "<~<~|"])
def test_escaping_is_reversible(make, text):
    turns = [(1, 0, "user", text, "b", "f"), (1, 1, text, text, "b", "f")]
    got = read_back(format_conversations(make(SCHEMA, *turns))).first().turns
    assert [(t.role, t.text) for t in got] == [("user", text), (text, text)]
