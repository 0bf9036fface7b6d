import re

import pytest

from hearthcheck.llm.pii import base_spans, find_spans, luhn, report
from tests.llm.conftest import ODD


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e f", "x@@y.z", "..@a.b-c.d. e@f", "é@a.b", "1.2.3.4.5.6.7.8", "1.2.3.400 01.002.3.4", "4539 1488 0343 6467", "45391488034364671",
     "+1 (743) 555-3824 +12", "+1+2 3456789", "a" * 300 + "@" * 3 + "b.c", "1" * 500 + ".2.3.4", "4-5-3-9-1-4-8-8-0-3-4-3-6-4-6-7", "a%b+c@x.y_z.w"],
)
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == brute(text)


def test_context_finds_unseen_identifiers(docs):
    rows = [(k, f"noise {k} words, my hotline: +1 555 010 {1000 + k} ok") for k in range(30)]
    rows += [(90, "reach my hotline: 555-010-7777 today"), (91, "the year 1999-2001 was long"), (92, "order 123456789 shipped")]
    got = {r.doc_id: r for r in report(find_spans(docs(*rows))).collect()}
    assert got[90].spans == "phone:18:30" and got[90].n_phone == 0
    assert got[91].spans == got[92].spans == ""
    assert all(got[k].n_phone == 1 and got[k].spans.count(":") == 2 for k in range(30))


def test_odd_rows(docs):
    got = report(find_spans(docs(*ODD, (8, "x" * 200_000 + "@a.b")))).collect()
    assert len(got) == len(ODD) + 1
    assert {r.doc_id: r.spans for r in got}[8] == "email:0:200004"
    assert {r.doc_id: r.spans for r in got}[1] == ""
    assert report(find_spans(docs())).collect() == []
