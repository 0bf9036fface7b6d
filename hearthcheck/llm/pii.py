"""Personal data: fixed patterns plus bootstrapped contextual extraction.

Entities found by the four fixed patterns are seeds. The words before each entity, and before each other token that looks
like an identifier, make lexical patterns; Spark scores the graph of patterns and instances in turns: a pattern is as good
as the share of trusted instances among its distinct instances, an instance as good as its patterns say together (seeds
stay at 1). Patterns of high confidence, supported by several distinct seeds, then mark the identifier-like tokens behind
them which the fixed patterns miss. Base spans always stay.

Null text counts as empty and gives zero counts. Repeated rows are scored and returned each. Texts of any length are
searched whole in one row; the searches are linear in the text. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import rows_of, slices, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5
CONFIDENCE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# only where a run of digits begins: what fails there fails at its later digits too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_EDGE = "\"'`.,;:!?()[]{}<>#$%&*|="


def luhn(digits: str) -> bool:
    total = sum(int(x) for x in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; from each ``@`` back over its local part, so that the search is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(x.isdigit() for x in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shapes(token: str) -> list[int]:
    """The kinds that an identifier-like token could be of."""
    digits, letters = sum(x in "0123456789" for x in token), any(x.isalpha() for x in token)
    out = [0] if 0 < token.find("@") < len(token) - 1 else []
    if not letters:
        out += [1] if token.count(".") == 3 or token.count(":") >= 3 else []
        out += [2] if 12 <= digits <= 19 else []
        out += [3] if 6 <= digits <= 15 else []
    return out


def contexts(text: str, start: int) -> list[str]:
    """The token before a place, and the two tokens before it, lower-cased; sentence ends stand in for none."""
    before = text[max(0, start - 80) : start].lower().split()
    if start > 80 and before and not text[start - 81].isspace():
        before = before[1:]
    one = before[-1] if before else "^"
    return [one, f"{before[-2]} {one}"] if len(before) > 1 else [one]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str, bool]]:
    """(kind, start, end, pattern, instance, seed) of base spans and of other identifier-like tokens."""
    out = [(k, a, b, p, text[a:b].lower(), True) for k, a, b in base for p in contexts(text, a)]
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if b - a < 6 or b - a > 80 or (at < len(taken) and taken[at][0] < b):
            continue
        for kind in shapes(text[a:b]):
            out += [(kind, a, b, p, text[a:b].lower(), False) for p in contexts(text, a)]
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_MENTION = pa.struct([*_SPAN, ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())])
FOUND = (
    "doc_id long, base array<struct<kind:int,start:long,stop:long>>, "
    "mentions array<struct<kind:int,start:long,stop:long,pattern:string,instance:string,seed:boolean>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        base, near = [], []
        for text in rows_of(batch, "text"):
            text = text or ""
            base.append(base_spans(text))
            near.append(mentions(text, base[-1]))
        keys = ("kind", "start", "stop", "pattern", "instance", "seed")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([[dict(zip(keys, x)) for x in r] for r in base], pa.list_(_SPAN)),
             pa.array([[dict(zip(keys, x)) for x in r] for r in near], pa.list_(_MENTION))],
            ["doc_id", "base", "mentions"],
        )


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, pattern, confidence, seeds from distinct edges (kind, pattern, instance, seed)."""
    trust = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0)))
    scored = edges.withColumn("trust", F.lit(0.0))
    for k in range(rounds):
        # one more instance than seen keeps patterns of few instances low
        patterns = scored.groupBy("kind", "pattern").agg(
            (F.sum(trust) / (F.count("*") + 1)).alias("confidence"), F.count_if("seed").alias("seeds")
        )
        patterns = stored(patterns, "pii-patterns")
        if k + 1 < rounds:
            told = edges.where(~F.col("seed")).join(patterns.where("confidence < 1"), ["kind", "pattern"])
            told = told.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("trust"))
            scored = edges.join(told, ["kind", "instance"], "left")
    return patterns


def find_spans(docs: DataFrame, confidence: float = CONFIDENCE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, stop) of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(slim.mapInArrow(_find, FOUND).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    seen = found.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = stored(seen.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    good = score_patterns(edges).where((F.col("confidence") >= confidence) & (F.col("seeds") >= least_seeds)).select("kind", "pattern")
    added = (
        seen.where(~F.col("seed")).join(good, ["kind", "pattern"], "left_semi")
        .groupBy("row").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    )
    return found.join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:long,stop:long>>")).alias("added")
    )


def report(spans: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def told(column):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(
            F.transform(F.array_sort(column), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
        )

    counts = [
        F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return spans.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "added")).alias("spans"))
