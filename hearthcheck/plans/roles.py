"""Which column or table plays which role, found from names and schemas only (no Spark job)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthcheck.functions import scalars as S
from hearthcheck.plans import patterns as P


# ---------------------------------------------------------------------- columns


def person_name_columns(columns: Iterable[str], keep: Iterable[str] = ()) -> list[str]:
    """Columns naming a surveyed person. Agent columns and ``keep`` are never among them."""
    kept = set(keep)
    return [c for c in columns if P.PERSON_NAME.search(c) and not P.AGENT.search(c) and c not in kept]


def drop_person_names(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return df.drop(*person_name_columns(df.columns, keep))


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if P.IDENTIFIER.search(c)]


def agent_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if P.AGENT.search(c)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def first_column(df: DataFrame, pattern: re.Pattern) -> str | None:
    return next((c for c in df.columns if pattern.search(c)), None)


def primary_id(df: DataFrame) -> str | None:
    """A column called exactly ``id``, else the first identifier."""
    named = [c for c in df.columns if c.strip().lower() == "id"]
    return (named or id_columns(df) or [None])[0]


def person_key(df: DataFrame) -> str | None:
    """The first person identifier that is not the second member of a pair."""
    return next((c for c in id_columns(df) if "individ" in c.lower() and not c.lower().endswith("2")), None)


def antenatal_dates(df: DataFrame) -> list[str]:
    """Visit dates in the order of their number, so that visit 10 follows visit 9."""
    numbered = [(int(m.group(1)), c) for c in df.columns if (m := P.ANTENATAL_DATE.match(c))]
    return [c for _, c in sorted(numbered)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if S.is_text(f.dataType)]


def typed_dates(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if S.is_temporal(f.dataType)]


def parsed_share(name: str) -> Column:
    """Aggregate: the share of a text column's filled values that are dates."""
    return F.avg(F.when(S.column(name).isNotNull(), S.as_flag(S.parse_moment(S.column(name)).isNotNull())))


def date_columns(df: DataFrame, share: float = P.DATE_SHARE) -> list[str]:
    """Date-typed columns, plus text columns where more than ``share`` of the filled values parse.

    Text columns are judged together in one aggregate over the table, which runs at once: reports that go
    over the table anyway judge them in their own aggregate instead (``text_columns``, ``parsed_share``).
    """
    texts = text_columns(df)
    judged: dict[str, float | None] = {}
    if texts:
        row = df.agg(*[parsed_share(c).alias(f"s{i}") for i, c in enumerate(texts)]).first()
        judged = {c: row[i] for i, c in enumerate(texts)}
    return [
        f.name
        for f in df.schema.fields
        if S.is_temporal(f.dataType) or (judged.get(f.name) or 0.0) > share
    ]


# ---------------------------------------------------------------------- tables


def normalised_name(name: str, prefixes: Sequence[str] = P.TABLE_PREFIXES) -> str:
    """Lower-case name without technical prefix and underscores: ``d_e_c_e_s`` reads ``deces``."""
    lowered = name.lower()
    prefix = next((p for p in prefixes if lowered.startswith(p) and lowered != p), "")
    return lowered[len(prefix) :].replace("_", "")


def plays_role(name: str, keywords: Sequence[str], prefixes: Sequence[str] = P.TABLE_PREFIXES) -> bool:
    spellings = (name.lower(), normalised_name(name, prefixes))
    return any(word in spelling for word in keywords for spelling in spellings)


def table_for_role(
    tables: Mapping[str, DataFrame],
    keywords: Sequence[str],
    unless: Sequence[str] = (),
    prefixes: Sequence[str] = P.TABLE_PREFIXES,
) -> str | None:
    """First table, in load order, whose name carries a keyword and none of ``unless``."""
    for name in tables:
        if plays_role(name, keywords, prefixes) and not (unless and plays_role(name, unless, prefixes)):
            return name
    return None


def person_table(
    tables: Mapping[str, DataFrame], exclude: str | None = None, prefixes: Sequence[str] = P.TABLE_PREFIXES
) -> str | None:
    """The reference table of persons: right name, a person key and a birth date."""
    for name, df in tables.items():
        if name == exclude or not plays_role(name, P.PERSON_TABLE, prefixes):
            continue
        if person_key(df) and first_column(df, P.BIRTH_DATE):
            return name
    return None
