"""Consistency checks inside one table, declared as data.

A row check yields, per metric, how much one row adds to the count; all row checks of a table are
summed in a single aggregate over it. Key checks compare the lowest and highest value seen per key,
which needs no distinct count. ``None`` means the table lacks a needed column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.plans import patterns as P
from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet


@dataclass(frozen=True)
class Sheet:
    """One table as a check sees it: its columns by role, its dates parsed, the reference day."""

    name: str
    df: DataFrame
    as_of: str | None = None

    def find(self, pattern: re.Pattern) -> str | None:
        return R.first_column(self.df, pattern)

    def find_all(self, *patterns: re.Pattern) -> list[str] | None:
        found = [self.find(p) for p in patterns]
        return None if None in found else found

    def moment(self, column: str) -> Column:
        return S.moment(self.df, column)

    def text(self, column: str) -> Column:
        return S.exact_text(self.df, column)

    def number(self, column: str) -> Column:
        return S.numeric(self.df, column)

    def age(self, birth_column: str) -> Column:
        return S.age_years(self.moment(birth_column), S.today(self.as_of))


@dataclass(frozen=True)
class Metric:
    """What one row adds to a count, and the columns looked at. ``name`` tells counters apart."""

    adds: Column
    columns: tuple[str, ...]
    name: str = "n"


Findings = list[Metric] | None


@dataclass(frozen=True)
class RowCheck:
    check: str
    label: str
    build: Callable[[Sheet], Findings]
    tables: Sequence[str] | None = None  # keywords of the tables it is meant for; None: every table


def _one(condition: Column, *columns: str) -> Findings:
    return [Metric(S.as_flag(condition), columns)]


def self_reference(sheet: Sheet) -> Findings:
    pairs = [(c, c + "2") for c in R.id_columns(sheet.df) if not c.endswith("2") and c + "2" in sheet.df.columns]
    if not pairs:
        return None
    adds = sum((S.as_flag(S.column(a) == S.column(b)) for a, b in pairs), F.lit(0).cast("bigint"))
    return [Metric(adds, tuple(f"{a}/{b}" for a, b in pairs))]


def same_parents(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.FATHER_ID, P.MOTHER_ID)
    return found and _one(S.column(found[0]) == S.column(found[1]), *found)


def young_without_parent(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.BIRTH_DATE, P.MOTHER_ID)
    if not found:
        return None
    birth, mother = found
    motherless = (sheet.age(birth) < P.YOUNG_CHILD_AGE) & S.column(mother).isNull()
    metrics = [Metric(S.as_flag(motherless), (birth, mother))]
    father = sheet.find(P.FATHER_ID)
    if father:
        orphan = motherless & S.column(father).isNull()
        metrics.append(Metric(S.as_flag(orphan), (birth, mother, father), "n_without_both"))
    return metrics


def _out_of_order(sheet: Sheet, first: re.Pattern, then: re.Pattern) -> Findings:
    found = sheet.find_all(first, then)
    if not found or found[0] == found[1]:
        return None
    return _one(sheet.moment(found[0]) > sheet.moment(found[1]), *found)


def birth_after_death(sheet: Sheet) -> Findings:
    return _out_of_order(sheet, P.BIRTH_DATE, P.DEATH_DATE)


def entered_before_birth(sheet: Sheet) -> Findings:
    return _out_of_order(sheet, P.BIRTH_DATE, P.ENTRY_DATE)


def _sentinel(sheet: Sheet, pattern: re.Pattern, value: float) -> Findings:
    found = sheet.find(pattern)
    return found and _one(sheet.number(found) == value, found)


def missing_weight(sheet: Sheet) -> Findings:
    return _sentinel(sheet, P.WEIGHT, P.MISSING_WEIGHT)


def missing_height(sheet: Sheet) -> Findings:
    return _sentinel(sheet, P.HEIGHT, P.MISSING_HEIGHT)


def outside_territory(
    sheet: Sheet, latitudes: tuple[float, float] = P.LATITUDE_RANGE, longitudes: tuple[float, float] = P.LONGITUDE_RANGE
) -> Findings:
    found = sheet.find_all(P.LATITUDE, P.LONGITUDE)
    if not found:
        return None
    inside = sheet.number(found[0]).between(*latitudes) & sheet.number(found[1]).between(*longitudes)
    return _one(~F.coalesce(inside, F.lit(False)), *found)


def invalid_phone(sheet: Sheet) -> Findings:
    found = sheet.find(P.PHONE)
    return found and _one(S.phone_is_invalid(sheet.text(found)), found)


def left_before_arriving(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.ARRIVAL_DATE, P.DEPARTURE_DATE)
    return found and _one(sheet.moment(found[1]) <= sheet.moment(found[0]), *found)


def age_outside(low: float, high: float) -> Callable[[Sheet], Findings]:
    def build(sheet: Sheet) -> Findings:
        birth = sheet.find(P.BIRTH_DATE)
        return birth and _one(~sheet.age(birth).between(low, high), birth)

    return build


def union_age_outside(sheet: Sheet) -> Findings:
    found = sheet.find(P.UNION_AGE)
    return found and _one(~sheet.number(found).between(*P.UNION_AGE_RANGE), found)


def slept_but_departed(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.SLEPT, P.DEPARTURE_DATE)
    return found and _one(S.is_yes(S.column(found[0])) & S.column(found[1]).isNotNull(), *found)


def absent_without_departure(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.SLEPT, P.DEPARTURE_DATE)
    return found and _one(S.is_filled_not_yes(S.column(found[0])) & S.column(found[1]).isNull(), *found)


def no_presence_dates(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.SLEPT, P.ARRIVAL_DATE, P.DEPARTURE_DATE)
    return found and _one(S.column(found[1]).isNull() & S.column(found[2]).isNull(), *found[1:])


def died_where_never_went(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.DIED_IN_FACILITY, P.WENT_TO_FACILITY)
    return found and _one(S.is_yes(S.column(found[0])) & S.is_filled_not_yes(S.column(found[1])), *found)


def minor_head(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.BIRTH_DATE, P.HEAD_RELATION)
    if not found:
        return None
    return _one((sheet.age(found[0]) < P.HEAD_MINIMUM_AGE) & S.is_code(sheet.text(found[1]), P.HEAD_CODE), *found)


def visits_out_of_order(sheet: Sheet) -> Findings:
    """A visit is late when any visit numbered before it has a later date: compare with the running latest."""
    found = R.antenatal_dates(sheet.df)
    if len(found) < 2:
        return None
    dates = [sheet.moment(c) for c in found]
    late = [
        F.coalesce((dates[0] if i == 1 else F.greatest(*dates[:i])) > dates[i], F.lit(False))
        for i in range(1, len(dates))
    ]
    return _one(S.any_of(late), *found)


def visits_missing(sheet: Sheet) -> Findings:
    declared, found = sheet.find(P.ANTENATAL_COUNT), R.antenatal_dates(sheet.df)
    if declared is None or not found:
        return None
    filled = sum((S.as_flag(S.column(c).isNotNull()) for c in found), F.lit(0).cast("bigint"))
    return _one(sheet.number(declared) > filled, declared, *found)


def child_birth_year(sheet: Sheet) -> Findings:
    found = sheet.find(P.CHILD_BIRTH_DATE)
    return found and _one(~F.year(sheet.moment(found)).between(*P.CHILD_BIRTH_YEARS), found)


def interview_length(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.BEGIN_TIME, P.END_TIME)
    if not found:
        return None
    minutes = S.minutes_between(S.clock(sheet.df, found[0]), S.clock(sheet.df, found[1]))
    short = (minutes >= 0) & (minutes < P.SHORT_INTERVIEW_MINUTES)
    return [
        Metric(S.as_flag(short), tuple(found), "n_too_short"),
        Metric(S.as_flag(minutes < 0), tuple(found), "n_end_before_start"),
    ]


def menses_month_missing(sheet: Sheet) -> Findings:
    found = sheet.find_all(P.MENSES, P.MENSES_MONTH)
    return found and _one(S.is_code(sheet.text(found[0]), P.NO_CODE) & S.column(found[1]).isNull(), *found)


def internet_contradiction(sheet: Sheet) -> Findings:
    use, places = sheet.find(P.INTERNET_USE), [c for c in sheet.df.columns if P.INTERNET_PLACE.match(c)]
    if use is None or not places:
        return None
    somewhere = S.any_of([S.is_code(sheet.text(c), *P.USED_CODES) for c in places])
    return _one(S.is_code(sheet.text(use), P.NEVER_CODE) & somewhere, use, *places)


ROW_CHECKS: tuple[RowCheck, ...] = (
    RowCheck("CHK2", "Identifier refers to itself", self_reference),
    RowCheck("CHK3", "Father and mother are the same person", same_parents),
    RowCheck("CHK4", "Young child without a parent", young_without_parent),
    RowCheck("CHK5", "Birth after death", birth_after_death),
    RowCheck("CHK6", "Entered before birth", entered_before_birth),
    RowCheck("CHK7", "Weight is the missing code", missing_weight),
    RowCheck("CHK8", "Height is the missing code", missing_height),
    RowCheck("CHK9", "Coordinates missing or outside the territory", outside_territory),
    RowCheck("CHK10", "Invalid phone number", invalid_phone),
    RowCheck("CHK11", "Departure not after arrival", left_before_arriving),
    RowCheck("CHK15", "Age at first union outside 12-40", union_age_outside, P.UNION_TABLE),
    RowCheck("CHK16", "Slept here but has a departure date", slept_but_departed, P.PRESENCE_TABLE),
    RowCheck("CHK17", "Did not sleep here and has no departure date", absent_without_departure, P.PRESENCE_TABLE),
    RowCheck("CHK18", "Neither arrival nor departure date", no_presence_dates, P.PRESENCE_TABLE),
    RowCheck("CHK20", "Died in a facility never gone to", died_where_never_went, P.DEATH_TABLE),
    RowCheck("CHK21", "Household head under 12", minor_head, P.BIRTH_TABLE),
    RowCheck("CHK22", "Antenatal dates out of order", visits_out_of_order, P.ANTENATAL_TABLE),
    RowCheck("CHK23", "More antenatal visits declared than dated", visits_missing, P.ANTENATAL_TABLE),
    RowCheck("CHK24", "Child's birth year outside 2022-2026", child_birth_year, P.REPRODUCTIVE_COMPLEMENT_TABLE),
    RowCheck("CHK25", "Interview too short or ending before it starts", interview_length, P.OBSERVATION_TABLE),
    RowCheck("CHK27", "Month of last menses unknown", menses_month_missing, P.HEALTH_TABLE),
    RowCheck("CHK28", "Never uses internet but uses it somewhere", internet_contradiction, P.HEALTH_TABLE),
)


def bracket_checks(tables: TableSet, name: str) -> list[RowCheck]:
    """The age-bracket checks meant for a table, by its form type."""
    return [
        RowCheck("CHK13", f"Age outside {low:g}-{high:g}", age_outside(low, high), words)
        for words, low, high in P.AGE_BRACKETS
        if tables.plays(name, words)
    ]


# ---------------------------------------------------------------------- keys


@dataclass(frozen=True)
class KeyCheck:
    """Keys with more than one distinct value of another column (or more than one row)."""

    check: str
    label: str
    columns: Callable[[Sheet], tuple[str, str | None] | None]
    tables: Sequence[str] | None = None


def _person_place(sheet: Sheet) -> tuple[str, str | None] | None:
    person = next((c for c in R.id_columns(sheet.df) if "individ" in c.lower()), None)
    place = sheet.find(P.PLACE) or sheet.find(P.HOUSEHOLD)
    return (person, place) if person and place and person != place else None


def _person_once(sheet: Sheet) -> tuple[str, str | None] | None:
    person = R.person_key(sheet.df)
    return (person, None) if person else None


def _respondent_household(sheet: Sheet) -> tuple[str, str | None] | None:
    found = sheet.find_all(P.RESPONDENT_ID, P.HOUSEHOLD)
    return (found[0], found[1]) if found else None


KEY_CHECKS: tuple[KeyCheck, ...] = (
    KeyCheck("CHK12", "Person attached to several places", _person_place),
    KeyCheck("CHK19", "Person declared dead more than once", _person_once, P.DEATH_TABLE),
    KeyCheck("CHK26", "Respondent in several households", _respondent_household, P.HEALTH_TABLE),
)


def offending_keys(df: DataFrame, key: str, value: str | None) -> DataFrame:
    """Keys (``_key``) that break a key check. Two distinct values show as lowest < highest."""
    keyed = df.where(S.column(key).isNotNull()).groupBy(S.column(key).alias("_key"))
    if value is None:
        return keyed.agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    spread = keyed.agg(F.min(S.column(value)).alias("_low"), F.max(S.column(value)).alias("_high"))
    return spread.where("_low < _high").select("_key")


# ---------------------------------------------------------------------- identifier lengths


def length_cells(df: DataFrame) -> DataFrame:
    """Column name and text length of every filled identifier cell."""
    cells = ", ".join(
        f"named_struct('column', {S.sql_text(c)}, 'length', length({S.sql_exact_text(df, c)}))"
        for c in R.id_columns(df)
    )
    return df.selectExpr(f"inline(array({cells}))").where("length is not null")


def unusual_lengths(cells: DataFrame, *by: str) -> DataFrame:
    """Per identifier column: how many filled values, and how many have an unusual length.

    Counts per column and length are few, so only they are shuffled. The modal length is the
    most frequent one, the shortest on ties.
    """
    lengths = cells.groupBy(*by, "column", "length").agg(F.count(F.lit(1)).alias("k"))
    return lengths.groupBy(*by, "column").agg(
        F.sum("k").alias("n_values"),
        (F.sum("k") - F.max("k")).alias("n"),
        F.min(F.struct((-F.col("k")).alias("rank"), "length")).getField("length").alias("modal_length"),
    )


def identifier_lengths(df: DataFrame) -> DataFrame:
    return unusual_lengths(length_cells(df))
