"""The audit: every check on every table and across tables, as one long-form result.

Shape of the result: ``check, table_a, table_b, metric, columns, applicable, n``. A check whose
columns are missing gives one row with ``applicable`` false, so nothing is silently left out.

All counts come from two groupings over all tables (``one_pass``): one of rows and keys, which reads each
table once, and one of persons in time and in their households, which reads the tables that have dates
or homes once more. No check joins or scans on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.operators import checks as C
from hearthcheck.operators.one_pass import OnePass, Reading
from hearthcheck.operators.skew import join_reference
from hearthcheck.operators.stats import union_all
from hearthcheck.plans import patterns as P
from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet

PERSON_RULES = ("RUL1", "RUL2", "RUL3", "RUL4", "RUL5")


# ---------------------------------------------------------------------- one table


def _wanted(check: str, only: Sequence[str] | None) -> bool:
    return only is None or check in only


def _row_checks(tables: TableSet, name: str, only: Sequence[str] | None) -> list[C.RowCheck]:
    meant = [c for c in C.ROW_CHECKS if c.tables is None or tables.plays(name, c.tables)]
    return [c for c in meant + C.bracket_checks(tables, name) if _wanted(c.check, only)]


def readings_of(tables: TableSet, as_of: str | None) -> dict[str, Reading]:
    return {name: Reading(name, df, as_of) for name, df in tables.items()}


def _add_table_checks(run: OnePass, tables: TableSet, names: Sequence[str], only: Sequence[str] | None) -> None:
    """Every check meant for the named tables, including those not applicable to them."""
    for name in names:
        sheet, rows = run.readings[name], run.space()
        for check in _row_checks(tables, name, only):
            findings = check.build(sheet)
            if findings is None:
                # A form without its own birth date is bracketed through the person table (XCK1).
                if check.check != "CHK13" or tables.persons(exclude=name) is None:
                    run.entry(check.check, name, None, "n", (), None)
                continue
            for metric in findings:
                run.entry(check.check, name, None, metric.name, metric.columns, run.count_rows(sheet, rows, metric.adds))
        for key_check in C.KEY_CHECKS:
            if not _wanted(key_check.check, only) or not (key_check.tables is None or tables.plays(name, key_check.tables)):
                continue
            found = key_check.columns(sheet)
            slot = run.check_keys(sheet, *found) if found else None
            run.entry(key_check.check, name, None, "n", [c for c in found or () if c], slot)
        if _wanted("CHK1", only):
            ids = R.id_columns(sheet.df)
            run.entry("CHK1", name, None, "n", ids, run.check_lengths(sheet, ids) if ids else None)


def audit_tables(
    tables: TableSet, names: Sequence[str], as_of: str | None = None, only: Sequence[str] | None = None
) -> list[DataFrame]:
    """Counts of every check meant for the named tables, including those not applicable to them, as one part (or none)."""
    run = OnePass(readings_of(tables, as_of))
    _add_table_checks(run, tables, names, only)
    return [run.result()] if run.entries else []


def audit_table(
    tables: TableSet, name: str, as_of: str | None = None, only: Sequence[str] | None = None
) -> DataFrame:
    """Counts of the checks meant for one table."""
    parts = audit_tables(tables, [name], as_of, only)
    if not parts:
        raise ValueError(f"No check is meant for {name}")
    return union_all(parts)


def flagged_rows(
    tables: TableSet, name: str, as_of: str | None = None, only: Sequence[str] | None = None
) -> DataFrame:
    """The rows of a table that break a row check, with the list of checks each one breaks."""
    sheet = C.Sheet(name, tables[name], as_of)
    marks = [
        F.when(metric.adds > 0, F.lit(check.check if metric.name == "n" else f"{check.check}:{metric.name}"))
        for check in _row_checks(tables, name, only)
        for metric in (check.build(sheet) or [])
    ]
    if not marks:
        raise ValueError(f"No row check applies to {name}")
    return sheet.df.withColumn("violations", F.array_compact(F.array(*marks))).where(F.size("violations") > 0)


def flagged_key_rows(tables: TableSet, name: str, check_id: str) -> DataFrame:
    """The rows of a table whose key breaks a key check."""
    check = next(c for c in C.KEY_CHECKS if c.check == check_id)
    found = check.columns(C.Sheet(name, tables[name]))
    if found is None:
        raise ValueError(f"{check_id} does not apply to {name}")
    keys = C.offending_keys(tables[name], *found)
    return join_reference(tables[name], S.column(found[0]), keys, "_key", "left_semi")


def unusual_length_rows(tables: TableSet, name: str) -> DataFrame:
    """Rows with an identifier whose length is unusual. One histogram of lengths gives the modal length of every column."""
    df = tables[name]
    ids = R.id_columns(df)
    modal = C.identifier_lengths(df).select(F.struct("column", "modal_length").alias("m"))
    modal = modal.agg(F.map_from_entries(F.collect_list("m")).alias("m")).scalar()  # one entry per identifier column
    marks = [
        F.when(S.column(c).isNotNull() & (F.length(S.exact_text(df, c)) != modal[c]), F.lit(c)) for c in ids
    ]
    return df.withColumn("violations", F.array_compact(F.array(*marks))).where(F.size("violations") > 0)


# ---------------------------------------------------------------------- ledgers across tables


@dataclass
class Ledger:
    """Tallies per key over several tables, and the checks that are arithmetic on them (SQL over the tallies' names)."""

    sources: list[tuple[str, DataFrame, str, Column]] = field(default_factory=list)
    checks: list[tuple[str, str, str, str, tuple[str, ...], tuple[str, ...], Callable[..., str], bool]] = field(
        default_factory=list
    )

    def tally(self, name: str, df: DataFrame, key: str | None, adds: Column | None) -> bool:
        if key is None or adds is None:
            return False
        if all(existing != name for existing, *_ in self.sources):
            self.sources.append((name, df, key, adds))
        return True

    def check(
        self,
        check: str,
        table_a: str,
        table_b: str,
        metric: str,
        columns: Sequence[str],
        needs: Sequence[str],
        violation: Callable[..., str],
        null_key: bool = False,
    ) -> None:
        self.checks.append((check, table_a, table_b, metric, tuple(columns), tuple(needs), violation, null_key))

    def _selected(self, only: Sequence[str] | None):
        have = {name for name, *_ in self.sources}
        return [c for c in self.checks if _wanted(c[0], only) and set(c[5]) <= have]

    def grouped(self, only: Sequence[str] | None = None) -> DataFrame | None:
        """One row per key with the tallies that the selected checks need."""
        selected = self._selected(only)
        if not selected:
            return None
        needed = {t for c in selected for t in c[5]}
        sources = [s for s in self.sources if s[0] in needed]
        as_text = S.needs_text_key([(df, key) for _, df, key, _ in sources])
        names = [s[0] for s in sources]
        by_scan: dict[tuple[int, str], list[tuple[str, DataFrame, str, Column]]] = {}
        for source in sources:
            by_scan.setdefault((id(source[1]), source[2]), []).append(source)
        stacked = []
        for group in by_scan.values():
            df, key = group[0][1], group[0][2]
            stacked.append(
                df.select(
                    S.key_column(df, key, as_text).alias("_key"),
                    *[adds.cast("bigint").alias(name) for name, _, _, adds in group],
                )
            )
        totals = [F.expr(f"coalesce(sum(`{t}`), 0)").alias(t) for t in names]
        return union_all(stacked, fill_missing=True).groupBy("_key").agg(*totals)

    @staticmethod
    def _violation(check) -> Column:
        _, _, _, _, _, needs, violation, null_key = check
        amount = F.expr(violation(*[S.quoted(t) for t in needs]))
        return amount if null_key else F.when(F.col("_key").isNotNull(), amount)

    def add_to(self, run: OnePass, only: Sequence[str] | None = None) -> set[str]:
        """Hand the selected checks to a run; the tables are found again by their frames."""
        selected = self._selected(only)
        needed = {t for c in selected for t in c[5]}
        reading = {id(r.df): r for r in run.readings.values()}
        sources = [(name, reading[id(df)], key, adds) for name, df, key, adds in self.sources if name in needed]
        slots = run.ledger(sources, [c[5:] for c in selected]) if selected else []
        for (check, a, b, metric, columns, *_), slot in zip(selected, slots):
            run.entry(check, a, b, metric, columns, slot)
        return {c[0] for c in selected}

    def keys(self, check_id: str, cap: int | None = P.LIST_CAP) -> DataFrame:
        """The keys behind a cross check, per metric, sorted as text; ``cap`` None lists them all."""
        selected, per_key = self._selected([check_id]), self.grouped([check_id])
        if per_key is None:
            raise ValueError(f"{check_id} does not apply")
        parts = []
        for c in selected:
            hits = per_key.where(self._violation(c) > 0).select(
                F.lit(c[0]).alias("check"),
                F.lit(c[1]).alias("table_a"),
                F.lit(c[2]).alias("table_b"),
                F.lit(c[3]).alias("metric"),
                F.col("_key").cast("string").alias("key"),
            )
            parts.append(hits if cap is None else hits.orderBy("key").limit(cap))
        return union_all(parts)



def _flag(condition: str) -> str:
    return f"cast({condition} as bigint)"


def _rows_if(rows: str, condition: str) -> str:
    return f"case when {condition} then {rows} end"


@dataclass
class CrossAudit:
    """Every check across tables that the loaded tables allow."""

    tables: TableSet
    as_of: str | None = None
    readings: dict[str, Reading] | None = None  # set where the counts come from a run

    def __post_init__(self) -> None:
        t = self.tables
        self.presence = t.with_role(P.PRESENCE_TABLE)
        self.deaths = t.with_role(P.DEATH_TABLE)
        self.departures = t.with_role(P.DEPARTURE_TABLE)
        self.arrivals = t.with_role(P.ARRIVAL_TABLE)
        self.pregnancies = t.with_role(P.PREGNANCY_TABLE, P.NOT_PREGNANCY_TABLE)
        self.outcomes = t.with_role(P.OUTCOME_TABLE)
        self.births = t.with_role(P.BIRTH_TABLE)
        self.reproductive = t.with_role(P.REPRODUCTIVE_TABLE, P.REPRODUCTIVE_COMPLEMENT_TABLE)
        self.complement = t.with_role(P.REPRODUCTIVE_COMPLEMENT_TABLE)
        self.health = t.with_role(P.HEALTH_TABLE)
        self.poverty = t.with_role(P.POVERTY_TABLE)
        self.snakebite = t.with_role(P.SNAKEBITE_TABLE, P.NOT_SNAKEBITE_TABLE)
        self.residency = t.with_role(P.RESIDENCY_TABLE)
        self.telephones = t.with_role(P.TELEPHONE_TABLE)
        self.relationships = t.with_role(P.RELATIONSHIP_TABLE)
        self.union_history = t.with_role(P.UNION_HISTORY_TABLE)
        self.persons = t.persons()

    # -- helpers ------------------------------------------------------------

    def sheet(self, name: str | None) -> C.Sheet | None:
        if name is None:
            return None
        return self.readings[name] if self.readings else C.Sheet(name, self.tables[name], self.as_of)

    def _eligible(self) -> tuple[Column, list[str]] | None:
        """Slept here and has not departed, on whichever of the two columns exist."""
        sheet = self.sheet(self.presence)
        if sheet is None:
            return None
        slept, departed = sheet.find(P.SLEPT), sheet.find(P.DEPARTURE_DATE)
        conditions = []
        if slept:
            conditions.append(S.is_yes(S.column(slept)))
        if departed:
            conditions.append(S.column(departed).isNull())
        return S.all_of(conditions), [c for c in (slept, departed) if c]

    # -- persons ------------------------------------------------------------

    def person_ledger(self) -> Ledger:
        """Everything that is counted per person."""
        ledger = Ledger()
        t = self.tables
        one = F.lit(1)
        eligible = self._eligible()
        presence = self.sheet(self.presence)
        slept = presence.find(P.SLEPT) if presence else None
        presence_key = R.person_key(presence.df) if presence else None

        if presence and presence_key:
            ledger.tally("presence", presence.df, presence_key, one)
            ledger.tally("eligible", presence.df, presence_key, S.as_flag(eligible[0]))
            if slept:
                ledger.tally("not_slept", presence.df, presence_key, S.as_flag(~S.is_yes(S.column(slept))))

        forms = {
            "education": t.with_role(P.EDUCATION_TABLE),
            "employment": t.with_role(P.EMPLOYMENT_TABLE),
            "complement": self.complement,
            "telephone": self.telephones,
        }
        for name in forms.values():
            if name is None or not (presence and presence_key):
                continue
            key = R.person_key(t[name])
            if not ledger.tally(f"rows:{name}", t[name], key, one):
                continue
            looked_at = (key, *eligible[1])
            needs = ("eligible", f"rows:{name}")
            ledger.check(
                "XCK2", self.presence, name, "n_eligible_without_form", looked_at, needs,
                lambda e, f: _flag(f"{e} > 0 and {f} = 0"),
            )
            ledger.check(
                "XCK2", self.presence, name, "n_form_without_eligibility", looked_at, needs,
                lambda e, f: _flag(f"{e} = 0 and {f} > 0"),
            )

        for check, name in (("XCK4", self.deaths), ("XCK5", self.departures)):
            if name and presence and ledger.tally(f"rows:{name}", t[name], R.person_key(t[name]), one):
                ledger.check(
                    check, name, self.presence, "n", (R.person_key(t[name]),), (f"rows:{name}", "presence"),
                    lambda rows, present: _rows_if(rows, f"{present} > 0"), null_key=True,
                )

        if self.pregnancies:
            key = R.person_key(t[self.pregnancies])
            pregnant = f"rows:{self.pregnancies}"
            ledger.tally(pregnant, t[self.pregnancies], key, one)
            if self.outcomes and ledger.tally(
                f"rows:{self.outcomes}", t[self.outcomes], R.person_key(t[self.outcomes]), one
            ):
                ledger.check(
                    "XCK10", self.pregnancies, self.outcomes, "n", (key,), (pregnant, f"rows:{self.outcomes}"),
                    lambda rows, ended: _rows_if(rows, f"{ended} = 0"), null_key=True,
                )
            ledger.check(
                "XCK13", self.pregnancies, self.presence, "n", (key, slept), (pregnant, "not_slept"),
                lambda rows, away: _flag(f"{rows} > 0 and {away} > 0"),
            )

        self._person_attributes(ledger)
        return ledger

    def _person_attributes(self, ledger: Ledger) -> None:
        """Checks multiplying rows of a form by persons of a given age or sex with the same key."""
        t, one = self.tables, F.lit(1)
        persons = self.sheet(self.persons)
        complement, reproductive = self.sheet(self.complement), self.sheet(self.reproductive)

        if complement and reproductive:
            living, alive = reproductive.find(P.LIVING_CHILDREN), complement.find(P.CHILD_ALIVE)
            if living and alive:
                ledger.tally(
                    "childless", reproductive.df, R.person_key(reproductive.df),
                    S.as_flag(reproductive.number(living) == 0),
                )
                ledger.tally(
                    "live_child", complement.df, R.person_key(complement.df), S.as_flag(S.is_yes(S.column(alive)))
                )
                ledger.check(
                    "XCK15", self.reproductive, self.complement, "n", (living, alive), ("childless", "live_child"),
                    lambda none, child: _flag(f"{none} > 0 and {child} > 0"),
                )

        health = self.sheet(self.health)
        respondent = health.find(P.RESPONDENT_ID) if health else None
        if respondent:
            ledger.tally("health", health.df, respondent, one)
            ledger.check(
                "XCK18", self.health, self.presence, "n", (respondent,), ("health", "not_slept"),
                lambda rows, away: _flag(f"{rows} > 0 and {away} > 0"),
            )

        if persons is None:
            return
        key, birth = R.person_key(persons.df), persons.find(P.BIRTH_DATE)
        age = persons.age(birth)

        def product(rows: str, kind: str) -> str:
            return f"{rows} * {kind}"

        def persons_where(tally: str, condition: Column) -> str:
            ledger.tally(tally, persons.df, key, S.as_flag(condition))
            return tally

        birth_name = f"{self.persons}.{birth}"
        for words, low, high in P.AGE_BRACKETS:
            for name in t:
                if name == self.persons or not t.plays(name, words) or R.first_column(t[name], P.BIRTH_DATE):
                    continue
                form_key = R.person_key(t[name])
                if ledger.tally(f"rows:{name}", t[name], form_key, one):
                    outside = persons_where(f"age:{low:g}-{high:g}", ~age.between(low, high))
                    ledger.check(
                        "XCK1", name, self.persons, "n", (form_key, birth_name), (f"rows:{name}", outside), product
                    )

        gender = persons.find(P.GENDER)
        if gender:
            male = persons_where("male", S.is_code(persons.text(gender), P.MALE_CODE))
            for form in (reproductive, complement):
                if form and ledger.tally(f"rows:{form.name}", form.df, R.person_key(form.df), one):
                    looked_at = (R.person_key(form.df), f"{self.persons}.{gender}")
                    ledger.check(
                        "XCK14", form.name, self.persons, "n", looked_at, (f"rows:{form.name}", male), product
                    )

        if respondent:
            minor = persons_where("minor", age < P.ADULT_AGE)
            ledger.check("XCK19", self.health, self.persons, "n", (respondent, birth_name), ("health", minor), product)
            menses = health.find(P.MENSES)
            if menses:
                ledger.tally("menses", health.df, respondent, S.as_flag(S.column(menses).isNotNull()))
                younger = persons_where("under_menses_age", age < P.MENSES_AGE)
                ledger.check(
                    "XCK20", self.health, self.persons, "n", (respondent, menses, birth_name), ("menses", younger),
                    product,
                )

        phones = self.sheet(self.telephones)
        phone_key = R.person_key(phones.df) if phones else None
        if phone_key:
            number = phones.find(P.PHONE)
            has = S.column(number).isNotNull() & S.column(phone_key).isNotNull() if number else F.lit(False)
            ledger.tally("phone", phones.df, phone_key, S.as_flag(has))
            looked_at = tuple(c for c in (phone_key, birth_name, number) if c)
            minor = persons_where("minor", age < P.ADULT_AGE)
            adult = persons_where("adult", age >= P.ADULT_AGE)
            ledger.check(
                "XCK17", self.telephones, self.persons, "n_minor_with_phone", looked_at, (minor, "phone"),
                lambda kind, phone: _rows_if(kind, f"{phone} > 0"),
            )
            ledger.check(
                "XCK17", self.telephones, self.persons, "n_adult_without_phone", looked_at, (adult, "phone"),
                lambda kind, phone: _rows_if(kind, f"{phone} = 0"), null_key=True,
            )

    def rule_ledger(self) -> Ledger:
        """Documented rules about parents that are counted per parent key."""
        ledger = Ledger()
        persons = self.sheet(self.persons)
        if persons is None:
            return ledger
        key, gender = R.person_key(persons.df), persons.find(P.GENDER)
        ledger.tally("registered", persons.df, key, F.lit(1))
        if gender:
            known = S.column(gender).isNotNull()
            ledger.tally("not_male", persons.df, key, S.as_flag(known & ~S.is_code(persons.text(gender), P.MALE_CODE)))
            ledger.tally("not_female", persons.df, key, S.as_flag(known & ~S.is_code(persons.text(gender), P.FEMALE_CODE)))
        for parent, pattern, wrong in (("father", P.FATHER_ID, "not_male"), ("mother", P.MOTHER_ID, "not_female")):
            column = persons.find(pattern)
            if column is None:
                continue
            ledger.tally(f"child_of_{parent}", persons.df, column, F.lit(1))
            ledger.check(
                "RUL3", self.persons, self.persons, f"n_{parent}", (column, key), (f"child_of_{parent}", "registered"),
                lambda children, known: _rows_if(children, f"{known} = 0"),
            )
            ledger.check(
                "RUL4", self.persons, self.persons, f"n_{parent}", (column, key), (f"child_of_{parent}", wrong),
                lambda children, other: f"{children} * {other}",
            )
        return ledger

    # -- households ---------------------------------------------------------

    def _homes(self) -> tuple[C.Sheet, C.Sheet, str, str, str, list[tuple[str, str]]] | None:
        """Presence, persons, their keys, the household column, and the forms kept per household with theirs."""
        persons, presence = self.sheet(self.persons), self.sheet(self.presence)
        if not (persons and presence):
            return None
        household, key, presence_key = persons.find(P.HOUSEHOLD), R.person_key(persons.df), R.person_key(presence.df)
        if not (household and presence_key):
            return None
        forms = [(n, R.first_column(self.tables[n], P.HOUSEHOLD)) for n in (self.poverty, self.health) if n]
        return presence, persons, presence_key, key, household, [(n, c) for n, c in forms if c]

    def home_ledger(self) -> Ledger:
        """XCK3 per household, for listing the households; the counts come from ``add_homes``."""
        ledger, found = Ledger(), self._homes()
        if found is None:
            return ledger
        presence, persons, presence_key, key, household, forms = found
        as_text = S.needs_text_key([(persons.df, key), (presence.df, presence_key)])
        staying = presence.df.where(self._eligible()[0]).select(S.key_column(presence.df, presence_key, as_text).alias("_p")).distinct()
        homes = persons.df.join(staying, S.key_column(persons.df, key, as_text) == F.col("_p"), "left_semi").select(S.column(household))
        ledger.tally("eligible_home", homes, household, F.lit(1))
        for name, column in forms:
            ledger.tally(f"rows:{name}", self.tables[name], column, F.lit(1))
            needs, looked_at = ("eligible_home", f"rows:{name}"), self._home_columns(found, column)
            ledger.check(
                "XCK3", self.presence, name, "n_eligible_without_form", looked_at, needs,
                lambda e, f: _flag(f"{e} > 0 and {f} = 0"),
            )
            ledger.check(
                "XCK3", self.presence, name, "n_form_without_eligibility", looked_at, needs,
                lambda e, f: _flag(f"{e} = 0 and {f} > 0"),
            )
        return ledger

    def _home_columns(self, found: tuple, column: str) -> tuple[str, ...]:
        _, _, presence_key, _, household, _ = found
        return (presence_key, column, *self._eligible()[1], f"{self.persons}.{household}")

    def add_homes(self, run: OnePass) -> bool:
        found = self._homes()
        if found is None or not found[-1]:
            return False
        presence, persons, presence_key, key, household, forms = found
        staying = (run.readings[presence.name], presence_key, self._eligible()[0])
        slots = run.homes(staying, (run.readings[persons.name], key, household), [(run.readings[n], c) for n, c in forms])
        for (name, column), both in zip(forms, slots):
            for metric, slot in zip(("n_eligible_without_form", "n_form_without_eligibility"), both):
                run.entry("XCK3", self.presence, name, metric, self._home_columns(found, column), slot)
        return True

    def household_ledger(self) -> Ledger:
        ledger = Ledger()
        one = F.lit(1)
        bites, residency = self.sheet(self.snakebite), self.sheet(self.residency)
        if bites and residency:
            home, found = bites.find(P.HOUSEHOLD), residency.find_all(P.HOUSEHOLD, P.RESIDENCE_STATUS)
            if home and found:
                resident = S.as_flag(S.is_code(residency.text(found[1]), P.RESIDENT_CODE))
                ledger.tally("snakebite", bites.df, home, one)
                ledger.tally("resident", residency.df, found[0], resident)
                looked_at, needs = (home, *found), ("snakebite", "resident")
                ledger.check(
                    "XCK21", self.snakebite, self.residency, "n_form_without_resident", looked_at, needs,
                    lambda form, living: _flag(f"{form} > 0 and {living} = 0"),
                )
                ledger.check(
                    "XCK21", self.snakebite, self.residency, "n_residents_without_form", looked_at, needs,
                    lambda form, living: _flag(f"{form} = 0 and {living} > 0"),
                )
        return ledger

    # -- events -------------------------------------------------------------

    def event_ledgers(self) -> list[Ledger]:
        """Births against outcomes, and outcomes against pregnancies, on their event numbers."""
        ledgers = []
        for check, name, own, other, theirs in (
            ("XCK11", self.births, P.PREGNANCY_OUTCOME_ID, self.outcomes, P.EVENT_ID),
            ("XCK12", self.outcomes, P.PREGNANCY_EVENT_ID, self.pregnancies, P.EVENT_ID),
        ):
            if name is None or other is None:
                continue
            left, right = R.first_column(self.tables[name], own), R.first_column(self.tables[other], theirs)
            ledger = Ledger()
            if ledger.tally("own", self.tables[name], left, F.lit(1)) and ledger.tally(
                "other", self.tables[other], right, F.lit(1)
            ):
                ledger.check(
                    check, name, other, "n", (f"{name}.{left}", f"{other}.{right}"), ("own", "other"),
                    lambda mine, theirs: _flag(f"{mine} > 0 and {theirs} = 0"),
                )
            ledgers.append(ledger)
        return ledgers

    # -- dates against births ------------------------------------------------

    def add_dates(self, run: OnePass, only: Sequence[str] | None) -> set[str]:
        """Dates that contradict the person's birth date: before it (None), or too few years after it."""
        persons = self.sheet(self.persons)
        if persons is None:
            return set()
        key, birth = R.person_key(persons.df), persons.find(P.BIRTH_DATE)
        asked: dict[float | None, list[tuple[str, str, C.Sheet, str | None, str | None]]] = {}

        def ask(check: str, metric: str, name: str | None, key: str | None, pattern, years: float | None = None) -> None:
            sheet = self.sheet(name)
            if sheet and _wanted(check, only):
                day = sheet.find(pattern)
                key = key or R.person_key(sheet.df)
                if key and day:
                    asked.setdefault(years, []).append((check, metric, sheet, key, day))

        ask("XCK6", "n", self.deaths, None, P.DEATH_DATE)
        for kind, pattern in P.UNION_DATES.items():
            ask("XCK7", f"n_{kind}", self.relationships, None, pattern)
        ask("XCK16", "n", self.complement, None, P.CHILD_BIRTH_DATE, P.MOTHER_MINIMUM_AGE)
        if only is not None and "RUL5" in only:
            for parent, pattern in (("father", P.FATHER_ID), ("mother", P.MOTHER_ID)):
                if column := persons.find(pattern):
                    ask("RUL5", f"n_{parent}", self.persons, column, P.BIRTH_DATE, P.PARENT_AGE_GAP)
        for years, events in asked.items():
            slots = run.later((persons, key, birth), [e[2:] for e in events], years)
            for (check, metric, sheet, k, day), slot in zip(events, slots):
                run.entry(check, sheet.name, self.persons, metric, (k, day, f"{self.persons}.{birth}"), slot)
        return {e[0] for events in asked.values() for e in events}

    def add_union_ages(self, run: OnePass) -> bool:
        """XCK8: declared age at union against the age computed from the union and birth dates.

        Values are counted per person first; a person has one row per distinct age and per distinct day.
        """
        history, unions, persons = self.sheet(self.union_history), self.sheet(self.relationships), self.sheet(self.persons)
        if not (history and unions and persons):
            return False
        declared, start = history.find(P.UNION_AGE), unions.find(P.UNION_DATES["start"])
        birth = persons.find(P.BIRTH_DATE)
        keys = [R.person_key(s.df) for s in (history, unions, persons)]
        if not (declared and start and all(keys)):
            return False

        def day(sheet: C.Sheet, column: str) -> Column:
            return F.datediff(sheet.moment(column).cast("date"), F.lit("1970-01-01").cast("date"))

        slot = run.union_ages(
            (history, keys[0], history.number(declared)), (unions, keys[1], day(unions, start)), (persons, keys[2], day(persons, birth)), P.UNION_AGE_GAP
        )
        run.entry("XCK8", self.union_history, self.relationships, "n", (keys[0], declared, start, f"{self.persons}.{birth}"), slot)
        return True

    def add_departures(self, run: OnePass) -> bool:
        """XCK9: (departure, arrival) pairs of a person where the departure comes first."""
        out, into = self.sheet(self.departures), self.sheet(self.arrivals)
        if not (out and into):
            return False
        left, came = out.find(P.DEPARTURE_DATE), into.find(P.ARRIVAL_DATE)
        key_out, key_in = R.person_key(out.df), R.person_key(into.df)
        if not (left and came and key_out and key_in):
            return False
        (slot,) = run.later((into, key_in, came), [(out, key_out, left)])
        run.entry("XCK9", self.departures, self.arrivals, "n", (f"{self.departures}.{left}", f"{self.arrivals}.{came}"), slot)
        return True

    def add_person_rules(self, run: OnePass, only: Sequence[str] | None) -> set[str]:
        """Documented rules on the person table itself: code lists, own parent."""
        persons = self.sheet(self.persons)
        if persons is None:
            return set()
        key, space = R.person_key(persons.df), run.space()

        def add(check: str, metric: str, columns: Sequence[str], broken: Column) -> None:
            if _wanted(check, only):
                run.entry(check, self.persons, None, metric, columns, run.count_rows(persons, space, S.as_flag(broken)))

        for metric, pattern, codes in (
            ("n_sex", P.GENDER, P.SEX_CODES),
            ("n_ethnic_group", P.ETHNIC_GROUP, P.ETHNIC_CODES),
        ):
            column = persons.find(pattern)
            if column:
                add("RUL1", metric, (column,), ~S.code_text(persons.text(column)).isin(*codes))
        for metric, pattern in (("n_father", P.FATHER_ID), ("n_mother", P.MOTHER_ID)):
            column = persons.find(pattern)
            if column:
                add("RUL2", metric, (key, column), S.column(column) == S.column(key))
        return {c for c in ("RUL1", "RUL2") if _wanted(c, only)}

    # -- all ----------------------------------------------------------------

    def ledgers(self) -> list[Ledger]:
        return [self.person_ledger(), self.household_ledger(), *self.event_ledgers(), self.rule_ledger()]

    def add_to(self, run: OnePass, only: Sequence[str] | None = None) -> None:
        """Hand the wanted checks to a run; those the loaded tables do not allow come as not applicable."""
        applied: set[str] = set()
        for ledger in self.ledgers():
            applied |= ledger.add_to(run, only)
        applied |= self.add_dates(run, only) | self.add_person_rules(run, only)
        for check, add in (("XCK3", self.add_homes), ("XCK8", self.add_union_ages), ("XCK9", self.add_departures)):
            if _wanted(check, only) and add(run):
                applied.add(check)
        for check in CROSS_CHECKS if only is None else only:
            if check not in applied:
                run.entry(check, None, None, "n", (), None)

    def keys(self, check_id: str, cap: int | None = P.LIST_CAP) -> DataFrame:
        for ledger in [*self.ledgers(), self.home_ledger()]:
            if ledger._selected([check_id]):
                return ledger.keys(check_id, cap)
        raise ValueError(f"{check_id} has no key listing or does not apply")


CROSS_CHECKS = tuple(f"XCK{i}" for i in range(1, 22))


def audit_across(tables: TableSet, as_of: str | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Counts of the cross-table checks. Rules that are only written down run when asked for."""
    wanted = CROSS_CHECKS if only is None else only
    run = OnePass(readings_of(tables, as_of))
    CrossAudit(tables, as_of, run.readings).add_to(run, wanted)
    if not run.entries:
        raise ValueError("No cross-table check applies to the loaded tables")
    return run.result()


def audit_full(
    tables: TableSet, as_of: str | None = None, table: str | None = None, include_rules: bool = False
) -> DataFrame:
    """Every check on every table, then across tables; ``table`` keeps what concerns one table."""
    run = OnePass(readings_of(tables, as_of))
    _add_table_checks(run, tables, [table] if table else list(tables), None)
    CrossAudit(tables, as_of, run.readings).add_to(run, CROSS_CHECKS + (PERSON_RULES if include_rules else ()))
    result = run.result()
    return result.where((F.col("table_a") == table) | (F.col("table_b") == table)) if table else result


def status_overlap(tables: TableSet, status_table: str, target: str, key: str | None = None) -> DataFrame:
    """How many rows of a status table (deaths, departures) concern keys that a target table has."""
    from hearthcheck.operators.joins import overlap_count

    return overlap_count(tables, status_table, target, key or R.person_key(tables[target]))
