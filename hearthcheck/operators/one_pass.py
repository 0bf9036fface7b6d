"""Many checks over many tables from two groupings, each of which reads a table once at most.

A check that counts rows, that counts rows per key, or that compares lengths becomes *cells*: a table emits, per row, the
cells (space, key, part, tally, n, value) of all checks it takes part in, cells that add nothing are left out, and the
cells of all tables are grouped together by space, key and part. What a check asks is then arithmetic on the grouped
tallies, with entries (labels of the result rows) joined from a small table.

Checks that compare moments of a person, or that lead from persons to households, use a second emission with the same
idea: rows are totalled per person and moment, and "how many of these come after that" is a running total. Running totals
have two levels: within a stretch of the calendar, and over the totals of the stretches. So a person holding a large share of
all events is spread over stretches, and no pair is ever formed.

Nothing runs while the result is built. Groupings combine map-side, so a hot key is one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.operators import checks as C
from hearthcheck.operators.stats import union_all

STRETCH_BITS = 42  # microseconds of a stretch of the calendar: about 51 days
DAY_STRETCH_BITS = 12  # the same in hundredths of a day: about 41 days
HOME_SALTS = 8
MOST_TALLIES = 6
_NO_TEXT, _NO_LONG, _NO_DOUBLE = (f"cast(null as {kind})" for kind in ("string", "bigint", "double"))


@dataclass(frozen=True)
class Reading(C.Sheet):
    """A table as both emissions read it: text dates are parsed once, into columns that the expressions refer to."""

    parsed: dict[str, str] = field(default_factory=dict)
    cells: list[str] = field(default_factory=list)
    timed: list[str] = field(default_factory=list)
    named: list[Column] = field(default_factory=list)
    timed_named: list[Column] = field(default_factory=list)
    known: dict[str, str] = field(default_factory=dict)

    def moment(self, column: str) -> Column:
        return F.col(self.parsed.setdefault(column, f"_day{len(self.parsed)}"))

    def rows(self) -> DataFrame:
        days = [S.moment(self.df, column).alias(name) for column, name in self.parsed.items()]
        return self.df.select("*", *days) if days else self.df

    def column(self, value: Column, timed: bool = False) -> str:
        """The name under which an emission finds an expression."""
        held = self.timed_named if timed else self.named
        name = f"_{'t' if timed else 'c'}{len(held)}"
        held.append(value.alias(name))
        return name

    def key(self, column: str, timed: bool = False) -> str:
        """The name of a column's text as a key; the same one each time."""
        known = f"key:{timed}:{column}"
        if known not in self.known:
            self.known[known] = self.column(S.key_column(self.df, column, True), timed)
        return self.known[known]


    def tally(self, name: str, adds: Column) -> str:
        """The name under which a tally that several spaces use is found."""
        known = f"tally:{name}:{id(adds)}"
        if known not in self.known:
            self.known[known] = self.column(adds.cast("bigint"))
        return self.known[known]


@dataclass
class Entry:
    check: str
    table_a: str | None
    table_b: str | None
    metric: str
    columns: tuple[str, ...]
    slot: str | None  # None: not applicable


@dataclass
class Rule:
    """A check on the tallies of a key: what one key adds, from its tallies by position."""

    needs: tuple[int, ...]
    amount: Callable[..., str]
    null_key: bool


@dataclass
class Timing:
    """Events of several kinds counted against base moments that come strictly later."""

    bits: int
    kinds: int = 0


class OnePass:
    """Collects checks, then answers all of them with ``result``."""

    def __init__(self, readings: dict[str, Reading]):
        self.readings = readings
        self.entries: list[Entry] = []
        self.spaces = 0
        self.plain: set[int] = set()  # spaces whose only tally is the count, one result per part
        self.modal: set[int] = set()  # spaces of lengths: all but the most frequent part of each key count
        self.repeated: set[int] = set()  # spaces where a key counts when it has several rows
        self.varied: set[int] = set()  # spaces where a key counts when it has several values
        self.ledgers: dict[int, list[Rule]] = {}
        self.tallies = 1
        self.timings: dict[int, Timing] = {}
        self.union_space: tuple[int, float] | None = None
        self.home_space: int | None = None
        self.home_forms = 0
        self.home_rows: list[DataFrame] = []

    # -- what is asked -------------------------------------------------------

    def space(self) -> int:
        self.spaces += 1
        return self.spaces - 1

    def entry(self, check: str, table_a: str | None, table_b: str | None, metric: str, columns: Sequence[str], slot: str | None) -> None:
        self.entries.append(Entry(check, table_a, table_b, metric, tuple(columns), slot))

    def _cell(self, reading: Reading, space: int, key: str, part: str, tally: int, n: str, value: str = _NO_LONG, more: str = _NO_LONG) -> None:
        reading.cells.append(f"{space}, {key}, {part}, {tally}, {n}, {value}, {more}")

    def count_rows(self, reading: Reading, space: int, adds: Column) -> str:
        """A sum over all rows of a table; spaces of this kind hold one per part."""
        self.plain.add(space)
        part = sum(c.startswith(f"{space}, ") for c in reading.cells)
        self._cell(reading, space, _NO_TEXT, f"'{part}'", 0, reading.column(adds.cast("bigint")))
        return f"{space}:{part}:0"

    def check_keys(self, reading: Reading, key: str, value: str | None) -> str:
        """Keys with several rows, or with several values of another column."""
        space = self.space()
        (self.repeated if value is None else self.varied).add(space)
        k = reading.key(key)
        if value is None:
            shown = (_NO_LONG, _NO_LONG)
        elif S.integral(reading.df, value):
            shown = (reading.column(S.column(value).cast("bigint")), _NO_LONG)
        else:  # 128 bits of digest stand for a text: numbers combine in a hash table, texts would have to be sorted
            text = S.column(value).cast("string")
            shown = tuple(reading.column(F.when(text.isNotNull(), F.xxhash64(text, F.lit(seed)))) for seed in (1, 2))
        self._cell(reading, space, k, _NO_TEXT, 0, f"case when {k} is not null then 1L end", *shown)
        return f"{space}::0"

    def check_lengths(self, reading: Reading, columns: Sequence[str]) -> str:
        """Filled cells whose length is not the most frequent one of their column."""
        space = self.space()
        self.modal.add(space)
        for column in columns:
            length = reading.column(F.length(S.exact_text(reading.df, column)).cast("string"))
            self._cell(reading, space, S.sql_text(column), length, 0, f"case when {length} is not null then 1L end")
        return f"{space}::0"

    def ledger(self, sources: Sequence[tuple[str, Reading, str, Column | None]], rules: Sequence[tuple]) -> list[str]:
        """Checks on tallies per key; sources are (tally, table, key column, adds or None for 1).

        Checks that share tallies share a space as long as it holds few tallies: a grouped row stays narrow.
        """
        slots: dict[int, str] = {}
        waiting = list(range(len(rules)))
        while waiting:
            held, picked = set(rules[waiting[0]][0]), []
            for i in sorted(waiting, key=lambda i: len(set(rules[i][0]) - held)):
                if len(held | set(rules[i][0])) <= MOST_TALLIES:
                    held |= set(rules[i][0])
                    picked.append(i)
            waiting = [i for i in waiting if i not in picked]
            space = self.space()
            mine = [source for source in sources if source[0] in held]
            place = {name: i for i, (name, *_) in enumerate(mine)}
            self.tallies = max(self.tallies, len(place))
            for name, reading, key, adds in mine:
                n = "1L" if adds is None else reading.tally(name, adds)
                self._cell(reading, space, reading.key(key), _NO_TEXT, place[name], n)
            self.ledgers[space] = [Rule(tuple(place[x] for x in rules[i][0]), *rules[i][1:]) for i in picked]
            slots |= {i: f"{space}::{at}" for at, i in enumerate(picked)}
        return [slots[i] for i in range(len(rules))]

    def _timed(self, reading: Reading, space: int, key: str, tally: int, n: str, place: str = _NO_LONG, x: str = _NO_DOUBLE, home: str = _NO_TEXT) -> None:
        reading.timed.append(f"{space}, {key}, {place}, {x}, {home}, {tally}, {n}")

    def later(self, base: tuple[Reading, str, str], events: Sequence[tuple[Reading, str, str]], years: float | None = None) -> list[str]:
        """Pairs per person of an event and a base moment that comes later: (table, key column, date column) each.

        With ``years``: pairs where fewer than so many years lie between the base day and the event's day.
        """
        space = self.space()
        self.timings[space] = Timing(STRETCH_BITS if years is None else DAY_STRETCH_BITS, len(events))
        for tally, (reading, key, column) in enumerate([base, *events]):
            at = reading.moment(column)
            place = micros(at) if years is None else F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 100
            if years is not None and tally:
                place = place - F.lit(round(years * S.DAYS_PER_YEAR * 100)).cast("bigint")
            p, k = reading.column(place, True), reading.key(key, True)
            self._timed(reading, space, k, tally, f"case when {k} is not null and {p} is not null then 1L end", place=p)
        return [f"t{space}:{i}" for i in range(len(events))]

    def union_ages(self, declared: tuple, started: tuple, born: tuple, gap: float) -> str:
        """Combinations per person of a declared age, a start and a birth that disagree by more than ``gap`` years."""
        space = self.space()
        self.union_space = (space, gap)
        for tally, (reading, key, value) in enumerate((declared, started, born)):
            x, k = reading.column(value.cast("double"), True), reading.key(key, True)
            self._timed(reading, space, k, tally, f"case when {k} is not null and {x} is not null then 1L end", x=x)
        return f"t{space}:u"

    def homes(self, staying: tuple[Reading, str, Column], persons: tuple[Reading, str, str], forms: Sequence[tuple[Reading, str]]) -> list[tuple[str, str]]:
        """Households with an eligible person against households with a form: (without form, form without), per form."""
        space = self.home_space = self.space()
        reading, key, eligible = staying
        k, yes = reading.key(key, True), reading.column(S.as_flag(eligible), True)
        self._timed(reading, space, k, 0, f"case when {k} is not null then {yes} end")
        reading, key, household = persons
        k, home = reading.key(key, True), reading.key(household, True)
        self._timed(reading, space, k, 1, f"case when {k} is not null and {home} is not null then 1L end", home=home)
        self.home_forms = len(forms)
        for i, (form, column) in enumerate(forms):
            self.home_rows.append(form.df.select(S.key_column(form.df, column, True).alias("home"), *[F.lit(int(i == j)).cast("bigint").alias(f"f{j}") for j in range(len(forms))]))
        return [(f"t{space}:h{2 * i}", f"t{space}:h{2 * i + 1}") for i in range(len(forms))]

    # -- the first grouping: rows and keys ---------------------------------------

    def _rows_and_keys(self) -> DataFrame | None:
        parts = []
        for reading in self.readings.values():
            if reading.cells:
                wide = reading.rows().select(*reading.named) if reading.named else reading.rows().select(F.lit(1).alias("_"))
                parts.append(wide.selectExpr(f"stack({len(reading.cells)}, {', '.join(reading.cells)}) as (s, k, u, j, n, v, w)").where("n <> 0"))
        if not parts:
            return None
        pivoted = [F.expr(f"sum(case when j = {i} then n end)").alias(f"t{i}") for i in range(self.tallies)]
        per_key = union_all(parts).groupBy("s", "k", "u").agg(*pivoted, F.expr("min(v) < max(v) or min(w) < max(w) as varied"))
        return self._slots(per_key)

    def _slots(self, per_key: DataFrame) -> DataFrame:
        """(slot, n) from the grouped cells."""
        results = max([1, *(len(rules) for rules in self.ledgers.values())])
        outs = []
        for place in range(results):
            cases = []
            if place == 0:
                counted = self.plain | self.modal
                cases += [(self.repeated, "cast(t0 > 1 as bigint)"), (self.varied, "cast(varied as bigint)"), (counted, "t0")]
            for s, rules in self.ledgers.items():
                if place < len(rules):
                    rule = rules[place]
                    amount = rule.amount(*(f"coalesce(t{i}, 0L)" for i in rule.needs))
                    cases.append(({s}, amount if rule.null_key else f"case when k is not null then {amount} end"))
            outs.append(f"{_by_space(cases)} as o{place}")
        group = _by_space([(self.plain, "u"), (self.modal, "k")])
        modal = f"s in ({', '.join(map(str, sorted(self.modal)))})" if self.modal else "false"
        totals = per_key.selectExpr("s", f"cast({group} as string) as g", *outs).groupBy("s", "g").agg(
            *[F.expr(f"sum(o{i}) as o{i}") for i in range(results)], F.expr("max(o0) as most")
        )
        listed = ", ".join(f"o{i}" for i in range(1, results))
        rows = totals.selectExpr(
            "s", f"case when {modal} then '' else coalesce(g, '') end as g",
            f"posexplode(array(case when {modal} then o0 - most else o0 end{', ' if listed else ''}{listed})) as (place, n)",
        )
        return rows.where("n is not null").selectExpr("concat_ws(':', cast(s as string), g, cast(place as string)) as slot", "n")

    # -- the second grouping: persons in time, persons and households ------------------

    def _persons_in_time(self) -> DataFrame | None:
        parts = []
        for reading in self.readings.values():
            if reading.timed:
                wide = reading.rows().select(*reading.timed_named)
                parts.append(wide.selectExpr(f"stack({len(reading.timed)}, {', '.join(reading.timed)}) as (s, k, p, x, h, j, n)").where("n <> 0"))
        if not parts:
            return None
        kinds = max([2, *(t.kinds for t in self.timings.values())])
        pivoted = [F.expr(f"coalesce(sum(case when j = {i} then n end), 0L)").alias(f"a{i}") for i in range(kinds + 1)]
        per_moment = union_all(parts).groupBy("s", "k", "p", "x", "h").agg(*pivoted)
        timed = F.col("s").isin(sorted(self.timings)) if self.timings else F.lit(False)
        home = F.col("s") == self.home_space if self.home_space is not None else F.lit(False)
        union, gap = self.union_space or (None, 0.0)
        ages = F.col("s") == union if union is not None else F.lit(False)

        stretch = F.array(F.lit(0).cast("bigint"))
        for s, timing in self.timings.items():
            stretch = F.when(F.col("s") == s, F.array(F.shiftright("p", timing.bits))).otherwise(stretch)
        salt = F.pmod(F.xxhash64("h"), F.lit(HOME_SALTS))
        stretch = F.when(home & F.col("h").isNull(), F.sequence(F.lit(0), F.lit(HOME_SALTS - 1)).cast("array<bigint>")).when(home, F.array(salt)).otherwise(stretch)
        spread = per_moment.withColumn("c", F.explode(stretch))

        inside = Window.partitionBy("s", "k", "c").orderBy(F.desc("p"))
        before, whole = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        columns = ["s", "k", "c", *(f"a{i}" for i in range(kinds + 1))]
        after = F.when(timed, F.coalesce(F.sum("a0").over(before), F.lit(0))).otherwise(F.lit(0))
        stays = F.max(F.when(home, F.col("a0"))).over(whole) > 0
        listed = [F.collect_list(F.when(ages & (F.col(f"a{i}") > 0), F.struct("x", F.col(f"a{i}").alias("n")))).over(whole) for i in (1, 2)]
        rows = spread.select(*columns, "x", "h", after.alias("after"), stays.alias("stays"), listed[0].alias("starts"), listed[1].alias("births"))

        def apart(start: Column, birth: Column) -> Column:
            return F.abs(F.col("x") - (start["x"] - birth["x"]) / F.lit(S.DAYS_PER_YEAR)) > F.lit(gap)

        zero = F.lit(0).cast("bigint")
        odd = F.aggregate("starts", zero, lambda total, start: total + F.aggregate(
            "births", zero, lambda t, birth: t + F.when(apart(start, birth), start["n"] * birth["n"]).otherwise(zero)))
        rows = rows.select(
            *columns, "after",
            F.when(home & (F.col("a1") > 0) & F.col("stays"), F.col("h")).alias("home"),
            F.when(ages & (F.col("a0") > 0), F.col("a0") * odd).alias("odd"),
        )
        per_stretch = rows.groupBy("s", "k", "c", "home").agg(
            *[F.sum(f"a{i}").alias(f"a{i}") for i in range(kinds + 1)],
            *[F.sum(F.col(f"a{i}") * F.col("after")).alias(f"e{i}") for i in range(1, kinds + 1)],
            F.sum("odd").alias("odd"),
        )
        stretches = Window.partitionBy("s", "k", F.when(~timed, F.col("c"))).orderBy(F.desc("c"))
        beyond = F.coalesce(F.sum("a0").over(stretches.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per_stretch = per_stretch.select("s", "home", "odd", beyond.alias("beyond"), *[f"a{i}" for i in range(1, kinds + 1)], *[f"e{i}" for i in range(1, kinds + 1)])
        counted = per_stretch.select(
            "s", "home", "odd", S.as_flag(F.col("home").isNotNull()).alias("stays"),
            *[F.when(timed, F.col(f"e{i}") + F.col(f"a{i}") * F.col("beyond")).alias(f"e{i}") for i in range(1, kinds + 1)],
        )
        if self.home_rows:
            forms = [part.where("home is not null").withColumn("s", F.lit(self.home_space)) for part in self.home_rows]
            counted = union_all([counted, *forms], fill_missing=True)
        return self._timed_slots(counted, kinds)

    def _timed_slots(self, counted: DataFrame, kinds: int) -> DataFrame:
        names = ["odd", *(f"e{i}" for i in range(1, kinds + 1))]
        tallies = ["stays", *(f"f{i}" for i in range(self.home_forms if self.home_rows else 0))]
        per_home = counted.groupBy("s", "home").agg(*[F.sum(c).alias(c) for c in names], *[F.expr(f"coalesce(sum({c}), 0L)").alias(c) for c in tallies])
        sums = [F.sum(c).alias(c) for c in names]
        for i in range(len(tallies) - 1):
            known = F.col("home").isNotNull()
            sums.append(F.sum(S.as_flag(known & (F.col("stays") > 0) & (F.col(f"f{i}") == 0))).alias(f"h{2 * i}"))
            sums.append(F.sum(S.as_flag(known & (F.col("stays") == 0) & (F.col(f"f{i}") > 0))).alias(f"h{2 * i + 1}"))
        shown = [("u", "odd"), *((str(i - 1), f"e{i}") for i in range(1, kinds + 1)), *((f"h{i}", f"h{i}") for i in range(2 * (len(tallies) - 1)))]
        totals = per_home.groupBy("s").agg(*sums)
        listed = ", ".join(f"'{part}', `{c}`" for part, c in shown)
        rows = totals.selectExpr("s", f"stack({len(shown)}, {listed}) as (part, n)").where("n is not null")
        return rows.select(F.concat(F.lit("t"), F.col("s").cast("string"), F.lit(":"), F.col("part")).alias("slot"), "n")

    # -- the answer ----------------------------------------------------------------

    def _labels(self, spark: SparkSession) -> DataFrame:
        lines = []
        for e in self.entries:
            columns = f"array({', '.join(S.sql_text(c) for c in e.columns)})" if e.columns else "cast(array() as array<string>)"
            texts = ", ".join(S.sql_text(x) for x in (e.slot, e.check, e.table_a, e.table_b, e.metric))
            lines.append(f"({texts}, {columns})")
        return spark.sql(f"select * from values {', '.join(lines)} as t(slot, `check`, table_a, table_b, metric, columns)")

    def result(self) -> DataFrame:
        """check, table_a, table_b, metric, columns, applicable, n: one row per entry."""
        if not self.entries:
            raise ValueError("No check is meant for these tables")
        spark = next(iter(self.readings.values())).df.sparkSession
        parts = [p for p in (self._rows_and_keys(), self._persons_in_time()) if p is not None]
        labels = self._labels(spark).withColumn("applicable", F.col("slot").isNotNull())
        if not parts:
            return labels.select("check", "table_a", "table_b", "metric", "columns", "applicable", F.lit(None).cast("bigint").alias("n"))
        found = union_all(parts).groupBy(F.col("slot").alias("_slot")).agg(F.sum("n").alias("_n"))
        joined = labels.join(F.broadcast(found), F.col("slot") == F.col("_slot"), "left")  # at most one row per entry
        n = F.when(F.col("applicable"), F.coalesce("_n", F.lit(0).cast("bigint")))
        return joined.select("check", "table_a", "table_b", "metric", "columns", "applicable", n.alias("n"))


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (F.hour(moment) * 3600 + F.minute(moment) * 60).cast("bigint")
    return (days * 86400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("bigint")


def _by_space(cases: Sequence[tuple[set[int], str]]) -> str:
    """SQL that picks by space; null for the others."""
    picked = [f"when s in ({', '.join(map(str, sorted(spaces)))}) then {value}" for spaces, value in cases if spaces]
    return f"case {' '.join(picked)} end" if picked else "cast(null as bigint)"
