"""Frequencies, cross-tabs, correlations, samples, duplicates and generic consistency reports.

Hot values are harmless here: every report is a map-side combined aggregate, and the few
operators that return rows join on a small key list instead of opening a window per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.operators.skew import join_reference
from hearthcheck.plans import patterns as P
from hearthcheck.plans import roles as R
from hearthcheck.plans.catalog import TableSet


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"No such column: {', '.join(missing)}. Columns: {', '.join(df.columns)}")


def union_all(parts: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """Union by name, paired up level by level so that a long list stays a shallow plan.

    ``fill_missing`` lets the parts differ in columns; the absent ones are null.
    """

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b, allowMissingColumns=fill_missing)

    level = list(parts)
    while len(level) > 1:
        level = [reduce(pair, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


# ---------------------------------------------------------------------- counts


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value, missing included.

    The total is a scalar subquery over the counts, so no task ever sees all values.
    """
    require_columns(df, column)
    counts = df.groupBy(S.column(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("percent", F.bround(100 * F.col("n") / total, 1))


def frequency_sorted(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """The frequency table, most frequent first; ``top`` keeps the leading rows for display."""
    ordered = frequency(df, column).orderBy(F.desc("n"), F.asc_nulls_last(S.quoted(column)))
    return ordered.limit(top) if top else ordered


def group_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of rows of each combination of several columns, missing values kept."""
    require_columns(df, *columns)
    return df.groupBy(*[S.column(c).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, first: str, second: str, total: str = "Total") -> DataFrame:
    """Cells and margins of two columns in long form; rows missing either value are left out.

    Cells are counted first, so the four grouping sets expand counted cells and not rows.
    """
    require_columns(df, first, second)
    cells = (
        df.where(S.column(first).isNotNull() & S.column(second).isNotNull())
        .groupBy(S.column(first).cast("string").alias("row_value"), S.column(second).cast("string").alias("column_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        cells.cube("row_value", "column_value")
        .agg(F.sum("n").alias("n"), F.grouping("row_value").alias("gr"), F.grouping("column_value").alias("gc"))
        .select(
            F.when(F.col("gr") == 1, F.lit(total)).otherwise(F.col("row_value")).alias("row_value"),
            F.when(F.col("gc") == 1, F.lit(total)).otherwise(F.col("column_value")).alias("column_value"),
            ((F.col("gr") == 1) | (F.col("gc") == 1)).alias("is_margin"),
            "n",
        )
    )


def crosstab_wide(df: DataFrame, first: str, second: str, columns: Sequence[str], total: str = "Total") -> DataFrame:
    """The cross-tab with one column per listed value of ``second``."""
    cells = crosstab(df, first, second, total)
    return cells.groupBy("row_value").pivot("column_value", [*columns, total]).agg(F.first("n")).na.fill(0)


def largest_cell(df: DataFrame, first: str, second: str) -> DataFrame:
    """The most frequent combination of two columns; ties go to the lowest values."""
    require_columns(df, first, second)
    cells = (
        df.where(S.column(first).isNotNull() & S.column(second).isNotNull())
        .groupBy(S.column(first).cast("string").alias("row_value"), S.column(second).cast("string").alias("column_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = cells.agg(F.min(F.struct((-F.col("n")).alias("rank"), "row_value", "column_value", "n")).alias("best"))
    return best.select("best.row_value", "best.column_value", "best.n")


# ---------------------------------------------------------------------- correlation


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3, whole: bool = False
) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, over the rows where both are filled.

    One pass for all pairs. A column that does not vary has no correlation (null). ``whole`` adds the
    mirrored pairs and the diagonal, from the same pass.
    """
    numeric = R.numeric_columns(df)
    chosen = [c for c in (numeric if columns is None else columns) if c in numeric]
    if len(chosen) < 2:
        raise ValueError(f"Two numeric columns are needed (numeric: {', '.join(numeric)}).")
    value = {c: S.numeric(df, c) for c in chosen}
    moments: list[Column] = []
    pairs = [(a, b) for i, a in enumerate(chosen) for b in chosen[i + 1 :]]
    for k, (a, b) in enumerate(pairs):
        moments += [
            F.covar_pop(value[a], value[b]).alias(f"c{k}"),
            F.stddev_pop(F.when(value[b].isNotNull(), value[a])).alias(f"a{k}"),
            F.stddev_pop(F.when(value[a].isNotNull(), value[b])).alias(f"b{k}"),
        ]
    def cell(a: str, b: str, r: Column) -> Column:
        return F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), r.alias("r"))

    shares = [F.round(F.try_divide(F.col(f"c{k}"), F.col(f"a{k}") * F.col(f"b{k}")), digits) for k in range(len(pairs))]
    entries = [cell(a, b, r) for (a, b), r in zip(pairs, shares)]
    if whole:
        moments += [F.stddev_pop(value[c]).alias(f"v{i}") for i, c in enumerate(chosen)]
        entries += [cell(b, a, r) for (a, b), r in zip(pairs, shares)]
        entries += [cell(c, c, F.when(F.col(f"v{i}") > 0, F.lit(1.0))) for i, c in enumerate(chosen)]
    return df.agg(*moments).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """The full matrix in long form: both triangles and the diagonal."""
    return correlation_pairs(df, columns, digits, whole=True)


def strongest_correlation(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """The pair furthest from zero; ties go to the first names."""
    pairs = correlation_pairs(df, columns, digits).where(F.col("r").isNotNull())
    best = pairs.agg(F.min(F.struct((-F.abs("r")).alias("rank"), "column_a", "column_b", "r")).alias("best"))
    return best.select("best.column_a", "best.column_b", "best.r")


# ---------------------------------------------------------------------- samples


def sample_rows(
    df: DataFrame, n: int = P.SAMPLE_SIZE, seed: int = P.SAMPLE_SEED, keys: Sequence[str] | None = None
) -> DataFrame:
    """``n`` rows without replacement, the same ones whatever the partitioning.

    Rows are ordered by a digest of seed and key, and the first ``n`` are kept: each task
    keeps its own ``n`` best, so nothing is sorted as a whole.
    """
    ordering = list(keys) if keys else df.columns
    require_columns(df, *ordering)
    parts = [F.coalesce(S.column(c).cast("string"), F.lit("")) for c in ordering]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    ranked = df.withColumn("_digest", digest)
    return ranked.orderBy("_digest", *[S.column(c) for c in ordering]).limit(n).drop("_digest")


# ---------------------------------------------------------------------- quality of one table


def missing_rates(df: DataFrame, digits: int = 3) -> DataFrame:
    """Share of missing values of each column that has any, in one pass."""
    one_row = df.agg(*[F.avg(S.as_flag(S.column(c).isNull())).alias(f"m{i}") for i, c in enumerate(df.columns)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.bround(F.col(f"m{i}"), digits).alias("missing_rate"))
            for i, c in enumerate(df.columns)
        ]
    )
    return one_row.select(F.explode(entries).alias("e")).select("e.*").where(F.col("missing_rate") > 0)


def duplicated_rows(df: DataFrame, column: str | None = None) -> DataFrame:
    """Every copy of the rows sharing a filled identifier with another row.

    Counting first keeps a hot identifier to one row per task; the way back to the rows is a
    semi-join that salts hot identifiers.
    """
    if column is None:
        found = R.id_columns(df)
        if not found:
            raise ValueError("No identifier column found; name one.")
        column = found[0]
    require_columns(df, column)
    repeated = (
        df.where(S.column(column).isNotNull())
        .groupBy(S.column(column).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    return join_reference(df, S.column(column), repeated.select("_key"), "_key", "left_semi")


def _id_values(df: DataFrame, columns: Sequence[str], *extra: Column) -> DataFrame:
    """One row per row and identifier column: the column's name and its value as text."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), S.column(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(*extra, F.explode(cells).alias("cell")).select(
        *[F.col(c) for c in df.select(*extra).columns], "cell.column", "cell.value"
    )


def duplicate_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows involved in a duplicate, per identifier column, in one shuffle for all columns."""
    ids = list(columns) if columns is not None else R.id_columns(df)
    if not ids:
        raise ValueError("No identifier column found; name some.")
    require_columns(df, *ids)
    return (
        _id_values(df, ids)
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))).alias("n"))
    )


def implausible_date(df: DataFrame, column: str, as_of: str | None = None, earliest: str = P.EARLIEST_DATE) -> Column:
    """Missing, unreadable, later than the reference day, or before ``earliest``."""
    day = S.moment(df, column)
    limit = S.today(as_of).cast("timestamp_ntz")
    if as_of is None:
        limit = F.current_timestamp().cast("timestamp_ntz")
    return day.isNull() | (day > limit) | (day < F.lit(earliest).cast("timestamp_ntz"))


def implausible_dates(df: DataFrame, column: str, as_of: str | None = None) -> DataFrame:
    require_columns(df, column)
    return df.where(implausible_date(df, column, as_of))


def coherence_report(
    df: DataFrame,
    as_of: str | None = None,
    ids: Sequence[str] | None = None,
    dates: Sequence[str] | None = None,
) -> DataFrame:
    """Row count, duplicates per identifier, implausible dates per date column, missing rates.

    Long form (kind, column, value). Checked columns without a finding appear with 0, so what
    was examined is always visible. Columns are detected when not given; text columns are judged as
    dates by the report's own aggregate.
    """
    ids = R.id_columns(df) if ids is None else list(ids)
    texts = R.text_columns(df) if dates is None else []
    dates = [c for c in df.columns if c in (*R.typed_dates(df), *texts)] if dates is None else list(dates)
    one_row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(S.as_flag(implausible_date(df, c, as_of))).alias(f"d{i}") for i, c in enumerate(dates)],
        *[F.avg(S.as_flag(S.column(c).isNull())).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[R.parsed_share(c).alias(f"p{i}") for i, c in enumerate(dates) if c in texts],
    )

    def found(i: int, c: str) -> Column:
        value = F.coalesce(F.col(f"d{i}"), F.lit(0))
        return F.when(F.col(f"p{i}") > P.DATE_SHARE, value) if c in texts else value

    def entry(kind: str, column: str | None, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column"), value.cast("double").alias("value")
        )

    entries = [entry("rows", None, F.col("rows"))]
    entries += [entry("implausible_dates", c, found(i, c)) for i, c in enumerate(dates)]
    entries += [entry("missing_rate", c, F.bround(F.col(f"m{i}"), 3)) for i, c in enumerate(df.columns)]
    report = (
        one_row.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where(F.col("value").isNotNull() & ((F.col("kind") != "missing_rate") | (F.col("value") > 0)))
    )
    if not ids:
        return report
    duplicates = duplicate_counts(df, ids).select(
        F.lit("duplicates").alias("kind"), "column", F.col("n").cast("double").alias("value")
    )
    return report.unionByName(duplicates)


# ---------------------------------------------------------------------- every table at once


def on_every_table(tables: TableSet, names: Sequence[str], build) -> DataFrame:
    """One report over several tables; ``build(df)`` must give the same columns for each."""
    parts = [build(tables[n]).select(F.lit(n).alias("table"), "*") for n in names]
    if not parts:
        raise ValueError("No loaded table has the columns asked for.")
    return union_all(parts)


def frequency_everywhere(tables: TableSet, column: str) -> DataFrame:
    """The frequency of one column in every table that has it, values as text."""
    names = tables.tables_with_columns([column])

    def build(df: DataFrame) -> DataFrame:
        own = next(c for c in df.columns if c.lower() == column.lower())
        return frequency(df, own).select(S.column(own).cast("string").alias("value"), "n", "percent")

    return on_every_table(tables, names, build)


def crosstab_everywhere(tables: TableSet, first: str, second: str) -> DataFrame:
    return on_every_table(tables, tables.tables_with_columns([first, second]), lambda df: crosstab(df, first, second))


def correlation_everywhere(tables: TableSet, columns: Sequence[str]) -> DataFrame:
    names = [
        n for n in tables.tables_with_columns(columns) if len(set(columns) & set(R.numeric_columns(tables[n]))) >= 2
    ]
    return on_every_table(tables, names, lambda df: correlation_pairs(df, columns))


def group_counts_everywhere(tables: TableSet, columns: Sequence[str]) -> DataFrame:
    def build(df: DataFrame) -> DataFrame:
        return group_counts(df, columns).select(*[S.column(c).cast("string").alias(c) for c in columns], "n")

    return on_every_table(tables, tables.tables_with_columns(columns), build)


def duplicates_everywhere(tables: TableSet) -> DataFrame:
    names = [n for n in tables if R.id_columns(tables[n])]
    return on_every_table(tables, names, duplicate_counts)


def coherence_everywhere(tables: TableSet, as_of: str | None = None) -> DataFrame:
    return on_every_table(tables, list(tables), lambda df: coherence_report(df, as_of))


def samples_everywhere(tables: TableSet, n: int = P.SAMPLE_SIZE, seed: int = P.SAMPLE_SEED) -> DataFrame:
    """A sample of each table, rows as JSON since the tables differ in shape."""

    def build(df: DataFrame) -> DataFrame:
        picked = sample_rows(df, n, seed)
        return picked.select(F.to_json(F.struct(*[S.column(c) for c in df.columns])).alias("row"))

    return on_every_table(tables, list(tables), build)


def running_total(df: DataFrame, day: str, value: str) -> DataFrame:
    """Daily totals and their cumulative sum. Days are totalled first, so the ordered pass is
    over calendar days only."""
    from pyspark.sql import Window

    daily = df.groupBy(S.column(day).alias("day")).agg(F.sum(S.column(value)).alias("n"))
    ordered = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cumulative", F.sum("n").over(ordered))
