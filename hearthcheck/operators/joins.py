"""Joining, comparing and looking up tables on documented keys.

Counts of matches are computed as tagged unions grouped by key: one shuffle, combined on the
map side, so a key holding a large share of the rows costs one row per task. Operators that
return rows join to a reference with each key once, salting the hot keys (see ``skew``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S
from hearthcheck.operators.skew import join_reference
from hearthcheck.operators.stats import require_columns, union_all
from hearthcheck.plans import patterns as P
from hearthcheck.plans.catalog import TableSet

KEY = "_key"


def resolve_key(tables: TableSet, a: str, b: str, key: str | None = None) -> tuple[str, str]:
    """The key column of both tables: the one asked for, else the first documented shared one."""
    for name in (a, b):
        if name not in tables:
            raise ValueError(f"Table not loaded: {name}")
    if key is not None:
        if key not in tables[a].columns or key not in tables[b].columns:
            raise ValueError(f"'{key}' is not a column of both {a} and {b}.")
        return key, key
    shared = tables.shared_columns(a, b)
    best = tables.join_key(a, b)
    if best is None:
        why = f"shared but not documented: {', '.join(shared)}" if shared else "no shared column"
        raise ValueError(f"No documented key links {a} and {b} ({why}).")
    other = next(c for c in tables[b].columns if c.lower() == best.lower())
    return best, other


def _keyed(df: DataFrame, column: str, as_text: bool) -> DataFrame:
    return df.withColumn(KEY, S.key_column(df, column, as_text))


def _distinct_keys(df: DataFrame, column: str, as_text: bool) -> DataFrame:
    return df.select(S.key_column(df, column, as_text).alias(KEY)).distinct()


def _same(left: DataFrame, right: DataFrame, match_nulls: bool) -> Column:
    return left[KEY].eqNullSafe(right[KEY]) if match_nulls else left[KEY] == right[KEY]


def fuse(tables: TableSet, a: str, b: str, key: str | None = None, match_nulls: bool = False) -> DataFrame:
    """Inner join of two tables. Columns both have get the table's name as suffix.

    Rows without a key meet nothing unless ``match_nulls`` asks to pair each with each of the other
    table, which gives as many rows as the product of their numbers.

    Both inputs reach the join straight from their shuffle, so adaptive execution can split a
    hot key on either side.
    """
    key_a, key_b = resolve_key(tables, a, b, key)
    left, right = tables[a], tables[b]
    as_text = S.needs_text_key([(left, key_a), (right, key_b)])
    clash = (set(left.columns) & set(right.columns)) - {key_a}
    rename = {c: f"{c}_{a}" for c in left.columns if c in clash}
    left = _keyed(left, key_a, as_text).withColumnsRenamed(rename)
    right = _keyed(right, key_b, as_text).drop(key_b).withColumnsRenamed({c: f"{c}_{b}" for c in clash})
    return left.join(right, _same(left, right, match_nulls), "inner").drop(KEY)


def difference(tables: TableSet, a: str, b: str, key: str | None = None, match_nulls: bool = True) -> DataFrame:
    """Rows of ``a`` whose key ``b`` does not have."""
    return _filtered(tables, a, b, key, match_nulls, "left_anti")


def overlap(tables: TableSet, a: str, b: str, key: str | None = None, match_nulls: bool = True) -> DataFrame:
    """Rows of ``a`` whose key ``b`` has."""
    return _filtered(tables, a, b, key, match_nulls, "left_semi")


def _filtered(tables: TableSet, a: str, b: str, key: str | None, match_nulls: bool, how: str) -> DataFrame:
    key_a, key_b = resolve_key(tables, a, b, key)
    as_text = S.needs_text_key([(tables[a], key_a), (tables[b], key_b)])
    keys = _distinct_keys(tables[b], key_b, as_text)
    return join_reference(tables[a], S.key_column(tables[a], key_a, as_text), keys, KEY, how, match_nulls)


def fuse_and_publish(tables: TableSet, a: str, b: str, key: str | None = None) -> DataFrame:
    return tables.publish(f"fusion_{a}_{b}", fuse(tables, a, b, key))


def difference_and_publish(tables: TableSet, a: str, b: str, key: str | None = None) -> DataFrame:
    return tables.publish(f"difference_{a}_sans_{b}", difference(tables, a, b, key))


# ---------------------------------------------------------------------- set comparisons


def key_counts(sides: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per key and side: one column per side, 0 where the side lacks the key. Null keys group."""
    as_text = S.needs_text_key(list(sides.values()))
    tagged = [
        df.select(
            S.key_column(df, column, as_text).alias(KEY),
            *[F.lit(1 if side == other else 0).cast("bigint").alias(other) for other in sides],
        )
        for side, (df, column) in sides.items()
    ]
    return union_all(tagged).groupBy(KEY).agg(*[F.sum(side).alias(side) for side in sides])


def difference_counts(tables: TableSet, a: str, b: str, key: str | None = None) -> DataFrame:
    """Rows of each table without a partner in the other, both ways, in one shuffle."""
    key_a, key_b = resolve_key(tables, a, b, key)
    counts = key_counts({"a": (tables[a], key_a), "b": (tables[b], key_b)})
    totals = counts.agg(
        F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(F.lit(0))).alias("only_a"),
        F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(F.lit(0))).alias("only_b"),
    )
    ways = F.array(
        F.struct(F.lit(a).alias("in_table"), F.lit(b).alias("not_in_table"), F.col("only_a").alias("n")),
        F.struct(F.lit(b).alias("in_table"), F.lit(a).alias("not_in_table"), F.col("only_b").alias("n")),
    )
    return totals.select(F.explode(ways).alias("w")).select("w.*")


def overlap_count(tables: TableSet, a: str, b: str, key: str | None = None) -> DataFrame:
    """Number of rows of ``a`` whose key ``b`` has."""
    key_a, key_b = resolve_key(tables, a, b, key)
    counts = key_counts({"a": (tables[a], key_a), "b": (tables[b], key_b)})
    matched = counts.agg(F.sum(F.when(F.col("b") > 0, F.col("a")).otherwise(F.lit(0))).alias("n"))
    return matched.select(F.lit(a).alias("status_table"), F.lit(b).alias("target"), F.lit(key_a).alias("key"), "n")


def set_difference(
    left: tuple[DataFrame, str], right: tuple[DataFrame, str], cap: int | None = P.LIST_CAP
) -> DataFrame:
    """Distinct keys on one side only, with the side, sorted as text.

    ``cap`` limits the listing of each side for display (None lists all); the counts come from
    ``set_difference_counts``.
    """
    counts = key_counts({"l": left, "r": right}).where(F.col(KEY).isNotNull())
    one_sided = counts.where((F.col("l") == 0) | (F.col("r") == 0)).select(
        F.when(F.col("r") == 0, F.lit("left")).otherwise(F.lit("right")).alias("side"),
        F.col(KEY).cast("string").alias("key"),
    )
    if cap is None:
        return one_sided
    return union_all([one_sided.where(F.col("side") == s).orderBy("key").limit(cap) for s in ("left", "right")])


def set_difference_counts(left: tuple[DataFrame, str], right: tuple[DataFrame, str]) -> DataFrame:
    counts = key_counts({"l": left, "r": right}).where(F.col(KEY).isNotNull())
    return counts.agg(
        F.sum(S.as_flag(F.col("r") == 0)).alias("left_only"),
        F.sum(S.as_flag(F.col("l") == 0)).alias("right_only"),
        F.sum(S.as_flag((F.col("l") > 0) & (F.col("r") > 0))).alias("both"),
    )


def distinct_keys_in_both(left: tuple[DataFrame, str], right: tuple[DataFrame, str]) -> DataFrame:
    counts = key_counts({"l": left, "r": right})
    return counts.where(F.col(KEY).isNotNull() & (F.col("l") > 0) & (F.col("r") > 0)).select(
        F.col(KEY).alias("key")
    )


# ---------------------------------------------------------------------- lookups


def one_per_key(reference: DataFrame, key: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """One value per key: that of the first row in ``order`` (lowest value when no order is given).

    Rows without a value never hide a known one: a key has no value only if none of its rows has.
    """
    ranking = F.struct(*[S.column(c) for c in order], S.column(value).alias("_value"))
    return (
        reference.where(S.column(key).isNotNull() & S.column(value).isNotNull())
        .groupBy(S.column(key).alias("_lookup"))
        .agg(F.min(ranking).alias("_first"))
        .select("_lookup", F.col("_first._value").alias("_found"))
    )


def lookup(
    df: DataFrame,
    key: str,
    reference: DataFrame,
    reference_key: str,
    value: str,
    alias: str,
    default: str | None = P.NOT_GIVEN,
    order: Sequence[str] = (),
) -> DataFrame:
    """Add one column found in a reference table by key, with a default text where there is none."""
    require_columns(df, key)
    as_text = S.needs_text_key([(df, key), (reference, reference_key)])
    keyed = reference.withColumn("_ref", S.key_column(reference, reference_key, as_text))
    if as_text:
        keyed = keyed.withColumn("_ref", F.trim("_ref"))
    found = one_per_key(keyed, "_ref", value, order)
    own = S.key_column(df, key, as_text)
    joined = join_reference(df, F.trim(own) if as_text else own, found, "_lookup", "left")
    result = F.col("_found") if default is None else F.coalesce(F.col("_found").cast("string"), F.lit(default))
    return joined.withColumn(alias, result).drop("_found")
