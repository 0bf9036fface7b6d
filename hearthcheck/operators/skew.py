"""Joining rows to a keyed reference when one key may hold a large share of the rows.

Adaptive execution splits a skewed side by itself, while the rows lie in the shuffle, but only where both inputs come
straight from a shuffle made for the join. A reference with one row per key is an aggregate already dealt by key, which
rules that out. So the join asks for one more column, computed from the key and the same for equal keys: the reference is
dealt once more by both (narrow rows, one per key), and a hot key of the other side is then cut into as many tasks as
its bytes are worth, each with a copy of its reference partition. Nothing is counted beforehand and every input is read
once.

``member_bits`` is a Bloom filter of a set of keys, for dropping rows before they are shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_WORDS = 1 << 14  # 64 bits each: 128 KB, about 1 % wrong hits at 100 000 keys
FILTER_PROBES = 3


def join_reference(
    left: DataFrame,
    left_key: Column,
    reference: DataFrame,
    reference_key: str,
    how: str,
    match_nulls: bool = False,
) -> DataFrame:
    """Left, inner, semi or anti join to a reference that has each key once."""
    keyed = left.withColumn("_k", left_key).withColumn("_s", _same_for_equal("_k"))
    renamed = reference.withColumnRenamed(reference_key, "_rk").withColumn("_rs", _same_for_equal("_rk"))
    same = F.col("_k").eqNullSafe(F.col("_rk")) if match_nulls else F.col("_k") == F.col("_rk")
    return keyed.join(renamed, same & (F.col("_s") == F.col("_rs")), how).drop("_k", "_rk", "_s", "_rs")


def _same_for_equal(key: str) -> Column:
    """Always 0, in a way the planner does not see through."""
    return F.pmod(F.xxhash64(key), F.lit(1))


def _probes(value: str, words: int) -> list[tuple[str, str]]:
    """Word and bit of each probe of a key, as SQL."""
    hashes = [f"xxhash64({value}, {probe})" for probe in range(FILTER_PROBES)]
    return [(f"cast(pmod({h}, {words}) as int)", f"cast(shiftrightunsigned({h}, 58) as int)") for h in hashes]


def member_bits(keys: DataFrame, key: str, words: int = FILTER_WORDS) -> Column:
    """The Bloom filter of a set of keys: an array of ``words`` numbers, computed once by the query that uses it.

    With many more keys than it is made for it lets more pass, so an exact test has to follow.
    """
    probes = ", ".join(f"named_struct('word', {word}, 'bit', {bit})" for word, bit in _probes(f"`{key}`", words))
    set_bits = keys.selectExpr(f"inline(array({probes}))").selectExpr("word", "shiftleft(1L, bit) as bits")
    empty = keys.sparkSession.range(words).selectExpr("cast(id as int) as word", "0L as bits")
    held = set_bits.unionByName(empty).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    listed = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return held.agg(listed.alias("l")).select(F.col("l.bits").alias("bits")).scalar()


def may_be_member(value: str, bits: str, words: int = FILTER_WORDS) -> str:
    """SQL: may this value be among the keys whose filter is in column ``bits``? Never false for one that is."""
    return " and ".join(f"getbit(get({bits}, {word}), {bit}) = 1" for word, bit in _probes(value, words))
