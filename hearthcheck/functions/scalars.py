"""Column expressions shared by the operators: parsing, codes, keys, ages, phones, text folding.

Everything here is a built-in expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "yes".
YES_CODES = ["1", "1.0", "oui", "yes", "true"]

# Every letter of the Latin blocks that is a plain letter with marks, and that plain letter.
_MARKED = {
    chr(x): unicodedata.normalize("NFD", chr(x))[0]
    for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if unicodedata.normalize("NFD", chr(x))[0].isascii()
}
ACCENTED, UNACCENTED = "".join(_MARKED), "".join(_MARKED.values())

DAYS_PER_YEAR = 365.25

ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
SLASH_DATE = r"^\s*\d{1,2}/\d{1,2}/\d{4}"
DASH_DATE = r"^\s*\d{1,2}-\d{1,2}-\d{4}"
# Other shapes and how they are read; each text has one shape at most. A fraction of a second is cut off first.
SHORT_YEAR = r"^\d{1,2}/\d{1,2}/\d{2}( |$)"
LAST_SHORT_YEAR = 2068  # two digits up to 68 are of this century, the others of the last one
OTHER_DATES = (
    (r"^\d{4}/\d{1,2}/\d{1,2}( |$)", "yyyy/M/d[ H:mm[:ss]]"),
    (r"^\d{1,2}[.]\d{1,2}[.]\d{4}( |$)", "d.M.yyyy[ H:mm[:ss]]"),
    (r"^(19|20)\d{6}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}( |$)", "d MMM yyyy[ H:mm[:ss]]"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}( |$)", "d MMMM yyyy[ H:mm[:ss]]"),
)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def text_to_double(t: Column) -> Column:
    """Text as double or null; a trailing type letter (``1f``, ``2d``) is not a number here."""
    return F.when(~t.rlike(r"[dDfF]\s*$"), t.try_cast("double"))


def as_number(c: Column) -> Column:
    """A number written with a point or a comma; null when it is neither."""
    return text_to_double(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")))


def numeric(df: DataFrame, name: str) -> Column:
    """The column as double: numbers pass straight through, text is coerced, the rest is null."""
    dtype = field_type(df, name)
    if isinstance(dtype, T.NumericType):
        return F.col(quoted(name)).cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.col(quoted(name)).cast("int").cast("double")
    return text_to_double(F.col(quoted(name)).cast("string"))


def quoted(name: str) -> str:
    """A column name that survives dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str | None) -> str:
    """A SQL string literal, or a typed null."""
    if value is None:
        return "cast(null as string)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def column(name: str) -> Column:
    return F.col(quoted(name))


def plain_text(c: Column) -> Column:
    """Lower-cased, trimmed text of any value."""
    return F.lower(F.trim(c.cast("string")))


def code_text(c: Column) -> Column:
    """Text of a code, without the ``.0`` that a gappy integer column picks up."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def is_code(c: Column, *codes: str) -> Column:
    return F.coalesce(code_text(c).isin(*codes), F.lit(False))


def is_yes(c: Column) -> Column:
    return F.coalesce(plain_text(c).isin(*YES_CODES), F.lit(False))


def is_filled_not_yes(c: Column) -> Column:
    return c.isNotNull() & ~is_yes(c)


def sql_exact_text(df: DataFrame, name: str) -> str:
    """SQL for the text of a value, whole numbers without decimals or exponent however they are stored."""
    dtype, c = field_type(df, name), quoted(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        whole = f"cast(cast({c} as decimal(38, 0)) as string)"
        return f"case when {c} = floor({c}) then {whole} else cast({c} as string) end"
    if is_text(dtype):
        return f"regexp_replace({c}, '[.]0$', '')"
    return f"cast({c} as string)"


def exact_text(df: DataFrame, name: str) -> Column:
    return F.expr(sql_exact_text(df, name))


def key_column(df: DataFrame, name: str, as_text: bool) -> Column:
    """A join key. Integers stay integers unless the other side needs text."""
    return exact_text(df, name) if as_text else column(name).cast("bigint")


def integral(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.IntegralType)


def writes_integer(text: str) -> bool:
    """Is the text how an integer column shows a value? ``007`` is not: text is compared, not amounts."""
    return bool(re.fullmatch(r"-?\d{1,18}", text)) and str(int(text)) == text


def needs_text_key(sides: Sequence[tuple[DataFrame, str]]) -> bool:
    return not all(integral(df, name) for df, name in sides)


def parse_moment(text: Column) -> Column:
    """Day-first text, then ISO text, then the shapes of ``OTHER_DATES``, to a timestamp without zone.

    Null when none fits: month names in other languages than English, years of fewer digits than shown,
    month-first dates and times with a zone or of 12 hours behind a day-first date stay unread. Two-digit
    years lie between 1969 and 2068. The shape is tested before parsing so that no exception is raised and
    swallowed per row.
    """
    t = F.regexp_replace(F.trim(text), r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4} +\d{1,2}:\d{2}:\d{2})[.]\d+$", "$1")
    day_first = F.coalesce(
        F.when(t.rlike(SLASH_DATE), F.try_to_timestamp(t, F.lit("d/M/yyyy[ H:mm[:ss]]"))),
        F.when(t.rlike(DASH_DATE), F.try_to_timestamp(t, F.lit("d-M-yyyy[ H:mm[:ss]]"))),
    )
    iso = F.when(t.rlike(ISO_DATE), t.try_cast("timestamp_ntz"))
    others = [F.when(t.rlike(shape), F.try_to_timestamp(F.initcap(t), F.lit(how))) for shape, how in OTHER_DATES]
    short = F.when(t.rlike(SHORT_YEAR), F.try_to_timestamp(t, F.lit("d/M/yy[ H:mm[:ss]]"))).cast("timestamp_ntz")
    short = F.when(F.year(short) > LAST_SHORT_YEAR, short - F.make_ym_interval(F.lit(100))).otherwise(short)
    return F.coalesce(day_first.cast("timestamp_ntz"), iso, short, F.coalesce(*others).cast("timestamp_ntz"))


def moment(df: DataFrame, name: str) -> Column:
    """The column as a timestamp without zone; dates and timestamps are taken as they are."""
    dtype = field_type(df, name)
    if isinstance(dtype, T.TimestampNTZType):
        return column(name)
    if is_temporal(dtype):
        return column(name).cast("timestamp_ntz")
    if is_text(dtype):
        return parse_moment(column(name))
    return F.lit(None).cast("timestamp_ntz")


def clock(df: DataFrame, name: str) -> Column:
    """Like ``moment`` but also accepts a bare time of day such as ``07:35``."""
    if not is_text(field_type(df, name)):
        return moment(df, name)
    t = F.trim(column(name))
    bare = F.when(t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.try_to_timestamp(t, F.lit("H:mm[:ss]")))
    return F.coalesce(parse_moment(t), bare.cast("timestamp_ntz"))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date")) / F.lit(DAYS_PER_YEAR)


def age_years(birth: Column, as_of: Column) -> Column:
    return years_between(birth, as_of)


def today(as_of: str | None) -> Column:
    """The reference day: an ISO date for repeatable runs, else the current date."""
    return F.lit(as_of).cast("date") if as_of else F.current_date()


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end) / F.lit(60.0)


def phone_is_invalid(c: Column) -> Column:
    """Any non-blank part between slashes that is not exactly eight digits."""
    parts = F.split(code_text(c), "/")
    bad = F.exists(parts, lambda p: (F.trim(p) != "") & ~F.trim(p).rlike("^[0-9]{8}$"))
    return F.coalesce(bad, F.lit(False))


def fold_accents(c: Column) -> Column:
    """Letters without their diacritics, combining marks removed."""
    return F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), r"\p{Mn}", "")


def folded(c: Column) -> Column:
    return fold_accents(F.lower(c))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def as_flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0)).cast("bigint")
