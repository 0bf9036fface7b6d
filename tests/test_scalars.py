import datetime

import pytest
from pyspark.sql import functions as F

from hearthcheck.functions import scalars as S


def value(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("03/04/2020", datetime.datetime(2020, 4, 3)),
        ("3/4/2020 5:06", datetime.datetime(2020, 4, 3, 5, 6)),
        ("03-04-2020", datetime.datetime(2020, 4, 3)),
        ("2020-02-01", datetime.datetime(2020, 2, 1)),
        ("2020-02-01 10:20:30", datetime.datetime(2020, 2, 1, 10, 20, 30)),
        ("2020-02-01T10:20:30", datetime.datetime(2020, 2, 1, 10, 20, 30)),
        ("31/02/2020", None),
        ("not a date", None),
        ("", None),
    ],
)
def test_dates_are_day_first_and_iso_stays_iso(make, text, expected):
    assert value(make("d string", (text,)), S.parse_moment(F.col("d"))) == [expected]


def test_numbers_accept_a_comma_and_refuse_type_letters(make):
    df = make("x string", ("12,5",), (" 7 ",), ("1f",), ("a",), (None,))
    assert value(df, S.as_number(F.col("x"))) == [12.5, 7.0, None, None, None]


def test_yes_codes(make):
    df = make("x string", ("Oui ",), ("1.0",), ("TRUE",), ("non",), (None,))
    assert value(df, S.is_yes(F.col("x"))) == [True, True, True, False, False]
    assert value(df, S.is_filled_not_yes(F.col("x"))) == [False, False, False, True, False]


def test_keys_written_as_decimals_stay_whole(make):
    df = make("k double", (12345678.0,), (1.0,), (1.5,), (None,))
    assert value(df, S.exact_text(df, "k")) == ["12345678", "1", "1.5", None]


def test_phone_parts(make):
    df = make("p string", ("70123456",), ("701234",), ("70123456/70654321",), ("70123456/",), (None,), ("7012345a",))
    assert value(df, S.phone_is_invalid(F.col("p"))) == [False, True, False, False, False, True]


def test_phone_stored_as_a_decimal(make):
    df = make("p double", (70123456.0,), (701234.0,))
    assert value(df, S.phone_is_invalid(S.exact_text(df, "p"))) == [False, True]


def test_times_of_day(make):
    df = make("a string, b string", ("07:35", "07:37"), ("08:00", "07:00"), ("x", "07:00"))
    assert value(df, S.minutes_between(S.clock(df, "a"), S.clock(df, "b"))) == [2.0, -60.0, None]


def test_accents_fold(make):
    df = make("t string", ("Décès À Noël ÇŒ",), ("é",))
    assert value(df, S.folded(F.col("t"))) == ["deces a noel cœ", "e"]


def test_age_uses_the_mean_year(make):
    df = make("b string", ("2000-01-01",))
    assert round(value(df, S.age_years(S.parse_moment(F.col("b")), S.today("2005-01-01")))[0], 6) == round(1827 / 365.25, 6)
