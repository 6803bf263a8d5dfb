import decimal

from pyspark.sql import functions as F

from tickloom.functions import text
from test_clock import column


def test_price_text(spark):
    prices = {
        135_420_000_000: "135.42",
        100_000_000_000: "100",
        1: "0.000000001",
        0: "0",
        -2_500_000_000: "-2.5",
        -1: "-0.000000001",
        -(2**63): "-9223372036.854776",
        999_999_999_999_999: "999999.999999999",
        # beyond 15 digits the float has lost some
        2**63 - 1: "9223372036.854776",
        10**16: "10000000",
        12_345_678_123_456_789: "12345678.123456787",
    }
    assert dict(zip(prices, column(spark, prices, "bigint", text.price_text))) == prices


def test_scale_price(spark):
    values = [1_500_000_000, text.UNDEFINED_PRICE, None]
    assert column(spark, values, "bigint", text.scale_price) == [1.5, 9223372036.854776, None]
    assert column(spark, values, "bigint", lambda c: text.scale_price(c, null_undefined=True)) == [1.5, None, None]
    assert column(spark, values[:1], "bigint", text.exact_price) == [decimal.Decimal("1.500000000")]


def test_ascii_code(spark):
    codes = [84, 33, 126, 32, 127, 0, -1, None]
    assert column(spark, codes, "int", text.ascii_code) == ["T", "!", "~", "_", "_", "_", "_", "_"]


def test_escape_tag(spark):
    assert column(spark, ["BF.B", "a b,c=d\\"], "string", text.escape_tag) == ["BF.B", r"a\ b\,c\=d" + "\\"]


def test_date_from_filename(spark):
    names = ["feed-20251113.mbo.parquet", "x123456789012.y", "99999999", "feed-2025-11-13", ""]
    expected = ["2025-11-13", "1234-56-78", "9999-99-99", None, None]
    assert column(spark, names, "string", text.date_from_filename) == expected


def test_slot_filename(spark):
    one = spark.range(1).select(
        text.slot_filename(F.lit("2025-10-22").cast("date"), F.lit("14-30")),
        text.slot_filename(F.lit("2025-10-22").cast("date"), F.lit("14-30"), F.lit("NVDA")),
    )
    assert tuple(one.first()) == ("mbo_2025-10-22_14-30.parquet", "mbo_NVDA_2025-10-22_14-30.parquet")


def test_clean_symbols(spark):
    lines = [" bf.b \r", "# note", "  #x", "", "\t", "AAPL"]
    assert column(spark, lines, "string", text.clean_symbols) == ["BF.B", None, None, None, None, "AAPL"]
