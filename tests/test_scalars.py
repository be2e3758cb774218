"""Time functions give the same result whatever the session zone."""

import datetime as dt

from marketpulse.functions import scalars as sc


def test_times_do_not_depend_on_the_session_zone(spark):
    wall = [dt.datetime(2024, 3, 10, 2, 30, 0, 250000), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(1969, 12, 31, 23, 59, 59)]
    want = [(t - dt.datetime(1970, 1, 1)).total_seconds() for t in wall]
    df = spark.createDataFrame([(t, int(w), int(w * 1000)) for t, w in zip(wall, want, strict=True)], "t timestamp_ntz, s long, ms long")
    old = spark.conf.get("spark.sql.session.timeZone")
    got = []
    try:
        for zone in ("UTC", "Asia/Taipei"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(df.select(sc.to_epoch("t"), sc.to_epoch("t", "Asia/Taipei"), sc.epoch_to_local("s"),
                                 sc.millis_to_date("ms"), sc.millis_to_date("ms", "Asia/Taipei")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got[0] == got[1]
    assert [r[0] for r in got[0]] == want and [r[1] for r in got[0]] == [w - 8 * 3600 for w in want]
    assert [r[2] for r in got[0]] == ["2024-03-10 10:30:00", "2024-11-03 09:30:00", "1970-01-01 07:59:59"]
    assert [r[3] for r in got[0]] == ["2024-03-10", "2024-11-03", "1969-12-31"]
    assert [r[4] for r in got[0]] == ["2024-03-10", "2024-11-03", "1970-01-01"]


def test_quantize_keeps_values_beyond_the_stored_precision(spark):
    """Sums over a larger table have more digits than decimal(10,4): none is refused or lost."""
    from decimal import Decimal
    df = spark.createDataFrame([(2.00005,), (16000000.12345,), (-999999999999.5,), (None,)], "x double")
    got = [tuple(r) for r in df.select(sc.quantize_half_even("x", 4, 10), sc.quantize_half_even("x", 8, 20)).collect()]
    assert got == [(Decimal("2.0000"), Decimal("2.00005")), (Decimal("16000000.1234"), Decimal("16000000.12345")),
                   (Decimal("-999999999999.5"), Decimal("-999999999999.5")), (None, None)]
