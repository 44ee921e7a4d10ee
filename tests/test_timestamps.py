from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from paperloom.operators.timestamps import with_normal_form

SCHEMA = "id int, value string, zone string, locale string, form string"


def normal(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], SCHEMA)
    out = with_normal_form(df, "value", "zone", "locale", **options).orderBy("id").collect()
    assert all(r.form == "kept" for r in out)  # a column of a clashing name stays
    return [r.normal_form for r in out]


CASES = [
    (("2016-03-09", "UTC", "en-GB"), "2016-03-09"),
    (("20160813T081234Z", "UTC", "en-GB"), "2016-08-13T08:12:34Z"),
    (("2024-12-04T16:48:56.716261Z", "Asia/Tokyo", "en-GB"), "2024-12-04T16:48:56Z"),
    (("D:20120304165107", "Asia/Kolkata", "en-GB"), "2012-03-04T11:21:07Z"),
    (("D:20170321155651+09'00'", "UTC", "en-GB"), "2017-03-21T06:56:51Z"),
    (("D:20110419", "UTC", "en-GB"), "2011-04-19"),
    (("12/25/2008", "UTC", "en-US"), "2008-12-25"),
    (("12/25/2008", "UTC", "en-GB"), None),
    (("05/04/2010", "UTC", "en-US"), "2010-05-04"),
    (("05/04/2010", "UTC", "nb-NO"), "2010-04-05"),
    (("05.04.2010", "UTC", "en-US"), "2010-04-05"),
    (("30/10/2011 3:46:40 AM", "Europe/Oslo", "de-DE"), "2011-10-30T02:46:40Z"),
    (("12/10/2011 12:46:40 am", "UTC", "de-DE"), "2011-10-12T00:46:40Z"),
    (("14 February 2008, 21:49:45 AEDT", "Australia/Sydney", "en-GB"), "2008-02-14T10:49:45Z"),
    (("2 December 2011, 10:46:30 CST", "America/Chicago", "en-US"), "2011-12-02T16:46:30Z"),
    (("2 December 2011, 10:46:30 CST", "Asia/Shanghai", "en-GB"), "2011-12-02T02:46:30Z"),
    (("10 July 2014, 02:13:12 GMT", "Europe/London", "en-GB"), "2014-07-10T02:13:12Z"),
    (("Wed, 23 Oct 2024 16:19:29 +0530", "UTC", "en-GB"), "2024-10-23T10:49:29Z"),
    (("19/May/2015:23:02:45 +0530", "UTC", "en-GB"), "2015-05-19T17:32:45Z"),
    (("28th October 2018", "UTC", "en-GB"), "2018-10-28"),
    (("11 de septiembre de 2014", "UTC", "en-GB"), "2014-09-11"),
    (("29. Mai 2025", "UTC", "en-GB"), "2025-05-29"),
    (("Apr 2018", "UTC", "en-GB"), "2018-04"),
    (("09/2013", "UTC", "en-US"), "2013-09"),
    (("2019-01", "UTC", "en-US"), "2019-01"),
    (("2008", "UTC", "en-GB"), "2008"),
    (("1737195632", "Asia/Tokyo", "en-GB"), "2025-01-18T10:20:32Z"),
    (("1766251223621", "UTC", "en-GB"), "2025-12-20T17:20:23Z"),
    (("  2018-01-27T13:13:56+02:00 ", "UTC", "en-GB"), "2018-01-27T11:13:56Z"),
    (("2010-10-31 02:30:00", "Europe/Oslo", "en-GB"), "2010-10-31T00:30:00Z"),  # occurs twice: the earlier instant
]


@pytest.mark.parametrize("batch", [CASES])
def test_forms(spark, batch):
    assert normal(spark, [c[0] for c in batch]) == [c[1] for c in batch]


def test_placeholders_and_impossible(spark):
    bad = [None, "", "  ", "unknown", "n.d.", "D:", "--", "00/00/0000", "2019-13-05", "2020-02-30", "31.06.2018", "2017-00-00", "issue 3", "2020-01-01 25:00:00", "13/13/2020 1:00:00 PM", "1 Foo 2020", "x" * 5000]
    assert normal(spark, [(v, "UTC", "en-GB") for v in bad]) == [None] * len(bad)


def test_missing_zone_is_utc(spark):
    assert normal(spark, [("2020-01-01 00:00:00", None, None)]) == ["2020-01-01T00:00:00Z"]


def test_policies(spark):
    twice = [("2010-10-31 02:30:00", "Europe/Oslo", "en-GB")]
    assert normal(spark, twice, ambiguous="later") == ["2010-10-31T01:30:00Z"]
    gap = [("2010-03-28 02:30:00", "Europe/Oslo", "en-GB")]
    assert normal(spark, gap) == ["2010-03-28T01:30:00Z"]
    assert normal(spark, gap, nonexistent="null") == [None]
    with pytest.raises(ValueError):
        normal(spark, gap, ambiguous="sometimes")


def test_against_zoneinfo(spark):
    rows, want = [], []
    for name in ("Europe/Oslo", "America/New_York", "Australia/Sydney", "Asia/Kolkata"):
        for k in range(60):
            wall = datetime(2009, 1, 1, 1, 30) + timedelta(days=37 * k, hours=k)
            rows.append((wall.strftime("%Y-%m-%d %H:%M:%S"), name, "en-GB"))
            want.append(wall.replace(tzinfo=ZoneInfo(name)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    assert normal(spark, rows) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert with_normal_form(df, "value", "zone", "locale").select(F.count("*")).first()[0] == 0
