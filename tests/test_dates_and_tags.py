import datetime

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import dates, naming, tags


@pytest.mark.parametrize(
    ("raw", "days", "shifted"),
    [
        ("20230515", 10, "20230525"), ("20230515104822", 10, "20230525104822"), ("20230515.104822", 10, "20230525.104822"),
        ("20230515.104822.677000", 10, "20230525.104822.677000"), ("20230515.104822.677", 10, "20230525.104822.677"), ("2024-05-11", 10, "2024-05-21"),
        ("20200228", 1, "20200229"), ("2024-05-11 10:48:22", -1, "2024-05-10 10:48:22"), ("2024-05-11T10:48:22", 366, "2025-05-12T10:48:22"), (" 20230515 ", 1, "20230516"),
        ("", 10, None), (None, 10, None), ("NotADate", 10, None), ("20230231", 10, None), ("2023515", 10, None), ("2023-5-1", 10, None),
        ("20230515104822.677+0100", 10, "20230525104822.677+0100"), ("20230515104822-0500", 10, "20230525104822-0500"), ("202305151048", 10, "202305251048"), ("2023051510", 10, "2023052510"),
        ("202305", -40, "202303"), ("2023", -1, "2022"), ("20230101-20230131", 10, "20230111-20230210"), ("20230101-", 10, "20230111-"), ("-20230131", 10, "-20230210"),
        ("20230101-20230231", 10, None), ("202313", 1, None), ("2023051525", 1, None), ("2024-05-11T10:48:22.5+01:00", 1, "2024-05-12T10:48:22.5+01:00"),
    ],
)
def test_shift_text(spark, raw, days, shifted):
    row = spark.createDataFrame([(raw,)], "v string").select(dates.shift_text(F.col("v"), F.lit(days)).alias("s")).first()
    assert row.s == shifted


def test_shift_days_are_fixed_by_the_patient(spark):
    df = spark.createDataFrame([("P1",), ("P2",), ("P1",)], "p string").select(dates.shift_days(F.col("p")).alias("d"), dates.shift_days(F.col("p"), -10, -10).alias("c"), dates.shift_days(F.col("p"), 5, -5).alias("w"))
    rows = df.collect()
    assert rows[0] == rows[2] and all(-365 <= r.d <= -1 and r.c == -10 and -5 <= r.w <= 5 for r in rows)


def test_parse_date(spark):
    got = spark.createDataFrame([("20230101",), ("x",), (None,)], "v string").select(dates.parse_date(F.col("v")).alias("d")).collect()
    assert [r.d for r in got] == [datetime.date(2023, 1, 1), datetime.date(1900, 1, 1), datetime.date(1900, 1, 1)]


def test_private_tags(spark):
    rows = [("0011,1010", True), ("0010,0010", False), ("0099,0010", False), ("0099,1001", False), ("000B,0001", True), ("bad", False), ("zz11,0000", False)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", tags.is_private(F.col("t")).alias("p")).collect()
    assert [(r.t, r.p) for r in got] == rows


def test_names(spark):
    row = spark.range(1).select(
        naming.clean_filename(F.lit(" a b/c:d.e-é ")).alias("a"),
        naming.clean_label(F.lit("//")).alias("b"),
        naming.study_folder(F.lit("2025-01-01").cast("date"), F.lit("Chest CT"), F.lit("1.2.345678")).alias("c"),
        naming.numbered_file(F.lit(12345), F.lit("u")).alias("d"),
        naming.numbered_file(F.lit(None).cast("int"), F.lit("u")).alias("e"),
        naming.subject_folder(F.lit("")).alias("f"),
    ).first()
    assert tuple(row) == ("a_bcd.e-é", "Unknown", "Study_2025-01-01_Chest_CT_45678", "12345.dcm", "u.dcm", "Subject_UnknownPatient")
