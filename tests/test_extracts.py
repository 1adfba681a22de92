"""Reading, cleaning and deduplicating extracts, with the traits real files have."""

import datetime as dt
import uuid

import pytest

from usage_ts.operators import cleaning
from usage_ts.plans import jobs
from usage_ts.sources import extracts
from usage_ts.sources.layout import Layout

HEADER_A = 'CONTRACT_ACCOUNT,EFFECTIVE_DATE,END_DATE,CONSUMPTION,RATE_CLASS,PARCEL_AREA,SERVICE_STATUS," ""STORM_CHARGE_EX""",METER_SIZE,EST_READ'
HEADER_B = "CONTRACT_ACCOUNT,EFFECTIVE_DATE,END_DATE,CONSUMPTION,RATE_CLASS,EST_READ"
D = dt.date


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("extracts")
    (d / "2020q1.csv").write_bytes(
        b"\xef\xbb\xbf"
        + "\n".join(
            [
                HEADER_A,
                "1,1/1/2020,1/10/2020,100,W&S_RESI,1.5,On,X,M1,3",
                "1,1/11/2020,1/20/2020,50,W&S_RESI,x,Discon, ,,",
                "2,1/1/2020,1/31/2020,31,W&S_COMM, ,On,,M2,",
                "4,bad,1/31/2020,7,W&S_COMM,1,On,,M2,",
                "5,1/9/2020,1/8/2020,7,W&S_COMM,1,On,,Caf\xe9,",
            ]
        ).encode("latin-1")
    )
    (d / "2020q2.csv").write_bytes(
        "\n".join([HEADER_B, "1,1/11/2020,1/20/2020,60,W&S_RESI,4", "3,2/1/2020,2/10/2020,n/a,W&S_RESI,"]).encode()
    )
    (d / "notes.txt").write_text("not an extract")
    return str(d)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_header_cells_are_cleaned():
    assert extracts.clean_name(' ""STORM_CHARGE_EX""') == "STORM_CHARGE_EX"
    assert extracts.clean_name("﻿INSTALLATION NUMBER") == "INSTALLATIONNUMBER"


def test_one_frame_per_header(spark, folder):
    paths = extracts.list_extracts(spark, folder)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["2020q1.csv", "2020q2.csv"]
    frames = extracts.read_extracts(spark, paths)
    assert len(frames) == 2
    assert "STORM_CHARGE_EX" in frames[0].columns and "CONTRACT_ACCOUNT" in frames[0].columns
    assert {r[0] for r in frames[1].select(extracts.SOURCE).distinct().collect()} == {"2020q2.csv"}


def jobs_of(spark, work):
    group = f"census-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "census")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_follow_layouts_not_files(spark, tmp_path):
    for i in range(160):
        head = ("a,b", "a,b,c")[i % 2]
        lines = "\n".join(f"{i},{j}" + ",x" * (i % 2) for j in range(i % 5 * 10))
        (tmp_path / f"f{i:03d}.csv").write_text(f"{head}\n{lines}")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    paths = extracts.list_extracts(spark, str(tmp_path))
    assert len(paths) == 161
    few, n_few = jobs_of(spark, lambda: extracts.read_extracts(spark, paths[:81]))
    many, n_many = jobs_of(spark, lambda: extracts.read_extracts(spark, paths))
    assert n_few == n_many and len(few) == len(many) == 2
    assert sum(f.count() for f in many) == sum(i % 5 * 10 for i in range(160))
    census = {bytes(r.line): r.files for r in extracts.header_census(spark, paths).collect()}
    assert census == {b"a,b": 80, b"a,b,c": 80}
    assert extracts.read_extracts(spark, []) == []


def test_first_lines_of_split_files(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n" + "0,0\n" * 2_000_000)
    (tmp_path / "short.csv").write_bytes(b"\r\na,c\r\n1,2\r\n")
    paths = extracts.list_extracts(spark, str(tmp_path))
    assert [h for h, _ in extracts.layouts_of(spark, paths)] == [["a", "b"], ["a", "c"]]


def test_broken_lines_are_counted(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b,c\n1,2,3\n1,2\n\n1,2,3,4\n,,\n')
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n3,4\n')
    (tmp_path / "r.csv").write_text("a,b,c\n")
    paths = extracts.list_extracts(spark, str(tmp_path))
    plain = {r[0]: (r.lines, r.broken) for r in extracts.line_counts(spark, paths).collect()}
    assert plain == {"p.csv": (4, 2), "q.csv": (3, 1)}
    quoted = {r[0]: (r.lines, r.broken) for r in extracts.line_counts(spark, paths, multiline=True).collect()}
    assert quoted == {"p.csv": (4, 2), "q.csv": (2, 0)}
    cells = [r.b for f in extracts.read_extracts(spark, paths, multiline=True) if "c" not in f.columns for r in f.collect()]
    assert cells == ["two\nlines", "4"]
    assert extracts.line_counts(spark, []).count() == 0


def test_records_are_clean_and_last_file_wins(spark, folder):
    r = jobs.load_records(spark, folder)
    assert set(r.columns) == set(Layout().columns)
    got = rows(r.filter("CONTRACT_ACCOUNT = '1'"), "EFFECTIVE_DATE", "CONSUMPTION", "METER_SIZE", "EST_READ", "STORM_CHARGE_EX")
    assert got == [(D(2020, 1, 1), 100.0, "M1", "3_", 1.0), (D(2020, 1, 11), 60.0, "Unknown", "4_", 0.0)]
    third = r.filter("CONTRACT_ACCOUNT = '3'").first()
    assert (third.CONSUMPTION, third.PARCEL_AREA, third.EST_READ, third.SERVICE_STATUS) == (0.0, 0.0, "nan_", 0.0)
    assert r.filter("CONTRACT_ACCOUNT = '4'").first().EFFECTIVE_DATE is None
    assert r.filter("CONTRACT_ACCOUNT = '5'").first().METER_SIZE == "Caf\xe9"


def test_class_filter_strict_and_compat(spark, folder):
    strict = jobs.load_records(spark, folder, rate_class="comm")
    assert {x[0] for x in rows(strict, "CONTRACT_ACCOUNT")} == {"2", "4", "5"}
    loose = jobs.load_records(spark, folder, rate_class="comm", compat=True)
    # The second file holds no such class and so contributes all its rows.
    assert {x[0] for x in rows(loose, "CONTRACT_ACCOUNT")} == {"1", "2", "3", "4", "5"}
    assert jobs.load_records(spark, folder, rate_class="all").count() == 6


def test_merge_keeps_every_column_and_recent_years(spark, folder):
    merged = jobs.merge_extracts(spark, folder, "2025-01-15")
    assert "METER_SIZE" in merged.columns and merged.filter("METER_SIZE is null").count() == 2
    assert min(x[0] for x in rows(merged, "END_DATE")) >= D(2020, 1, 15)
    assert jobs.merge_extracts(spark, folder, "2026-01-01").count() == 0


def test_quality_counters(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), D(2020, 1, 2), 5, 1), ("a", D(2020, 1, 1), D(2020, 1, 2), 6, 2), ("b", D(2020, 1, 3), D(2020, 1, 1), 1, 3)],
        "account string, start_d date, end_d date, consumption int, seq int",
    )
    q = cleaning.quality_counters(df, ["account", "start_d", "end_d"], ["seq"]).first()
    assert (q.rows_read, q.rows_kept, q.accounts, q.total_consumption, q.broken_intervals) == (3, 2, 2, 7.0, 1)


def test_codes_encode_and_decode(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "f string")
    codes = cleaning.ordinal_codes(df, ["f"])
    assert {(r.value, r.code) for r in codes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    coded = cleaning.encode(df, codes, "f", "code").drop("f")
    assert sorted(r.f for r in cleaning.decode(coded, codes, "f", "code").collect()) == ["a", "a", "b", "c"]


def test_daily_job_from_files(spark, folder, tmp_path):
    layout = Layout(start_trim=0, end_trim=0, missing_ranges=(("2020-01-05", "2020-01-06"),))
    t = jobs.build_daily(spark, folder, layout, raw_path=str(tmp_path / "raw"), out_path=str(tmp_path / "daily"))
    by_day = {r.d: r for r in t.collect()}
    assert D(2020, 1, 5) not in by_day and D(2020, 1, 4) in by_day
    # 100 over 10 days plus 31 over 31 days.
    assert float(by_day[D(2020, 1, 2)].consumption) == pytest.approx(11.0)
    assert by_day[D(2020, 1, 2)]["RATE_CLASS_W&S_RESI"] == pytest.approx(0.5)
    assert by_day[D(2020, 1, 2)].SERVICE_STATUS == 1.0
    assert max(by_day) == D(2020, 2, 9) and min(by_day) == D(2020, 1, 1)
    assert spark.read.parquet(str(tmp_path / "daily")).count() == len(by_day)


def test_all_classes_in_one_pass_equal_single_runs(spark, folder):
    layout = Layout(start_trim=0, end_trim=0, missing_ranges=())
    together = jobs.build_daily(spark, folder, layout, by=["RATE_CLASS"])
    for name in ("resi", "comm"):
        alone = jobs.build_daily(spark, folder, layout, rate_class=name)
        a = {(r.d, r.consumption, r.PARCEL_AREA_avg) for r in alone.collect()}
        b = {
            (r.d, r.consumption, r.PARCEL_AREA_avg)
            for r in together.filter(f"RATE_CLASS = 'W&S_{name.upper()}'").collect()
        }
        assert a == b
