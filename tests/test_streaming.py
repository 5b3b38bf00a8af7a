"""Streaming totals by date: several micro-batches, restart from the
checkpoint, a new file updates only what it touches."""

import datetime as dt
import os

from epilens.session import staging_path
from epilens.streaming import case_file_stream, totals_from_rows, update_case_rows

HEADER = "Case_Type,Cases,Date,Combined_Key,Province_State,iso3,Population_Count\n"


def _write(folder, name, lines):
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, name), "w") as fh:
        fh.write(HEADER + "".join(line + "\n" for line in lines))


def _totals(spark, table):
    return {r["Date"]: r["Number_Of_Cases"] for r in totals_from_rows(spark, table).collect()}


def _run(spark, folder, table, ckpt):
    update_case_rows(case_file_stream(spark, folder, files_per_batch=1), table, ckpt)


def test_republished_history_replaces_and_restart_continues(spark):
    folder, table, ckpt = (staging_path(spark, f"t-stream-{x}") for x in ("src", "out", "ckpt"))
    day16 = ['Confirmed,5,04/16/2020,"A1, A",A1,AAA,100', "Deaths,1,04/16/2020,A1,A1,AAA,100"]
    day17 = ["Confirmed,9,04/17/2020,A1,A1,AAA,100", "Confirmed,7,04/17/2020,B,,BBB,300",
             "Confirmed,3,04/17/2020,X,,,300"]  # null iso3: dropped
    _write(folder, "day1.csv", day16)
    _run(spark, folder, table, ckpt)
    assert _totals(spark, table) == {dt.date(2020, 4, 16): 5}
    _write(folder, "day2.csv", day16 + day17)  # repeats 04-16
    _run(spark, folder, table, ckpt)
    assert _totals(spark, table) == {dt.date(2020, 4, 16): 5, dt.date(2020, 4, 17): 16}

    corrected = ["Confirmed,8,04/17/2020,A1,A1,AAA,100", "Confirmed,14,04/19/2020,A1,A1,AAA,100", "Confirmed,11,04/19/2020,B,,BBB,300"]
    _write(folder, "day3.csv", corrected)
    _write(folder, "day4.csv", day16)
    _run(spark, folder, table, ckpt)
    assert _totals(spark, table) == {dt.date(2020, 4, 16): 5, dt.date(2020, 4, 17): 15, dt.date(2020, 4, 19): 25}


def test_unfinished_version_is_not_read(spark):
    folder, table, ckpt = (staging_path(spark, f"t-stream2-{x}") for x in ("src", "out", "ckpt"))
    _write(folder, "day1.csv", ["Confirmed,5,04/16/2020,A1,A1,AAA,100"])
    _run(spark, folder, table, ckpt)
    local = table[len("file:"):] if table.startswith("file:") else table
    os.makedirs(f"{local}/v7")  # a batch that died while writing
    assert _totals(spark, table) == {dt.date(2020, 4, 16): 5}
