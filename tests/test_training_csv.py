"""S-1: the training file's columns are found by name, and odd files have a defined result."""

import os

import pandas as pd
import pytest

from strideframe import schemas as S
from strideframe.sources import tables as TB

NAMES = [f.name for f in S.TRAINING_TEXT.fields]
ROW = "yoga,none,low,30,100.5,endurance"


def write(tmp_path, text, name="t.csv"):
    path = os.path.join(tmp_path, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def rows(spark, path, **kw):
    return sorted(map(tuple, TB.read_training(spark, path, **kw).collect()), key=repr)


@pytest.mark.parametrize("multiline", [True, False])
@pytest.mark.parametrize("header", [
    "goal,workout_type,equipment,intensity,duration_min,calories_burned",
    "id,goal,duration_min,extra.dotted,intensity,calories_burned,equipment,workout_type,more",
    ",workout_type,equipment,intensity,duration_min,calories_burned,goal",
    "﻿workout_type,a,a,equipment,intensity,duration_min,calories_burned,goal"])
def test_any_order_and_extra_columns_give_the_same_rows(spark, tmp_path, header, multiline):
    values = dict(zip(NAMES, ROW.split(",")))
    names = header.split(",")
    line = ",".join(values.get(n.removeprefix("﻿"), "7") for n in names)
    path = write(tmp_path, f"{header}\n{line}\n{line}\n")
    assert rows(spark, path, multiline=multiline) == [("yoga", "none", "low", 30.0, 100.5, "endurance")] * 2
    got = TB.read_training(spark, path, multiline=multiline)
    assert got.select("goal").first()[0] == "endurance" and got.count() == 2


@pytest.mark.parametrize("missing", NAMES)
def test_a_missing_column_is_named(spark, tmp_path, missing):
    path = write(tmp_path, ",".join(n for n in NAMES if n != missing) + "\n1,2,3,4,5\n")
    with pytest.raises(ValueError, match=f"'{missing}' is missing"):
        TB.read_training(spark, path)
    spark.createDataFrame([(1,)], "goal int").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="'workout_type' is missing"):
        TB.read_training(spark, str(tmp_path / "p"), fmt="parquet")


def test_a_column_named_twice_and_an_empty_file_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="'goal' stands in the header more than once"):
        TB.read_training(spark, write(tmp_path, ",".join(NAMES) + ",goal\n" + ROW + ",x\n"))
    with pytest.raises(ValueError, match="no header"):
        TB.read_training(spark, write(tmp_path, "", "empty.csv"))
    assert rows(spark, write(tmp_path, ",".join(NAMES) + "\n", "only.csv")) == []


def test_names_are_told_apart_by_case(spark, tmp_path):
    with pytest.raises(ValueError, match="'goal' is missing"):
        TB.read_training(spark, write(tmp_path, ",".join(NAMES[:-1]) + ",Goal\n" + ROW + "\n"))


def test_quotes_line_breaks_and_short_rows(spark, tmp_path):
    text = ("note,goal,workout_type,equipment,intensity,duration_min,calories_burned\n"
            '"a ""b"", c\nd",endurance,yoga,none,low,30,1\n'
            "x,endurance,yoga\n"
            'back\\slash,"g, h",yoga,none,low,,NA\n')
    path = write(tmp_path, text)
    want = pd.read_csv(path)[NAMES]
    want = sorted([tuple(None if x != x else x for x in r) for r in want.astype(object).itertuples(index=False)], key=repr)
    # pandas reads 'none' as a value too
    assert rows(spark, path) == want == sorted([
        ("yoga", "none", "low", 30.0, 1.0, "endurance"), ("yoga", None, None, None, None, "endurance"),
        ("yoga", "none", "low", None, None, "g, h")], key=repr)
    with pytest.raises(Exception, match="quoted line break"):
        rows(spark, path, multiline=False)


@pytest.mark.parametrize("multiline", [True, False])
def test_long_rows_fail_or_are_left(spark, tmp_path, multiline):
    head = ",".join(NAMES)
    path = write(tmp_path, f"{head}\n{ROW}\n{ROW},extra\n{ROW},\nyoga,none,low,30,100.5,,more\n")
    with pytest.raises(Exception, match="more cells than the header"):
        rows(spark, path, multiline=multiline)
    with pytest.raises(Exception, match="more cells than the header"):
        TB.read_training(spark, path, multiline=multiline).select("intensity").collect()
    assert len(rows(spark, path, long_rows="leave", multiline=multiline)) == 2
    assert sorted(r[0] for r in TB.long_training_rows(spark, path, multiline).collect()) == [
        f"yoga,none,low,30,100.5,,more", f"{ROW},extra"]


def test_a_file_with_another_header_fails(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder, ",".join(NAMES) + "\n" + f"{ROW}\n" * 3, "a.csv")
    write(folder, ",".join(NAMES) + "\n" + ROW + "\n", "b.csv")
    assert len(rows(spark, str(folder))) == 4
    write(folder, ",".join(reversed(NAMES)) + "\n" + ",".join(reversed(ROW.split(","))) + "\n", "c.csv")
    with pytest.raises(Exception, match="(?i)header"):
        rows(spark, str(folder))
