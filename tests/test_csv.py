"""Quoted CSV cut into stretches, against the reader that takes a file as one task."""

import csv
import random

import pytest

from parlance.schema import CSV_COLUMNS
from parlance.sources.turns import latest_turns, read_turns_csv, read_turns_csv_split
from tests.helpers import plan_of, rows_of

PARTS = ('"', '""', "\n", "\n\n", ",", "é", "word", " ", "x" * 40)


def write(path, n, seed, end="\n", inner=PARTS):
    rng = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(CSV_COLUMNS)
        for i in range(n):
            text = "a" + "".join(rng.choice(inner) for _ in range(rng.randrange(12))) + "b"
            out.writerow([f"c{seed}", i, "2025-08-01T10:00:00", "agent", text, "", "Bo"])


@pytest.mark.parametrize("size", [37, 64, 301, 1 << 20])
def test_breaks_and_quotes_at_every_edge(spark, tmp_path, size):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", 40, 1)
    write(tmp_path / "in" / "b.csv", 25, 2, end="\r\n")
    path = str(tmp_path / "in")
    plain, split = read_turns_csv(spark, path), read_turns_csv_split(spark, path, size)
    assert split.drop("row_order").schema == plain.drop("row_order").schema
    assert rows_of(split.drop("row_order")) == rows_of(plain.drop("row_order"))
    ordered = split.where("conv_id = 'c1'").orderBy("row_order").collect()
    assert [r["turn_index"] for r in ordered] == list(range(40))
    assert rows_of(latest_turns(split, "row_order").select("text_raw")) == rows_of(plain.select("text_raw"))


def test_a_field_longer_than_many_stretches(spark, tmp_path):
    text = 'say "x",\n' * 200
    with open(tmp_path / "a.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerows([CSV_COLUMNS, ["c", 0, "", "agent", text, "", ""], ["c", 1, "", "agent", "z", "", ""]])
    found = read_turns_csv_split(spark, str(tmp_path / "a.csv"), 100)
    assert rows_of(found.select("turn_index", "text_raw")) == [(0, text), (1, "z")]


@pytest.mark.parametrize("line, error", [
    ('c,0,,agent,"open,,', "open at the end"),
    ('c,0,,agent,5" pipe,,\nc,1,,agent,6" pipe,,', "not quoted"),
])
def test_broken_quotes_raise(spark, tmp_path, line, error):
    (tmp_path / "a.csv").write_text(",".join(CSV_COLUMNS) + "\n" + line + "\n")
    with pytest.raises(Exception, match=error):
        read_turns_csv_split(spark, str(tmp_path / "a.csv")).collect()


def test_lines_are_not_shuffled(spark, tmp_path):
    write(tmp_path / "a.csv", 5, 3)
    plan = plan_of(read_turns_csv_split(spark, str(tmp_path / "a.csv")))
    assert "BroadcastHashJoin RightOuter BuildLeft" in plan and "SortMergeJoin" not in plan
