"""Quoted line breaks in split files: rows and ordinals like the engine's one-task reader."""

import random

import pytest

from siftrank.sources.readers import with_ordinals
from siftrank.sources.split_csv import header_names, read_csv_splits

NAMES = ["molecule_id", "smiles", "note"]


def write(path, seed, rows, end="\n"):
    rng = random.Random(seed)
    cells = ["plain", "", "a,b", 'say ""hi""', "two\nlines", "é\n\n,x", " spaced ", "x" * 40, '""', "\n"]
    lines = [",".join(NAMES)]
    for i in range(rows):
        picked = [rng.choice(cells) for _ in range(2)]
        quoted = [f'"{c}"' if any(x in c for x in ',\n"') or rng.random() < 0.3 else c for c in picked]
        lines.append(",".join([f"m{i}", *quoted]))
        if rng.random() < 0.1:
            lines.append("")
    path.write_bytes((end.join(lines) + (end if seed % 2 else "")).encode())
    return str(path)


def one_task(spark, path):
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
    return with_ordinals(raw, NAMES)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def compare(spark, path):
    got = [tuple(r) for r in read_csv_splits(spark, path).collect()]
    want = [(r.molecule_id, r.smiles, r.note, r.ord) for r in one_task(spark, path).collect()]
    assert sorted(got, key=lambda r: r[3]) == sorted(want, key=lambda r: r[3])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_task(spark, tmp_path, small_splits, seed):
    path = write(tmp_path / "a.csv", seed, 120)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    compare(spark, path)


def test_several_files(spark, tmp_path, small_splits):
    for i in range(4):
        write(tmp_path / f"f{i}.csv", i, 30)
    compare(spark, f"{tmp_path}/*.csv")


def test_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(["line, with \"\"quotes\"\""] * 80)
    (tmp_path / "a.csv").write_text(f'molecule_id,smiles,note\nA,"{long}",n\nB,x,"{long}"\n\nC,y,z')
    compare(spark, str(tmp_path / "a.csv"))


def test_windows_line_ends_bom_and_quoted_header(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes("﻿\"molecule_id\",smiles,note\r\nA,\"x\r\ny\",1\r\n\r\nB,\"\",2\r\n".encode())
    got = [tuple(r) for r in read_csv_splits(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()]
    assert [r[0] for r in got] == ["A", "B"] and got[0][1] == "x\ny" and [r[3] for r in got] == [1, 2]


def test_headers():
    assert header_names(["a,b\r", "﻿a,\"b\""]) == ["a", "b"] and header_names([]) == []
    with pytest.raises(ValueError, match="(?i)header"):
        header_names(["a,b", "b,a"])
