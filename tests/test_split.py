"""Files read by many tasks give the rows that Spark's whole-file readers give."""

from __future__ import annotations

import csv
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echoloom.sources import split

TEXTS = [
    'quote " and, comma', "line\nbreak", "emoji 🙂 ’", "back\\slash", "", "  spaced  ", '"', '""\n""', "\n\n", "}{][,:", '"}', '\\"}{', "a}\n{b",
    'deep "records": [ {', "tab\tend\\",
]
CSV_SCHEMA = "id int, text string, note string"
JSON_SCHEMA = "id int, text string, tags array<string>, inner struct<a:string,b:array<struct<c:string>>>"


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Text files are read in splits of 512 bytes, so that values and records cross several of them."""
    read = split._pieces

    def pieces(*args):
        keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "1"}
        before = {key: spark.conf.get(key) for key in keys}
        try:
            for key, value in keys.items():
                spark.conf.set(key, value)
            return read(*args)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)

    monkeypatch.setattr(split, "_pieces", pieces)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def values(seed, n=60):
    draw = random.Random(seed)
    return [(i, "".join(draw.choices(TEXTS, k=draw.randint(0, 4))), draw.choice(TEXTS) * draw.choice([1] * 9 + [60])) for i in range(n)]


def write_csv(path, rows, quoting, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, quoting=quoting, lineterminator=end)
        writer.writerow(["id", "text", "note"])
        writer.writerows(rows)


@pytest.mark.parametrize("quoting,end", [(csv.QUOTE_ALL, "\n"), (csv.QUOTE_MINIMAL, "\n"), (csv.QUOTE_ALL, "\r\n")])
def test_csv_over_many_splits(spark, small_splits, tmp_path, quoting, end):
    written = [r for seed in (1, 2) for r in values(seed)]
    for seed in (1, 2):
        write_csv(tmp_path / f"{seed}.csv", values(seed), quoting, end)
    schema = spark.createDataFrame([], CSV_SCHEMA).schema
    read = split.read_csv(spark, str(tmp_path), schema, nullValue="", emptyValue="")
    assert sorted((r.id, r.text or "", r.note or "") for r in read.collect()) == sorted(written)
    places = split.csv_records(spark, str(tmp_path)).select("_file", "_block").distinct().count()
    assert places > 10
    if end == "\n":
        whole = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', nullValue="", emptyValue="").csv(str(tmp_path))
        assert rows_of(read) == rows_of(whole)


def test_csv_edges(spark, tmp_path):
    schema = spark.createDataFrame([], CSV_SCHEMA).schema
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "empty.csv").write_text("")
    (tmp_path / "a" / "header.csv").write_text("id,text,note")
    (tmp_path / "a" / "marked.csv").write_text('﻿id,text,note\r\n\r\n1,"x\r\ny",\r\n2,short\n\nbad,z,w\n', newline="")
    got = {(r.id, r.text, r.note) for r in split.read_csv(spark, str(tmp_path / "a"), schema).collect()}
    assert {(2, "short", None), (None, "z", "w")} <= got and len(got) == 3
    for name, text in [("open", 'id,text,note\n1,"x,y\n'), ("names", "id,note,text\n1,x,y\n"), ("blank", "\nid,text,note\n")]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(text)
        with pytest.raises(ValueError, match="f.csv"):
            split.read_csv(spark, str(tmp_path / name), schema)


def records(seed, n=40):
    draw = random.Random(seed)
    return [
        {"id": i, "text": text, "tags": draw.choices(TEXTS, k=draw.randint(0, 3)),
         "inner": draw.choice([None, {"a": note, "b": [{"c": t} for t in draw.choices(TEXTS, k=draw.randint(0, 3))]}])}
        for i, text, note in values(seed, n)
    ]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("wrapped", [True, False])
def test_json_over_many_splits(spark, small_splits, tmp_path, indent, wrapped):
    for seed in (3, 4):
        table = records(seed)
        extra = {"total": len(table), "about": {"note": 'see "records": [{', "more": {"x": {"y": 1}}}, "days": ["a}", "b"]}
        document = extra | {"records": table, "after": {"k": {"l": 1}}} if wrapped else table
        (tmp_path / f"{seed}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=seed == 3), encoding="utf-8")
    schema = spark.createDataFrame([], JSON_SCHEMA).schema
    read = split.read_records(spark, str(tmp_path), schema)
    whole = spark.createDataFrame([json.dumps(r) for s in (3, 4) for r in records(s)], "string").select(F.from_json("value", schema).alias("r")).select("r.*")
    assert rows_of(read) == rows_of(whole) and read.count() == 80


def test_json_edges(spark, tmp_path):
    schema = spark.createDataFrame([], "id int").schema

    def ids(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text)
        return sorted(r.id for r in split.read_records(spark, str(tmp_path / name), schema).collect())

    assert ids("none", "") == ids("blank", " \n") == ids("array", "[]\n") == ids("wrapper", '{"records": []}') == []
    assert ids("several", '{"records": [{"id": 1}, {"id": 2}]}\n{"records": [{"id": 3}]}\n') == [1, 2, 3]
    assert ids("arrays", '[{"id": 1}]\n[{"id": 2}, {"id": 3}]') == [1, 2, 3]
    assert ids("others", '[1, null, {"id": 1}, 2.5, {"id": 2}]') == [1, 2]
    assert ids("long", "[" + ",".join(json.dumps({"id": i, "t": "}" * 50}) for i in range(300)) + "]") == list(range(300))
    with pytest.raises(ValueError, match="f.json"):
        ids("cut", '[{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="beside records"):
        ids("second", '{"weeks": [{"w": 1}, {"w": 2}], "records": [{"id": 1}]}')


def test_steps_of_json_pieces_are_counted_on_bytes():
    """Same quotes and brackets as by patterns: a backslash takes the next character of its piece along."""
    draw = random.Random(5)
    pieces = ["", '"', "\\", '\\"', "a\\\\", '{"k": ["x\\\\", "}']
    pieces += ["".join(draw.choices(['"', "\\", "{", "[", "]", "é", "🙂", "a", ","], k=draw.randint(0, 12))) for _ in range(2000)]
    expected = []
    for piece in pieces:
        parts = re.sub(r"(?s)\\.", "", piece).split('"')
        odd = (len(parts) - 1) % 2
        texts = ["".join(parts[side::2]) for side in (0, 1)]
        depth = [t.count("{") + t.count("[") - t.count("]") - (odd == side) for side, t in enumerate(texts)]
        expected.append((odd, *depth))
    got = split._json_steps(*split._letters(pa.array(["before", *pieces]).slice(1)))
    assert list(zip(*(column.tolist() for column in got))) == expected


def test_lines_of_csv_are_moved_once(spark, tmp_path):
    """Lines of one record meet by its number, which sums over lines tell: no window moves them before that."""
    write_csv(tmp_path / "a.csv", values(1), csv.QUOTE_ALL)
    plan = split.csv_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(") == 1


def test_a_csv_header_of_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"te\nxt",note\n1,"x\ny",z\n')
    with pytest.raises(ValueError, match="a.csv"):
        split.read_csv(spark, str(tmp_path), spark.createDataFrame([], CSV_SCHEMA).schema)
    records = split.csv_records(spark, str(tmp_path))
    assert sorted(r.record for r in records.collect()) == ['1,"x\ny",z', 'id,"te\nxt",note']
