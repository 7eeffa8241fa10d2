"""Scans against plain readers: CSV in blocks, whole JSON lines."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import constraints as C
from loomtext.sources import csvblocks, readers


def written(path, seed, rows, end):
    rng = random.Random(seed)
    field = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", "é", '"\n"', " ", "\\"]) for _ in range(rng.choice([0, 1, 3, 9, 40])))
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["x", "a,b", 'q"r'])
    for _ in range(rows):
        w.writerow([field() for _ in range(3)])
    path.write_bytes(("﻿" if seed % 2 else "").encode() + out.getvalue().encode())
    return [tuple(r) for r in csv.reader(io.StringIO(path.read_bytes().decode("utf-8-sig"), newline=""))][1:]


@pytest.mark.parametrize("split", [48, 900, None])
def test_csv_in_blocks_equals_a_plain_reader(spark, tmp_path, split):
    want = [r for k, (n, end) in enumerate([(150, "\n"), (120, "\r\n"), (0, "\n"), (4, "\r\n")]) for r in written(tmp_path / f"{k}.csv", k, n, end)]
    d = readers.read_csv(spark, str(tmp_path), ("x", 'q"r'), with_place=True, split=split)
    assert d.columns == ["x", "a,b", 'q"r', readers.PLACE]
    assert [tuple(r)[:3] for r in d.orderBy(readers.PLACE).collect()] == [r for r in want if r]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    written(tmp_path / "a.csv", 2, 400, "\n")
    lines = csvblocks._in_blocks(spark, str(tmp_path), 1000)
    blocks = csvblocks._blocks(lines).collect()
    assert len(blocks) > 15 and sum(b.open for b in blocks) > 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") not in ("1000", 1000)


def test_quotes_out_of_place_and_open_ones_are_read_as_spark_reads_them(spark, tmp_path):
    for k, text in enumerate(('a,b\n1,x"y\n2,"z"\n', 'a,b\n1,"x"y\n', 'a,b\n1,"open\n2,z\n')):
        p = tmp_path / f"{k}.csv"
        p.write_text(text)
        assert not csvblocks.records(spark, str(p), 8)[1].isEmpty()
        old = spark.read.csv(str(p), header=True, **csvblocks.OPTIONS).na.fill("").collect()
        assert [tuple(r) for r in readers.read_csv(spark, str(p), split=8).collect()] == [tuple(r) for r in old]


def test_csv_refuses_bad_headers_and_fills_short_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b,"c\nd"\n1\n\n2,3,4,5\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(p)).orderBy("a").collect()] == [("1", "", ""), ("2", "3", "4")]
    with pytest.raises(C.ConstraintError, match="missing"):
        readers.read_csv(spark, str(p), ("z",))
    p.write_text("a,a\n1,2\n")
    with pytest.raises(C.ConstraintError, match="twice"):
        readers.read_csv(spark, str(p))
    p.write_text("")
    with pytest.raises(C.ConstraintError, match="header"):
        readers.read_csv(spark, str(p))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d" / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(C.ConstraintError, match="headers"):
        readers.read_csv(spark, str(tmp_path / "d"))


LINES = ['{"a":1}{"a":2}', '{"a":3} {"a":4}', '{"a":6, "a":7} x}', '{"a":1},{"b":2}', '{"a":1},"e":0}', "[1]", "1", '{"a":1,}', '{"a":1}]', '{"a":1}}', "{'a':1}", '{"a":1}//c', '{"a":"\\x"}', '{"a":01}', '{"a"', '{"a":"x\ty"}']
WHOLE = ['{"a":5}', '{"a":6, "a":7}', '{"a":{"b":1,"b":2}}', ' \t{"a":[1,{"b":"}{"}]}\x0b', "{}", '{"a":"\\"}"}', '{"a":"é😀","b":[true,null,-1e5]}', "", "  "]


def test_a_line_is_one_whole_object(spark):
    d = spark.createDataFrame([(x,) for x in LINES + WHOLE], "v string").select("v", readers.not_objects(F.col("v")).alias("bad"))
    assert {r.v for r in d.collect() if r.bad} == set(LINES)
    for x in WHOLE:
        assert not x.strip() or isinstance(json.loads(x.strip()), dict)


@pytest.mark.parametrize("strict", [True, False])
def test_text_behind_an_object_is_an_error_with_its_place(spark, tmp_path, strict):
    for bad in LINES[:4]:
        p = tmp_path / "a.jsonl"
        p.write_text(f'{{"a":5}}\n\n{bad}\n')
        with pytest.raises(C.ConstraintError, match=r"a.jsonl', 3, "):
            readers.read_jsonl(spark, str(p), "a int", strict=strict)
        with pytest.raises(C.ConstraintError, match=r"', 3, "):
            readers.read_raw_json(spark, str(p))


def test_a_source_is_read_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    d = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int")
    (tmp_path / "a.jsonl").unlink()  # what was read does not depend on it any more
    assert store.executionsCount() - before == 1 and sorted(r.a for r in d.collect()) == [1, 2]
