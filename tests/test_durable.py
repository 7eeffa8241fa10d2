"""Ledgered streams, documents on any file system, file digests, relations equal in order, exact draws, case folding."""

import glob
import hashlib
import json
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.operators import constraints as C
from loomtext.operators import selection as O
from loomtext.operators.draws import draws
from loomtext.operators.joins import ordered_diff
from loomtext.sources import readers, writers
from loomtext.streaming import resume


def keyed(spark, *spans):
    return spark.createDataFrame([(f"k{i}", i) for a, b in spans for i in range(a, b)], "key string, n long")


def doubled(d):
    return d.withColumn("score", F.col("n") * 2)


def stream(spark, tmp_path, name="ck", **more):
    resume.stream_scores(spark, str(tmp_path / "in"), "key string, n long", str(tmp_path / name), str(tmp_path / "out"), "key", doubled, **more)


def test_a_stream_does_not_read_what_it_has_written(spark, tmp_path):
    keyed(spark, (0, 10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream(spark, tmp_path)
    for f in glob.glob(str(tmp_path / "out" / "ledger_batch=*" / "*.parquet")):
        os.rename(f, f + ".kept")
        with open(f, "wb") as g:
            g.write(b"unreadable")
    keyed(spark, (5, 15), (12, 18)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream(spark, tmp_path)  # keys 5 to 9 are known without a look at the table
    for f in glob.glob(str(tmp_path / "out" / "ledger_batch=*" / "*.kept")):
        os.rename(f, f.removesuffix(".kept"))
        crc = os.path.join(os.path.dirname(f), "." + os.path.basename(f).removesuffix(".kept") + ".crc")
        os.path.exists(crc) and os.remove(crc)
    got = readers.read_completed(spark, str(tmp_path / "out"), "key")
    assert sorted((r.n, r.score) for r in got.collect()) == [(i, 2 * i) for i in range(18)]
    lines = {r.ledger_batch: r.rows for r in resume.ledger(spark, str(tmp_path / "out")).collect()}
    assert sorted(lines.values()) == [8, 10]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    keyed(spark, (0, 10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream(spark, tmp_path)
    commits = sorted((tmp_path / "ck" / "query" / "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the driver was lost before it
        f.exists() and f.unlink()
    stream(spark, tmp_path)
    assert readers.read_completed(spark, str(tmp_path / "out"), "key").count() == 10


def test_runs_over_whole_inputs_may_come_before_a_stream(spark, tmp_path):
    resume.run_pending(keyed(spark, (0, 6)), str(tmp_path / "out"), "key", doubled)
    resume.run_pending(keyed(spark, (3, 9)), str(tmp_path / "out"), "key", doubled)
    for a in (0, 7, 14):
        keyed(spark, (a, a + 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream(spark, tmp_path, refresh=lambda d: seen.append(d.count()), files_per_batch=1)
    assert seen == [9, 14, 21] or sorted(seen)[-1] == 21
    pieces = glob.glob(str(tmp_path / "ck" / "earlier-keys" / "_piece=*"))
    assert 1 < len(pieces) <= resume.PIECES
    assert readers.read_completed(spark, str(tmp_path / "out"), "key").count() == 21
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_documents_are_written_where_only_spark_can(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./d", f"file://{tmp_path}")
    for base in ("viewfs://docs/d", f"file://{tmp_path}/f", str(tmp_path / "p")):
        path = f"{base}/x/summary.json"
        assert not os.path.exists(path) or base.startswith("/")
        writers.write_document({"b": "é", "a": 1}, path)
        writers.write_document({"b": "ü", "a": 2}, path)
        assert readers.load_document(path) == {"a": 2, "b": "ü"}
        m = writers.manifest({"t": spark.range(3)}, seed=1)
        assert writers.resume_manifest(f"{base}/m.json", m) == m == writers.resume_manifest(f"{base}/m.json", m)
    assert json.loads((tmp_path / "x" / "summary.json").read_text()) == {"a": 2, "b": "ü"}
    assert not [f for f in os.listdir(tmp_path / "x") if "summary" in f and f not in ("summary.json", ".summary.json.crc")]
    writers.write_document([], str(tmp_path / "l.json"))
    with pytest.raises(C.ConstraintError, match="object"):
        readers.load_document(str(tmp_path / "l.json"))


def test_digests_of_files_read_in_blocks(spark, tmp_path):
    rng = random.Random(1)
    files = {"empty": b"", "one": b"a", "end": b"a\n", "blank": b"\n\n\n", "crlf": b"a\r\nb\r\n", "large": b"".join(bytes(rng.randrange(256) for _ in range(rng.randrange(200))) + b"\n" for _ in range(3000)), "open": b"x\n" * 999 + b"y\xff\xfe"}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r.path.rsplit("/", 1)[-1]: (r.size, r.sha256) for r in readers.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    m = writers.manifest({}, {"in": str(tmp_path)})
    assert m["inputs"]["in"]["end"] == {"size": 2, "sha256": hashlib.sha256(b"a\n").hexdigest()}


def test_relations_that_differ_in_order_only_are_told_apart(spark, tmp_path):
    d = spark.createDataFrame([(i, f"v{i % 5}", None) for i in range(200)], "k long, v string, x int")
    path = str(tmp_path / "t")
    assert writers.ensure_written(d.repartition(7), path, order=("k",)) and not writers.ensure_written(d.repartition(3), path, order=("k",))
    assert [r.k for r in readers.in_stored_order(spark, path).orderBy("ordinal").collect()] == list(range(200))
    with pytest.raises(C.ConstraintError, match="another order, first at: .(0|\\(0), "):
        writers.ensure_written(d.withColumn("k", 199 - F.col("k")), path, order=("k",))
    swapped = str(tmp_path / "s")
    d.withColumn("_o", F.expr("CASE k WHEN 50 THEN 51 WHEN 51 THEN 50 ELSE k END")).orderBy("_o").drop("_o").coalesce(1).write.parquet(swapped)
    assert not writers.ensure_written(d, swapped)
    with pytest.raises(C.ConstraintError, match="first at.*50"):
        writers.ensure_written(d, swapped, order=("k",))
    a, b = (O.with_ordinal(x, "k", name="ordinal") for x in (d, d.where("k < 198")))
    assert [(r.ordinal, r.right) for r in ordered_diff(a, b).orderBy("ordinal").collect()] == [(198, None), (199, None)]


@pytest.mark.parametrize(("rows", "step"), [(0, 5), (1, 5), (23, 5), (20, 20)])
def test_draws_are_those_of_one_generator(spark, rows, step):
    rng = random.Random(9)
    d = draws(spark, 9, rows, step)
    assert [(r.ordinal, r.draw) for r in d.orderBy("ordinal").collect()] == [(k, rng.random()) for k in range(rows)]
    assert d.rdd.getNumPartitions() == max(1, -(-rows // step))


def test_exact_modes_equal_a_plain_loop(spark):
    rows = spark.createDataFrame([(i * 3, f"S{i}") for i in range(40)], "source_idx long, scenario_id string").repartition(5)
    rng = random.Random(4)
    assert {r.scenario_id: r.tie for r in O.exact_ties(rows, 4).collect()} == {f"S{i}": rng.random() for i in range(40)}
    cases = [(i, "request" if i % 3 else "duty_role") for i in range(50)]
    by = {f: [i for i, g in cases if g == f] for f in ("request", "duty_role")}
    for size, seed in ((10, 1), (7, 2), (200, 3)):
        rng, target = random.Random(seed), min(size, 50)
        first = round(target * len(by["request"]) / 50)
        want = []
        for f, n in (("request", first), ("duty_role", target - first)):
            pool = list(by[f])
            rng.shuffle(pool)
            want += pool[:n]
        rng.shuffle(want)
        got = O.exact_audit_sample(spark.createDataFrame(cases, "source_idx long, input_format string").repartition(4), size, seed)
        assert [r.source_idx for r in got.orderBy("audit_id").collect()] == want
    assert O.exact_audit_sample(spark.createDataFrame([], "source_idx long, input_format string"), 5, 1).count() == 0


def test_folding_equals_python_on_all_characters(spark):
    every = [chr(n) for n in range(1, 0x110000) if not 0xD800 <= n < 0xE000 and unicodedata.category(chr(n)) != "Cn"]
    texts = ["".join(every[k : k + 500]) for k in range(0, len(every), 500)] + ["", "Straße ŉ ǰ ﬃ ΑΣ", "plain ASCII"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.casefold(F.col("t")).alias("f"))
    assert all(r.f == r.t.casefold() for r in d.collect())
