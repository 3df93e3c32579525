"""Sources, sinks and the incremental reply parse."""

import os
import tempfile

from pyspark.sql import functions as F

from votelab.operators import schema as S
from votelab.session import scratch_path
from votelab.sources import files as IO
from votelab.sources import fixtures as fx
from votelab.streaming import responses as ST

SF = "/root/testdata/sf0.001"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_scan_groups_by_header_not_position(spark):
    d = tempfile.mkdtemp(prefix="votelab-csv-")
    _write(f"{d}/eng.csv", 'id,text,joy,fear\n1,"a, b",1,0\n2,"line\nbreak",0,1\n')
    _write(f"{d}/deu.csv", "id,text,fear,joy\n3,x,1,0\n")
    _write(f"{d}/amh.csv", "ID,TEXT,Joy\n4,y,1\n")
    _write(f"{d}/tat.csv", "id,text\n5,z\n")
    got = {(r.lang, r.id, r.label): r.value for r in IO.scan_long(spark, f"{d}/*.csv").collect()}
    assert got[("deu", "3", "fear")] == 1 and got[("deu", "3", "joy")] == 0
    assert got[("eng", "2", "fear")] == 1 and got[("eng", "1", "joy")] == 1
    assert got[("amh", "4", "joy")] == 1 and ("amh", "4", "fear") not in got
    assert not any(k[0] == "tat" for k in got)
    texts = {(r.lang, r.id): r.text for r in IO.scan_texts(spark, f"{d}/*.csv").collect()}
    assert texts[("eng", "1")] == "a, b" and texts[("eng", "2")] == "line\nbreak"


def test_scan_prediction_dirs(spark):
    d = tempfile.mkdtemp(prefix="votelab-pred-")
    _write(f"{d}/bert/pred_eng.csv", "id,joy,fear\n1,1,0\n")
    _write(f"{d}/llm/eng.csv", "id,fear,joy\n1,1,1\n")
    got = {(r.model, r.lang, r.label): r.value for r in IO.scan_long(spark, f"{d}/*/*.csv", model_from_dir=True).collect()}
    assert got == {("bert", "eng", "joy"): 1, ("bert", "eng", "fear"): 0,
                   ("llm", "eng", "fear"): 1, ("llm", "eng", "joy"): 1}


def test_partitioned_sink_prunes(spark):
    d = scratch_path(spark, "sink")
    IO.write_predictions(fx.pred_table(spark, SF), d)
    df = spark.read.parquet(d).where(F.col("model") == "m2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan
    assert df.select("model").distinct().collect()[0].model == "m2"


def test_dynamic_overwrite_keeps_other_partitions(spark):
    d = scratch_path(spark, "ovw")
    a = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "combo string, v double")
    IO.overwrite_results(a, d, ["combo"])
    IO.overwrite_results(spark.createDataFrame([("c2", 5.0)], "combo string, v double"), d, ["combo"])
    got = {r.combo: r.v for r in spark.read.parquet(d).collect()}
    assert got == {"c1": 1.0, "c2": 5.0}


def test_append_keeps_runs_and_ignores_retries(spark):
    d = scratch_path(spark, "app")
    a = spark.createDataFrame([("x", 1.0)], "k string, v double")
    assert IO.append_results(a, d, "001") and IO.append_results(a, d, "r/2")
    assert not IO.append_results(a, d, "r/2")
    assert sorted(r.run_id for r in IO.read_results(spark, d).collect()) == ["001", "r/2"]
    # an attempt that failed before its commit, and a run without rows
    a.withColumn("run_id", F.lit("r3")).write.parquet(f"{d}/rows/{IO.ATTEMPT}=lost")
    assert IO.append_results(a.limit(0), d, "r4")
    assert IO.read_results(spark, d).count() == 2 and IO.read_results(spark, d).columns == ["k", "v", "run_id"]
    assert IO.append_results(a, d, "r3") and IO.read_results(spark, d).count() == 3


def test_second_of_two_attempts_at_once_does_not_count(spark, monkeypatch):
    d = scratch_path(spark, "app2")
    a = spark.createDataFrame([("x", 1.0)], "k string, v double")
    names = iter(["one", "two"])
    monkeypatch.setattr(IO.uuid, "uuid4", lambda: type("U", (), {"hex": next(names)})())
    inner = IO.json.dumps
    def late(x):
        # the other attempt tries to commit between this one's create and its write
        monkeypatch.setattr(IO.json, "dumps", inner)
        assert not IO.append_results(a, d, "r1")
        return inner(x)
    monkeypatch.setattr(IO.json, "dumps", late)
    assert IO.append_results(a, d, "r1")
    assert IO.read_results(spark, d).count() == 1


def test_streaming_resume_adds_nothing_twice(spark):
    base = scratch_path(spark, "stream")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    catalog = S.label_catalog(fx.gold_table(spark, SF))
    replies = fx.responses_b(spark, SF)
    replies.where(F.col("lang") == "en").write.parquet(src)
    n1 = ST.run_incremental(spark, src, sink, ckpt, catalog)
    n2 = ST.run_incremental(spark, src, sink, ckpt, catalog)
    replies.where(F.col("lang") != "en").write.mode("append").parquet(src)
    n3 = ST.run_incremental(spark, src, sink, ckpt, catalog)
    assert n1 > 0 and n2 == 0 and n3 > 0
    assert n1 + n3 == replies.count()
    out = spark.read.parquet(sink)
    assert out.count() == 2 * replies.count()


def test_a_good_reply_replaces_an_error_once(spark):
    base = scratch_path(spark, "resumed")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    catalog = spark.createDataFrame([("en", "toxic")], "lang string, label string")
    good = lambda n: '{"choices":[{"message":{"content":"toxic(%d)"}}]}' % n

    def drop(*rows):
        spark.createDataFrame([("en", i, r) for i, r in rows], ST.REPLIES_SCHEMA).write.mode("append").parquet(src)
        n = ST.run_resumed(spark, src, sink, ckpt, catalog)
        return n, {r.id: r.value for r in spark.read.parquet(sink).collect()}, spark.read.parquet(sink).count()

    assert drop((1, good(1)), (2, fx.ERROR_REPLY), (3, None), (4, "no json"), (1, good(1))) == (1, {1: 1}, 1)
    assert drop((2, good(2)), (1, good(3)), (3, fx.ERROR_REPLY)) == (1, {1: 1, 2: 2}, 2)
    assert drop((2, good(1)), (3, good(3))) == (1, {1: 1, 2: 2, 3: 3}, 3)
    assert ST.run_resumed(spark, src, sink, ckpt, catalog) == 0


def test_score_texts_batches(spark):
    from votelab.operators.scoring import score_texts
    texts = spark.createDataFrame([("en", 1, "I hate this stupid thing :("), ("en", 2, "the study results, however")],
                                  "lang string, id long, text string")
    got = {(r.id, r.label): r.score for r in score_texts(texts).collect()}
    assert set(got) == {(1, "quality"), (1, "toxic"), (2, "quality"), (2, "toxic")}
    assert got[(1, "toxic")] > 0.5 and got[(2, "toxic")] == 0.0
    assert got[(2, "quality")] > 0.5


def test_scorer_runs_when_launched_outside_the_repo():
    """Python workers import the package from the shipped zip, not from the launch folder."""
    import os
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', %r).getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['score_texts'](s, '/root/testdata/sf0.001').count(), file=sys.stderr)\n"
    ) % (root, tempfile.mkdtemp(prefix="votelab-ship-"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="votelab-cwd-"),
                         capture_output=True, text=True, timeout=600, env=env)
    assert "ROWS 800" in out.stderr  # 200 texts x 2 labels x 2 scorers
    assert out.returncode == 0, out.stderr[-2000:]
