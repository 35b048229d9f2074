"""Order over several partitions."""

import numpy as np
from pyspark.sql import functions as F

from plexgrid.operators.storage import ordinals, quantiles


def test_ordinals_and_quantiles(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 300, 5000)
    rows = [(int(k % 3), float(x)) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = ordinals(df, ["g", "v"], "o", 11).orderBy("o").collect()
    assert [r["o"] for r in got] == list(range(5000))
    assert [(r["g"], r["v"]) for r in got] == sorted(rows)
    for q in (0.0, 0.2, 0.95, 1.0):
        own = {r["g"]: r["q"] for r in quantiles(df, "v", q, ["g"]).collect()}
        assert all(abs(own[g] - np.quantile([x for h, x in rows if h == g], q)) < 1e-9 for g in range(3))
    assert abs(quantiles(df, "v", 0.9).first()["q"] - np.quantile(v, 0.9)) < 1e-9
    assert quantiles(df.where("v < 0"), "v", 0.5).first()["q"] is None  # as SQL has it
    assert ordinals(df.where("v < 0"), ["v"]).count() == 0
    assert quantiles(df.withColumn("v", F.lit(None).cast("double")), "v", 0.5, ["g"]).count() == 0


def test_equal_values_spread_over_tasks(spark):
    df = spark.range(1_000_000).select((F.col("id") % 2).cast("int").alias("g"), F.when(F.col("id") < 10, F.col("id")).otherwise(0).cast("double").alias("v"))
    got = {r["g"]: r["q"] for r in quantiles(df, "v", 0.999999, ["g"]).collect()}
    for g in range(2):
        v = np.array([k if k < 10 else 0 for k in range(g, 1_000_000, 2)], float)
        assert abs(got[g] - np.quantile(v, 0.999999)) < 1e-9
    o = ordinals(spark.range(100_000).select("id", F.lit(0).alias("same")), ["same"], "o", 8)
    assert o.agg(F.countDistinct("o"), F.min("o"), F.max("o")).first() == (100_000, 0, 99_999)
    assert o.withColumn("part", F.spark_partition_id()).groupBy("part").count().agg(F.max("count")).first()[0] < 50_000


def test_written_tables_go(spark):
    import os

    from plexgrid.operators.storage import Scratch, shared_dir

    with Scratch(spark, "scratch") as tmp:
        a, b = tmp.written(spark.range(3), "a"), tmp.written(spark.range(4), "b")
        c = tmp.written(spark.range(5), "c")
        tmp.drop(c)
        tmp.keep(b)
        assert len(os.listdir(tmp.root)) == 2 and a.count() == 3
    assert [x[0] for x in map(str, os.listdir(tmp.root))] == ["b"] and b.count() == 4
    assert tmp.root.startswith(shared_dir(spark))
    try:
        with Scratch(spark, "failed") as tmp:
            tmp.keep(tmp.written(spark.range(3), "a"))
            raise KeyError
    except KeyError:
        assert not os.listdir(tmp.root)


def test_tables_written_by_workers_start_no_process(tmp_path):
    import os
    import subprocess
    import sys

    log = tmp_path / "chmods"
    log.write_text("")
    (tmp_path / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec /bin/chmod "$@"\n')
    (tmp_path / "chmod").chmod(0o755)
    code = """
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from plexgrid.llm.lines import dedup_lines
from plexgrid.operators.storage import Scratch
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
with Scratch(spark, "tables", by_workers=True) as tmp:
    df = spark.range(100_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string").cast("binary")).alias("b"), F.array(F.struct(F.col("id").alias("x"), (F.col("id") < 5).alias("y"))).alias("s")).repartition(5)
    back = tmp.written(df, "a")
    assert back.dtypes == df.dtypes and back.count() == 100_000 and not back.exceptAll(df).count()
    assert tmp.written(df.where("id < 0"), "none").count() == 0
    twice = tmp.written(df.select("id"), "b", lambda batches: (b for b in batches for _ in range(2)), "id long")
    assert twice.count() == 200_000 and twice.distinct().count() == 100_000
text = "\\n".join(f"line {i} with some words" for i in range(20))
out = dedup_lines(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out] == [(text, 20, 0), ("", 20, 20), (None, 0, 0)]
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PATH": f"{tmp_path}:{os.environ['PATH']}"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    written = [x for x in log.read_text().splitlines() if "parquet" in x or "_temporary" in x]
    assert not written, written[:3]
