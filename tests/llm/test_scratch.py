"""What intermediate tables and their shuffles leave on disk, and connected components whatever the hubs."""

import os
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from terrace.operators import graph
from terrace.scratch import materialize, shared_root

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    grouped = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count()
    assert materialize(grouped.join(spark.range(200).withColumnRenamed("id", "k").repartition("k"), "k"), "grouped").count() == 97
    for _ in range(50):  # files are deleted without waiting
        left = {n for n in _shuffle_files(spark) - before if n.endswith(".data")}
        if len(left) <= 4:  # of the count
            break
        spark._jvm.java.lang.Thread.sleep(200)
    assert len(left) <= 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_copies_leave_only_what_they_return(spark):
    root = f"{shared_root(spark)}/terrace"
    names = lambda: {f"{d}/{n}" for d in (os.listdir(root) if os.path.isdir(root) else []) for n in os.listdir(f"{root}/{d}")}
    before = names()
    out = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert [n.split("/")[-1] for n in names() - before] == ["near-copies"]
    assert out.count() > 0


@pytest.mark.parametrize("hub", [4096, 5])
def test_components_with_and_without_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB_EDGES", hub)
    rng = random.Random(3)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(k, k + 1) for k in range(2000, 2060)] + [(3000, 3000 + k) for k in range(1, 40)] + [(7, 7), (5, 4), (4, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = sorted(tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long")).select("node", "root").collect())
    assert got == sorted((x, find(x)) for x in root if find(x) != x)


def test_stars_without_hubs_join_nothing(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    plan = graph._small_star(graph._large_star(edges, None), None)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3
