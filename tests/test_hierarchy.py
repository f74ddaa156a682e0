import random
from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from lumatable.functions.text import path_parts
from lumatable.operators.hierarchy import descendants, hierarchy


def brute(parents, names):
    out, below = {}, Counter()
    for n in parents:
        chain, x = [n], n
        while (p := parents[x]) is not None and p in parents and p not in chain:
            chain.append(p)
            x = p
        if p is not None and p in chain:
            out[n] = (min(chain[chain.index(p) :]), -1, [])
        else:
            out[n] = (chain[-1], len(chain) - 1, [names[c] for c in reversed(chain)])
            below.update(chain[1:])
    return {n: (*v, -1 if v[1] < 0 else below[n]) for n, v in out.items()}


def check(spark, parents, names):
    df = spark.createDataFrame([(i, p, names[i]) for i, p in parents.items()] + [(i, p, names[i]) for i, p in list(parents.items())[:3]], "id bigint, parent bigint, name string").withColumn("leaf", F.lit(1)).withColumn("steps", F.lit("s"))
    for local_nodes in (0, len(parents) // 2, 50_000):  # peeled by all tasks, begun so and ended in one, and in one from the start
        got = {r.id: (r.root_id, r.depth, r.path, r.n_descendants) for r in hierarchy(df, local_nodes).collect()}
        assert got == brute(parents, names), local_nodes


def test_random_forest_with_long_chains_and_cycles(spark):
    rng = random.Random(5)
    parents = {i: (None if i == 1 else rng.choice([i - 1, i - 1, i - 1, rng.randint(1, i - 1), 9_999])) for i in range(1, 160)}
    parents |= {200: 201, 201: 202, 202: 200, 203: 202, 204: 203, 205: 205, 206: 205, 207: 204}
    check(spark, parents, {i: f"n{i % 7}" for i in parents})


def test_single_chain_and_star(spark):
    parents = {1: None} | {i: i - 1 for i in range(2, 70)} | {100 + i: 1 for i in range(40)}
    check(spark, parents, {i: str(i) for i in parents})


def test_empty_null_names_and_descendants(spark):
    schema = "id bigint, parent bigint, name string"
    assert hierarchy(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, 1, "b"), (3, 2, "c"), (None, 1, "x")], schema)
    assert rows(hierarchy(df).select("id", F.concat_ws("|", "path"), "depth")) == [(1, "", 0), (2, "|b", 1), (3, "|b|c", 2)]
    assert rows(descendants(df)) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_path_parts(spark):
    df = spark.createDataFrame([(" A / b|| C ",), (None,), ("",), (" | x y/ /z |",), ("a" + " " * 100_000 + "b",)], "p string").select(path_parts(F.col("p")).alias("x"))
    assert [r.x for r in df.collect()] == [["a", "b", "c"], [], [], ["x y", "z"], ["a" + " " * 100_000 + "b"]]
