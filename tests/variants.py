"""Odd variants of the smallest tables: empty ones, and ones with null rows, repeated rows and extra columns of common names."""

from pathlib import Path

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
EXTRA = ("spans", "n", "key", "part", "slot", "kind", "t", "value", "cell", "piece")


def write(spark, folder, kind):
    for p in sorted(Path(DATA).glob("*.parquet")):
        df = spark.read.parquet(str(p))
        if kind == "empty":
            out = df.limit(0)
        else:
            nulls = spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema)
            out = df.unionByName(nulls).unionByName(df.limit(5))
            out = out.select("*", *(F.lit("x").alias(c) for c in EXTRA if c not in df.columns))
        out.coalesce(1).write.parquet(f"{folder}/{p.name}")
    return str(folder)
