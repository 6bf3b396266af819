"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, root: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that lineage ends here."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def drop(df: DataFrame, root: str, *names: str) -> None:
    """Deletes tables of a shared folder that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the component's smallest node. Loops and nulls are left out.

    Alternates large-star and small-star until nothing changes. A star's centre may have very many
    leaves: they are only grouped by partial minima and joined to their minimum by a join whose
    large side can be split. Each round is written and the one before it deleted.
    """
    root = shared_folder(edges, "components")
    pairs = edges.select("a", "b").where("a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), root, "small-0")
    before = None
    for k in range(1, most_rounds + 1):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # each neighbour above u goes to the smallest in u's neighbourhood
        up = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = cut(up, root, f"large-{k}")
        # then u and its smaller neighbours go to the smallest of them
        low = up.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        down = up.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = cut(down.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), root, f"small-{k}")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges, root, f"large-{k}", f"small-{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
