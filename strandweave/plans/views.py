"""Particle views over generic vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One oriented particle per vector: three components are the position, three the Euler angles."""
    src = table(spark, sf_dir, "embeddings")
    part = [F.col("embedding")[k].cast("double") for k in range(7)]
    return src.select(
        F.col("vec_id").alias("particle_id"),
        F.col("label").cast("int").alias("tomo_id"),
        F.concat(F.lit("tomo"), F.col("label").cast("string")).alias("tomo_name"),
        *[(part[k] * 1000).alias(n) for k, n in enumerate("xyz")],
        (part[3] * 360).alias("phi"), (part[4] * 360).alias("psi"), (F.abs(part[5]) * 180).alias("theta"),
        (F.col("vec_id") % 4).cast("int").alias("cls"),
        F.lit("none").alias("psf"),
        part[6].alias("score"),
    )


def particles_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One particle per event along a tube that grows with the table; a third of all rows are in volume 0."""
    i = F.col("event_id")
    turn = [(i * prime % modulus) / scale for prime, modulus, scale in ((7919, 1009, 10.0), (104729, 10007, 50.0), (1299709, 10009, 50.0))]
    angle = [(i * prime % 3600) / 10.0 for prime in (613, 1291)]
    return table(spark, sf_dir, "events").select(
        i.alias("particle_id"), F.when(i % 3 == 0, 0).otherwise(F.col("user_id") % 40 + 1).cast("int").alias("tomo_id"),
        F.when(i % 3 == 0, "tomo0").otherwise(F.concat(F.lit("tomo"), (F.col("user_id") % 40 + 1).cast("string"))).alias("tomo_name"),
        (i * 0.5 + turn[0]).alias("x"), turn[1].alias("y"), turn[2].alias("z"),
        angle[0].alias("phi"), angle[1].alias("psi"), (i * 17 % 1800 / 10.0).alias("theta"),
        (i % 4).cast("int").alias("cls"), F.lit("none").alias("psf"), ((i * 31 % 997) / 997.0).alias("score"))
