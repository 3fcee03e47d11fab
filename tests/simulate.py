"""Simulated chains of oriented particles with a fixed seed."""

import numpy as np

from tests import models


def chain(n, step_pos, step_ang, start_pos, start_ang, rng=None, degree=0.0):
    pos, rot = np.array(start_pos, float), models.zxz(*start_ang)
    out = [(pos.copy(), models.euler(rot))]
    for _ in range(n - 1):
        wobble = models.zxz(*rng.uniform(0, degree, 3)) if degree else np.eye(3)
        jitter = rng.uniform(0, degree, 3) if degree else np.zeros(3)
        rot = wobble @ rot @ models.zxz(*step_ang)
        pos = pos + rot @ (np.array(step_pos, float) + jitter)
        out.append((pos.copy(), models.euler(rot)))
    return out


def table(spark, volumes, shuffle=None):
    """``volumes``: name -> list of (position, Euler triple); returns the particle table and the given order."""
    rows = [(name, *map(float, p), *map(float, e)) for name, parts in volumes.items() for p, e in parts]
    order = list(range(len(rows))) if shuffle is None else list(shuffle.permutation(len(rows)))
    data = [(k, *rows[o], 0, "none") for k, o in enumerate(order)]
    names = sorted(volumes)
    df = spark.createDataFrame(data, "particle_id long, tomo_name string, x double, y double, z double, phi double, psi double, theta double, cls int, psf string")
    code = {n: i for i, n in enumerate(names)}
    from pyspark.sql import functions as F
    return df.withColumn("tomo_id", F.element_at(F.create_map(*[F.lit(v) for kv in code.items() for v in kv]), F.col("tomo_name"))), order
