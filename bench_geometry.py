"""

Prints one JSON line. BENCH_CPUS: cores of the Spark part; BENCH_BUILDINGS: number of small polygons.
"""

from __future__ import annotations

import json
import math
import os
import random
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import topology as T
from lodestrata.functions.expr import web_mercator_ladder
from lodestrata.functions.overview import Grid, overview_parts
from lodestrata.functions.wkb import Geometry, write

CPUS = os.environ.get("BENCH_CPUS", "8")
BUILDINGS = int(os.environ.get("BENCH_BUILDINGS", "20000"))


def circle(n: int, radius: float, x: float = 0.0, y: float = 0.0) -> list[tuple[float, float]]:
    return [(x + radius * math.cos(2 * math.pi * k / n), y + radius * math.sin(2 * math.pi * k / n)) for k in range(n)]


def validity(n: int) -> float:
    """Seconds to find a circle of n vertices on a fine grid valid."""
    ring = [(round(x), round(y)) for x, y in circle(n, 1e8)]
    began = time.perf_counter()
    assert T.polygons_valid([[ring]])
    return round(time.perf_counter() - began, 4)


def building(rng: random.Random) -> bytes:
    """A turned L of 7 points, 8 to 40 m wide, somewhere in a square of 20 km."""
    x, y, s, a = rng.uniform(0, 20_000), rng.uniform(0, 20_000), rng.uniform(8, 40), rng.uniform(0, math.pi)
    shape = [(0, 0), (1, 0), (1, 0.5), (0.4, 0.5), (0.4, 1), (0, 1), (0, 0)]
    turn = [(x + s * (u * math.cos(a) - v * math.sin(a)), y + s * (u * math.sin(a) + v * math.cos(a))) for u, v in shape]
    return write(Geometry(6, [[np.array(turn)]]))


def main() -> None:
    took = {f"validity_{n}": validity(n) for n in (5_000, 10_000, 20_000)}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rng = random.Random(2)
    rows = spark.createDataFrame([(building(rng),) for _ in range(BUILDINGS)], "geometry binary").repartition(4 * int(CPUS)).cache()
    rows.count()
    ladder = web_mercator_ladder(0, 16)
    began = time.perf_counter()
    rows.select(*(overview_parts(F.col("geometry"), Grid.of(r)).alias(f"l{i}") for i, r in enumerate(ladder))).write.format("noop").mode("overwrite").save()
    took[f"overviews_{BUILDINGS}_x_{len(ladder)}"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "geometry_seconds", "unit": "sec", "cpus": int(CPUS), "queries": took}))


if __name__ == "__main__":
    main()
