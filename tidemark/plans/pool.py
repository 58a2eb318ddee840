"""Several independent chains of Spark jobs at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import SparkSession

T, R = TypeVar("T"), TypeVar("R")
POOL_KEY = "spark.tidemark.pool"  # how many chains run at a time
DEFAULT_POOL = 4


def run_pool(spark: SparkSession, work: Callable[[T], R], items: Iterable[T], size: int | None = None) -> list[R]:
    """``work`` of every item, in order, with a bounded number at a time.

    Fits on one reference after another leave a cluster idle while their small stages end. The chains take a scheduler pool each, which
    counts where the cluster runs ``spark.scheduler.mode=FAIR``. The first failure is raised once the others have ended.
    """
    at_once = size or int(spark.conf.get(POOL_KEY, str(DEFAULT_POOL)))

    def one(numbered: tuple[int, T]) -> R:
        number, item = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"tidemark-{number % at_once}")
        return work(item)
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, enumerate(items)))
