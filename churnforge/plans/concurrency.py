"""Run independent Spark jobs (MLlib fits, parameter aggregates) concurrently.

Spark schedules jobs submitted from several driver threads side by side; this
keeps all executors busy while each small iterative fit waits on its own
stages. Results come back in input order.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor


def parallel_map(fn, items, workers: int | None = None):
    items = list(items)
    if len(items) <= 1:
        return [fn(x) for x in items]
    workers = workers or min(len(items), int(os.environ.get("CHURNFORGE_JOB_THREADS", "8")))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(fn, items))
