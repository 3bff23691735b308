"""Calls of a plain callable for every row: bounded at once, tried again where that can help, failures as rows."""

from __future__ import annotations

import random
import re
import sys
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.text import error_class

#: Executors may lack this package: its functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Calls at most for one request, the longest wait for a reply that names one, statuses that no repetition changes.
ATTEMPTS, MOST_WAIT = 3, 50.0
FINAL = (400, 401, 402, 403, 404)


class CallFailed(Exception):
    """What a callable raises for a refused call: its status, Retry-After header (or None) and body."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | None = None, body: str = ""):
        super().__init__(message)
        self.status, self.retry_after, self.body = status, retry_after, body

    def __reduce__(self):
        return type(self), (str(self), self.status, self.retry_after, self.body)


# Where a reply names a wait in seconds, the first that is there.
WAITS = (r"^\s*(\d+(?:\.\d+)?)\s*$", r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s?"', r"(?i)retry in (\d+(?:\.\d+)?)")


def wait_named(retry_after: str | None, body: str | None) -> float:
    """Seconds that a refusal asks to wait, in its header or its body; 0 if it names none."""
    found = (re.search(pattern, text or "") for pattern, text in zip(WAITS, (retry_after, body, body)))
    return next((float(m[1]) for m in found if m), 0.0)


@dataclass(frozen=True)
class Policy:
    """How calls are made: threads of a task, tries of a call, the longest wait; sleep and jitter can be replaced in tests."""

    threads: int = 4
    attempts: int = ATTEMPTS
    most_wait: float = MOST_WAIT
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[], float] = random.random

    def reply(self, call: Callable[[str], str], request: str) -> tuple[str | None, str | None, int]:
        """(reply, error, tries). Refusals that no repetition changes end at once; rate limits and faults of the
        server wait as long as they say, or longer with each try; other failures wait longer with each try."""
        for attempt in range(1, self.attempts + 1):
            try:
                return call(request), None, attempt
            except Exception as e:  # noqa: BLE001
                error, status = str(e) or type(e).__name__, getattr(e, "status", None)
                if status in FINAL or attempt == self.attempts:
                    return None, error, attempt
                named = wait_named(e.retry_after, e.body) if isinstance(e, CallFailed) and (status == 429 or (status or 0) >= 500) else 0.0
                self.sleep(min(named or 1.5 * attempt, self.most_wait) + 1.5 * self.jitter())
        raise AssertionError("attempts must be positive")


def made(requests: DataFrame, key: str, call: Callable[[str], str], at_once: int = 8, policy: Policy = Policy(), dealt: bool = False) -> DataFrame:
    """key, reply, error, kind (the class of the error) and tries for each row (key, request).

    At most `at_once` calls run at a time: the rows are dealt to tasks of policy.threads threads each. `dealt`: the partitions are
    about even, so that some are put together and no request is shuffled. A row without a request is an error. Requests stream through a task a batch at a time."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(policy.threads) as pool:
            for pdf in batches:
                replies = pool.map(lambda r: (None, "no request", 0) if r is None else policy.reply(call, r), pdf["request"])
                out = pd.DataFrame(list(replies), columns=["reply", "error", "tries"])
                out.insert(0, key, pdf[key].to_numpy())
                yield out

    tasks = max(1, at_once // policy.threads)
    requests = requests.select(key, "request")
    rows = (requests.coalesce(tasks) if dealt else requests.repartition(tasks, key)).mapInPandas(run, f"`{key}` {kind}, reply string, error string, tries int")
    return rows.withColumn("kind", F.when(F.col("error").isNotNull(), error_class(F.col("error"))))
