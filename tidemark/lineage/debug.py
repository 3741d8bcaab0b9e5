"""Finding the input records that make a result fail."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored
from tidemark.session import rounds as until_done


@dataclass(frozen=True)
class Round:
    """One step of the search."""

    number: int
    suspects: int
    parts: int
    failing_part: int | None
    seconds: float


def isolate(
    suspects: DataFrame, key: list[str], run: Callable[[DataFrame, list[str]], DataFrame],
    faulty: Column, parts: int = 8, max_rounds: int | None = None,
) -> tuple[DataFrame, list[Round]]:
    """Delta debugging: shrink the suspect inputs while the job still fails on them.

    ``run(rows, extra_keys)`` is the job, with ``extra_keys`` added to its group keys, so all parts
    of a round run in one job. Parts are hash ranges of the record key. When a part is kept that is
    a small share of what was read, it is written out and the search goes on from there, so all
    rounds together read little more than the first. If no single part fails, each part is left
    out in turn; the search ends when neither fails.
    """
    rounds: list[Round] = []
    current = suspects
    size = read = current.count()
    for number in until_done(max_rounds):
        if size <= 1:
            break
        began = time.perf_counter()
        # each round hashes with its number, so the parts of later rounds are cut anew
        part = F.pmod(F.xxhash64(F.lit(number), *key), F.lit(parts))
        cut = current.withColumn("_part", part)
        # at most ``parts`` rows come back
        failing = sorted(
            r[0] for r in run(cut, ["_part"]).where(faulty).select("_part").distinct().collect()
        )
        if failing:
            current = current.where(part == failing[0])
        else:
            for left_out in range(parts):
                rest = current.where(part != left_out)
                if not run(rest, []).where(faulty).isEmpty():
                    remaining = rest.count()
                    if remaining < size:
                        current = rest
                        break
            else:
                rounds.append(Round(number, size, parts, None, time.perf_counter() - began))
                break
        rounds.append(
            Round(number, size, parts, failing[0] if failing else None, time.perf_counter() - began)
        )
        size = current.count()
        if size * 4 <= read:
            current, read = stored(current, "suspects"), size
    return current, rounds
