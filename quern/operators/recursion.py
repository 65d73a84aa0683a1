"""Transitive closure over a self-relation by a frontier loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from quern.sources.lineage import checkpoint


def closure(rows: DataFrame, start: DataFrame, key: list[str], here: list[str], there: list[str], max_depth: int | None = None) -> DataFrame:
    """The start rows and all rows they reach by following ``here = there``, or those
    reached in ``max_depth`` steps.

    Only keys travel round the loop; each round joins the frontier to the edges
    and drops keys already met, so cycles end.  Each round's keys are checkpointed,
    which keeps plans short and survives lost executors.
    """
    edges = rows.select(*[S.col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[S.col(h).alias(f"__h{i}") for i, h in enumerate(here)], *[S.col(t).alias(f"__t{i}") for i, t in enumerate(there)])
    keys = [f"__k{i}" for i in range(len(key))]
    steps = edges.select(*[S.col(k).alias(f"__f{k}") for k in keys], *[f"__h{i}" for i in range(len(here))]).join(
        edges.select(*keys, *[f"__t{i}" for i in range(len(there))]), [S.col(f"__h{i}") == S.col(f"__t{i}") for i in range(len(here))]
    ).select(*[f"__f{k}" for k in keys], *keys)
    met = checkpoint(start.select(*[S.col(k).alias(n) for k, n in zip(key, keys, strict=True)]).distinct())
    frontier, depth = met, 0
    while max_depth is None or depth < max_depth:
        frontier = checkpoint(frontier.toDF(*[f"__f{k}" for k in keys]).join(steps, [f"__f{k}" for k in keys]).select(*keys).distinct().join(met, keys, "left_anti"))
        if frontier.isEmpty():
            break
        met, depth = met.union(frontier), depth + 1
        if depth % 8 == 0:  # each frontier is written down already; this keeps the plan short
            met = checkpoint(met)
    return rows.join(met, [S.col(k) == S.col(n) for k, n in zip(key, keys, strict=True)], "left_semi")
