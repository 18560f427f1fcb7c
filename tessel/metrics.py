"""SQL metrics of an executed DataFrame, read from its final plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_metrics(df: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """(node, {metric: value}) for each node of the plan that ran; needs an action on this very DataFrame before."""

    def walk(node) -> list[tuple[str, dict[str, int]]]:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        found, it = {}, node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            found[pair._1()] = pair._2().value()
        out, children = [(node.nodeName(), found)], node.children().iterator()
        while children.hasNext():
            out += walk(children.next())
        return out

    return walk(df._jdf.queryExecution().executedPlan())


def total(metrics: list[tuple[str, dict[str, int]]], node: str, name: str) -> int | None:
    values = [found[name] for kind, found in metrics if kind.startswith(node) and name in found]
    return sum(values) if values else None


def each(metrics: list[tuple[str, dict[str, int]]], node: str, name: str) -> list[int]:
    """The metric of each such node, in the plan's order: of a join, the probe side's nodes come before the build side's."""
    return [found[name] for kind, found in metrics if kind.startswith(node) and name in found]
