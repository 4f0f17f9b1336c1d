"""EXPLAIN as DataFrames: text, placement of operators, JSON, and metrics of a run."""

from __future__ import annotations

import json
import re
import time
from typing import NamedTuple

from pyspark.sql import DataFrame


class Node(NamedTuple):
    depth: int
    name: str
    detail: str


#: Where an operator runs, by the first pattern that its name or detail matches.
PLACEMENT = (
    (r"^(File)?Scan|^LocalTableScan|^Range|^InMemoryTableScan|^BatchScan", "scan", "executor, leaseholder of the split"),
    (r"^TakeOrdered|^CollectLimit|^GlobalLimit", "top-k", "executor, merged at the gateway"),
    (r"Aggregate.*partial_", "partial aggregate", "executor-local"),
    (r"Aggregate", "final aggregate", "merge at the gateway"),
    (r"Join|^CartesianProduct", "join", "distributed-executor"),
    (r"Exchange|^AQEShuffleRead|^ShuffleQueryStage|^BroadcastQueryStage", "exchange", "networked-executor"),
    (r"^Filter|^Project", "filter or projection", "executor-local"),
    (r"^Sort|^Window|^LocalLimit|^Generate|^Expand|^Union|^Sample", "local operator", "executor-local"),
)


def tree(text: str) -> list[Node]:
    """Nodes of an indented plan tree with their depth."""
    out = []
    for line in text.splitlines():
        m = re.match(r"^([\s:|]*)(?:[+:]- )?\s*(?:\*\s?\(\d+\)\s*)?([A-Za-z]\w*)(.*)$", line)
        if not m or line.startswith("=="):
            continue
        indent = len(re.match(r"^[\s:+\-|]*", line).group())
        out.append(Node(indent // 3, m.group(2), m.group(3).strip()))
    return out


def physical(df: DataFrame) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", plan)


def placement(node: Node) -> tuple[str, str] | None:
    for pattern, operator, where in PLACEMENT:
        if re.search(pattern, f"{node.name} {node.detail}"):
            return operator, where
    return None


def dist_rows(df: DataFrame) -> list[tuple[int, str, str, str]]:
    """(step, operator, node, placement), from the root down."""
    out = []
    for n in tree(physical(df)):
        found = placement(n)
        if found:
            out.append((len(out) + 1, found[0], n.name, found[1]))
    return out


def nested(nodes: list[Node]) -> list[dict]:
    """The tree as nested dicts."""
    roots: list[dict] = []
    stack: list[tuple[int, dict]] = []
    for n in nodes:
        item = {"node": n.name, "detail": n.detail, "children": []}
        while stack and stack[-1][0] >= n.depth:
            stack.pop()
        (stack[-1][1]["children"] if stack else roots).append(item)
        stack.append((n.depth, item))
    return roots


def explain(df: DataFrame, analyze: bool = False, verbose: bool = False, dist: bool = False, as_json: bool = False, access_path: dict | None = None) -> DataFrame:
    """A plan as rows: plan_type and plan; with dist step, operator, node, placement; with as_json one document."""
    spark = df.sparkSession
    metrics = run(df) if analyze else None
    if as_json:
        doc: dict = {"plan": nested(tree(physical(df)))}
        if dist:
            doc["dist"] = [dict(zip(("step", "operator", "node", "placement"), r, strict=True)) for r in dist_rows(df)]
        if metrics:
            doc["analyze"] = metrics
        if access_path:
            doc["access_path"] = access_path
        return spark.createDataFrame([(json.dumps(doc),)], "plan STRING")
    if dist:
        return spark.createDataFrame(dist_rows(df), "step INT, operator STRING, node STRING, placement STRING")
    parts = [("physical_plan", physical(df))]
    if verbose:
        parts.insert(0, ("logical_plan", df._jdf.queryExecution().optimizedPlan().toString()))
    if access_path:
        parts.append(("access_path", json.dumps(access_path)))
    if metrics:
        parts.append(("metrics", json.dumps(metrics)))
    return spark.createDataFrame(parts, "plan_type STRING, plan STRING")


def run(df: DataFrame) -> dict:
    """Runs the query without keeping its rows: seconds and row count."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    began = time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return {"rows": seen.get["rows"], "seconds": round(time.time() - began, 3)}
