"""Lines of a textual PostgreSQL plan, annotated: what each says, in columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of plan nodes, of conditions, and what counts as much.
NODES = (
    "Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan", "Hash Join", "Hash", "Nested Loop", "Merge Join", "Aggregate", "HashAggregate", "GroupAggregate", "Sort", "Limit", "Append",
    "Gather", "Gather Merge", "Materialize", "Memoize", "Unique", "WindowAgg", "CTE Scan", "Subquery Scan", "Result", "ProjectSet", "Function Scan", "Values Scan", "Table Function Scan", "Foreign Scan", "LockRows", "SetOp",
    "RecursiveUnion", "Modify Table", "Insert", "Update", "Delete",
)
CONDITIONS = ("Filter", "Index Cond", "Recheck Cond", "Hash Cond", "Join Filter", "Sort Key", "Group Key", "One-Time Filter", "Output", "Index", "Cache Key", "Merge Cond")
MANY_REMOVED = 1000


# Labels of lines with a figure of their own.
REMOVED, FETCHES, WORKERS, TIMINGS = "Rows Removed by Filter", "Heap Fetches", ("Workers Planned", "Workers Launched", "Worker Planned", "Worker Launched"), ("Planning Time", "Execution Time", "Planning", "Execution")


def _figures(line: Column, begins: str) -> Column:
    """The figures of a node's bracket that begins so, by their names."""
    bracket = F.get(F.filter(F.split(line, r"\("), lambda x: x.startswith(begins)), F.lit(0))
    return F.str_to_map(F.substring_index(bracket, ")", 1), F.lit(" "), F.lit("="))


def annotated(plans: DataFrame, text: str = "plan_text") -> DataFrame:
    """id, n (the line, from 1), depth (blanks before a node), kind, name, cost and rows expected, rows and loops met, never (executed), value, flagged.

    kind: node, condition, removed, heap_fetches, workers, buffers, timing, query_id or other. Flagged are many rows removed by a filter, and fetches from the heap.
    A line is its blanks, an arrow or none, and what follows: a node's name with figures in brackets, or a label and its value."""
    lines = plans.select("id", F.posexplode(F.split(text, r"\r?\n")).alias("_n", "_line")).select("id", (F.col("_n") + 1).alias("n"), "_line")
    bare = F.regexp_replace("_line", r"^\s+", "")
    rest = F.when(F.startswith("_bare", F.lit("->")), F.regexp_replace(F.substring("_bare", 3, 1 << 30), r"^\s+", "")).otherwise(F.col("_bare"))
    node = F.nullif(F.regexp_extract("_rest", rf"^(?:{'|'.join(sorted(NODES, key=len, reverse=True))})(?!\w)", 0), F.lit(""))
    # The patterns are matched once a line: what filters ask of these columns can't be moved below this.
    told = lines.withColumn("_bare", bare).withColumn("_rest", rest).withColumn("_node", node)
    lines = told.select("id", "n", F.explode(F.array(F.struct("_line", "_bare", "_rest", "_node"))).alias("_l")).select("id", "n", "_l.*")
    bare = F.col("_bare")
    lines = lines.withColumns({"_inner": F.length(bare) < F.length("_line"), "_label": F.when(bare.contains(":"), F.substring_index(bare, ":", 1))})
    lines = lines.withColumn("_value", F.regexp_replace(F.substring(bare, F.length("_label") + 2, F.lit(1 << 30)), r"^\s+", ""))
    label, value, inner = F.col("_label"), F.col("_value"), F.col("_inner")
    number = lambda *names: F.when(inner & label.isin(*names), F.substring_index(value, " ", 1).try_cast("long"))
    removed, fetches, workers = number(REMOVED), number(FETCHES), number(*WORKERS)
    took = F.when(~inner & label.isin(*TIMINGS), F.nullif(F.substring_index(value, " ", 1), F.lit("")))
    kind = (
        F.when(F.col("_node").isNotNull(), "node").when(inner & label.isin(*CONDITIONS), "condition").when(removed.isNotNull(), "removed").when(fetches.isNotNull(), "heap_fetches").when(workers.isNotNull(), "workers")
        .when(inner & (label == "Buffers"), "buffers").when(took.try_cast("double").isNotNull(), "timing").when(~inner & (label == "Query Identifier"), "query_id").otherwise("other")
    )
    lines = lines.withColumns({"kind": kind, "_cost": _figures(F.col("_rest"), "cost="), "_met": _figures(F.replace(F.col("_rest"), F.lit("(actual "), F.lit("(")), "time=")})
    at_node = lambda c: F.when(F.col("kind") == "node", c)
    return lines.select(
        "id", "n", at_node(F.length("_line") - F.length("_rest")).alias("depth"), "kind",
        F.when(F.col("kind") == "node", F.col("_node")).when(F.col("kind").isin("condition", "timing"), label).alias("name"),
        at_node(F.substring_index(F.col("_cost")["cost"], "..", -1).try_cast("double")).alias("cost"), at_node(F.col("_cost")["rows"].try_cast("long")).alias("rows_expected"),
        at_node(F.col("_met")["rows"].try_cast("double")).alias("rows_met"), at_node(F.col("_met")["loops"].try_cast("long")).alias("loops"), at_node(F.col("_line").contains("(never executed)")).alias("never"),
        F.when(F.col("kind") == "condition", value).when(F.col("kind") == "timing", took).otherwise(F.coalesce(removed, fetches, workers).cast("string")).alias("value"),
        (F.coalesce(removed >= MANY_REMOVED, F.lit(False)) | F.coalesce(fetches > 0, F.lit(False))).alias("flagged"),
    )


def parents(lines: DataFrame) -> DataFrame:
    """id, n, parent of each node: the line of the latest node before it that is less deep. One pass over each plan's nodes in order, with the
    nodes that are still open."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened = None, []
        for batch in batches:
            out = []
            for i, n, depth in zip(batch["id"], batch["n"], batch["depth"], strict=True):
                if i != now:
                    now, opened = i, []
                while opened and opened[-1][0] >= depth:
                    opened.pop()
                out.append(opened[-1][1] if opened else None)
                opened.append((depth, n))
            yield batch[["id", "n"]].assign(parent=pd.array(out, "Int32"))

    nodes = lines.where("kind = 'node'").select("id", "n", "depth")
    kind = dict(nodes.dtypes)["id"]
    return nodes.repartition("id").sortWithinPartitions("id", "n").mapInPandas(step, f"id {kind}, n int, parent int")
