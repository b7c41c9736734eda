"""Connected components of an undirected graph given as an edge table.

Minimum-label propagation with hooking and pointer jumping (after the FastSV scheme of Zhang, Azad
and Buluc, 2020), so the number of rounds grows with the logarithm of the graph, not with its
diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from kerbsight.operators.ranking import salt_count
from kerbsight.session import Workspace

# `prev` is the root a node had before the last round. Offers to a node are
#  - its own root and the root of that root (pointer jumping),
#  - the root that a node which used to have it as root has found since (hooking),
#  - the roots of its neighbours' roots.
# Very many nodes may share one root. Their look-up of it is spread over salts, for which
# only nodes that are some node's root are copied; what they offer it is combined map-side by min().
_ROUND = """
WITH jumped AS (
  SELECT l.node, l.root, r.root AS up
  FROM (SELECT node, root, pmod(xxhash64(node), {salts}L) AS salt FROM {{labels}}) l
  JOIN (SELECT node, root, explode(sequence(0L, {salts}L - 1L)) AS salt FROM {{labels}}
        LEFT SEMI JOIN (SELECT DISTINCT root AS top FROM {{labels}}) ON node = top) r
    ON r.node = l.root AND r.salt = l.salt)
SELECT node, min(offer) AS root, max(own) AS prev
FROM (
  SELECT node, least(root, up) AS offer, root AS own FROM jumped
  UNION ALL
  SELECT prev AS node, root AS offer, NULL AS own FROM {{labels}} WHERE prev != root
  UNION ALL
  SELECT e.a AS node, j.up AS offer, NULL AS own FROM {{edges}} e JOIN jumped j ON j.node = e.b)
GROUP BY node
"""


def connected_components(
    ws: Workspace, nodes: DataFrame, edges: DataFrame, salts: int | None = None
) -> DataFrame:
    """`nodes(node bigint)` and symmetric `edges(a, b)` → `(node, root)`.

    `root` is the smallest node of the component. Each round writes its labels to the shared
    folder: lineage stays one round long and a lost executor re-reads the last round. Rounds end
    when one has changed no label, however many that takes; only the last two are kept. `salts`
    follows from the number of shuffle partitions unless given, never from the data.

    The number of changed labels is observed while they are written. A task that runs twice
    may be counted twice, but a count of zero is always true.
    """
    salts = salts or salt_count(ws.spark)
    nearest = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    first = nodes.join(nearest, "node", "left").selectExpr(
        "node", "least(node, near) AS root", "node AS prev"
    )
    paths = [ws.path("labels")]
    labels = ws.save_at(paths[0], first)
    changed = True
    while changed:
        seen = Observation()
        step = ws.spark.sql(_ROUND.format(salts=salts), labels=labels, edges=edges)
        paths.append(ws.path("labels"))
        labels = ws.save_at(
            paths[-1], step.observe(seen, F.count_if(F.col("root") != F.col("prev")).alias("n"))
        )
        changed = seen.get["n"] > 0
        if len(paths) > 2:
            ws.drop(paths.pop(0))
    return labels.select("node", "root")
