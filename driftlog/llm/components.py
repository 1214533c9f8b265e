"""Connected components of a graph of any size, by random contraction.

In each round every node moves to the neighbour, or itself, of the smallest hash under that round's seed;
edges between the places that nodes moved to are the next round's graph. Each round leaves a fraction of
the nodes on average, whatever the graph's shape, so the number of rounds grows with the logarithm of
the graph. Every round is written to the shared folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.shared import Scratch, written

#: edges that go to one task when a round is written
ROWS_A_FILE = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for each node of ``edges`` (``a``, ``b``: long; a written table); equal labels: connected.

    Loops and repeated edges do no harm; rows with a null end are ignored; no edges give no rows.
    """
    files = most = edges.count() // ROWS_A_FILE + 1
    scratch = Scratch(edges.sparkSession)
    now = scratch.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges", files)
    moves: list[DataFrame] = []
    while n := now.count():
        files = min(files, n // ROWS_A_FILE + 1)
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seed = F.lit(len(moves))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("v"))).alias("near"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("v"))
        move = scratch.written(near.select(F.col("a").alias("node"), F.least("near", own).getField("v").alias("label")), "cc-moves", files)
        moves.append(move)
        to_a, to_b = move.select(F.col("node").alias("a"), F.col("label").alias("x")), move.select(F.col("node").alias("b"), F.col("label").alias("y"))
        ends = now.join(to_a, "a").join(to_b, "b").where("x <> y")
        now = scratch.written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges", files)
    if not moves:
        scratch.drop()
        return edges.sparkSession.createDataFrame([], "node long, label long")
    out = moves[0]
    for move in moves[1:]:
        later = move.select(F.col("node").alias("label"), F.col("label").alias("further"))
        out = out.join(later, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    out = written(out, "cc-labels", most)
    scratch.drop()
    return out
