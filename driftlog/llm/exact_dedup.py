"""Exact duplicates by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted by content on disk within partitions,
and each row is compared in full with its neighbour. Splitters are samples of a bounded key, never of whole
texts: head of the normalised text, its SHA-256, length of the original descending, id. The head keeps the
order of content; among texts with one head the digest deals, so that equal texts are in one stretch of
partitions, the row that stays comes first, and a group of any size is cut like any other stretch of rows:
no partition holds it alone. Within a partition rows are sorted by the whole text, length and id. Runs at
the ends of partitions are stitched by comparing their texts in full: two of a partition take part.

Defined results: null text counts as empty; all empty texts are one group; repeated rows with one id are
rows like any other and one of them stays; a null id sorts after all ids; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.shared import arrow_batches, id_and_text, tidy, written

#: characters of a text in the key of a splitter
HEAD_CHARS = 48
#: runs that may be broadcast
SMALL = 400_000
_ROWS = "doc_id long, text_sha256 binary, part int, run int, head boolean, edge string, keep_id long, size long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the run of equal texts each belongs to."""
    import numpy as np

    part, ids, digests, fresh, first_text, last = TaskContext.get().partitionId(), [], [], [], None, None
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column("norm")
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = pc.not_equal(text.slice(1), text.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or text[0].as_py() != last
        first_text = text[0].as_py() if first_text is None else first_text
        last = text[-1].as_py()
        ids.append(b.column("doc_id"))
        digests.append(b.column("sha"))
        fresh.append(new)
    if not ids:
        return
    doc_id, sha, new = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(digests).combine_chunks(), np.concatenate(fresh)
    run = np.cumsum(new) - 1
    first, size = np.flatnonzero(new), np.bincount(run)
    # whole texts go on only with the first row of the first and of the last run
    edge = pa.chunked_array([pa.array([first_text], pa.string()), pa.nulls(max(0, len(run) - 1), pa.string())]).combine_chunks()
    if run[-1]:
        at = int(first[-1])
        edge = pa.concat_arrays([edge.slice(0, at), pa.array([last], pa.string()), edge.slice(at + 1)])
    out = pa.record_batch(
        {
            "doc_id": doc_id, "text_sha256": sha, "part": pa.array(np.full(len(run), part, np.int32)), "run": pa.array(run.astype(np.int32)), "head": pa.array(new),
            "edge": edge, "keep_id": doc_id.take(pa.array(first[run])), "size": pa.array(size[run].astype(np.int64)),
        }
    )
    for at in range(0, out.num_rows, 50_000):
        yield out.slice(at, 50_000)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` (hex)."""
    arrow_batches(docs.sparkSession)
    # one pattern for a whole run of white space: fewer matches than one for each character
    d = id_and_text(docs).select("doc_id", F.length("text").alias("n"), F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("norm"))
    d = d.select("doc_id", (-F.col("n")).alias("less"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm", F.substring("norm", 1, HEAD_CHARS).alias("lead"))
    key = [F.col("lead"), F.col("sha"), F.col("less"), F.col("doc_id").asc_nulls_last()]
    placed = d.repartitionByRange(*key).sortWithinPartitions("norm", "less", F.col("doc_id").asc_nulls_last())
    rows = written(placed.select("doc_id", "sha", "norm").mapInArrow(tidy(_runs), _ROWS), "content-runs")
    # runs at the ends of partitions, at most two from each, are grouped by their texts
    edges = rows.where("edge IS NOT NULL").select("edge", "part", "run", "keep_id", "size")
    whole = edges.groupBy("edge").agg(F.min_by(F.struct("part", "keep_id"), "part").alias("first"), F.sum("size").alias("whole"), F.count("*").alias("pieces")).where("pieces > 1")
    crossing = written(edges.join(whole, "edge").select("part", "run", "first", "whole"), "crossing-runs", 1)
    if crossing.count() <= SMALL:
        crossing = F.broadcast(crossing)
    return rows.join(crossing, ["part", "run"], "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("keep_id")).otherwise(F.col("first.keep_id")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("head") & (F.col("first").isNull() | (F.col("first.part") == F.col("part")))).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )
