"""Exact similarity candidates by the prefix filter: the second way of problem 1.

Shingles are ordered from rare to common; two texts of similarity t must share one among the first (1 - t) of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm import shingles as S
from gavelspark.llm.near_duplicates import sketch_batch
from gavelspark.session import checked_broadcast, materialize

#: Counters of the order (a power of two); shingles on one counter share a place in the order, which stays exact.
COUNTERS = 1 << 24


def _prefixer(counts, threshold: float):
    """Rows (did, salt, text) to (did, n, v, at): the prefix of each text, without shingles that no counted text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch, held in S.sliced(batches, 2):
            sizes, _, found = sketch_batch(held, 1 << 62)
            if not sizes.sum():
                continue
            owner = np.repeat(np.arange(len(sizes)), sizes)
            v = salted(np.concatenate(found), owner, batch.column(1).to_pylist())
            seen = table[v & (len(table) - 1)]
            order = np.lexsort((v, seen, owner))
            v, seen = v[order], seen[order]
            place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            n = sizes[owner]
            keep = (seen > 0) & (place <= n - np.ceil(n * threshold - 1e-9) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(n[keep], pa.int32()), pa.array(v[keep]), pa.array(place[keep], pa.int32())], ["did", "n", "v", "at"])

    return run


def salted(values: np.ndarray, owner: np.ndarray, salts: list[str | None]) -> np.ndarray:
    """Values of the texts ``owner``; texts with different salts share none."""
    salt = np.array([xxhash.xxh3_64_intdigest(x) if x is not None else 0 for x in salts], np.uint64)
    return (S.scramble(values.view(np.uint64) ^ salt[owner]) >> np.uint64(16)).view(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, held in S.sliced(batches, 1):
        sizes, _, found = sketch_batch(held, 1 << 62)
        if sizes.sum():
            v = salted(np.concatenate(found), np.repeat(np.arange(len(sizes)), sizes), batch.column(0).to_pylist())
            slots, seen = np.unique(v & (COUNTERS - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(seen, pa.int64())], ["slot", "seen"])


def few_to_all(texts: DataFrame, few: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) that can reach ``threshold`` of one of the ``few`` dids and any did of ``texts``, both ways round.

    ``texts`` has (did, salt, text), a did once; texts of different salt do not pair. Exact: the prefix filter holds for
    every fixed order of the shingles. Only the prefixes leave the scan, and of them only shingles that one of the few
    may have: a text whose first places are all taken by others resembles none of them. The counters have a fixed size.
    """
    few = checked_broadcast(few)
    few_texts = texts.join(few, "did", "left_semi").select("salt", "text")
    seen = few_texts.mapInArrow(_counter, "slot int, seen long").groupBy("slot").agg(F.least(F.sum("seen"), F.lit((1 << 31) - 1)).cast("int").alias("seen")).toArrow()
    table, much = np.zeros(COUNTERS, np.uint8), seen["seen"].to_numpy()
    # one byte a counter: exact up to 128, then eight steps for each doubling
    table[seen["slot"].to_numpy()] = np.minimum(255, np.where(much <= 128, much, 128 + np.floor(8 * np.log2(np.maximum(much, 128) / 128))))
    counts = texts.sparkSession.sparkContext.broadcast(table)
    posts = texts.select("did", "salt", "text").mapInArrow(_prefixer(counts, threshold), "did long, n int, v long, at int")
    posts = materialize(posts.join(few.withColumn("few", F.lit(True)), "did", "left"), "prefixes")
    a = posts.where("few").select("v", F.col("did").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    b = posts.select("v", F.col("did").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    # the first common shingle and all after it must make up the overlap that the threshold asks for
    enough = (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) * (1 + threshold) >= (F.col("na") + F.col("nb")) * threshold - 1e-6
    by_size = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    return a.join(b, "v").where((F.col("a") != F.col("b")) & by_size & enough).select("a", "b").distinct()
