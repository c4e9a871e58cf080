"""Problem 5: near-duplicate texts by bottom-k sketches.

One hash function orders the shingles of every text; a text keeps its ``K`` smallest (its sketch). Texts with
equal token sequences form a class with one representative. An inverted list per retained value generates
overlaps between representatives, the ``K`` smallest values of the union of both sketches estimate the
similarity, and the exact Jaccard index decides. An estimate may lie ``DEVIATIONS`` standard deviations under the threshold.

A value on more than ``MAX_LIST`` sketches is common (boilerplate, or a large family of variants): its list would
pair quadratically many texts and is not joined. A pair that the estimate lets pass shares a least number of
values; if at most one of them is not common, the common ones make up the rest. So the common values of a
sketch are ordered from rare to frequent, and the pair must share two of the first few of each (prefix filter):
these twos are lists of their own, much shorter than those of single values. Nothing that the estimate would
pass is lost.

Skew: values are counted with map-side combining, and long lists leave before the join; no group is collected. Lineage is cut by tables in the shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gavelspark.llm import shingles as S
from gavelspark.session import checked_broadcast, materialize

#: Size of a sketch.
K = 24
#: Longest inverted list of a single value that is joined with itself.
MAX_LIST = 16
#: An estimate from K values may lie so many standard deviations under the threshold.
DEVIATIONS = 2.5
_VALUE_BITS = np.uint64(48)
_NONE = np.int64(1) << np.int64(62)


def sketch_batch(texts: list[str | None], k: int) -> tuple[np.ndarray, list[bytes | None], list[np.ndarray]]:
    """Number of shingles, key of the token sequence (null without shingles) and bottom-k sketch of each text.

    Values are the upper 48 bits of the shingle hash, so that one sort orders a batch by text and value.
    """
    flat, counts = S.flat_hashes(texts)
    h, owner, _ = S.runs(flat, counts, S.SHINGLE)
    both = np.sort((owner.astype(np.uint64) << _VALUE_BITS) | (h >> np.uint64(16)))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    sizes = np.bincount((both >> _VALUE_BITS).astype(np.int64), minlength=len(texts))
    values = (both & np.uint64((1 << 48) - 1)).view(np.int64)
    starts = np.cumsum(sizes) - sizes
    stops = np.cumsum(counts)
    sketches = [values[b : b + min(s, k)] for s, b in zip(sizes, starts)]
    keys = [xxhash.xxh3_128_digest(flat[e - c : e].tobytes()) if s else None for s, c, e in zip(sizes, counts, stops)]
    return sizes, keys, sketches


def _sketcher(ids: list[str], k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in S.sliced(batches, len(ids)):
            sizes, keys, sketches = sketch_batch(texts, k)
            keep = np.flatnonzero(sizes > 0)
            if not len(keep):
                continue
            kept = [sketches[i] for i in keep]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in kept]))), pa.int32())
            rows = batch.take(pa.array(keep))
            columns = [rows.column(i) for i in range(len(ids))]
            columns += [pa.array([keys[i] for i in keep], pa.binary()), pa.array(sizes[keep]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept), pa.int64())), rows.column(len(ids))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def sketches(df: DataFrame, ids: list[str], text: str, k: int = K) -> DataFrame:
    """(ids, cls, n, sketch, text) of every text that has a shingle; n is the number of its shingles."""
    made = [("cls", T.BinaryType()), ("n", T.IntegerType()), ("sketch", T.ArrayType(T.LongType(), False)), ("text", T.StringType())]
    out = T.StructType([*(df.schema[c] for c in ids), *(T.StructField(c, t) for c, t in made)])
    return df.select(*ids, text).mapInArrow(_sketcher(ids, k, to_arrow_schema(out)), out)


def least_estimate(threshold: float, k: int = K) -> float:
    """The least estimate of the similarity, from k values, that a pair of similarity ``threshold`` may have."""
    return max(threshold / 4, threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / k))


def estimates(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Share of the k smallest values of the union of sketches a[i] and b[i] (ascending) that are in both."""
    rows = []
    for side in (a, b):
        sizes = np.fromiter(map(len, side), np.int64, len(side))
        table = np.full((len(side), k), _NONE)
        table[np.arange(k) < sizes[:, None]] = np.concatenate([np.zeros(0, np.int64), *side])
        rows.append(table)
    both = np.sort(np.concatenate(rows, axis=1), axis=1)
    held = both < _NONE
    new = np.ones_like(held)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    place = np.cumsum(new, axis=1)
    shared = (~new & held & (place <= k)).sum(axis=1)
    return shared / np.maximum(1, np.minimum(k, (new & held).sum(axis=1)))


def _estimated(least: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 12):
                batch = whole.slice(at, 1 << 12)
                sides = [[np.asarray(x.values) for x in batch.column(c)] for c in ("x", "y")]
                yield batch.select(["a", "b"]).filter(pa.array(estimates(*sides, k) >= least - 1e-9))

    return run


def _candidates(reps: DataFrame, threshold: float, max_list: int, k: int) -> DataFrame:
    """Pairs (a, b), a < b, of reps (did, n, sketch) that share as many values as the least estimate asks for, or may do so."""
    least = least_estimate(threshold, k)
    # values that a text shares with each text that resembles it; the larger text of a pair asks for more
    need = lambda n: F.ceil(F.least(n, F.lit(k)) * least - 1e-9)
    by_size = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    posts = reps.select("did", "n", F.explode("sketch").alias("v"))
    # numbered from rare to frequent, so that numbers stand for values and their order
    common = posts.groupBy("v").agg(F.count("*").alias("df")).where(F.col("df") > max_list).orderBy("df", "v").select("v", F.monotonically_increasing_id().alias("number"))
    common = checked_broadcast(materialize(common, "common"))

    rest = posts.join(common, "v", "left_anti")
    a, b = (rest.select("v", F.col("did").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    # where one value is enough it counts twice
    weight = F.when(need(F.greatest("na", "nb")) <= 1, 2).otherwise(1)
    listed = a.join(b, "v").where((F.col("a") < F.col("b")) & by_size).groupBy("a", "b").agg(F.sum(weight).alias("shared")).where("shared >= 2")
    hot = materialize(posts.join(common, "v").groupBy("did", "n").agg(F.sort_array(F.collect_list("number")).alias("hot")), "hot")
    held = reps.select("did", "n").join(hot.select("did", F.size("hot").alias("h")), "did", "left").select("did", "n", F.coalesce("h", F.lit(0)).alias("h"))
    for x in "ab":
        listed = listed.join(held.select(F.col("did").alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}")), x)
    listed = listed.where(F.col("shared") + F.least("ha", "hb") >= need(F.greatest("na", "nb"))).select("a", "b")

    # all but one of the needed values are common ones
    left = F.greatest(need(F.col("n")) - 1, F.lit(1))
    first = lambda more: F.slice("hot", 1, F.greatest(F.size("hot") - F.col("left") + more, F.lit(0)).cast("int"))
    twos = F.flatten(F.transform(first(2), lambda x, i: F.transform(F.slice(first(2), i + 2, F.size("hot")), lambda y: F.xxhash64(x, y))))
    small = math.floor(math.floor(2 / least + 1e-9) / threshold + 1e-9)
    ones = F.when(F.col("n") <= small, first(1)).otherwise(F.array().cast("array<bigint>"))
    keyed = hot.withColumn("left", left).where("size(hot) >= left").select("did", "n", "left", F.transform("hot", lambda x: F.pmod(x, F.lit((1 << 31) - 1)).cast("int")).alias("hot"), F.concat(ones, F.when(F.col("left") >= 2, twos).otherwise(F.array().cast("array<bigint>"))).alias("keys"))
    keyed = keyed.select("did", "n", "left", "hot", F.explode("keys").alias("v"))
    a, b = (keyed.select("v", *[F.col(c).alias(f"{c}{x}") for c in ("did", "n", "left", "hot")]).withColumnRenamed(f"did{x}", x) for x in "ab")
    enough = F.size(F.array_intersect("hota", "hotb")) >= F.greatest("lefta", "leftb")
    return listed.union(a.join(b, "v").where((F.col("a") < F.col("b")) & by_size & enough).select("a", "b")).distinct()


def _similarity(threshold: float):
    @F.pandas_udf(T.DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(S.similarities(list(a), list(b), threshold), dtype="float64")

    return similarity


def near_duplicates(df: DataFrame, ids: list[str], text: str, threshold: float = 0.6, max_list: int = MAX_LIST, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes of the texts of ``df``.

    Returns ``links``: pairs (a, b, similarity) of class representatives, a < b, each a struct of the id
    columns, with exact similarity of at least ``threshold``; and ``members``: (id, rep) of every text that
    has a shingle. Texts that are null, empty or shorter than three tokens resemble nothing and are in
    neither; an empty table gives empty results. Repeated rows count once; an id that comes with several
    texts is taken with the one whose class key is smallest, and that text is the one compared. Null ids are ids like
    any other. Further columns of ``df``, whatever their names, are not read.
    """
    one = F.struct(*ids)
    table = materialize(sketches(df, ids, text, k).withColumn("did", F.monotonically_increasing_id()), "sketches")
    slim = table.select("did", "cls", one.alias("id"))
    clash = materialize(slim.groupBy("id").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most").select("id", "least"), "clash")
    if not clash.isEmpty():
        lost = slim.join(checked_broadcast(clash), slim["id"].eqNullSafe(clash["id"])).where("cls <> least").select("did")
        lost = checked_broadcast(materialize(lost, "lost"))
        slim, table = slim.join(lost, "did", "left_anti"), table.join(lost, "did", "left_anti")
    classes = slim.groupBy("cls").agg(F.min(F.struct("did", "id")).alias("rep"), F.max("did").alias("last"))
    copies = materialize(classes.where("rep.did <> last").select("cls", "rep"), "copies")
    members = slim.join(checked_broadcast(copies), "cls", "left").select("did", "id", F.coalesce("rep.id", "id").alias("rep"), F.coalesce("rep.did", "did").alias("rep_did"))
    others = checked_broadcast(materialize(members.where("did <> rep_did").select("did"), "others"))
    reps = table.join(others, "did", "left_anti")
    pairs = materialize(_candidates(reps.select("did", "n", "sketch"), threshold, max_list, k), "candidates")

    # 31 bits keep the order and tell the values of two sketches apart
    table = table.withColumn("short", F.transform("sketch", lambda v: F.shiftright(v, 17).cast("int")))

    def joined(pairs: DataFrame, column: str) -> DataFrame:
        wanted = checked_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("did")).distinct())
        some = table.join(wanted, "did", "left_semi").select("did", *ids * (column == "text"), column)
        for side, to in (("a", "x"), ("b", "y")):
            pairs = pairs.join(some.select(F.col("did").alias(side), *[one.alias(f"i{side}")] * (column == "text"), F.col(column).alias(to)), side)
        return pairs

    close = joined(pairs, "short").select("a", "b", "x", "y").mapInArrow(_estimated(least_estimate(threshold, k), k), "a long, b long")
    close = materialize(close, "estimated")
    checked = joined(close, "text").select("ia", "ib", _similarity(threshold)("x", "y").alias("similarity"))
    links = checked.where(F.col("similarity") >= threshold).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
    return links, members.select("id", "rep").distinct()


def expand(links: DataFrame, members: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs (a, b) of texts, a < b: links between all members of classes and the copies within them.

    A class is one token sequence, so its members may differ in case and layout. With a ``limit`` the representative
    of a class of more members stands for all in links to other texts, and each copy is paired with it only."""
    copies = members.where(F.col("id") != F.col("rep"))
    sizes = copies.groupBy("rep").agg(F.count("*").alias("copies"))
    few = copies if limit is None else copies.join(sizes.where(F.col("copies") < limit).select("rep"), "rep")
    side = lambda x: few.select(F.col("rep").alias(x), F.col("id").alias(f"{x}_copy"))
    every = lambda x: F.explode(F.array_compact(F.array_append(F.coalesce(f"{x}_all", F.array()), F.col(x))))
    lists = {x: side(x).groupBy(x).agg(F.collect_list(f"{x}_copy").alias(f"{x}_all")) for x in "ab"}
    across = links.select("a", "b").join(lists["a"], "a", "left").select("b", every("a").alias("a")).join(lists["b"], "b", "left").select("a", every("b").alias("b"))
    star = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    within = few.select("rep", F.col("id").alias("a")).join(few.select("rep", F.col("id").alias("b")), "rep").select("a", "b").where("a < b")
    pairs = across.select("a", "b")
    every = pairs.union(star).union(within)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def flat(pairs: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """Pairs of structs as plain columns named id_a, id_b."""

    def parts(x: str) -> list[Column]:
        return [F.col(f"{x}.{c}").alias(f"{n}_{x}") for c, n in zip(ids, names)]

    return pairs.select(*parts("a"), *parts("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node that it is connected with.

    Alternating large and small stars: each round hangs the neighbours of a node on the smallest of them, until
    nothing changes; the number of rounds grows with the logarithm of the longest chain. A round is two
    aggregations and two joins on nodes, no neighbourhood is collected, and its edges are a table in the shared folder.
    """
    now = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "star")
    seen = None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        below = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(below, "u")
        hung = small.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(small.select("m", "u"))
        now = materialize(hung.where("lo <> hi").distinct(), "star")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rep, root, links) of every text: its class, its group of near-same texts, and links of its class to other classes."""
    links = materialize(links.select("a", "b"), "links")
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    about = roots.join(degree, "node").withColumnRenamed("node", "rep")
    return members.join(about, "rep", "left").select("id", "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
