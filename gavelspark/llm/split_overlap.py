"""Problem 1: records that occur in two splits, exactly or almost.

Each query is reduced to winnowing fingerprints: of every ``WINDOW`` consecutive hashes of ``RUN`` tokens the
smallest is kept, so two queries with RUN + WINDOW - 1 tokens in a row in common share one. Fingerprints of the
same language are joined between the splits, the shared ones of a pair are chained in order of their places,
the seeds of the chain are extended token by token, and the exact similarity of queries and candidates decides.
Very short queries are fingerprinted by all their shingles.

Fingerprints that would pair more than ``MAX_PRODUCT`` records (stock phrases) are not joined; records that have
few others are joined with all records by an exact second way, the prefix filter over all shingles. Identical records form a class that
is compared once. Only counts, fingerprints and the records of candidate pairs are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gavelspark.llm import shingles as S
from gavelspark.llm.prefix_filter import few_to_all
from gavelspark.llm.token_budget import canonical
from gavelspark.session import checked_broadcast, materialize

RUN, WINDOW = 5, 4
#: Queries with at most so many shingles are also listed under each of them.
SHORT = 40
MAX_PRODUCT = 48
#: Fewest seeds in the chain of a pair (one is enough for short queries).
LEAST_CHAIN = 2
#: Records with at most so many, or this share, of their fingerprints outside the stock phrases take the second way.
#: A pair is left to the fingerprints only if both records have more; scattered edits at similarity 0.6 leave about 0.4 of its own to each.
FEW, FEW_SHARE = 10, 0.65
_SEEDS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
_SHORT_SALT = np.uint64(0x5851F42D4C957F2D)


def winnow(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the fingerprints, a hash once per text, and the number of shingles of each text."""
    h, owner, place = S.runs(flat, counts, RUN)
    keep = np.zeros(len(h), bool)
    n = len(h) - WINDOW + 1
    if n > 0:
        least = np.arange(n)
        for k in range(1, WINDOW):
            least = np.where(h[k : k + n] <= h[least], np.arange(k, k + n), least)
        keep[least[owner[:n] == owner[WINDOW - 1 :]]] = True
    keep |= np.bincount(owner, minlength=len(counts))[owner] < WINDOW
    h, owner, place = h[keep], owner[keep], place[keep]
    s, s_owner, s_place = S.runs(flat, counts, S.SHINGLE)
    s, s_owner, s_place = _once(s, s_owner, s_place)
    sizes = np.bincount(s_owner, minlength=len(counts))
    short = sizes[s_owner] <= SHORT
    h, owner, place = (np.concatenate(x) for x in ((h, S.scramble(s[short] ^ _SHORT_SALT)), (owner, s_owner[short]), (place, s_place[short])))
    return *_once(h, owner, place), sizes


def _once(h: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((place, h, owner))
    h, owner, place = h[order], owner[order], place[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], owner[first], place[first]


def _fingerprinter(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in S.sliced(batches, 3, 4):
            ids, train, language, queries, candidates = batch.columns
            flat, counts = S.flat_hashes(texts)
            h, owner, place, sizes = winnow(flat, counts)
            salts = np.array([xxhash.xxh3_64_intdigest(x) for x in language.to_pylist()], np.uint64)
            h = S.scramble(h ^ salts[owner]).view(np.int64) if len(h) else h.view(np.int64)
            per = np.bincount(owner, minlength=len(texts))
            offsets = pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32())
            keys = _keys(flat, counts, candidates.to_pylist(), train.to_pylist(), language.to_pylist())
            marks = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(h), pa.array(place, pa.int32()))]
            out = [ids.cast(id_type), train, pa.array(keys, pa.binary()), language, pa.array(sizes, pa.int32()), *marks, queries, candidates]
            yield pa.RecordBatch.from_arrays(out, names=["id", "train", "cls", "language", "n", "marks", "places", "query", "candidates"])

    return run


def _keys(flat: np.ndarray, counts: np.ndarray, groups: list, train: list, language: list) -> list[bytes]:
    ends = np.cumsum(counts)
    programs = [p for g in groups for p in g or ()]
    inner, inner_counts = S.flat_hashes(programs)
    inner_ends = np.cumsum(inner_counts)
    keys, at = [], 0
    for i, g in enumerate(groups):
        h = xxhash.xxh3_128(flat[ends[i] - counts[i] : ends[i]].tobytes())
        h.update(f"{train[i]}|{language[i]}|{len(g) if g is not None else -1}".encode())
        for p in g or ():
            h.update(b"|" if p is None else inner[inner_ends[at] - inner_counts[at] : inner_ends[at]].tobytes() + b"|.")
            at += 1
        keys.append(h.digest())
    return keys


def chain(pa_: np.ndarray, pb: np.ndarray) -> list[tuple[int, int]]:
    """The longest chain of seeds (place in a, place in b) that ascends in both."""
    seeds = sorted(zip(pa_, pb), key=lambda s: (s[0], -s[1]))
    tails, at, back = [], [], [-1] * len(seeds)
    for i, (_, b) in enumerate(seeds):
        k = bisect_left(tails, b)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append((int(seeds[i][0]), int(seeds[i][1])))
        i = back[i]
    return out[::-1]


def extend(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> tuple[int, int]:
    """Number of tokens of a and of b that lie in the seeds or in their extensions by equal tokens."""
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i, j in seeds:
        if i < len(a) and j < len(b) and a[i] == b[j] and not (in_a[i] and in_b[j]):
            lo = 0
            while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            hi = 1
            while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
                hi += 1
            in_a[i - lo : i + hi] = True
            in_b[j - lo : j + hi] = True
    return int(in_a.sum()), int(in_b.sum())


def common_seeds(a: str, b: str) -> list[tuple[int, int]]:
    """The chain of all fingerprints, stock ones too, that a and b share; of their shingles if they share no fingerprint."""
    flat, counts = S.flat_hashes([a, b])
    for h, owner, place in (winnow(flat, counts)[:3], _once(*S.runs(flat, counts, S.SHINGLE))):
        _, i, j = np.intersect1d(h[owner == 0], h[owner == 1], assume_unique=True, return_indices=True)
        if len(i):
            return chain(place[owner == 0][i], place[owner == 1][j])
    return []


@F.pandas_udf(_SEEDS)
def _chained(seeds: pd.Series) -> pd.Series:
    out = []
    for s in seeds:
        found = chain([x["i"] for x in s], [x["j"] for x in s]) if len(s) else []
        out.append([{"i": i, "j": j} for i, j in found])
    return pd.Series(out)


def _seeded_pairs(reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a in train, b outside) and the dids of the second way, from reps (did, train, n, marks, places)."""
    posts = reps.select("did", "train", "n", F.arrays_zip("marks", "places").alias("z")).select("did", "train", "n", F.explode("z").alias("z")).select("did", "train", "n", F.col("z.marks").alias("v"), F.col("z.places").alias("at"))
    sides = posts.groupBy("v").agg(F.sum(F.col("train").cast("long")).alias("t"), F.count("*").alias("all"))
    stock = sides.where(F.col("t") * (F.col("all") - F.col("t")) > MAX_PRODUCT).select("v")
    stock = checked_broadcast(materialize(stock, "stock"))
    rest = posts.join(stock, "v", "left_anti")
    a = rest.where("train").select("v", F.col("did").alias("a"), F.col("at").alias("i"), F.col("n").alias("na"))
    b = rest.where("not train").select("v", F.col("did").alias("b"), F.col("at").alias("j"), F.col("n").alias("nb"))
    seeds = F.collect_list(F.struct("i", "j"))
    by_size = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    pairs = a.join(b, "v").where(by_size).groupBy("a", "b").agg(seeds.alias("seeds"), F.min(F.least("na", "nb")).alias("n"))
    pairs = pairs.where((F.size("seeds") >= LEAST_CHAIN) | (F.col("n") <= SHORT)).withColumn("seeds", _chained("seeds"))
    pairs = pairs.where((F.size("seeds") >= LEAST_CHAIN) | (F.col("n") <= SHORT)).select("a", "b")
    marks = posts.join(stock, "v").groupBy("did").agg(F.count("*").alias("stock"))
    sizes = reps.select("did", F.size("marks").alias("marks"))
    left = F.col("marks") - F.col("stock")
    few = marks.join(sizes, "did").where((left <= FEW) | (left <= F.col("marks") * FEW_SHARE)).select("did")
    return pairs, few


def _judge(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            similar = S.similarities(list(f.qa), list(f.qb), threshold)
            f = f.assign(similarity=similar)[similar >= threshold]
            f = f[np.array([len(x) > 0 and len(y) > 0 for x, y in zip(f.ca, f.cb)], bool)]
            left, right, spans = [], [], []
            for x, y in zip(f.ca, f.cb):
                spans.append((len(left), len(x), len(y)))
                for p in x:
                    left += [p] * len(y)
                    right += list(y)
            close = S.similarities(left, right, threshold) >= threshold
            keep, coverage = [], []
            for (start, m, n), qa, qb in zip(spans, f.qa, f.qb):
                grid = close[start : start + m * n].reshape(m, n)
                a, b = int(grid.any(axis=1).sum()), int(grid.any(axis=0).sum())
                keep.append((m > n or 2 * a >= m) and (n > m or 2 * b >= n))
                ta, tb = S.tokens(qa), S.tokens(qb)
                coverage.append(extend(ta, tb, common_seeds(qa, qb))[1] / max(1, len(tb)))
            f = f.assign(coverage=coverage)[np.array(keep, bool)] if len(f) else f.assign(coverage=[])
            yield f[["a", "b", "similarity", "coverage"]]

    return run


def split_overlaps(lists: DataFrame, names: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs of lists, one in split train and one outside, that are the same or nearly so.

    ``lists`` has list_id, split, language, query, candidates; ``names`` the spellings of languages. Returns
    (train_id, other_id, similarity, coverage): similarity of the queries, and the share of the other list's
    query that lies in seeds extended by equal tokens. Both lists have the same canonical language, similarity of at
    least ``threshold``, and at least half the candidates of the one with fewer (of both, if equally many) have
    a counterpart of such similarity. Null languages, null or blank queries and lists without candidates match
    nothing; a null candidate counts as an entry without counterpart; a null split is not train. Deliveries of
    the same list count once; if they differ, the one with the smallest content key counts. An empty table gives
    no rows; other columns are not read. Every copy of a record is written out, on
    both sides: a class of m records that overlaps one of n gives m n rows.
    """
    known = canonical(F.col("language"), names, lists.select("list_id", "split", "language", "query", "candidates"), "language").where("language is not null and query is not null and list_id is not null")
    known = known.select("list_id", F.coalesce(F.col("split") == "train", F.lit(False)).alias("train"), "language", "query", "candidates")
    id_field, texts = known.schema["list_id"], T.ArrayType(T.StringType())
    made = [("id", id_field.dataType), ("train", T.BooleanType()), ("cls", T.BinaryType()), ("language", T.StringType()), ("n", T.IntegerType()), ("marks", T.ArrayType(T.LongType(), False)), ("places", T.ArrayType(T.IntegerType(), False)), ("query", T.StringType()), ("candidates", texts)]
    table = known.mapInArrow(_fingerprinter(to_arrow_type(id_field.dataType)), T.StructType([T.StructField(c, t) for c, t in made])).where("n > 0")
    table = materialize(table.withColumn("did", F.monotonically_increasing_id()), "marks")
    slim = table.select("did", "id", "cls")
    best = slim.groupBy("id").agg(F.min(F.struct("cls", "did")).alias("best"), F.count("*").alias("rows"))
    extra = materialize(slim.join(best.where("rows > 1"), "id").where("did <> best.did").select("did"), "extra")
    extra = checked_broadcast(extra)
    slim, table = slim.join(extra, "did", "left_anti"), table.join(extra, "did", "left_anti")
    classes = slim.groupBy("cls").agg(F.min(F.struct("did", "id")).alias("rep"), F.max("did").alias("last"))
    copies = materialize(classes.where("rep.did <> last").select("cls", "rep"), "copies")
    copied = materialize(slim.join(checked_broadcast(copies), "cls").select("did", "id", F.col("rep.id").alias("rep"), F.col("rep.did").alias("rep_did")), "copied")
    others = checked_broadcast(copied.where("did <> rep_did").select("did"))
    reps = table.join(others, "did", "left_anti")
    pairs, few = _seeded_pairs(reps, threshold)
    pairs, few = materialize(pairs, "seeded"), materialize(few, "few")
    if not few.isEmpty():
        more = few_to_all(reps.select("did", F.col("language").alias("salt"), F.col("query").alias("text")), few, threshold)
        sides = reps.select("did", "train")
        more = more.join(sides.select(F.col("did").alias("a"), F.col("train").alias("x")), "a").join(sides.select(F.col("did").alias("b"), F.col("train").alias("y")), "b").where("x <> y")
        more = more.select(F.when(F.col("x"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("x"), F.col("b")).otherwise(F.col("a")).alias("b"))
        pairs = materialize(pairs.union(more).distinct(), "allseeded")
    wanted = checked_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("did")).distinct())
    content = materialize(reps.join(wanted, "did", "left_semi").select("did", "id", "query", "candidates"), "content")
    side = lambda x: content.select(F.col("did").alias(x), F.col("query").alias(f"q{x}"), F.coalesce("candidates", F.array().cast("array<string>")).alias(f"c{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "qa", "qb", "ca", "cb")
    found = joined.mapInPandas(_judge(threshold), "a long, b long, similarity double, coverage double")
    for x in "ab":
        found = found.join(content.select(F.col("did").alias(x), F.col("id").alias(f"i{x}")), x)
    found = found.select(F.col("ia").alias("train_id"), F.col("ib").alias("other_id"), "similarity", "coverage")
    for x in ("train_id", "other_id"):
        found = found.join(copied.select(F.col("rep").alias(x), F.col("id").alias("copy")), x, "left").withColumn(x, F.coalesce("copy", x)).drop("copy")
    return found


def _abouts(lists: DataFrame) -> DataFrame:
    """(other_id, split, source) of each list; of differing deliveries the smallest (split, source) counts."""
    return lists.where("list_id is not null").groupBy("list_id").agg(F.min(F.struct("split", "source")).alias("r")).select(F.col("list_id").alias("other_id"), "r.split", "r.source")


def overlap_report(overlaps: DataFrame, lists: DataFrame) -> DataFrame:
    """Overlaps per split and source of the list outside train: lists and pairs. Null split and source are slices of their own."""
    return overlaps.join(_abouts(lists), "other_id").groupBy("split", "source").agg(F.countDistinct("other_id").alias("lists"), F.count("*").alias("pairs"))


def coverage_report(overlaps: DataFrame, lists: DataFrame) -> DataFrame:
    """(list_id, split, source, partners, similarity, coverage) of each list outside train that overlaps: lists of
    train that it overlaps, the highest similarity of the queries, and the largest share of its query that one of them covers."""
    once = overlaps.groupBy("other_id").agg(F.count("*").alias("partners"), F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"))
    return once.join(_abouts(lists), "other_id").select(F.col("other_id").alias("list_id"), "split", "source", "partners", "similarity", "coverage")
