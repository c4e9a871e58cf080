"""Problems 1 and 5 against brute force, and the cases that every operator must bear."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.llm import near_duplicates as nd
from gavelspark.llm import prefix_filter
from gavelspark.llm import shingles as S
from gavelspark.llm import split_overlap as so

NAMES = [("Py", "python"), ("python", "python"), ("go", "go")]
LISTS = "list_id long, split string, source string, language string, query string, candidates array<string>, cls string, v string"


def variants(rng, count, length=60):
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(length)] for _ in range(count)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(rng.randint(0, 3)):
            c = list(b)
            for _ in range(rng.randint(0, 5)):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return out


def brute(texts, threshold):
    sets = {k: S.shingle_set(t) for k, t in texts.items()}
    return {(a, b) for a in sets for b in sets if a < b and S.jaccard(sets[a], sets[b]) >= threshold}


def found(spark, rows, schema="list_id long, pos int, text string, sketch string, v string"):
    df = spark.createDataFrame(rows, schema)
    links, members = nd.near_duplicates(df, ["list_id", "pos"], "text")
    pairs = nd.expand(links, members)
    return {((r.a.list_id, r.a.pos), (r.b.list_id, r.b.pos)) for r in pairs.collect()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = variants(rng, 60)
    texts += [texts[0], texts[0].upper(), None, "", "   ", "a b", "x y z", "x y z", "é 漢字 ñ ß", "é 漢字 ñ ß"]
    rows = [(i // 3, i % 3, t, "clash", "clash") for i, t in enumerate(texts)]
    got = found(spark, rows + rows[:20])
    assert got == brute({(i // 3, i % 3): t for i, t in enumerate(texts) if t is not None}, 0.6)


def test_families_of_variants_take_the_second_way(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(70):
        c = list(base)
        c[rng.randrange(60)] = f"x{rng.randrange(9)}"
        c[rng.randrange(60)] = f"y{rng.randrange(9)}"
        texts[(i, 0)] = " ".join(c)
    for i, t in enumerate(variants(rng, 20)):
        texts[(100 + i, 0)] = t
    assert found(spark, [(a, b, t, "", "") for (a, b), t in texts.items()]) == brute(texts, 0.6)


def test_families_meet_variants_of_their_own(spark):
    rng = random.Random(1)
    texts = {}
    for f in range(10):
        base = [f"b{f}_{i}" for i in range(100)]
        for i in range(30):
            own = [f"o{f}_{i}_{k}" for k in range(rng.randint(44, 54) if i % 4 == 0 else rng.randint(1, 5))]
            texts[(len(texts), 0)] = " ".join(base + own)
    assert found(spark, [(a, b, t, "", "") for (a, b), t in texts.items()]) == brute(texts, 0.6)


def test_very_long_and_empty(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    got = found(spark, [(1, 0, long, "", ""), (2, 0, long + " end", "", ""), (3, 0, "t1 t2 t3", "", "")])
    assert got == {((1, 0), (2, 0))}
    assert found(spark, []) == set()


def test_large_classes_are_starred(spark):
    rows = [(i, 0, "same program text here", "", "") for i in range(12)]
    df = spark.createDataFrame(rows, "list_id long, pos int, text string, sketch string, v string")
    links, members = nd.near_duplicates(df, ["list_id", "pos"], "text")
    assert nd.expand(links, members, limit=5).count() == 11
    assert nd.expand(links, members, limit=200).count() == 66


def test_large_classes_are_written_out(spark):
    forms = ["Same program text here\n", "same program   text here", "same program text here and"]
    texts = {(i, 0): forms[i % 3 if i < 9 else i % 2] for i in range(230)}
    assert found(spark, [(a, b, t, "", "") for (a, b), t in texts.items()]) == brute(texts, 0.6)


def test_prefix_filter_is_exact(spark):
    rng = random.Random(3)
    texts = dict(enumerate(variants(rng, 30, 25)))
    df = spark.createDataFrame([(i, "s", t) for i, t in texts.items()], "did long, salt string, text string")
    few = spark.createDataFrame([(i,) for i in texts if i % 2], "did long")
    candidates = {(min(r), max(r)) for r in prefix_filter.few_to_all(df, few, 0.6).collect()}
    assert {p for p in brute(texts, 0.6) if p[0] % 2 or p[1] % 2} <= candidates


def test_estimates_take_the_smallest_of_the_union():
    rng = np.random.default_rng(1)
    for k in (4, 24):
        a, b, expected = [], [], []
        for _ in range(200):
            x, y = (set(rng.integers(0, 60, rng.integers(1, 50)).tolist()) for _ in "ab")
            a.append(np.array(sorted(x)[:k]))
            b.append(np.array(sorted(y)[:k]))
            union = sorted(x | y)[:k]
            expected.append(len(set(union) & x & y) / len(union))
        assert nd.estimates(a, b, k) == pytest.approx(expected)


@pytest.mark.parametrize("kind", ["insertion", "scattered", "reordering"])
def test_recall_of_candidates_by_kind_of_edit(kind):
    """Pairs at similarity 0.60 to 0.62: the estimate lets pass at least 98 of 100."""
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 400:
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 160))]
        n = len(a)
        if kind == "insertion":
            at, more = rng.randrange(n), int(n * 0.64)
            b = a[:at] + [f"n{rng.randrange(10**6)}" for _ in range(more)] + a[at:]
        elif kind == "scattered":
            b = list(a)
            for i in rng.sample(range(n), int(n * 0.1)):
                b[i] = f"n{rng.randrange(10**6)}"
        else:
            cuts = [a[i : i + 8] for i in range(0, n, 8)]
            rng.shuffle(cuts)
            b = [w for c in cuts for w in c]
        if 0.6 <= S.jaccard(S.shingle_set(" ".join(a)), S.shingle_set(" ".join(b))) <= 0.62:
            pairs.append((" ".join(a), " ".join(b)))
    sides = [nd.sketch_batch(list(x), nd.K)[2] for x in zip(*pairs)]
    assert (nd.estimates(*sides, nd.K) >= nd.least_estimate(0.6)).mean() >= 0.98


def test_deliveries_that_differ_are_compared_by_the_text_of_their_class(spark):
    rng = random.Random(12)
    texts = [" ".join(f"d{rng.randrange(999)}" for _ in range(50)) for _ in range(8)]
    rows = [(1, 0, texts[0], "", ""), (1, 0, texts[1], "", ""), (2, 0, texts[2], "", ""), (2, 0, texts[3], "", "")]
    rows += [(10 + i, 0, t + " end", "", "") for i, t in enumerate(texts[:4])]
    keys = nd.sketch_batch([r[2] for r in rows[:4]], 1)[1]
    chosen = [min((keys[2 * i], 2 * i), (keys[2 * i + 1], 2 * i + 1))[1] for i in (0, 1)]
    assert found(spark, rows) == {((1, 0), (10 + chosen[0], 0)), ((2, 0), (10 + chosen[1], 0))}


def test_hashed_similarity_is_jaccard():
    rng = random.Random(4)
    texts = variants(rng, 20) + ["", None, "a", "a b c", "Ä_b1 漢字!?"]
    a, b = texts, texts[::-1]
    got = S.similarities(a, b, 0.6)
    assert list(got) == pytest.approx([S.jaccard(S.shingle_set(x), S.shingle_set(y)) for x, y in zip(a, b)])


def brute_lists(rows, threshold=0.6):
    canon = dict(NAMES)
    seen = {r[0]: r for r in rows if r[0] is not None}
    out = set()
    for x in seen.values():
        for y in seen.values():
            if x[0] >= y[0] or (x[1] == "train") == (y[1] == "train") or not x[4] or not y[4]:
                continue
            lx, ly = canon.get(x[3], x[3]), canon.get(y[3], y[3])
            if lx is None or lx != ly or S.jaccard(S.shingle_set(x[4]), S.shingle_set(y[4])) < threshold:
                continue
            cx, cy = x[5] or [], y[5] or []
            if not cx or not cy:
                continue
            hit = lambda p, qs: any(S.jaccard(S.shingle_set(p), S.shingle_set(q)) >= threshold for q in qs)
            a, b = sum(hit(p, cy) for p in cx), sum(hit(q, cx) for q in cy)
            if (len(cx) > len(cy) or 2 * a >= len(cx)) and (len(cy) > len(cx) or 2 * b >= len(cy)):
                out.add((x[0], y[0]))
    return out


def overlaps(spark, rows):
    df = spark.createDataFrame(rows, LISTS)
    names = spark.createDataFrame(NAMES, "spelling string, canonical string")
    got = so.split_overlaps(df, names).collect()
    assert all(0 <= r.coverage <= 1 and r.similarity >= 0.6 for r in got)
    return {(min(r.train_id, r.other_id), max(r.train_id, r.other_id)) for r in got}


def test_split_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for q in variants(rng, 50):
        cands = [rng.choice(["p one two three four five", "q six seven eight nine ten", None, ""]) for _ in range(rng.randint(1, 4))]
        cands = [c and f"{c} {rng.randrange(3)}" for c in cands]
        rows.append((len(rows), rng.choice(["train", "heldout", None]), "s", rng.choice(["Py", "python", "go", None]), q, cands, "c", "v"))
    rows += [(900, "train", "s", "go", None, ["a b c d"], "c", "v"), (901, "hard", "s", "go", "", ["a b c d"], "c", "v"), (902, "train", "s", "go", "x y z", ["a b c d"], "c", "v"), (903, "hard", "s", "go", "x y z", ["a b c d", None], "c", "v"), (904, "hard", "s", "go", "x y z", None, "c", "v"), (905, "hard", "s", "go", "x y z", [], "c", "v")]
    got = overlaps(spark, rows + rows[:10])
    assert got == brute_lists(rows)
    assert (902, 903) in got
    assert overlaps(spark, []) == set()


def test_stock_phrases_take_the_second_way(spark):
    rng = random.Random(6)
    stock = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(60):
        c = list(stock)
        for _ in range(3):
            c[rng.randrange(70)] = f"z{rng.randrange(5)}"
        rows.append((i, "train" if i % 2 else "adv", "s", "go", " ".join(c), ["a b c d e"], "c", "v"))
    assert overlaps(spark, rows) == brute_lists(rows)


def test_stock_phrases_meet_records_of_their_own(spark):
    rng = random.Random(8)
    rows = []
    for f in range(4):
        stock = [f"s{f}_{i}" for i in range(90)]
        for i in range(30):
            own = [f"o{f}_{i}_{k}" for k in range(rng.randint(36, 48) if i % 3 == 0 else rng.randint(1, 4))]
            rows.append((len(rows), "train" if i % 2 else "adv", "s", "go" if f else rng.choice(["go", "python"]), " ".join(stock + own), ["a b c d e"], "c", "v"))
        for i in range(30):
            c = list(stock)
            for k in rng.sample(range(90), rng.randint(2, 8)):
                c[k] = f"e{f}_{i}_{k}"
            rows.append((len(rows), "train" if i % 2 else "adv", "s", "go", " ".join(c), ["a b c d e"], "c", "v"))
    assert overlaps(spark, rows) == brute_lists(rows)


def test_every_copy_of_a_record_comes_out(spark):
    query = " ".join(f"c{i}" for i in range(30))
    rows = [(i, "train" if i < 2 else ("hard" if i % 2 else "adv"), f"s{i % 3}", "go", query, ["a b c d e"], "c", "v") for i in range(252)]
    assert overlaps(spark, rows) == {(a, b) for a in (0, 1) for b in range(2, 252)}
    df, names = spark.createDataFrame(rows, LISTS), spark.createDataFrame(NAMES, "spelling string, canonical string")
    report = so.overlap_report(so.split_overlaps(df, names), df).collect()
    assert len(report) == 6 and sum(r.lists for r in report) == 250 and sum(r.pairs for r in report) == 500


def test_chain_and_extension():
    assert so.chain([0, 5, 9, 3], [0, 5, 2, 30]) in ([(0, 0), (5, 5)], [(0, 0), (3, 30)], [(0, 0), (9, 2)])
    a, b = "x a b c d y".split(), "q a b c d z w".split()
    assert so.extend(a, b, [(2, 2)]) == (4, 4)
    assert so.extend(a, b, []) == (0, 0)


def test_batches_without_a_close_pair():
    import pandas as pd

    far = pd.DataFrame({"a": [1], "b": [2], "qa": ["a b c d"], "qb": ["w x y z"], "ca": [["p q r"]], "cb": [["p q r"]]})
    blank = far.assign(qb=["a b c d"], ca=[[]])
    assert [list(x.columns) + [len(x)] for x in so._judge(0.6)(iter([far, far[:0], blank]))] == [["a", "b", "similarity", "coverage", 0]] * 3


def test_coverage_of_stock_phrases(spark):
    stock = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(20):
        query = stock[:1] + [f"x{i}"] * (i > 0) + stock[1:]
        rows.append((i, "adv" if i % 2 else "train", "s", "go", " ".join(query), ["a b c d e"], "c", "v"))
    got = so.split_overlaps(spark.createDataFrame(rows, LISTS), spark.createDataFrame(NAMES, "spelling string, canonical string")).collect()
    assert len(got) == 100 and all(r.coverage >= 59 / 61 for r in got)


def test_report(spark):
    lists = spark.createDataFrame([(1, "hard", "s1"), (1, "hard", "s1"), (2, None, None)], "list_id long, split string, source string")
    pairs = spark.createDataFrame([(7, 1, 0.9, 0.5), (8, 1, 0.9, 1.0), (7, 2, 0.7, 0.25)], "train_id long, other_id long, similarity double, coverage double")
    got = {(r.split, r.source): (r.lists, r.pairs) for r in so.overlap_report(pairs, lists).collect()}
    assert got == {("hard", "s1"): (1, 2), (None, None): (1, 1)}
    assert {tuple(r) for r in so.coverage_report(pairs, lists).collect()} == {(1, "hard", "s1", 2, 0.9, 1.0), (2, None, None, 1, 0.7, 0.25)}


def test_schema_of_empty_results(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("list_id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())]))
    links, members = nd.near_duplicates(df, ["list_id", "pos"], "text")
    assert nd.flat(nd.expand(links, members), ["list_id", "pos"], ["list", "pos"]).columns == ["list_a", "pos_a", "list_b", "pos_b"]
    assert members.where(F.col("id").isNotNull()).count() == 0


def test_groups_equal_connected_components(spark):
    rng = random.Random(9)
    texts = {(i, 0): t for i, t in enumerate(variants(rng, 25))}
    texts[(90, 0)], texts[(91, 0)] = texts[(0, 0)], texts[(0, 0)]
    df = spark.createDataFrame([(a, b, t) for (a, b), t in texts.items()], "list_id long, pos int, text string")
    got = {tuple(r.id): tuple(r.root) for r in nd.groups(*nd.near_duplicates(df, ["list_id", "pos"], "text")).collect()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in brute(texts, 0.6):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert got == {k: top(k) for k in texts}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert nd.components(edges.where("false")).count() == 0
