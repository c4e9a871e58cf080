import itertools
import math
import random
from statistics import mode

import pytest
from pyspark.sql import functions as F

from gavelspark.functions import prompts as P
from gavelspark.operators import calibration as C
from gavelspark.operators import ranking as K
from gavelspark.operators import selection as S
from gavelspark.operators import votes as V
from gavelspark.sources import readers, sinks


def test_majority_counts_null_and_takes_the_first(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.choice(["A", "B", None])) for i in range(60) for k in range(4)]
    got = {r.list_id: r.answer for r in V.majority(spark.createDataFrame(rows, "list_id long, k int, answer string")).collect()}
    for i in range(60):
        assert got[i] == mode([a for l, _, a in rows if l == i])


def test_vote_distribution(spark):
    rows = [(1, "a"), (1, " A "), (1, "B"), (1, None), (1, "Z"), (2, "D"), (3, None)]
    sizes = spark.createDataFrame([(1, 3), (2, 3), (3, 2), (4, 2)], "list_id long, n int")
    got = {r.list_id: r for r in V.vote_distribution(spark.createDataFrame(rows, "list_id long, answer string"), sizes).collect()}
    assert got[1].predicted == "A" and got[1].dist == {"A": 2 / 3, "B": 1 / 3, "C": 0.0}
    assert all(got[i].predicted is None and got[i].conf is None for i in (2, 3, 4))


def test_option_softmax_floors_missing(spark):
    lp = spark.createDataFrame([(1, 0, -1.0), (1, 1, -0.5), (1, 10, -2.0)], "list_id long, token_id int, logprob double")
    opts = spark.createDataFrame([(0, "A"), (1, "A"), (10, "B"), (20, "C")], "token_id int, opt string")
    sizes = spark.createDataFrame([(1, 3), (2, 2)], "list_id long, n int")
    got = {(r.list_id, r.opt): r.p for r in V.option_softmax(lp, opts, sizes).collect()}
    z = 1 + math.exp(-1.5) + math.exp(-21.5)
    assert got[1, "A"] == pytest.approx(1 / z, abs=1e-8) and got[1, "B"] == pytest.approx(math.exp(-1.5) / z, abs=1e-8)
    assert got[2, "A"] is None


def test_ece_edges(spark):
    confs = [0.0, 0.1, 0.1 + 1e-12, 0.3, 0.30000000000000004, 0.7, 1.0, None, 0.7000000000000001]
    df = spark.createDataFrame([(c, 1) for c in confs], "conf double, is_correct int")
    got = {r.bin: r.n for r in C.bins(df).collect()}
    expected = {b: 0 for b in range(10)}
    for c in confs:
        for b in range(10):
            lo, hi = b * 0.1, (b + 1) * 0.1 if b < 9 else 1.0
            if c is not None and c <= hi and (c > lo or b == 0 and c >= lo):
                expected[b] += 1
    assert got == expected
    empty = df.where("false")
    assert C.ece(empty).first().ece == 0.0
    assert math.isnan(C.brier(empty).first().brier)
    assert C.calibration_summary(empty).first().accuracy == 0.0


def tau(wins, rates):
    pairs = list(itertools.combinations(range(len(wins)), 2))
    sign = lambda x: (x > 0) - (x < 0)
    a = [sign(wins[i] - wins[j]) for i, j in pairs]
    b = [sign(rates[i] - rates[j]) for i, j in pairs]
    n = math.sqrt(sum(map(abs, a)) * sum(map(abs, b)))
    return sum(x * y for x, y in zip(a, b)) / n if n else -1.0


def test_ranking_against_plain_python(spark):
    rng = random.Random(5)
    lists, records = {}, []
    for lid in range(80):
        n = rng.randint(1, 5)
        lists[lid] = [rng.choice([0.0, 0.5, 1.0]) for _ in range(n)]
        records += [(lid, i, j, rng.choice([i, j, None, 9])) for i, j in itertools.combinations(range(n), 2)]
    cand = spark.createDataFrame([(l, p, r, len(rs)) for l, rs in lists.items() for p, r in enumerate(rs)], "list_id long, pos int, pass_rate double, n int")
    verdicts = spark.createDataFrame(records, "list_id long, i int, j int, winner int")
    prefs = K.preference_set(verdicts).cache()
    known = {}
    for l, i, j, w in records:
        if w in (i, j):
            known.setdefault(l, set()).add((w, j if w == i else i))
    triples = transitive = 0
    for l, edges in known.items():
        for t in itertools.combinations(range(len(lists[l])), 3):
            inside = [(w, o) for w, o in edges if w in t and o in t]
            if len(inside) == 3:
                triples += 1
                transitive += sorted(sum(w == x for w, _ in inside) for x in t) == [0, 1, 2]
    sizes = cand.select("list_id", "n").distinct()
    row = K.transitivity(prefs, sizes).first()
    assert (row.triples, row.transitive) == (triples, transitive)
    taus = {r.list_id: r.tau for r in K.tau_per_list(prefs, cand).collect()}
    gains = {r.list_id: r.ndcg for r in K.ndcg_per_list(prefs, cand).collect()}
    for l, edges in known.items():
        wins = [sum(w == p for w, _ in edges) for p in range(len(lists[l]))]
        assert taus[l] == pytest.approx(tau(wins, lists[l]), abs=1e-8)
        order = sorted(range(len(wins)), key=lambda p: -wins[p])
        dcg = lambda rs: sum((2**r - 1) / math.log2(k + 2) for k, r in enumerate(rs))
        ideal = dcg(sorted(lists[l], reverse=True))
        assert (l in gains) == (ideal > 0)
        if ideal:
            assert gains[l] == pytest.approx(dcg([lists[l][p] for p in order]) / ideal, abs=1e-8)
    assert set(taus) == set(known)
    empty = verdicts.where("false")
    assert K.transitivity(K.preference_set(empty), sizes).first().rate == 0.0
    assert K.pairwise_accuracy(empty, cand).first().accuracy == 0.0
    assert K.ndcg(K.preference_set(empty), cand).first().ndcg == 0.0


def test_selection(spark):
    counts = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, 2), (2, 0, 0, 1), (3, 0, 3, 3)], "prob_id long, cand int, passed long, total long")
    sel = spark.createDataFrame([(1, 7), (2, 0), (3, None)], "prob_id long, sel int")
    row = S.pass_at_1(sel, counts).first()
    assert (row.problems, row.pass_at_1) == (3, pytest.approx(1 / 3, abs=1e-8))
    assert S.oracle_pass(counts).first().oracle >= S.random_pass(counts).first().random
    v = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 0), (1, 1, 2, None)], "prob_id long, i int, j int, winner int")
    got = {r.prob_id: r.sel for r in S.select_pairwise(v, spark.createDataFrame([(1,), (2,)], "prob_id long")).collect()}
    assert got == {1: 0, 2: None}


def test_execute_code_is_opt_in(spark):
    jobs = spark.createDataFrame([(1, 0, 0, "print(int(input()) * 2)", "21"), (1, 0, 1, "import time; time.sleep(30)", ""), (1, 0, 2, "raise SystemExit(3)", None)], "prob_id long, cand int, tc_id int, code string, stdin string")
    with pytest.raises(PermissionError):
        S.execute_code(jobs)
    got = {r.tc_id: (r.stdout.strip(), r.rc) for r in S.execute_code(jobs, timeout=2, allow=True).collect()}
    assert got == {0: ("42", 0), 1: ("TIMEOUT", -1), 2: ("", 3)}


def test_prompts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first().c
    cands = F.array(F.lit("x"), F.lit(None).cast("string"), F.lit("z"))
    assert get(P.label_candidates(cands, F.lit(2), F.lit("go"))) == "[CANDIDATE_A]\n```go\nx\n```\n[/CANDIDATE_A]\n\n[CANDIDATE_B]\n```go\n\n```\n[/CANDIDATE_B]"
    roles = lambda m: [x.role for x in get(m)]
    args = (F.lit("q"), F.lit("go"), cands, F.lit(3))
    assert roles(P.build_prompt(*args, "x-Instruct")) == ["system", "user"]
    assert roles(P.build_prompt(*args, "lrm")) == ["user", "assistant"]
    assert roles(P.build_prompt_train(*args, thinking=True)) == ["user", "assistant"]
    listed = lambda scoring, thinking: roles(P.build_list_prompt(F.lit("<p>q</p>"), cands, F.lit(3), scoring, thinking))
    assert [listed(s, t) for s in (False, True) for t in (False, True)] == [["system", "user"], ["user", "assistant"], ["user"], ["user", "assistant"]]
    assert roles(P.build_pair_prompt(F.lit("q"), F.lit("a"), F.lit("b"), False, False)) == ["system", "user"]
    messages = F.array(P.message("user", F.lit("u")))
    assert [x.content for x in get(P.extend_messages(messages, F.lit("t")))] == ["u", "t"]
    assert get(P.pick_continuation(F.array(F.lit("no"), F.lit(r"a\boxed{B}")), F.lit(5))) == r"a\boxed{"
    assert get(P.pick_continuation(F.array(F.lit("no")), F.lit(5))) == r"no\boxed{"
    meta = get(P.problem_meta(F.lit("LeetCode"), F.lit('{"func_name": "go"}')))
    assert (meta.platform, meta.functional, meta.func_name) == ("leetcode", True, "go")
    assert get(P.problem_meta(F.lit(None).cast("string"), F.lit("broken"))).func_name == "solve"


def test_hostile_answers_and_outputs(spark):
    answers = spark.createDataFrame([(1, "\tA"), (1, "A\n"), (1, "B"), (1, None)], "list_id long, answer string")
    row = V.vote_distribution(answers, spark.createDataFrame([(1, 2)], "list_id long, n int")).first()
    assert (row.n_votes, row.predicted, round(row.conf, 3)) == (3, "A", 0.667)
    runs = [(1, 0, 0, "1e2", "100", 0), (1, 0, 1, "true", "1", 0), (1, 0, 2, '{"a": 1, "b": [2]}', '{"b":[2],"a":1.0}', 0), (1, 0, 3, "x", None, 0), (1, 0, 4, "5", "5", 1)]
    executions = spark.createDataFrame(runs, "prob_id long, cand int, tc_id int, stdout string, expected string, rc int")
    assert [tuple(r) for r in S.test_pass_count(executions).collect()] == [(1, 0, 3, 5)]


def test_sources_and_sinks(spark, tmp_path):
    assert not readers.checkpoint_probe(str(tmp_path / "none"))
    (tmp_path / "checkpoint-x").mkdir()
    assert not readers.checkpoint_probe(str(tmp_path))
    (tmp_path / "checkpoint-12").mkdir()
    assert readers.checkpoint_probe(str(tmp_path))
    (tmp_path / "t.txt").write_text("{{ x }}")
    assert readers.scan_text_template(str(tmp_path / "t.txt")) == "{{ x }}"
    rows = spark.createDataFrame([("m", "d", str(tmp_path / "gone"), 0), ("m", "d", str(tmp_path / "t.txt"), 1)], "eval_llm string, data string, path string, row_no int")
    there = readers.existing_files(spark, str(tmp_path))
    assert [tuple(r) for r in readers.cache_lookup(rows, there).collect()] == [("m", "d", str(tmp_path / "t.txt"))]
    assert readers.cache_lookup(rows.withColumn("path", F.lit(None).cast("string")), there).count() == 0
    got = spark.createDataFrame([(0.1234567,), (None,)], "x double").select(sinks.fmt_percent(F.col("x")), sinks.fmt_decimals(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("12.35", "0.1235"), ("N/A", "N/A")]
