"""Problems 2, 3, 7 and 8."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavelspark.llm import leaks as L
from gavelspark.llm import pair_defects as D
from gavelspark.llm import pair_ranking as R
from gavelspark.llm import personal as P
from gavelspark.llm.queries import queries


def games(seed=1, items=7):
    rng = random.Random(seed)
    true = {f"i{k}": 1.2 * k - 3 for k in range(items)}
    rows = []
    for x in true:
        for y in true:
            if x < y and rng.random() < 0.9:
                n = rng.choice([5, 50, 400])
                wins = sum(rng.random() < 1 / (1 + math.exp(true[y] - true[x])) for _ in range(n))
                rows.append((x, y, wins, n - wins))
    return true, rows


class LocalPairs:
    """The normal matrix written out."""

    def __init__(self, rows, link, ridge):
        self.items = sorted({r[0] for r in rows} | {r[1] for r in rows})
        self.design = np.zeros((len(rows), len(self.items)))
        for k, (x, y, _, _) in enumerate(rows):
            self.design[k, self.items.index(x)], self.design[k, self.items.index(y)] = 1, -1
        self.wins, self.n = np.array([float(r[2]) for r in rows]), np.array([float(r[2] + r[3]) for r in rows])
        self.link, self.ridge = link, ridge

    def matrix(self, beta):
        weight, score = R.working(self.design @ beta, self.wins, self.n, self.link)
        return self.design.T @ (weight[:, None] * self.design) + self.ridge * np.eye(len(self.items)), self.design.T @ score

    def start(self, beta):
        matrix, score = self.matrix(beta)
        return score - self.ridge * beta, np.diag(matrix)

    def product(self, beta, vectors):
        return self.matrix(beta)[0] @ vectors


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_fit_solves_the_score_equations(spark, link):
    true, rows = games()
    found = R.strengths(spark.createDataFrame(rows, "x string, y string, wins long, losses long"), link).toPandas()
    beta = dict(zip(found["item"], found["strength"]))
    gradient = {k: -R.RIDGE * b for k, b in beta.items()}
    for x, y, w, l in rows:
        eta = beta[x] - beta[y]
        if link == "logit":
            s = w - (w + l) / (1 + math.exp(-eta))
        else:
            p, d = 0.5 * (1 + math.erf(eta / math.sqrt(2))), math.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
            s = (w - (w + l) * p) * d / (p * (1 - p))
        gradient[x] += s
        gradient[y] -= s
    assert max(map(abs, gradient.values())) < 1e-4
    assert sorted(beta, key=beta.get) == sorted(true, key=true.get)
    local, errors = R.fit(LocalPairs(rows, link, R.RIDGE), len(found))
    assert found.sort_values("item")["strength"].to_numpy() == pytest.approx(local, abs=1e-7)
    assert found.sort_values("item")["std_error"].to_numpy() == pytest.approx(errors, rel=1e-6)


def test_standard_errors_equal_the_inverse_and_their_estimate():
    _, rows = games(2, 9)
    system = LocalPairs(rows, "probit", 0.5)
    size = len(system.items)
    beta, errors = R.fit(system, size)
    centre = np.eye(size) - 1 / size
    inverse = centre @ np.linalg.inv(system.matrix(beta)[0]) @ centre
    assert errors == pytest.approx(np.sqrt(np.diag(inverse)), rel=1e-6)
    _, rows = games(4, R.PROBES + 30)
    system = LocalPairs(rows[:3000], "probit", 0.5)
    beta, errors = R.fit(system, len(system.items))
    exact = np.sqrt(np.diag((c := np.eye(len(beta)) - 1 / len(beta)) @ np.linalg.inv(system.matrix(beta)[0]) @ c))
    assert abs(np.mean(errors / exact) - 1) < 0.05 and np.std(errors / exact) < 0.25


def test_joined_vectors_give_the_same(spark):
    _, rows = games(3, 4)
    df = spark.createDataFrame(rows, "x string, y string, wins long, losses long")
    sent, joined = ({r["item"]: (r.strength, r.std_error) for r in R.strengths(df, "logit", max_sent=m).collect()} for m in (R.MAX_SENT, 0))
    assert all(joined[k] == pytest.approx(v, abs=1e-9) for k, v in sent.items()) and len(joined) == 4


def test_policy_games(spark):
    rec = [(1, 1, 0, 1, 0), (1, 1, 0, 1, 0), (2, 1, 0, 1, 1), (3, 1, 0, 1, None), (4, 1, 0, 1, 5), (5, 1, 0, 2, 0), (6, 9, 0, 1, 0), (None, 1, 0, 1, 0), (None, 1, 0, 1, 0), (7, None, 0, 1, 0)]
    records = spark.createDataFrame([(*r, "x") for r in rec], "record_id long, list_id long, i int, j int, winner int, policy string")
    owners = spark.createDataFrame([(1, 0, "b"), (1, 0, "c"), (1, 1, "a"), (1, 2, "b"), (None, 0, "z"), (2, 0, None)], "list_id long, pos int, policy string")
    got = [tuple(r) for r in R.policy_games(records, owners).collect()]
    assert got == [("a", "b", 1, 3)]
    assert R.policy_games(records.where("false"), owners).count() == 0
    ranked = R.ranking(R.strengths(R.policy_games(records, owners)), spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "policy string")).collect()
    assert [r.policy for r in ranked] == ["b", "new", "a"]
    none = R.ranking(R.strengths(R.policy_games(records.where("false"), owners)), spark.createDataFrame([("n",), ("m",)], "policy string")).collect()
    assert [r.policy for r in none] == ["m", "n"]


ENGLISH = ["The loop stops before the last value is seen and the answer is wrong.", "Both programs agree on the first example but not on the second one."]
SPANISH = ["El bucle termina antes de tiempo y por eso falta el último elemento.", "Los dos programas dan la misma salida para el primer ejemplo."]
GERMAN = ["Die Schleife endet zu früh, daher fehlt der letzte Eintrag der Liste.", "Beide Programme geben für das erste Beispiel die gleiche Ausgabe."]
PROMPT = "Which program is right for the given task? Count the ways to place the towers on the board. Print one number.\n[CANDIDATE_A]\nprint(1)\n[/CANDIDATE_A]\n[CANDIDATE_B]\nprint(2)\n[/CANDIDATE_B]"


WORDINGS = ["I pick {}", "My choice is {}, the others fail", "Final answer: {}", "So the right program is candidate {}.", "Ich wähle {}", "Elijo {}"]
REASONS = ["In candidate {} the counter is not reset between towers.", "I can't find a failing case for {} with 3 rooks.", "Candidate {} mishandles ties between two boards."]


def corpus(rng, size=120):
    """Responses with a verdict, last or first, and some that break off."""
    out = []
    for i in range(size):
        body = [rng.choice(REASONS).format(rng.choice("ABC")) for _ in range(rng.randint(2, 4))] + [rng.choice(ENGLISH)]
        rng.shuffle(body)
        verdict = rng.choice(WORDINGS).format(rng.choice("ABC"))
        out.append({0: verdict + "\n\n" + " ".join(body), 1: " ".join(body)[:-7]}.get(i % 10, " ".join(body) + "\n\n" + verdict))
    return out


def test_defects(spark):
    answers = {
        "empty": [None, "", " \n​", "<think>\n</think>", "```\n```", "\\boxed{ }", "null", "N/A", "...", "﻿"],
        "copy": [PROMPT, PROMPT.upper(), "Sure, here it is.\n" + "\n".join("> " + x for x in PROMPT.splitlines()), PROMPT.split("\n")[0]],
        "refusal": ["I'm sorry, but I can't help with this request.", "<think>\nI won't compare these programs.\n</think>", "Lo siento, no puedo evaluar esto.", "我拒绝协助处理这个请求。", "<think>\n" + ENGLISH[1] + "\n</think>\nUnfortunately nobody may expect me to judge such code."],
        "truncated": [ENGLISH[0] + " The helper retur", "<think>\n" + ENGLISH[1] + "\n</think>", ENGLISH[0] + "\n\n\\boxed{", ENGLISH[1] + " I can't find a failing case for A with 3 rooks", ENGLISH[1] + " I can't f"],
        "other_language": [SPANISH[0] + " " + SPANISH[1] + "\n\\boxed{A}", GERMAN[1] + "\n\nIch wähle B"],
        None: [ENGLISH[0] + " I pick B", "\\boxed{A}", "**A**", "[[B]]", "I pick A\n\n" + ENGLISH[1] + " and", ENGLISH[1] + " Final answer: B", ENGLISH[0] + "\nMy choice is B, the others fail"],
    }
    rows = [(kind, a) for kind, many in answers.items() for a in many]
    rows += [("rest", a) for a in corpus(random.Random(1))]
    pairs = spark.createDataFrame([(i, PROMPT, a, "\\boxed{A}", "clash") for i, (_, a) in enumerate(rows)], "pair_id long, prompt string, chosen string, rejected string, defect string")
    labelled = spark.createDataFrame([(c, t) for c, ts in (("en", ENGLISH * 3), ("es", SPANISH * 3), ("de", GERMAN * 3)) for t in ts] + [(None, "x"), ("en", None)], "language string, text string")
    got = {(r.pair_id, r.side): r.defect for r in D.pair_defects(pairs.union(pairs.where("pair_id < 3")), labelled).collect()}
    rest = {i for i, (kind, _) in enumerate(rows) if kind == "rest"}
    assert {k: v for k, v in got.items() if k[0] not in rest} == {(i, "chosen"): kind for i, (kind, _) in enumerate(rows) if kind and kind != "rest"}
    # the others: one of ten breaks off
    assert {i for i in rest if got.get((i, "chosen")) == "truncated"} == {i for i in rest if (i - min(rest)) % 10 == 1}
    assert D.pair_defects(pairs.where("false"), labelled).count() == 0
    nulls = pairs.where("pair_id < 3").select(F.lit(None).cast("long").alias("pair_id"), F.lit(None).cast("string").alias("prompt"), "chosen", "rejected")
    assert {r.defect for r in D.pair_defects(nulls, labelled.where("false")).collect()} == {"empty"}


def fitted(spark):
    responses = spark.createDataFrame([(t,) for t in corpus(random.Random(2), 200)] + [(None,), ("",)], "text string")
    ends = spark.sparkContext.broadcast(D.end_model(responses))
    return ends.value, D.whole_model(responses, ends)


def test_wordings_of_verdicts_are_learned(spark):
    ends, whole = fitted(spark)
    model = D.fit_languages([("en", t) for t in ENGLISH])
    long = " ".join(ENGLISH) * 3000
    texts = [f"{ENGLISH[0]} {w.format('C')}" for w in WORDINGS] + [long, long + " I pick A"]
    found = D.defects(PROMPT, texts, model, ends, whole)
    assert found == [None] * len(WORDINGS) + ["truncated", None]
    # without the model of ends no wording is known
    emptied = D.defects(PROMPT, texts, model, D.EndModel({}), whole)
    assert set(emptied) == {"truncated"}
    assert all(ends.probability(D._tail(r.format("A"), r.index("{}"))) < D.END_PROBABILITY for r in REASONS)


def test_refusals_are_other_texts_than_answers(spark):
    ends, whole = fitted(spark)
    model = D.fit_languages([("en", t) for t in ENGLISH])
    refusals = ["My guidelines keep me from judging code of strangers.", "Bitte wenden Sie sich an einen Menschen, das mache ich nicht."]
    assert D.defects(PROMPT, refusals, model, ends, whole) == ["refusal"] * 2
    assert D.defects(PROMPT, ["<think>\n" + ENGLISH[0] + "\n</think>\n" + refusals[0], "<think>\n" + ENGLISH[0] + "\n</think>\nFor Tavcor the expected out"], model, ends, whole) == ["refusal", "truncated"]
    assert not D.WholeModel(set()).refuses("")


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(8)] + [(100, "too short"), (101, None), (None, "x")]
    docs = []
    for d in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            source = rng.choice(items[:8])[1].split()
            start, size = rng.randint(0, 20), rng.randint(11, 16)
            parts[5:5] = [w.upper() + rng.choice([",", "-", " ", "\n"]) for w in source[start : start + size]]
        docs.append((d, " ".join(parts)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1] * 300), (202, items[1][1] * 300)]
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    grams = lambda t: {tuple(w[k : k + 13]) for w in [split(t)] for k in range(len(w) - 12)}
    expected = {(d, i) for d, t in docs for i, u in items if d is not None and i is not None and grams(t) & grams(u)}
    documents = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, item_id string")
    held = spark.createDataFrame([(i, t, "c") for i, t in items + items[:2]], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in L.leaked_items(documents, held).collect()} == expected
    assert L.leaked_items(documents, held).count() == len(expected)
    assert L.leaked_items(documents, held.where("false")).count() == 0
    assert L.leaked_items(documents.where("false"), held).count() == 0


def test_search_of_many_patterns_is_small_and_right():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 50_000, 2_000)) for _ in range(300)]
    search = L.PatternSearch(texts)
    size = sum(x.nbytes for x in (search.words, search.shift, search.keys, search.places, search.owners))
    assert size < 10 * sum(map(len, texts))
    inside = lambda i, at, n: " ".join(texts[i].split()[at : at + n])
    docs = ["x " * 700 + inside(7, 1987, 13), "ÀÉ " + inside(9, 0, 13).upper() + " y", inside(5, 100, 12), "", None, inside(3, 0, 2000) * 2 + " " + inside(4, 5, 20)]
    assert list(zip(*map(list, search.find(docs)))) == [(0, 7), (1, 9), (5, 3), (5, 4)]


def test_several_passes(spark):
    text = " ".join(f"w{i}" for i in range(20))
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    held = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words " * 10)], "item_id long, text string")
    assert {tuple(r) for r in L.leaked_items(documents, held, max_bytes=10).collect()} == {(1, 1), (1, 2)}


PIECES = {
    "email": ["a.b+c@mail.example.org", "kofi86@example.net", "jo [at] corp [dot] example", "jo(at)lab.example", "jo at mail dot example"],
    "phone": ["07700 900 103", "030/23125189", "+49 30 23125 121", "(274) 555-0193", "860.555.0104", "(335) 555-0154 ext. 12", "+44 (0)20 7946 0151", "01.99.00.40.43", "+17625550103"],
    "id": ["956-49-5922", "QQ 20 48 46 C", "X0053354", "000538046-X1"],
    "address": ["1745 Coldwater St, Apt 28, Oskerholm", "824 Old Quarry Road, Kestrelby, QX 00384", "Flat 13, 1 Coldwater Gardens, Dunmere", "Kupferstr. 41, 00196 Brindleford", "73 bis rue des Tilleuls, 00259 Pellington", "Calle de la Noria 23, 2º A, 00676 Brindleford"],
}


def test_grammars():
    for kind, many in PIECES.items():
        for piece in many:
            for text in (f"see {piece}.", f"({piece})", f"x: {piece}\nnext", f'"{piece}" – ok'):
                assert [(text[a:b], k) for a, b, k in P._spans(text)] == [(piece, kind)], text
    for text in ("limit 1000000007, seed 7369791949", "revision 73872.42.43, build 2026.53.6-38867", "ticket 2057-8439-16", "Round 53-18-74919", "Example: 897 33 289 381", "y = frame@94 + b@22, judge@localhost", "20 Old Road tests and 31 bis variants of task"):
        assert P._spans(text) == [], text
    assert [(m[1] - m[0], m[2]) for m in P._spans("my taxpayer number 953314827.")] == [(9, "id")]


def test_found_and_redacted(spark):
    families = ["Lisdunby", "Tornaroth", "Zemlidis", "Galkesmura", "Pelashby", "Quidunby"]
    given = ["Omar", "Lena", "Ivo", "Rosa", "Art"]
    rng = random.Random(8)
    docs, expected = [], set()
    for d in range(80):
        f, g = rng.choice(families), rng.choice(given[:4])
        name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} K. {f}", f"{g} {f}-{rng.choice(families)}"])
        docs.append((d, f"The tool was checked twice. thanks to {name} for it.\nArt Gallery variant {d}; Rose Window. Every evening it runs, mail a{d}@example.org"))
        expected |= {(d, "name", name), (d, "email", f"a{d}@example.org")}
    docs += [(900, None), (901, ""), (902, "  "), (None, "Omar Lisdunby"), (903, "word " * 50_000 + "thanks to Omar Lisdunby for it")]
    expected.add((903, "name", "Omar Lisdunby"))
    documents = spark.createDataFrame([(*d, "c") for d in docs + docs[:3]], "doc_id long, text string, kind string")
    names = spark.createDataFrame([(g,) for g in given] + [(None,), ("Omar",)], "given_name string")
    found = P.found_pieces(documents, names)
    assert {tuple(r) for r in found.select("doc_id", "kind", "found").collect()} == expected
    clean = {r.doc_id: r.text for r in P.redacted(documents, found, names).collect()}
    assert "[NAME] for it" in clean[0] and "[EMAIL]" in clean[0] and "Gallery" in clean[0]
    assert clean[900] is None and clean[901] == ""
    assert P.redacted(documents, found, names).count() == len(docs) + 3
    assert P.found_pieces(documents.where("false"), names).count() == 0
    assert {r.kind for r in P.found_pieces(documents, names.where("false")).collect()} <= {"email", "name"}


def test_pieces_are_replaced_where_they_stand(spark):
    texts = [(1, "Lisdunbyville is a town of Omar Lisdunby; Lisdunby and Omar left. Mail a@x.example, not aa@x.example"), (1, "Omar Lisdunby again"), (2, None), (None, "Omar Lisdunby")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    found = spark.createDataFrame([(1, "name", "Omar Lisdunby", 27), (1, "email", "a@x.example", 71), (2, "name", "x", 0), (None, "name", "Omar Lisdunby", 0)], "doc_id long, kind string, found string, start int")
    names = spark.createDataFrame([("Omar",), (None,)], "given_name string")
    got = [r.text for r in P.redacted(documents, found, names).orderBy("doc_id", F.length("text").desc()).collect()]
    assert got == ["Omar Lisdunby", "Lisdunbyville is a town of [NAME]; [NAME] and Omar left. Mail [EMAIL], not aa@x.example", "[NAME] again", None]


def test_short_family_names_and_other_letters(spark):
    rng = random.Random(9)
    families, given = ["Li", "Kim", "Wu", "Roy", "O'Hara", "Lisdunby", "Galdunby"], ["Omar", "Lena", "Ivo", "Rosa"]
    docs = [(d, f"The tool was checked twice. thanks to {rng.choice(given)} {families[d % 7]} for it. Every run is fine, It works.") for d in range(140)]
    names = spark.createDataFrame([(g,) for g in given], "given_name string")
    got = {(r.doc_id, r.found) for r in P.found_pieces(spark.createDataFrame(docs, "doc_id long, text string"), names).collect() if r.kind == "name"}
    assert got == {(d, re.search("to (.*) for", t).group(1)) for d, t in docs}
    assert [(P._spans(t)[0][2], t[slice(*P._spans(t)[0][:2])]) for t in ("my number AB 12 34 56 C", "passport L1234567.", "see K7654321 there")] == [("id", "AB 12 34 56 C"), ("id", "L1234567"), ("id", "K7654321")]


def test_all_queries_run(spark, data):
    for name, query in queries().items():
        assert query(spark, data).count() >= 0, name
