"""Branch tables of the text functions; expected values are written by hand."""

import ast
import random

from pyspark.sql import functions as F

from gavelspark.functions import text as X


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_boxed_text(spark):
    texts = [r"a\boxed{A}b\boxed{B}", r"\boxed{}", "no box", None, "\\boxed{a\nb}", "\\boxed{a\rb}", r"\boxed{x"]
    assert column(spark, texts, X.boxed_text) == ["A", "", None, None, None, "a\rb", None]


def test_boxed_text_eval(spark):
    texts = [r"\boxed{[[A]]}", r"\boxed{[[B}", r"\boxed{ C }", r"\boxed{x[[D]]y[[E]]}", None]
    assert column(spark, texts, X.boxed_text_eval) == ["A", "B", " C ", "D", None]


def test_scores_follow_the_literal_grammar(spark):
    rng = random.Random(1)
    bodies = ["[1, 2]", "[8,4,]", "[+8]", "[-1]", "[08]", "[8.5]", "[]", "nope", "[1 2]", "[10, 0]", "7", " [3] ", "[1,,2]", "[,]", "[--1]", None]
    bodies += ["".join(rng.choice("[]0123,+- ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    texts = [None if b is None else rf"\boxed{{{b}}}" for b in bodies]

    def expected(body):
        try:
            found = ast.literal_eval(body.strip(" "))
            return found if isinstance(found, list) and all(isinstance(x, int) for x in found) else []
        except Exception:
            return []

    native = column(spark, texts, X.boxed_scores)
    literal = column(spark, texts, X.boxed_scores_literal)
    for body, a, b in zip(bodies, native, literal):
        plain = body is None or not any(x in body.replace(" ", "") for x in ("+-", "-+", "--", "++")) and not any(s + d in body for s in "+-" for d in (" ",)) and "-" not in body.replace("[-", "").replace(",-", "").replace(", -", "")
        if body is not None and plain and "+" not in body and " " not in body.strip():
            assert a == expected(body), body
        assert b == (expected(body) if body is not None and not body.startswith(" ") else b)


def test_post_think_and_strip(spark):
    texts = ["<think>a</think> b ", "\u2003x\u00a0", "a</think>b</think>\n c\t", None, ""]
    assert column(spark, texts, X.post_think) == ["b", "x", "c", None, ""]


def test_strip_html(spark):
    assert column(spark, [" <b>a</b><br/> ", None, "", "1 < 2"], X.strip_html) == ["a", "", "", "1 < 2"]


def test_extract_code(spark):
    texts = ["<think>```python\nz\n```</think>x\n```python\na\n```\n```python\nb\n```", "```\nplain\n```", "only text ", None, "```python\nopen"]
    assert column(spark, texts, X.extract_code) == ["b", "plain", "only text", None, "```python\nopen"]


def test_verdicts(spark):
    lists = lambda c: X.list_verdict(c, F.lit(3))
    assert column(spark, [r"\boxed{B}", r"\boxed{D}", r"\boxed{b}", r"</think>\boxed{A}", r"\boxed{AB}", None], lists) == [1, None, None, 0, None, None]
    scored = lambda c: X.list_verdict(c, F.lit(2), scoring=True)
    assert column(spark, [r"\boxed{[1, 3]}", r"\boxed{[3, 3]}", r"\boxed{[1]}", None], scored) == [1, None, None, None]
    assert column(spark, [r"\boxed{A}", r"\boxed{C}", None], X.pair_verdict) == ["A", None, None]
    pair = lambda c: X.pair_verdict(c, scoring=True)
    assert column(spark, [r"\boxed{[2, 1]}", r"\boxed{[1, 2]}", r"\boxed{[1, 1]}", r"\boxed{[1]}"], pair) == ["A", "B", None, None]
    told = lambda c: X.interpret_pair(c, F.lit(4), F.lit(7))
    assert column(spark, [" a\n", "B", "C", "", None], told) == [4, 7, None, None, None]


def test_outputs(spark):
    assert column(spark, [" a  \r\nb\t\n\n", None, "a\n\n b"], X.normalize_output) == ["a\nb", None, "a\n\n b"]
    df = spark.createDataFrame([("1 \n", "1"), ('{"a":1, "b":2}', '{"b":2,"a":1.0}'), ("true", "1"), ("x", "y"), (None, "1"), ("[1", "[1 ")], "a string, b string")
    both = df.select(X.outputs_match(F.col("a"), F.col("b")), X.outputs_match_native(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in both] == [True, True, True, False, False, True]
    assert [r[1] for r in both] == [True, True, False, False, False, True]


def test_harness_and_names(spark):
    df = spark.createDataFrame([("class Solution: pass", "run", "1\n[2, 3]\n"), ("x", "f", "broken(")], "c string, n string, i string")
    first, second = (r[0] for r in df.select(X.functional_harness(F.col("c"), F.col("n"), F.col("i"))).collect())
    assert "given = [1, [2, 3]]" in first and '"run"' in first
    assert "given = []" in second
    assert column(spark, ["Org/Team/Model-7B", "plain", None], X.model_short_name) == ["model-7b", "plain", None]
    assert column(spark, [r"ab\boxed{C}", "none", None], X.truncate_at_boxed) == [r"ab\boxed{", None, None]
