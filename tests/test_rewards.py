from pyspark.sql import functions as F

from gavelspark.functions import rewards as R


def values(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_format(spark):
    texts = [r"<think>x</think> \boxed{B}", r"<think>a<think>b</think>\boxed{A}", r"<think>x</think>\boxed{C}", r"\boxed{A}", " <think>a\nb</think>\n\\boxed{A}\n ", None, ""]
    assert values(spark, texts, lambda c: R.list_format(c, F.lit(2))) == [0, -1, -1, -1, 0, -1, -1]
    assert values(spark, [r"so \boxed{A}", r"\boxed{A} so", r"\boxed{E}", None], lambda c: R.list_format_cot(c, F.lit(2))) == [0, -1, -1, -1]


def test_correct(spark):
    texts = [r"<think>\boxed{B}</think>\boxed{A}", r"\boxed{B}", None]
    assert values(spark, texts, lambda c: R.list_correct(c, F.lit("A"))) == [1, 0, 0]
    assert values(spark, texts, lambda c: R.list_correct_cot(c, F.lit("B"))) == [1, 1, 0]


def test_distance(spark):
    rates = F.array(F.lit(0.2), F.lit(1.0), F.lit(0.2))
    texts = [r"\boxed{B}", r"\boxed{A}", r"\boxed{C}", r"\boxed{D}", None]
    assert values(spark, texts, lambda c: R.list_distance(c, rates, F.lit(3))) == [1.0, -0.6, -0.8, -1.0, -1.0]
    assert values(spark, texts[:1], lambda c: R.list_distance(c, F.lit(None).cast("array<double>"), F.lit(3))) == [-1.0]


def test_scores(spark):
    texts = [r"\boxed{[10, 2]}", r"\boxed{[9, 2]}", r"\boxed{[2, 9]}", r"\boxed{[9, 9]}", r"\boxed{[9]}", None]
    assert values(spark, texts, lambda c: R.listsc_correct(c, F.lit(2), F.lit(0))) == [2, 1, -1, -1, -1, -1]
    rates = F.array(F.lit(0.8), F.lit(0.25))
    texts = [r"\boxed{[8, 2]}", r"\boxed{[9, 3]}", r"\boxed{[9, 1]}", r"\boxed{[5, 4]}", r"\boxed{[2, 8]}", r"\boxed{[1]}", None]
    assert values(spark, texts, lambda c: R.pairsc_content(c, rates)) == [3.2, 2.8, 2.8, 2.0, -1.5, -2.0, -2.0]


def test_score_formats(spark):
    t = "<think>x</think>"
    assert values(spark, [t + r"\boxed{[1, 10]}", t + r"\boxed{[1, 11]}", t + r"\boxed{[1]}", r"\boxed{[1, 2]}", None], R.pairsc_format) == [1, -0.5, -1, -1, -1]
    assert values(spark, [t + r"\boxed{[1, 2,  3]}", t + r"\boxed{[1, 2]}", t + r"\boxed{[1, -2, 3]}", None], lambda c: R.listsc_format(c, F.lit(3))) == [0, -1, -1, -1]


def test_length_and_set(spark):
    df = spark.createDataFrame([(5,), (20,), (25,), (30,), (31,)], "n int")
    assert [r[0] for r in df.select(R.overlong_penalty(F.col("n"), 30, 10)).collect()] == [0, 0, -0.5, -1, -1]
    assert (R.overlong_cache(4096), R.overlong_cache(4097)) == (1024, 2048)
    row = spark.range(1).select(R.reward_set(F.lit("a/DeepSeek-x"), F.lit("grpo")), R.reward_set(F.lit("a/b"), F.lit("bnpo"))).first()
    assert row[0] == ["list_correct", "list_format"]
    assert row[1] == ["list_correct_cot", "list_format_cot", "overlong_penalty"]
