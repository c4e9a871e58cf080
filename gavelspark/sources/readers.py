"""Sources: tables, problems, result summaries, templates, caches, and pluggable inference."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_split(spark: SparkSession, sf_dir: str, name: str, split: str) -> DataFrame:
    """The rows of one split; the predicate reaches the scan."""
    return scan_table(spark, sf_dir, name).where(F.col("split") == split)


def scan_problems(df: DataFrame, tests: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows with a non-empty array of tests, of which the first ``limit`` by key if it is given."""
    some = df.where(F.size(tests) > 0)
    return some.orderBy(key).limit(limit) if limit else some


def scan_csv_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result summaries with a header and a declared schema (nothing is inferred)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_text_template(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def cache_lookup(summary: DataFrame, files: DataFrame) -> DataFrame:
    """(eval_llm, data, path): of each pair of keys, the path of the first row (by row_no) whose file exists.

    ``summary`` has eval_llm, data, row_no, path; ``files`` the paths that exist (``existing_files`` lists a folder). Rows with
    a null key or path name no file; pairs without an existing file do not come out.
    """
    there = files.select("path").where("path is not null").distinct()
    found = summary.where("eval_llm is not null and data is not null").join(there, "path", "left_semi")
    return found.groupBy("eval_llm", "data").agg(F.min_by("path", "row_no").alias("path"))


def existing_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files under a folder of any file system that Spark reads; the folder's listing is distributed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def checkpoint_probe(folder: str) -> bool:
    """Whether the folder has a subfolder named checkpoint-<number>."""
    return os.path.isdir(folder) and any(re.fullmatch(r"checkpoint-\d+", e.name) and e.is_dir() for e in os.scandir(folder))


def scan_inference(prompts: DataFrame, generate: Callable[[list[str], int], list[list[str]]], n: int, key: str = "list_id", prompt: str = "prompt") -> DataFrame:
    """(key, k, text): ``n`` texts per prompt from ``generate``, called with one Arrow batch of prompts at a time.

    The generator is loaded in the worker that calls it; the key keeps the order that the results came in.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = generate(list(f[prompt]), n)
            yield pd.DataFrame({key: f[key].repeat(n).to_numpy(), "k": list(range(n)) * len(f), "text": [t for ts in texts for t in ts]})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, k int, text string")
