"""Searches through the gram sidecar: same rows as a full scan, fewer files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.text import contains_ci
from fleetlens.sources import text_index


def _texts(spark, seed, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    rows = [(f"h{seed}-{i}", " ".join(word() for _ in range(30))) for i in range(n)]
    rows[7] = (rows[7][0], "SELECT * FROM Orders_2024 WHERE x = 'ÄÖ-Übergang'")
    rows += [(f"e{seed}", None), (f"f{seed}", ""), (f"g{seed}", "abc")]
    return spark.createDataFrame(rows, "sql_handle string, text string")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    for seed in (1, 2):
        text_index.write_texts(_texts(spark, seed).repartition(4), path, max_records_per_file=40)
    return path


@pytest.mark.parametrize("needles", [["orders_2024"], ["ORDERS_2024", "zzzz-nowhere"], ["übergang"], ["abc"], ["e"], ["nowhere at all"], ["select * from"], [""]])
def test_same_rows_as_a_full_scan(spark, landed, needles):
    whole = spark.read.parquet(f"{landed}/texts")
    hit = F.lit(False)
    for n in needles:
        hit = hit | contains_ci("text", n)
    want = sorted(map(tuple, whole.filter(hit).collect()))
    assert sorted(map(tuple, text_index.read_texts_with(spark, landed, needles).collect())) == want


def test_a_rare_needle_opens_few_files(spark, landed):
    files = text_index._files(spark, landed)
    assert len(files) >= 20
    assert len(text_index.files_that_may_hold(spark, landed, ["Orders_2024"])) == 2
    assert text_index.files_that_may_hold(spark, landed, ["nowhere at all"]) == []
    assert text_index.files_that_may_hold(spark, landed, ["abc"]) == sorted(files)      # shorter than a gram
    plan = text_index.read_texts_with(spark, landed, ["Orders_2024"])
    assert len(plan.inputFiles()) == 2


def test_files_without_a_set_are_always_read(spark, tmp_path):
    path = str(tmp_path / "t")
    text_index.write_texts(_texts(spark, 3).coalesce(1), path)
    spark.createDataFrame([("late", "needle in a late file")], "sql_handle string, text string").coalesce(1).write.mode("append").parquet(f"{path}/texts")
    assert [r.sql_handle for r in text_index.read_texts_with(spark, path, ["needle in"]).collect()] == ["late"]
    text_index.write_texts(spark.createDataFrame([("more", "other")], "sql_handle string, text string").coalesce(1), path)
    assert len(text_index.files_that_may_hold(spark, path, ["needle in"])) == 1
