"""Lexical near-duplicates: equal to the SQL on odd records, in small blocks, and without pairs in a shuffle."""

import random

import pytest
from oracle import SF, connect, rows, same
from pyspark.sql import functions as F

from tarnstone import catalog
from tarnstone.plans import lexical as L

NAME = "vec_09_lexical_duplicates"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Records of few common words, so that most pairs share one, and odd ones; two of the same id."""
    r = random.Random(9)
    words = [w + str(k) for k in range(12) for w in ("a", "bb", "the", "reservoir")]
    made = [(k * 20, " ".join(r.choices(words[: r.choice((4, 12, 48))], k=r.randint(1, 30))), "active") for k in range(400)]
    made += [(m[0] + 7, m[1] + " More, words!", "active") for m in made[:200]]
    made += [(1 * 100 + 1, None, "active"), (8100, None, "active"), (8200, "", "active"), (8300, " -- \n", "active"), (8400, "É ñ", "active"), (None, made[0][1], "active"), (-8500, "x y", "active"), (8600, "X  Y, x", "active"), (8700, "x y", "stale")]
    made += [(8801, "x y z", "active"), (8801, "x y", "active"), (8900, "q r s t u v w x y z", "active"), (9001, "q r s t u v w", "active"), (9003, "q r s t u v", "active"), (9100, " ".join(f"n{k}" for k in range(300)), "active"), (9101, " ".join(f"n{k}" for k in range(299, 80, -1)), "active")]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(made, "id long, value string, status string").repartition(3).write.parquet(f"{folder}/memory.parquet")
    return str(folder)


def test_odd_records_equal_sql(spark, odd):
    same(spark, catalog.queries(), catalog.oracle_sql(), NAME, connect(odd), odd)


@pytest.mark.parametrize(("block", "rare", "cells"), [(100, 1, 50), (100, 3, 5000), (4_000_000, 1000, 1 << 18)])
def test_blocks_and_pieces_change_nothing(spark, odd, monkeypatch, block, rare, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    m = spark.read.parquet(f"{odd}/memory.parquet").where("value IS NOT NULL AND status = 'active'")
    m = m.select("id", F.array_distinct(F.array_remove(F.split(F.lower("value"), "[^a-z0-9]+"), "")).alias("w"))
    got = L.holders(m, m.where("id % 100 = 0"), "id", "w", 0.7, block=block, rare=rare).withColumn("score", F.round("score", 6))
    want = rows(connect(odd).execute(catalog.oracle_sql()[NAME]).df())
    assert rows(got.toPandas()) == want and len(want[1]) > 1000


def test_only_results_leave_a_task(spark):
    """The words of all candidate pairs were shuffled, 173 MB at 11,000 records."""
    plan = catalog.queries()[NAME](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_none_asked(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "active")], "id long, value string, status string").write.parquet(f"{tmp_path}/memory.parquet")
    assert catalog.queries()[NAME](spark, str(tmp_path)).collect() == []
