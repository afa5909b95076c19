"""Queries that once ran over less than their operator's job."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tarnstone import catalog
from tarnstone.plans import evaluation as E
from tarnstone.queries.lifecycle import _results
from tarnstone.storage import table

QUERIES = catalog.queries()


def test_large_files_are_admitted_as_text(spark):
    rows = table(spark, SF, "chunks").where("chunk_text IS NOT NULL")
    large = {r.id for r in rows.where("octet_length(chunk_text) > 3000").select("id").collect()}
    got = {r.id: r.language for r in QUERIES["src_05_admission"](spark, SF).collect()}
    assert len(large) > 0 and len(got) == rows.count() and {got[i] for i in large} == {"text"}


@pytest.mark.parametrize(("name", "of"), [("agg_18_bootstrap", "ndcg"), ("evl_05_bootstrap", "rr")])
def test_bootstrap_has_2000_resamples(spark, name, of):
    diffs = E.scores(*_results(spark, SF)).withColumn("diff", F.col(of) - F.col("recall"))
    assert QUERIES[name](spark, SF).collect() == E.bootstrap(diffs, "diff", resamples=2000).collect()


def test_all_repos_enter_the_upsert(spark):
    ids = {r.id for r in table(spark, SF, "repos").select("id").collect()}
    got = [r.id for r in QUERIES["dml_12_repo_upsert"](spark, SF).collect()]
    assert max(ids) > 20 and len(got) == len(set(got)) == 2 * len(ids) and {i for i in got if i > 0} == ids
