"""Every registered query of the library against its DuckDB oracle at sf0.001
(rows-only for the non-SQL operators), plus the driver's smoke entry.

The training queries load the one saved model of the session; here that is a
model of few trees, registered before they run (the default is tested by its
parameters)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from ratecraft.plans import catalog
from ratecraft.plans.oracles import ORACLES
from ratecraft.plans.queries import QUERIES, _matrix

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"train_gbt", "predict_batch", "model_metrics", "model_rank_places", "feature_importance",
             "stream_model_score", "training_run"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module", autouse=True)
def small_model(spark):
    from ratecraft.operators.train import save_model, train_gbt
    from ratecraft.session import scratch_path
    model = train_gbt(_matrix(spark, SF).where("is_train"), n_trees=6)
    catalog.set_model_path(spark, SF, "gbt", save_model(model, scratch_path(spark, "small-model")))
    yield
    catalog.clear()


def test_default_model_has_the_original_parameters():
    from ratecraft.operators.train import gbt_pipeline
    gbt = gbt_pipeline().getStages()[-1]
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize(), gbt.getSubsamplingRate(), gbt.getSeed()) == (
        200, 8, 0.1, 0.8, 42)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:5] == ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "is_train"]
    assert len(df.columns) == 4 + 1 + 22 + 1


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    if res["ok"] is None:
        assert res["rows"] > 0, res
    else:
        assert res["ok"], res
