"""The model registry and the fall-back chain at load time."""

import shutil

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from ratecraft.operators import registry as reg
from ratecraft.operators.train import save_model
from ratecraft.plans.serving import baseline_predictor
from ratecraft.session import scratch_path


@pytest.fixture
def saved(spark):
    def save(value):
        model = PipelineModel([SQLTransformer(statement=f"SELECT *, {value} AS prediction FROM __THIS__")])
        return save_model(model, scratch_path(spark, "t-model"))
    return save


@pytest.fixture
def answer(spark):
    rows = spark.createDataFrame([(2.5,)], "global_mean double")

    def ask(registry, name="m", alias="production"):
        s = reg.load_serving(spark, registry, name, lambda model: model.transform, baseline_predictor, alias)
        return float(s.predictor(rows).first()["prediction"]), s.version, s.stage
    return ask


def test_no_registry_and_unknown_name_answer_with_the_baseline(spark, saved, answer):
    path = scratch_path(spark, "t-registry")
    assert answer(path) == (2.5, "1.0", "Production")
    reg.register_model(spark, path, "other", 1, saved(9))
    assert answer(path) == (2.5, "1.0", "Production")


def test_alias_then_latest_then_baseline(spark, saved, answer):
    path = scratch_path(spark, "t-registry")
    paths = {v: saved(v) for v in (1, 2, 3)}
    for v in (1, 3, 2):
        reg.register_model(spark, path, "m", v, paths[v])
    assert answer(path) == (3.0, "3", "latest")              # no alias yet
    reg.set_alias(spark, path, "m", 1)
    assert answer(path) == (1.0, "1", "production")
    reg.set_alias(spark, path, "m", 2)                        # moved: the newest row decides
    assert answer(path) == (2.0, "2", "production")
    assert answer(path, alias="canary") == (3.0, "3", "latest")
    shutil.rmtree(paths[2].removeprefix("file:") + "/stages")  # broken files
    assert answer(path) == (3.0, "3", "latest")
    shutil.rmtree(paths[3].removeprefix("file:"))              # lost files
    assert answer(path) == (2.5, "1.0", "Production")
    reg.set_alias(spark, path, "m", 7)                        # a version that was never registered
    reg.register_model(spark, path, "m", 4, saved(4))
    assert answer(path) == (4.0, "4", "latest")
