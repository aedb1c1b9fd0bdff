"""Wide plans compiled operator by operator."""

import pytest

from flowloom.plans import predict
from flowloom.session import short_methods
from flowloom.streaming import responses

SETTING = "spark.sql.codegen.wholeStage"


def test_the_setting_of_plans_is_the_sessions_own_again(spark):
    before = spark.conf.get(SETTING, None)
    with pytest.raises(RuntimeError):
        with short_methods(spark):
            assert spark.conf.get(SETTING) == "false"
            raise RuntimeError
    assert spark.conf.get(SETTING, None) == before


def test_batches_of_requests_compile_operator_by_operator(spark, monkeypatch, tmp_path):
    seen = []

    def stop(requests, *_, **__):
        seen.append(requests.sparkSession.conf.get(SETTING))
        raise KeyError("stop")

    monkeypatch.setattr(predict, "predict_requests", stop)
    with pytest.raises(KeyError):
        responses.answer_batch(spark.range(3), 0, "flow_id", [], str(tmp_path / "r"), str(tmp_path / "q"))
    assert seen == ["false"] and spark.conf.get(SETTING, None) != "false"
