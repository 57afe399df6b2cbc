import numpy as np
import pytest

from ebbtide.config import Config
from ebbtide.queries import QUERIES, model_q


def test_registered_model_queries_use_the_whole_configuration(monkeypatch):
    seen = []
    monkeypatch.setattr(model_q, "panel", lambda spark, sf: None)
    monkeypatch.setattr(model_q, "fixed_selection", lambda d, meta: meta)
    monkeypatch.setattr(model_q.se, "report_frame", lambda spark, sel: None)
    for name in ("stability_select", "shadow_select"):
        monkeypatch.setattr(model_q.se, name, lambda d, sel, cfg: seen.append((len(sel), cfg)))
    model_q.stability(None, None)
    model_q.shadows(None, None)
    assert model_q.CFG == Config() and seen == [(12, Config())] * 2


def test_platt_takes_probabilities_rounded_to_zero_and_one(spark, monkeypatch):
    rows = [(i, 0.0 if i % 4 == 0 else 1.0 if i % 4 == 1 else 0.3 + 0.4 * (i % 4 == 3), int(i % 8 in (1, 3, 5, 6)), True) for i in range(400)]
    monkeypatch.setattr(model_q, "e_scored", lambda spark, sf: spark.createDataFrame(rows, "client long, p double, y int, train boolean"))
    (a, b), = QUERIES["model_platt"](spark, "").collect()
    assert 0.01 < a < 5 and np.isfinite(b)
    far = np.log(2.5e-5 / (1 - 2.5e-5))
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.0001,)], "p double").select(model_q.rounded_margin(model_q.F.col("p"))).collect()]
    assert got == pytest.approx([far, -far, 0.0, np.log(1e-4 / (1 - 1e-4))])


SF = "/root/testdata/sf0.001"


def test_boosted_trees_query_runs_as_configured(spark):
    rows = QUERIES["model_boosted_trees"](spark, SF).toPandas()
    assert len(rows) and rows["p"].between(0, 1).all()
    assert (1 / (1 + np.exp(-rows["logit"]))).to_numpy() == pytest.approx(rows["p"].to_numpy())


def test_validation_scores_each_client_by_a_fold_without_it(spark):
    rows = QUERIES["validation_nested_oof"](spark, SF).toPandas()
    scorable = model_q.panel(spark, SF).filter("scorable").count()
    assert rows["p"].notna().sum() == scorable and rows["base_score"].notna().sum() == scorable
    folds = rows.groupby("client")["fold"].nunique()
    assert (folds == 1).all() and 2 <= rows["fold"].nunique() <= Config().folds
