from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from toroid.operators import metrics as M
from toroid.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    other = duck.sql(ORACLE_SQL[name])
    assert sorted(other.columns) == sorted(df.columns)
    at = [other.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, rows), key=repr) == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=repr)


def test_trees_beat_the_baseline(spark):
    rows = {r.model: r for r in QUERIES["holdout_comparison"](spark, "/root/testdata/sf0.01").collect()}
    assert rows["random_forest"].beats_baseline and rows["hist_gradient_boosting"].beats_baseline


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", ["numeric_coercion", "tau_ipb98", "score_features", "viol_missing", "temp_conversions", "features_core"])
@pytest.mark.parametrize("column, shift, kind", [("l_partkey", 10**12, "BIGINT"), ("l_linenumber", 10**6, "INTEGER")])
def test_query_equals_sql_where_keys_are_large(spark, tmp_path, name, column, shift, kind):
    at = str(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (CAST({column} + {shift} AS {kind}) AS {column}) FROM '{SF}/lineitem.parquet') TO '{at}'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{at}'")
    df, other = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    places = [other.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in other.fetchall()), key=repr)


def test_families_share_their_medians(spark, monkeypatch):
    from toroid import queries as Q

    calls, own = [], Q.L.quantiles
    monkeypatch.setattr(Q.L, "quantiles", lambda *a, **k: calls.append(1) or own(*a, **k))
    monkeypatch.setattr(Q, "_SPLITS", {})
    assert QUERIES["holdout_comparison"](spark, SF).count() == 3 and len(calls) == 1
    assert QUERIES["rf_predict"](spark, SF).count() > 0 and QUERIES["feature_importance"](spark, SF).count() and len(calls) == 1


def test_metrics_table_has_every_step(spark):
    rows = {r.model: r for r in QUERIES["metrics_table"](spark, SF).collect()}
    assert list(rows)[0] == "surrogate" and {"baseline", "surrogate", "crude", "doubled"} == set(rows)
    holdout = ["holdout_mae", "holdout_rmse", "holdout_r2", "holdout_high_yield_mae", "holdout_high_yield_count"]
    assert all(r[c] is not None for r in rows.values() for c in holdout) and rows["baseline"].cv_rmse_std > 0


def test_a_fold_without_a_finite_error_raises(spark):
    folds = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 3.0, None)], "model string, fold int, mae double, rmse double")
    with pytest.raises(Exception, match="cross-validation fold 1: rmse"):
        M.fold_summary(folds).collect()
    assert M.fold_summary(folds.where("fold = 0")).first().cv_rmse_mean == 2.0
