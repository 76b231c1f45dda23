"""Schemas of all forms, the map from columns to features, chart tables and exports with a mark."""

import glob
from types import SimpleNamespace

import pytest

from tabulon.functions.values import INDEX
from tabulon.operators import charts, cleaning, clustering, features, schema
from tabulon.plans import pipeline
from tabulon.sources import sinks
from tabulon.sources.readers import load


@pytest.fixture(scope="module")
def df(spark):
    made = [(i, float(i), "ab"[i % 2], f"a long remark of several words, number {i}", i % 2 == 0, None) for i in range(20)]
    return spark.createDataFrame(made, f"{INDEX} long, x double, g string, note string, flag boolean, gone string")


@pytest.mark.parametrize("form", [
    {"x": "numeric", "g": "categorical"},
    {"columns": [{"name": "x", "inferred_type": " Numeric"}, {"name": "g", "type": "categorical"}]},
    [SimpleNamespace(name="x", inferred_type="numeric"), {"name": "g", "inferred_type": "categorical"}],
    SimpleNamespace(columns=(SimpleNamespace(name="x", type="numeric", metadata=None), SimpleNamespace(name="g", inferred_type="categorical", metadata={}))),
])
def test_forms(df, form):
    found = schema.resolve(df, form)
    assert found.types == {"x": "numeric", "g": "categorical", "note": "text", "flag": "categorical", "gone": "unknown"}
    assert found.inferred == ["note", "flag", "gone"] and len(found.warnings) == 3
    assert schema.resolve(df, form, "unknown").types["note"] == "unknown" and "note" not in schema.resolve(df, form, "ignore").types


def test_odd_schemas(df):
    found = schema.resolve(df, [{"name": "x", "inferred_type": "money"}, {"inferred_type": "text"}, {"name": "y", "type": "text"}, {"name": "g", "type": "text", "metadata": {"inference_confidence": 0.7, "samples": ["a"]}}], "ignore")
    assert found.types == {"x": "unknown", "g": "text"} and len(found.warnings) == 3
    assert found.confidence == {"g": 0.7} and found.samples == {"g": ["a"]}
    own = schema.resolve(df, schema.detect(df))
    assert own.inferred == [] and own.confidence["x"] == 0.99 and own.samples["g"][:2] == ["a", "b"]
    for bad, error in (([], ValueError), ({"columns": None}, TypeError), (5, TypeError), ([{"type": "text"}], ValueError), (df, TypeError), ("numeric", TypeError)):
        with pytest.raises(error):
            schema.resolve(df, bad)
    with pytest.raises(ValueError, match="no columns"):
        schema.resolve(df.select(), {"x": "numeric"})
    with pytest.raises(TypeError):
        schema.resolve([1], {"x": "numeric"})


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "`a.b` string, n int, v array<int>")
    assert schema.fallback_types(empty, empty.columns) == {"a.b": "unknown", "n": "numeric", "v": "unknown"}
    dotted = spark.createDataFrame([("p", [1]), ("q", None)], "`a.b` string, v array<int>")
    assert schema.fallback_types(dotted, dotted.columns) == {"a.b": "categorical", "v": "categorical"}


def test_stages_take_schemas(df):
    report = cleaning.missing_report(df, {"columns": [{"name": "x", "inferred_type": "numeric"}]})
    assert [(r["column"], r["type"], r["strategy"]) for r in report] == [("gone", "unknown", "drop_rows")]
    assert [r["column"] for r in cleaning.outlier_report(df, schema.detect(df))] == ["x"] == cleaning.numeric_columns(df, ["x"])
    with pytest.raises(ValueError, match="no such columns"):
        cleaning.outlier_report(df, ["nowhere"])


def test_feature_map(spark, df):
    fm = features.fit(df, {"x": "numeric", "gone": "numeric"}, "MinMaxScaler", "label", encoders={"flag": "One-Hot"})
    told = fm.describe()
    assert told["x"] == {"source_type": "numeric", "transformation": "scaled", "processor": "minmax", "state": {"centre": 0.0, "scale": 19.0}, "output_features": ["x"], "skipped": False}
    assert told["flag"]["categories"] == ["false", "true"] and told["flag"]["output_features"] == ["flag_false", "flag_true"] and told["g"]["processor"] == "ordinal"
    assert told["gone"]["skipped"] and told["gone"]["source_type"] == "numeric" and "missing" in told["gone"]["error"]
    assert told["note"]["transformation"] == "passthrough"
    assert fm.groups() == {"numeric": ["x"], "categorical": ["flag", "g"], "text": ["note"], "skipped": ["gone", INDEX]}
    places = fm.provenance(spark).orderBy("place").collect()
    assert [r["feature"] for r in places] == fm.names() and [r["level"] for r in places if r["source"] == "flag"] == ["false", "true"]
    assert len(features.apply(df, fm).first()["features"]) == len(places)
    many = features.fit(df.select("note"), {"note": "categorical"}, max_levels=5)
    assert many.describe()["note"]["fallback"] and any("more than 5 levels" in w for w in many.warnings)
    assert features.fit(df, {"x": "numeric"}, infer=False).names() == ["x"]
    with pytest.raises(ValueError, match="unknown encoder"):
        features.fit_encoders(df, ["g"], "hashing")
    with pytest.raises(ValueError, match="unknown scaler"):
        features.fit_scalers(df, ["x"], "log")


def test_text_columns(df):
    fm = features.FeatureMap(text=["note", "title"])
    assert fm.text_columns(df.select(INDEX, "g", "note"))[0] == ["note", "g"] and len(fm.text_columns(df.select("g", "note"))[1]) == 2
    assert features.FeatureMap().text_columns(df.select("g")) == (["g"], [])


def test_chart_tables(spark):
    tried = [clustering.Tried(3, 5.0, 0.4), clustering.Tried(2, 9.0, 0.5)]
    assert [tuple(r) for r in charts.k_chart(spark, tried, 2).orderBy("k").collect()] == [(2, 9.0, 0.5, True), (3, 5.0, 0.4, False)]
    assert [tuple(r) for r in charts.loss_chart(spark, [2.0, 1.5]).collect()] == [(1, 2.0), (2, 1.5)] and charts.loss_chart(spark, []).count() == 0


def test_run_gives_charts(spark):
    df = spark.createDataFrame([(float(i % 2 * 9 + i % 5 / 9), float(i % 3), "uv"[i % 2]) for i in range(40)], "x double, y double, g string")
    out = pipeline.run(df, pipeline.Config(k_max=3, restarts=1, epochs=4))
    assert [r["k"] for r in out.k_chart().where("chosen").collect()] == [out.k] and out.loss_chart().count() == 4
    points = out.scatter().collect()
    assert len(points) == out.table.count() and {r["label"] for r in points} == set(range(out.k))
    assert set(out.report["feature_map"]) >= {"x", "y", "g"} and out.report["feature_groups"]["categorical"] == ["g"]
    assert [r["chosen"] for r in out.report["tried"]].count(True) == 1


def test_mark(spark, tmp_path):
    df = spark.createDataFrame([(i, "é") for i in range(6)], "a int, b string").repartition(2)
    path = sinks.export_table(df, str(tmp_path), "t", bom=True)
    files = glob.glob(f"{path}/*.csv")
    assert len(files) == 2 and all(open(f, "rb").read().startswith(b"\xef\xbb\xbfa,b\n") for f in files)
    assert sorted(tuple(r)[-2:] for r in load(spark, path).collect()) == [(i, "é") for i in range(6)]
    assert not open(glob.glob(sinks.export_table(df, str(tmp_path), "u") + "/*.csv")[0], "rb").read().startswith(b"\xef")
