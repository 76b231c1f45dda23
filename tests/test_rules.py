"""Rules, sources, sinks and the whole run on small tables whose results are worked out by hand."""

import io
import math
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.values import INDEX, in_files, to_number, with_index
from tabulon.operators import cleaning, clustering, embedding, features, latent, profile, schema
from tabulon.plans import pipeline
from tabulon.sources import readers, sinks
from tabulon.sources.readers import Options, load, tidy_names
from tabulon.streaming import scoring


def rows(df):
    return [tuple(r) for r in df.collect()]


# Rules


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(x,) for x in ("5d", "1,234", " 7 ", "1e3", "nan", "", None, "-.5")], "s string")
    assert [r[0] for r in df.select(to_number(df, "s")).collect()] == [None, None, 7.0, 1000.0, None, None, None, -0.5]
    assert [r[0] for r in df.select(to_number(df, "s", commas=True)).collect()][1] == 1234.0
    numbers = spark.createDataFrame([(x,) for x in ("1", "2", "3", "4", "n/a", "100", None)], "s string")
    found = cleaning.outlier_report(numbers, ["s"])[0]
    assert (found["present"], found["outliers"], found["q1"], found["q3"], found["iqr"], found["status"]) == (5, 1, 2.0, 4.0, 2.0, "pending")
    assert cleaning.outlier_totals(numbers, [found]) == {"outliers": 1, "affected_rows": 1}
    assert rows(cleaning.outlier_sample(numbers, found)) == [("100",)]
    assert cleaning.outlier_report(numbers.limit(3), ["s"])[0]["status"] == "skipped"
    filled, report, _ = cleaning.handle_missing(numbers, {"s": "numeric"})
    assert report[0]["value"] == 22.0 and [r[0] for r in filled.collect()] == ["1", "2", "3", "4", "n/a", "100", "22.0"]


def test_semantic_types(spark):
    df = spark.createDataFrame([(i, str(i), f"{i},000", f"2024-01-{i + 1:02d}", i % 2 == 0, None) for i in range(20)], "id int, num_str string, comma_num string, date_str string, flag boolean, empty_col string")
    assert schema.types(schema.detect(df)) == {"id": "numeric", "num_str": "numeric", "comma_num": "numeric", "date_str": "categorical", "flag": "categorical", "empty_col": "unknown"}
    assert sum(schema.type_distribution(schema.detect(df)).values()) == 6


@pytest.mark.parametrize(("name", "role"), [("customer_id", "metadata"), ("customer-id", "metadata"), ("Order Date", "metadata"), ("lifetime_value", "metadata"), ("invoice", "metadata"), ("amount", "feature"), (INDEX, "metadata")])
def test_roles(name, role):
    assert profile.column_role(name, "numeric", 10, 10)[0] == role


def test_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, ""), (float("nan"), None), (3.0, "b")], "x double, c string")
    assert {r["column"]: r["n_missing"] for r in profile.counts(df).collect()} == {"x": 2, "c": 1}
    out = cleaning.filled(df, cleaning.fill_values(df, {"x": "mean", "c": "unknown"}))
    assert rows(out) == [(1.0, "a"), (2.0, ""), (2.0, "unknown"), (3.0, "b")]


def test_flat_quartiles(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 5.0, 5.0, 5.0, 9.0)], "x double")
    assert profile.fences(df, ["x"]) == {}  # the plan leaves it
    assert cleaning.outlier_report(df, ["x"])[0]["outliers"] == 1  # the stage does not
    assert cleaning.apply_plan(df, cleaning.Plan(duplicates="keep", outliers="drop_iqr")).report["removed_row_count"] == 0


def test_mode_of_equals_and_repeats(spark):
    df = spark.createDataFrame([(x,) for x in "babac"], "c string")
    assert profile.top_typed(df, "c") == "a"
    twice = spark.createDataFrame([(0, None, None), (1, "a", 1), (2, None, None), (3, "a", 1), (4, "a", 2)], f"{INDEX} int, k string, v int")
    done = cleaning.apply_plan(twice, cleaning.Plan(missing_numeric="keep", missing_categorical="keep", missing_text="keep", drop_constant=False))
    assert sorted(r[INDEX] for r in done.table.collect()) == [0, 1, 4]
    assert sorted(rows(done.removed.select(INDEX, "reason", "action", "affected_column"))) == [(2, "duplicate_row", "drop_row", ""), (3, "duplicate_row", "drop_row", "")]


def test_constant_columns(spark):
    df = spark.createDataFrame([("x", "b" if i == 0 else "a", None, i) for i in range(100)], "one string, most string, nothing string, n int")
    found = {c.name: c for c in profile.profile(df).by_column}
    assert (found["one"].constant, found["most"].constant, found["most"].near_constant, found["nothing"].constant) == (True, False, True, True)
    assert cleaning.apply_plan(df, cleaning.Plan()).report["dropped_columns"] == ["nothing", "one"]


def test_recommendation(spark):
    def of(cells, outliers=0, rows=1000):
        c = profile.ColumnProfile("x", "numeric", cells, 0.0, 10, 0.1, None, 0, False, False, "feature", False, "", outliers=outliers)
        return cleaning.recommend(profile.Profile(rows, 10, cells, 0, [c]))

    assert (of(0).missing_numeric, of(0, 3).missing_numeric, of(0, 3).outliers, of(0, 3).scaling) == ("mean", "median", "cap_iqr", "robust")
    # few cells are worth their rows; the mode is for tables with few missing cells in all, whatever columns hold them
    assert (of(50).missing_numeric, of(500).missing_numeric) == ("drop_rows", "mean")
    assert (of(10).missing_categorical, of(11).missing_categorical) == ("mode", "unknown")


def test_strategies(spark):
    s = cleaning.missing_strategy
    assert [s("text", "Empty String", False), s("numeric", "zero fill", False), s("unknown", "unknown_fill", False), s("categorical", "mean", False), s("numeric", None, True), s("unknown", None, False)] == ["empty", "zero", "unknown", "unknown", "drop_rows", "drop_rows"]
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)] + [(500.0, 500.0)], "a double, b double")
    config = cleaning.OutlierConfig(overrides={"a": "winsorization", "b": "outlier_group"})
    out, report, state = cleaning.handle_outliers(df, ["a", "b"], config)
    assert state == "auto" and cleaning.by_strategy(report) == {"numeric": {"cap": ["a"], "group": ["b"]}}
    last = out.where("b = 500").first()
    assert last["outlier_flag"] and last["a"] == report[0]["high"]
    assert cleaning.handle_outliers(df, ["a"], cleaning.OutlierConfig("skip"))[0].collect() == df.collect()


def test_confirmation():
    record = [{"column": "a"}]
    of = lambda **k: cleaning.confirmed(cleaning.MissingConfig(**k), record)
    assert [of(preview_only=True), of(confirm=lambda r: True), of(confirm=lambda r: False), of(), of(auto=False), cleaning.confirmed(cleaning.MissingConfig(), [])] == ["preview_only", "approved", "rejected", "auto", "awaiting", "not_required"]


def test_elbow():
    tried = [clustering.Tried(k, i, s) for k, i, s in zip(range(2, 7), (100, 60, 40, 35, 33), (0.5, 0.5, 0.49, 0.4, 0.3), strict=True)]
    assert clustering.elbow(tried) == 4 and clustering.best_k(tried) == 4
    assert clustering.best_k([clustering.Tried(2, 9.0, 0.9), clustering.Tried(3, 5.0, 0.2), clustering.Tried(4, 4.0, 0.1)]) == 2


def test_silhouette_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(4, 1, (20, 2)), [[50.0, 50.0]]])
    label = np.array([0] * 20 + [1] * 20 + [2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i, v in enumerate(label):
        own = (label == v).sum()
        a, b = d[i, label == v].sum() / max(1, own - 1), min(d[i, label == u].mean() for u in set(label) - {v})
        want.append((b - a) / max(a, b) if own > 1 else 0.0)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, label, strict=True)], "v array<double>, l int").repartition(3)
    assert math.isclose(clustering.silhouette(df, "v", "l"), np.mean(want), rel_tol=1e-9)
    monkeypatch.setattr(clustering, "BLOCK", 7)
    assert math.isclose(clustering.silhouette(df, "v", "l"), np.mean(want), rel_tol=1e-9)
    assert math.isclose(clustering.silhouette(df, "v", "l", queries=41), np.mean(want), rel_tol=1e-9)


def test_gradients():
    rng = np.random.default_rng(2)
    w, b = [rng.normal(0, 1, s) for s in ((4, 3), (3, 4))], [rng.normal(0, 1, k) for k in (3, 4)]
    x = rng.normal(0, 1, (5, 4))
    _, gw, gb = latent._pass(x, w, b, "relu", 1)
    for params, grads in ((w, gw), (b, gb)):
        for p, g in zip(params, grads, strict=True):
            at = tuple(0 for _ in p.shape)
            old, ends = p[at], []
            for e in (1e-6, -1e-6):
                p[at] = old + e
                ends.append(latent._pass(x, w, b, "relu", 1)[0])
            p[at] = old
            assert math.isclose(g[at], (ends[0] - ends[1]) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)


def test_model_failures_are_told(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            return np.ones((len(texts), 2))

        return model

    df = spark.createDataFrame([("a",), ("bad",), ("b",), (None,)], "t string").coalesce(1)
    m = embedding.Model(load, 2)
    assert [r["v"] for r in m.transform(df, "t", "v").collect()] == [[1, 1], [0, 0], [1, 1], [1, 1]]
    assert m.failures.value == 1
    for model, data in ((embedding.Model(load, 2, strict=True), df), (embedding.Model(load, 2), df.where("t = 'bad'"))):
        with pytest.raises(Exception, match="bad|failed on all"):
            model.transform(data, "t", "v").collect()


# Sources and sinks


def test_index(spark):
    df = spark.range(1000, numPartitions=7)
    for x in (df, df.repartition(5), df.where("id % 3 = 0")):
        got = with_index(x)
        assert sorted(r[0] for r in got.collect()) == list(range(x.count())) and got.columns[0] == INDEX
    assert with_index(with_index(df)).columns == [INDEX, "id"]


@pytest.fixture()
def place(tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    return put


def test_csv(spark, place):
    assert tidy_names(["a", "a", "", " b "]) == ["a", "a__1", "unnamed_column_2", "b"]
    assert load(spark, place("h.csv", "a,a,\n1,2,3\n")).columns == ["a", "a__1", "unnamed_column_2"]
    assert rows(load(spark, place("s.csv", "a;b\n1;x\n2;y\n"))) == [(1, "x"), (2, "y")]
    df = load(spark, place("w.csv", "né,b\n5 €,2\n„x“,3\n".encode("cp1252")))
    assert df.columns == ["né", "b"] and rows(df) == [("5 €", 2), ("„x“", 3)]
    assert rows(load(spark, place("q.csv", 'a,b\n"x\ny",1\n'))) == [("x\ny", 1)]
    with pytest.raises(ValueError, match="no rows"):
        load(spark, place("e.csv", "a,b\n"))
    assert load(spark, place("e.csv", "a,b\n"), Options(allow_empty=True)).count() == 0


def test_given_inline(spark, tmp_path):
    want = [(1, "x"), (2, "y")]
    assert rows(load(spark, "a,b\n1,x\n2,y\n", Options("csv"))) == want
    assert rows(load(spark, b"a,b\n1,x\n2,y\n")) == want
    assert rows(load(spark, io.StringIO("a,b\n1,x\n2,y\n"), Options("csv"))) == want
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    with open(tmp_path / "t.csv", "rb") as f:
        f.read()
        assert rows(load(spark, f)) == want
    assert rows(load(spark, tmp_path / "t.csv")) == want
    assert rows(load(spark, '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', Options("json"))) == want
    with pytest.raises(FileNotFoundError):
        load(spark, "/no/such/file.csv")
    with pytest.raises(TypeError):
        load(spark, 7)


@pytest.mark.parametrize(("orient", "text"), [
    (None, '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]'), (None, '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n'), (None, '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}'),
    ("columns", '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}'), ("index", '{"r": {"a": 1, "b": "x"}, "s": {"a": 2, "b": "y"}}'),
    ("split", '{"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, "y"]]}'),
])
def test_json(spark, place, orient, text):
    df = load(spark, place("t.json", text), Options(orient=orient))
    assert df.columns == ["a", "b"] and rows(df) == [(1, "x"), (2, "y")]


def test_json_values(spark, place):
    assert rows(load(spark, place("t.json", '[[1.5, "x"], [2, null]]'), Options(orient="values"))) == [(1.5, "x"), (2.0, None)]
    with pytest.raises(ValueError, match="orient"):
        load(spark, place("t.json", "[]"), Options(orient="table"))


def test_workbook(spark, place):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {m}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        cell = lambda at, v, s=0: f'<c r="{at}" s="{s}"><v>{v}</v></c>'
        text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
        z.writestr("xl/worksheets/s.xml", f"<worksheet {m}><sheetData><row>{text('A1', 'day')}{text('B1', 'n')}{text('C1', 'at')}</row><row>{cell('A2', 45292, 1)}{cell('B2', 3, 3)}{cell('C2', 45292.5, 2)}</row><row>{cell('A3', 45293, 1)}</row></sheetData></worksheet>")
    df = load(spark, place("t.xlsx", data.getvalue()))
    assert rows(df) == [(datetime(2024, 1, 1), 3, datetime(2024, 1, 1, 12)), (datetime(2024, 1, 2), None, None)]
    assert rows(load(spark, data.getvalue())) == rows(df)


def test_metadata_preview_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (0, None)], f"{INDEX} int, c string")
    assert readers.metadata(df)["nulls"] == {INDEX: 0, "c": 1}
    assert [r[INDEX] for r in readers.preview(df)] == [0, 1]
    path = sinks.export_table(df, str(tmp_path), "removed", single=True)
    assert [r[INDEX] for r in spark.read.csv(path, header=True, inferSchema=True).collect()] == [0, 1]
    assert sinks.export_table(df.limit(0), str(tmp_path), "none") is None
    assert "né" in open(sinks.export_report({"a": "né"}, str(tmp_path), "report"), encoding="utf-8").read()


# The whole run


def test_run_and_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = [(i, float(rng.normal(i % 2 * 10)), float(rng.normal(i % 2 * 10)), "ab"[i % 2] if i % 11 else None, "EU") for i in range(60)]
    df = spark.createDataFrame([*made, made[0]], "customer_id int, x double, y double, segment string, country string")
    result = pipeline.run(df, pipeline.Config(plan=cleaning.Plan(duplicates="drop"), k_max=3, restarts=2, epochs=3, autoencoder=False))
    assert result.k == 2 and result.report["cleaning"]["removed_row_count"] == 1 and result.report["cleaning"]["dropped_columns"] == ["country"]
    assert sum(result.metrics["distribution"].values()) == 60 and result.table.select("cluster_label").distinct().count() == 2
    assert result.tracker.state["evaluation"][0] == "done" and result.tracker.state["latent"][0] == "skipped"
    with pytest.raises(ValueError):
        pipeline.run(df.select("customer_id"))

    typed = {"x": "numeric", "y": "numeric"}
    table = df.select("x", "y")
    fm = features.fit(table, typed, "standard", "onehot")
    model = clustering.fit_kmeans(features.apply(table, fm), 2, restarts=1)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    scoring.start(stream, fm, model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = clustering.labelled(features.apply(table, fm), model).select("x", "y", "cluster_label")
    assert sorted(rows(got.select("x", "y", "cluster_label"))) == sorted(rows(want))


def test_index_in_profile(spark):
    p = profile.profile(with_index(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, c string")))
    assert (p.rows, p.missing_cells, p.duplicates) == (3, 1, 1)
    assert p.to_df(spark).where(F.col("name") == "c").first()["missing"] == 1


# Readers beyond the head of a file


LATE = "".join(f"{i},plain text {i},{i * 0.5}\n" for i in range(4000))


def small_splits(spark, size="16k"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")


@pytest.fixture()
def splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    small_splits(spark)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_late_quote_with_line_end(splits, place):
    text = "a,b,c\n" + LATE + '4000,"two\nlines, and ""quotes""\r\nhere",1\n' + LATE + '4001,5" pipe,2\n'
    df = load(splits, place("late.csv", text), Options(index=True))
    got = df.orderBy(readers.INDEX).collect()
    assert len(got) == 8002 and df.rdd.getNumPartitions() > 4
    assert tuple(got[4000]) == (4000, 4000, 'two\nlines, and "quotes"\r\nhere', 1.0) and tuple(got[4001])[1:] == (0, "plain text 0", 0.0) and got[8001]["b"] == '5" pipe'


def test_late_bytes_of_windows(splits, place):
    raw = ("a,b,c\n" + LATE).encode() + b"4000,caf\xe9 \x80,1\n"
    assert [r["b"] for r in load(splits, place("late.csv", raw)).where("a = 4000").collect()] == ["café €"]
    assert [r["b"] for r in load(splits, place("later.csv", raw + b"4001,\x81\x80\xe9,2\n")).where("a = 4001").collect()] == ["\x81\x80é"]
    assert [r["b"] for r in load(splits, place("broken.csv", raw + b'4001,"\xe9\n\x80",2\n')).where("a = 4001").collect()] == ["é\n€"]


def test_late_line_of_other_width(splits, place):
    text = "a;b,c\n" + "".join(f"{i};x,y{i}\n" for i in range(4000))
    assert load(splits, place("semi.csv", text)).count() == 4000
    more = "k,v|w\n" + "1,2|3\n" * 4000 + "1,2,9|3\n"  # a comma parts all but the last line
    df = load(splits, place("pipe.csv", more))
    assert df.columns == ["k,v", "w"] and df.count() == 4001


@pytest.mark.parametrize("seed", range(6))
def test_records_as_the_csv_module_cuts_them(splits, tmp_path, seed):
    """Random fields with quotes, line ends and separators over many splits, some of them inside one field."""
    import csv
    import random

    rng = random.Random(seed)
    bits = ["x", "yy ", '"', '""', "\n", "\r\n", ",", "é", "long " * 40, "z\n" * 30, "1"]
    rows_in = [[f"r{i}", "".join(rng.choices(bits, k=rng.randint(0, 6))), "".join(rng.choices(bits, k=rng.randint(0, 3))) + "e"] for i in range(600)]
    rows_in[300][1] = "line\n" * 9000  # splits that never leave a field
    (tmp_path / "t").mkdir()
    for name, part in (("a.csv", rows_in[:450]), ("b.csv", rows_in[450:])):
        with open(tmp_path / "t" / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([["id", "b", "c"], *part])
    small_splits(splits, "4k")
    df = load(splits, str(tmp_path / "t"), Options("csv"))
    got = {r["id"]: (r["b"] or "", r["c"]) for r in df.collect()}
    assert df.count() == 600 and got == {i: (b, c) for i, b, c in rows_in}


def test_splits_compose(splits, place, monkeypatch):
    """The looked-up way of what is broadcast while small gives the same rows."""
    text = "a,b\n" + "".join(f'{i},"x\n{i}\n"\n' if i % 3 else f"{i},y\n" for i in range(5000))
    path = place("t.csv", text)
    want = rows(load(splits, path))
    assert len(want) == 5000 and (1, "x\n1\n") in want
    monkeypatch.setattr(readers.records, "HELD_BYTES", 0)
    assert rows(load(splits, path)) == want


def test_a_quote_that_never_closes(splits, place, monkeypatch):
    monkeypatch.setattr(readers.records, "RECORD_BYTES", 10_000)
    with pytest.raises(Exception, match="quoted field of over"):
        load(splits, place("t.csv", 'a,b\n1,"x\n' + LATE.replace(",", ";"))).count()


def test_json_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}')
    (tmp_path / "t/b.json").write_text('{"a": {"1": 3, "0": 4}, "b": {"1": "z", "0": null}}')
    for orient in (None, "columns"):
        assert [tuple(r) for r in load(spark, str(tmp_path / "t"), Options("json", orient=orient)).collect()] == [(1, "x"), (2, "y"), (3, "z"), (4, None)]


def test_json_labels_and_lists(spark, place):
    assert rows(load(spark, place("l.json", '{"a": {"p": 1, "q": 2}, "b": {"p": "x", "q": "y"}}'))) == [(1, "x"), (2, "y")]
    assert rows(load(spark, place("m.json", '{"a": [1, 2],\n "b": ["x", "y"]}'))) == [(1, "x"), (2, "y")]
    assert load(spark, place("n.json", '{"a": {"p": 1}}\n{"a": {"p": 2}}\n')).count() == 2
    assert rows(load(spark, place("o.json", '{"a": 1, "b": "x"}'))) == [(1, "x")]


def test_mistyped_paths(spark):
    for path in ("/nowhere/x.csv", "nowhere/x.csv.gz", "s3://bucket/table"):
        with pytest.raises(Exception, match="nowhere|s3"):
            load(spark, path, Options("csv"))


# Models fitted together


def test_kmeans_together_and_apart(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in (0, 4, 9)] + [np.zeros((90, 3))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(7)
    together = clustering.fit_many(df, [2, 3, 4, 5], "v", restarts=3)
    for k, f in together.items():
        apart = clustering.fit_kmeans(df, k, "v", restarts=3)
        assert math.isclose(f.inertia, apart.inertia, rel_tol=1e-9) and f.sizes.sum() == len(x)
        at, d = clustering.assigned(x, f.centres)
        assert math.isclose(d.sum(), f.inertia, rel_tol=1e-9) and np.bincount(at, minlength=k).tolist() == f.sizes.tolist()
        lloyd = np.array([x[at == i].mean(0) for i in range(k)])
        assert np.abs(lloyd - f.centres).max() < 0.05  # a fixed point, to the tolerance
        named = clustering.labelled(df, f, "v").collect()
        assert [r["cluster_label"] for r in named] == clustering.assigned(np.array([r["v"] for r in named]), f.centres)[0].tolist()
    assert together[3].inertia < 1.2 * sum(((x[x.sum(1).argsort()][a:b] - x[x.sum(1).argsort()][a:b].mean(0)) ** 2).sum() for a, b in ((0, 150), (150, 210), (210, 270)))


def test_sweep_skips_what_fails(spark):
    x = [[float(i % 3), 0.0] for i in range(30)]
    df = spark.createDataFrame([(r,) for r in x], "v array<double>")
    with pytest.warns(UserWarning, match="K=4 was skipped: only 3 clusters"):
        tried = clustering.sweep(df, "v", 2, 5, restarts=2)
    assert [t.k for t in tried] == [2, 3] == list(tried.fits) and set(tried.skipped) == {4, 5} and math.isclose(tried[1].inertia, 0, abs_tol=1e-9) and tried[1].silhouette == 1
    for t in tried:
        assert math.isclose(t.silhouette, clustering.silhouette(clustering.labelled(df, tried.fits[t.k], "v"), "v", "cluster_label"), rel_tol=1e-9)
    with pytest.raises(ValueError, match="three rows"):
        clustering.sweep(df.limit(2), "v")


def full_batch(x, epochs=50, rate=0.01, seed=42):
    """The loss of Adam over all rows at once, a step an epoch."""
    d = x.shape[1]
    z = latent.latent_size(d)
    inner = latent.hidden_sizes(d, z)
    sizes = [d, *inner, z, *reversed(inner), d]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, math.sqrt(1 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)] + [np.zeros(k) for k in sizes[1:]]
    m, v, n = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], len(sizes) - 1
    for t in range(1, epochs + 1):
        loss, gw, gb = latent._pass(x, params[:n], params[n:], "relu", len(inner))
        for i, g in enumerate(gw + gb):
            g = g / len(x)
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return loss / len(x)


@pytest.mark.parametrize("batch", [128, 16])
def test_many_steps_a_pass(spark, batch):
    """Mini-batches reach at most the loss of full batches in as many epochs, in one task and with the weights of several averaged."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 12)) + 0.05 * rng.normal(size=(3000, 12))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    net = latent.train(df, "v", batch=batch)
    assert len(net.losses) == 50 and net.losses[-1] <= full_batch(x) and net.fallback is None


def test_weight_decay():
    """One step by hand: decay times the weight is part of the gradient."""
    rng = np.random.default_rng(9)
    params = [rng.normal(size=s) for s in ((4, 2), (2, 4), (2,), (4,))]
    x, old = rng.normal(size=(5, 4)), [p.copy() for p in params]
    _, gw, gb = latent._pass(x, old[:2], old[2:], "relu", 0)
    _, step = latent._walk(x, (params, [np.zeros_like(p) for p in old], [np.zeros_like(p) for p in old], 0), ("relu", 0, 2), 0.01, 0.3, 128, rng)
    for was, now, g in zip(old, params, gw + gb, strict=True):
        g = g / 5 + 0.3 * was
        assert np.allclose(now, was - 0.01 * g / (np.abs(g) + 1e-8), atol=1e-9) and step == 1


def test_simpler_network_after_failure(spark, monkeypatch):
    assert [latent.simpler_hidden(*a) for a in ((64, 16), (3, 2), (4, 2), (2, 1))] == [[40], [], [3], []]
    x = np.random.default_rng(7).normal(size=(200, 12))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    with pytest.warns(UserWarning, match="trying layers of"):
        net = latent.train(df, "v", hidden=[0], epochs=3)
    assert "can't be built" in net.fallback and [w.shape[1] for w in net.weights][:2] == [latent.simpler_hidden(12, latent.latent_size(12))[0], latent.latent_size(12)]
    with pytest.warns(UserWarning, match="diverged"), pytest.raises(ValueError, match="diverged"):
        latent.train(df, "v", rate=1e200, epochs=3, hidden=[10])
    with pytest.raises(ValueError, match="diverged"):
        latent.train(df, "v", rate=1e200, epochs=3, fallback=False)


def test_tsne_of_all_rows(spark):
    """Neighbours on a map of landmarks that the other rows are placed on are kept nearly as well as by exact t-SNE of all rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8, 10))[rng.integers(0, 8, 600)] * 4 + rng.normal(size=(600, 10))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k bigint, v array<double>")

    def kept(y):
        far = lambda a: np.argsort(latent._squares(a, a) + np.diag(np.full(len(a), np.inf)), axis=1)
        before, after = far(x)[:, :10], far(y)[:, :30]
        return np.mean([len({*a} & {*b}) / 10 for a, b in zip(before, after, strict=True)])

    got = latent.tsne_chart(df, "v", "k", landmarks=200).orderBy("k").toPandas()
    placed, exact = kept(got[["x", "y"]].to_numpy()), kept(latent.tsne(x))
    assert len(got) == 600 and placed > 0.75 * exact > 0.4, (placed, exact)
    whole = latent.tsne_chart(df.limit(150), "v", "k", landmarks=200)
    assert whole.count() == 150
    assert latent.tsne_chart(df.limit(1), "v", "k").count() == 1
    fitted = latent.Map(x[:200], latent.tsne(x[:200]))
    at = fitted.y[:50] + 0.3
    w = 1 / (1 + latent._squares(at, fitted.y))
    total, push = fitted.repulsion(at)
    assert np.allclose(total, w.sum(1), rtol=0.02) and np.allclose(push, (w * w).sum(1)[:, None] * at - (w * w) @ fitted.y, atol=0.05 * np.abs(push).max())


# Plans


def test_index_after_a_shuffle(spark):
    df = spark.range(5000, numPartitions=9).select("id", F.lit("x").alias("_file"), F.lit(1).alias("a.b")).repartitionByRange(6, "id").sortWithinPartitions("id")
    got = with_index(df)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == [INDEX, "id", "_file", "a.b"] and all(r[0] == r[1] for r in got.collect()) and got.count() == 5000
    assert with_index(df.where("id < 0").repartition(2)).count() == 0


def test_profile_counts_values_once(spark):
    rows_in = [(0.0, "a", datetime(2024, 1, 1), [1, 2], b"x"), (-0.0, "a", datetime(2024, 1, 1), [1, 2], b"y"), (float("nan"), None, None, [3], b"x"), (1.5, "b", datetime(2024, 1, 2), None, None)]
    df = spark.createDataFrame(rows_in, "d double, s string, t timestamp, l array<int>, b binary")
    plan = profile.by_column(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    got = {r["column"]: tuple(r)[1:4] for r in profile.by_column(df, df.columns).collect()}
    assert got == {"d": (1, 2, 4), "s": (1, 2, 4), "t": (1, 2, 4), "l": (1, 2, 4), "b": (1, 2, 4)}
    assert {c.name: (c.top_value, c.top_frequency) for c in profile.profile(df).by_column if c.name in "ds"} == {"d": ("0.0", 2), "s": ("a", 2)}
    none = profile.profile(df.limit(0))
    assert none.rows == 0 and [(c.missing, c.unique, c.top_value) for c in none.by_column] == [(0, 0, None)] * 5


def test_levels_and_ranks_over_many_tasks(spark):
    from tabulon.functions.quantiles import average_ranks
    from tabulon.operators import charts

    names = [f"Customer#{i:06d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "c string").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        levels = features.ordinal_levels(df, "c")
        assert in_files(df.distinct().orderBy("c"), F.lit(1))[1].count() > 4
        assert [tuple(r) for r in levels.orderBy("level").collect()] == [(n, i) for i, n in enumerate(names)]
        rng = np.random.default_rng(3)
        v = np.where(rng.random(2000) < 0.4, 7.0, rng.integers(0, 500, 2000) / 4)
        got = {r["value"]: r["rank"] for r in average_ranks(spark.createDataFrame([(float(a),) for a in v], "v double"), F.col("v")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    import pandas as pd

    assert got == dict(zip(v, pd.Series(v).rank(), strict=True))
    table = pd.DataFrame({"a": v, "b": v**2 + rng.normal(0, 50, 2000), "c": rng.integers(0, 9, 2000).astype(float), "d": np.where(rng.random(2000) < 0.2, np.nan, v)})
    want = table.corr("spearman")
    for r in charts.correlation(spark.createDataFrame(table), list("abcd"), "spearman").collect():
        assert math.isclose(r["r"], want.loc[r["a"], r["b"]], abs_tol=1e-9), r
    assert charts.correlation(spark.createDataFrame(table), list("abcd"), "spearman").count() == 6


# Failures, progress and logs


def test_failed_rows_are_named(spark):
    def load():
        tried = []

        def model(texts):
            tried.append(len(texts))
            if any("bad" in t for t in texts) or len(tried) == 1:
                raise ValueError("can't read " + texts[0])
            return np.ones((len(texts), 2))

        return model

    df = spark.createDataFrame([(1, "a", "x"), (2, "bad one", "y"), (3, None, "bad two")], "k int, t string, u string").coalesce(1)
    got = embedding.embed(df, ["t", "u"], embedding.Model(load, 2, errors="why", wait=0.01), "concat_vector").orderBy("k").collect()
    assert [(r["k"], r["embedding"], r["why"]) for r in got] == [(1, [1, 1, 1, 1], None), (2, [0, 0, 1, 1], "ValueError: can't read bad one"), (3, [1, 1, 0, 0], "ValueError: can't read bad two")]
    told = embedding.embed(df.where("k = 2"), ["t"], embedding.Model(load, 2, errors="why")).collect()
    assert told[0]["why"] == "ValueError: can't read bad one" and "_made" not in told[0].asDict()
    asked = embedding.embed(df, ["t"], embedding.HashedWords(8), model="e5", query=True)
    assert asked.where("k = 1").first()["embedding"] != embedding.embed(df, ["t"], embedding.HashedWords(8), model="e5").where("k = 1").first()["embedding"]


def test_progress_rises_while_a_job_runs(spark):
    import time

    from tabulon.plans import progress

    seen = []

    def slow(parts):
        for p in parts:
            time.sleep(0.4)
            yield p

    with progress.watched(spark, lambda done, total: seen.append((done, total)), every=0.1):
        spark.range(0, 24, 1, 24).mapInPandas(slow, "id bigint").count()
    done = [d for d, _ in seen]
    assert len(done) >= 3 and done == sorted(set(done)) and done[-1] == seen[-1][1] >= 24
    with progress.watched(spark, lambda *_: 1 / 0):
        assert spark.range(3).count() == 3


def test_run_reports_and_logs(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), "uv"[i % 2]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)) + 5 * rng.integers(0, 2, (60, 1)))], "x double, y double, g string")
    seen = []
    out = pipeline.run(df, pipeline.Config(autoencoder=False, k_max=3, restarts=1, progress=lambda *a: seen.append(a)))
    assert {"profile", "clustering"} <= {s for s, _, _ in seen} and [d for _, d, _ in seen] == sorted(d for _, d, _ in seen)
    said = [m for _, _, m in out.tracker.lines]
    assert "profile: running" in said and "evaluation: done" in said and said.index("clustering: running") < said.index("evaluation: running")
    log = pipeline.captured
    with log() as lines, pytest.raises(ValueError, match="no feature columns"):
        pipeline.run(spark.createDataFrame([(1, 2)], "a_id int, b_id int"))
    assert [(lv, m) for _, lv, m in lines.lines if lv == "ERROR"] == [("ERROR", "schema: failed (no feature columns)")] and lines.to_df(spark).count() == len(lines.lines)
