import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.tables import TABLE
from gridloom.operators import scoring
from gridloom.sources import readers, sinks
from gridloom.streaming import streams


def test_corpora_and_questions(spark, tmp_path):
    line = '{"context": "c", "table": {"header": ["h"], "rows": [["1"], [null]]}, "mentions": [[0, 1]], "answers": ["a"], "other": 1}\n'
    for name in readers.CORPORA:
        (tmp_path / f"{name}.jsonl").write_text(line * 2)
    corpora = readers.read_corpora(spark, str(tmp_path))
    assert {n: d.count() for n, d in corpora.items()} == dict.fromkeys(readers.CORPORA, 2)
    assert corpora["sql"].first().table.rows == [["1"], [None]]
    (tmp_path / "t.json").write_text('{"id": "1", "question": "q", "table": {"header": [], "rows": []}, "answers": []}\n')
    both = readers.read_questions(spark, {"train": str(tmp_path / "t.json"), "test": str(tmp_path / "t.json")})
    assert both.groupBy("split").count().count() == 2
    assert readers.select_split(both, "train").count() == 1
    pd.DataFrame({"id": ["1"], "question": ['a "b", c\nd'], "table": ['{"header": ["h"], "rows": [["1"]]}'], "answers": ['["x"]']}).to_csv(tmp_path / "t.csv", index=False)
    row = readers.read_questions(spark, {"validation": str(tmp_path / "t.csv")}).first()
    assert (row.question, row.table.header, row.answers) == ('a "b", c\nd', ["h"], ["x"])
    with pytest.raises(NotImplementedError):
        readers.select_split(both, "train", predicting=True)
    with pytest.raises(ValueError):
        readers.read_questions(spark, {"train": "x.parquet"})
    with pytest.raises(ValueError):
        readers.read_questions(spark, {})


def test_lines_ids_and_targets(spark, tmp_path):
    (tmp_path / "ids").write_text("".join(f"id-{i} \n" for i in range(5000)))
    lines = readers.numbered_lines(spark, str(tmp_path / "ids")).orderBy("line").collect()
    assert [(r.line, r.value) for r in lines] == [(i, f"id-{i}") for i in range(5000)]
    rows = spark.createDataFrame([("id-1", 1), ("id-2", 2), ("x", 3)], "id string, v int")
    two = spark.createDataFrame([("id-1",), ("id-2",)], "id string")
    assert readers.keep_ids(rows, two).count() == 2
    with pytest.raises(ValueError):
        readers.keep_ids(rows, readers.id_set(spark, str(tmp_path / "ids")))
    folder = tmp_path / "tagged"
    folder.mkdir()
    (folder / "a.tsv").write_text("id\ttargetValue\ttargetCanon\nnu-0\tx\\pz|y\t1|2\nnu-1\told\told\n")
    (folder / "b.tsv").write_text("targetCanon\tid\ttargetValue\n3\tnu-1\tnew\r\n\n4\tnu-5\n")
    targets = readers.read_targets(spark, str(folder))
    assert {r.ex_id: (r.originals, r.canonicals) for r in targets.collect()} == {"nu-0": (["x|z", "y"], ["1", "2"]), "nu-1": (["new"], ["3"]), "nu-5": (None, ["4"])}
    (tmp_path / "pred").write_text("1, 2\n3.0\n")
    predictions = scoring.predictions_with_ids(readers.numbered_lines(spark, str(tmp_path / "pred")), None)
    scored = scoring.denotation_scores(scoring.join_targets(predictions, targets), "prediction", "originals", "canonicals")
    assert {r.ex_id: r.correct for r in scored.collect()} == {"nu-0": True, "nu-1": True}
    with pytest.raises(Exception, match="no target"):
        scoring.join_targets(predictions, targets.where("ex_id = 'nu-0'")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, " b\nc "), (1, "a"), (3, None)], "i int, p string")
    sinks.write_predictions(df, "i", "p", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "a\nb c\n\n"
    report = sinks.metrics(df, "test", {"accuracy": 0.5}, 2)
    assert report.first().asDict() == {"test_samples": 2, "test_accuracy": 0.5}
    sinks.write_metrics(report, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_metrics(report, str(tmp_path / "m"))
    made = []
    make = lambda: made.append(1) or df
    source = tmp_path / "in.txt"
    source.write_text("a")
    again = lambda settings: sinks.cached(spark, make, str(tmp_path / "c"), settings, [str(source)]).count()
    assert again({"a": 1}) == again({"a": 1}) == 3 and len(made) == 1
    assert again({"a": 2}) == 3 and len(made) == 2
    source.write_text("other")  # the same settings over other data
    assert again({"a": 1}) == 3 and len(made) == 3


def test_pairs_and_content_keys(spark, monkeypatch):
    one, two = spark.range(3), spark.createDataFrame([("a",), ("b",)], "q string")
    assert readers.pair(one, two).count() == readers.pair(two, one).count() == 6
    assert "Broadcast" in readers.pair(one, two)._jdf.queryExecution().toString()
    monkeypatch.setattr(readers, "MAX_BROADCAST_ROWS", 1)
    with pytest.raises(ValueError):
        readers.pair(one, two)
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), (None, 1)], "a string, b int")
    keys = {frozenset(r.key for r in readers.content_key(rows.repartition(n), "a", "b").collect()) for n in (1, 3)}
    assert len(keys) == 1 and len(next(iter(keys))) == 4


def test_frame_and_predictor(spark):
    row = readers.from_frame(spark, "q", pd.DataFrame({"a": [1, 2], "b": ["x", None]})).first()
    assert (row.table.header, row.table.rows) == (["a", "b"], [["1", "x"], ["2", None]])

    def model(frames):
        for f in frames:
            yield f[["id"]].assign(prediction="p")

    assert scoring.predict(spark.createDataFrame([("1",)], "id string"), model, "id string, prediction string").first().prediction == "p"
    words = F.create_map(F.lit(5), F.lit(" a"), F.lit(6), F.lit("b"))
    df = spark.createDataFrame([([5, 6, -100, 1],)], "x array<int>")
    assert df.select(scoring.decode(F.col("x"), words).alias("s")).first().s == "ab"


def test_streams(spark, tmp_path):
    rows = [(i, (["h"], [[str(i)]]), "1, 2", "2, 1" if i % 2 else "3") for i in range(10)]
    df = spark.createDataFrame(rows, f"i int, table {TABLE}, p string, g string").withColumn("at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, i)"))
    df.write.parquet(str(tmp_path / "in"))
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = streams.stream_tables(spark, str(tmp_path / "in"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
    assert schema
    q = streams.linearized(stream).select("i", "flat").writeStream.format("memory").queryName("flat").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT flat FROM flat WHERE i = 3").first().flat == "col : h row 1 : 3"
    q = streams.running_accuracy(stream, "p", "g", "at").writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(examples) n, sum(correct) c FROM acc").first().asDict() == {"n": 10, "c": 5}
