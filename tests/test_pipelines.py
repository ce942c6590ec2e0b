import json

import pytest
from pyspark.sql import functions as F

from gridloom.functions.tables import TABLE
from gridloom.functions import tokenizers
from gridloom.operators import encoding, records, scoring
from gridloom.plans import pipelines
from gridloom.sources import readers


def test_fine_tuning_set(spark):
    rows = [("1", "Who WON?", (["a"], [["x"], ["y"]]), ["x", "y z"]), ("2", None, (["a"], [["x"]]), []), ("3", "q", None, None)]
    df = spark.createDataFrame(rows, f"id string, question string, table {TABLE}, answers array<string>")
    got = {r.id: r for r in pipelines.TableQA(max_source=32, max_target=3, lower_case=True).process(df).collect()}
    assert set(got) == {"1", "2", "3"}
    assert len(got["1"].labels) == 3 and got["2"].labels == [0, 2]
    assert all(len(r.attention_mask) == len(r.input_ids) <= 32 for r in got.values())
    shorter = pipelines.TableQA(max_source=32, max_target=9, max_target_predicting=3).process
    assert [len({r.id: r for r in shorter(df, training=t).collect()}["1"].labels) for t in (True, False)] == [6, 3]
    with pytest.raises(Exception, match="length changes"):
        spark.createDataFrame([("İ",)], "s string").select(pipelines.lower_checked(F.col("s"))).collect()
    assert pipelines.few_shot(df, None) is df
    assert pipelines.few_shot(df, spark.createDataFrame([("1",)], "id string")).count() == 1
    assert [r.id for r in pipelines.head(df, "id", 2).collect()] == ["1", "2"]


MODEL = """
def say(frames):
    for f in frames:
        yield f[["id"]].assign(prediction=[" y, x" if i != "k3" else "z" for i in f["id"]])
"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.parametrize("tokenizer", ["built-in", "vocabulary"])
def test_encodings_by_any_tokenizer(spark, tokenizer):
    """Budgets, frames and labels hold for the built-in tokenizer and for a vocabulary."""
    library = pytest.importorskip("tokenizers")
    special = tokenizers.Special(start=50001, end=50002, pad=50003, mask=50004, first=0, count=50000)
    tok = tokenizers.BuiltIn() if tokenizer == "built-in" else tokenizers.Vocabulary(VOCABULARY, special)
    rows = [(i, f"The mill of Kelé 字 {i} stands", (["Næme", "year"], [[f"mill {i} {j} 😀", str(1900 + j)] for j in range(i * 3)]), [[4, 8], [12, 16]], ["Kelé", "1901"]) for i in range(12)]
    df = spark.createDataFrame(rows, f"k int, context string, table {TABLE}, mentions array<array<int>>, answers array<string>").repartition(3)
    settings = encoding.Settings(max_source=96, max_context=24, tokenizer=tok)
    out = encoding.encoded(df, "k", ["qa", "random_masking", "salient_masking"], settings).collect()
    s = tok.special
    assert len(out) == 36
    for r in out:
        assert len(r.input_ids) <= 96 and r.input_ids[0] == r.target_input_ids[0] == s.start and r.input_ids[-1] == r.target_input_ids[-1] == s.end
        if r.method == "qa":
            assert r.labels == r.target_input_ids
            continue
        assert len(r.labels) == len(r.target_input_ids) >= len(r.input_ids) and r.labels[0] == r.labels[-1] == s.pad
        assert all(x == y or x == s.pad for x, y in zip(r.labels, r.target_input_ids)) and any(x != s.pad for x in r.labels)
        assert r.method == "random_masking" or r.input_ids.count(s.mask) == 2
    if tokenizer == "vocabulary":
        text = library.Tokenizer.from_file(VOCABULARY).decode(next(r for r in out if r.k == 1 and r.method == "salient_masking").target_input_ids[1:-1])
        assert text == " The mill of Kelé 字 1 stands col : Næme | year row 1 : mill 1 0 😀 | 1900 row 2 : mill 1 1 😀 | 1901 row 3 : mill 1 2 😀 | 1902"
        ids = spark.createDataFrame([([s.start, *tok.ids("Kelé, 7"), s.end], [s.start, *tok.ids("7.0, kelé"), -100])], "said array<int>, labels array<int>")
        vocabulary_special = tokenizers.Vocabulary(VOCABULARY, special)
        scored = scoring.id_scores(ids.select(F.expr("slice(said, 2, size(said) - 2)").alias("said"), F.expr("slice(labels, 2, size(labels) - 2)").alias("labels")), "said", "labels", tokenizer=vocabulary_special)
        assert scored.first().correct
    with pytest.raises(ValueError):
        encoding.encoded(df, "k", ["other"], settings)


def test_answers_steer_training_tables(spark):
    """Rows with the answer survive a budget that they would be beyond, with their neighbours."""
    table = (["h"], [[f"filler number {j}"] for j in range(60)] + [["the answer"]])
    df = spark.createDataFrame([("1", "who won", table, ["The Answer"])], f"id string, question string, table {TABLE}, answers array<string>")
    tok = tokenizers.BuiltIn()
    keep = encoding.steered_rows(tok, "who won", ["The Answer"], records.Table(*table), 120, "k")
    assert {58, 59, 60} <= set(keep) and len(keep) < 30 and keep == sorted(keep)
    ids = {t: pipelines.TableQA(max_source=120).process(df, training=t).first().input_ids for t in (True, False)}
    word = tok.ids("answer")[0]
    assert word in ids[True] and word not in ids[False] and all(len(x) <= 120 for x in ids.values())
    assert encoding.steered_rows(tok, "q", [], records.Table(["h"], [["a"]] * 3), 500, "k") == [0, 1, 2]


def test_command_line(spark, tmp_path, monkeypatch):
    line = json.dumps({"context": "the cat", "table": {"header": ["h"], "rows": [["1"]]}, "mentions": [[0, 3]], "answers": ["a"]}) + "\n"
    for name in readers.CORPORA:
        (tmp_path / f"{name}.jsonl").write_text(line * 3)
    out = str(tmp_path / "out")
    assert {(r.corpus, r.method): r.n for r in pipelines.main(spark, ["pretrain", str(tmp_path), out]).collect()} == {("natural", "random_masking"): 3, ("natural", "salient_masking"): 3, ("synthetic", "qa"): 3, ("sql", "qa"): 3}
    assert pipelines.length_violations(spark.read.parquet(out), 1024).first()[:3] == (0, 0, 0)
    with pytest.raises(Exception, match="(?i)exists"):
        pipelines.main(spark, ["pretrain", str(tmp_path), out])
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.tsv").write_text("id\ttargetValue\ttargetCanon\nk1\t5 km\t5\nk2\ta|b\ta|b\n")
    (tmp_path / "ids").write_text("k1\nk2\n")
    (tmp_path / "pred").write_text("5\nb, a\n")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"command": "score", "targets": str(tmp_path / "t"), "predictions": str(tmp_path / "pred"), "ids": str(tmp_path / "ids")}))
    assert pipelines.main(spark, [str(config)]).first().asDict() == {"examples": 2, "correct": 2, "accuracy": 1.0}
    rows = [{"id": f"k{i}", "question": "who?", "table": {"header": ["h"], "rows": [["x"], ["y"]]}, "answers": ["x", "y"]} for i in range(6)]
    for split in ("train", "test"):
        (tmp_path / f"{split}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    files = ["--train-file", str(tmp_path / "train.json"), "--test-file", str(tmp_path / "test.json")]
    (tmp_path / "shots").write_text("k1\nk4\n")
    tuned = pipelines.main(spark, ["finetune", *files, "--few-shot-ids", str(tmp_path / "shots"), str(tmp_path / "tuned")])
    assert tuned.first().n == 2 and {r.id for r in spark.read.parquet(str(tmp_path / "tuned")).collect()} == {"k1", "k4"}
    (tmp_path / "said_model.py").write_text(MODEL)  # right for all but k3
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "said_model.py"))
    told = pipelines.main(spark, ["predict", *files, "--max-predict-samples", "4", "--model", "said_model:say", str(tmp_path / "told")])
    assert told.first().asDict() == {"test_samples": 4, "test_accuracy": 0.75}
    assert "".join(p.read_text() for p in sorted((tmp_path / "told" / "predictions").glob("part-*"))).split("\n")[0] == "y, x"
    with pytest.raises(SystemExit):
        pipelines.parse(["other"])
    assert pipelines.options(encoding.Settings, {"max_context": 7}).max_context == 7
    with pytest.raises(ValueError):
        pipelines.options(encoding.Settings, {"size": 1})
