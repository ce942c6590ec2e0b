"""The data flows end to end: fine-tuning sets, pre-training corpora and scoring, with their parameters, and a command line."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.tokenizers import BuiltIn, Tokenizer, Vocabulary
from gridloom.operators import encoding, scoring
from gridloom.sources import readers, sinks


def lower_checked(s: Column) -> Column:
    """Lower case; a text whose length changes by it is an error, as places in it would move."""
    low = F.lower(s)
    return F.when(F.length(low) == F.length(s), low).when(s.isNull(), s).otherwise(F.raise_error(F.concat(F.lit("length changes in lower case: "), s)).cast("string"))


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by a column; all rows for None."""
    return df if n is None else df.orderBy(order).limit(n)


def length_violations(encoded: DataFrame, max_source: int) -> DataFrame:
    """One row of counts that must be 0: sources longer than targets (masking), labels unlike targets, sources over the limit; and of all tokens, and the longest source."""
    masked = F.col("method") != "qa"
    return encoded.agg(
        F.count_if(masked & (F.size("input_ids") > F.size("target_input_ids"))).alias("source_longer"),
        F.count_if(F.size("labels") != F.size("target_input_ids")).alias("label_unlike_target"),
        F.count_if(F.size("input_ids") > max_source).alias("source_too_long"),
        F.sum(F.size("input_ids")).alias("source_tokens"),
        F.max(F.size("input_ids")).alias("longest_source"),
    )


@dataclasses.dataclass(frozen=True)
class TableQA:
    """Question answering sets: source of question and table, labels of the answers, both within their budgets.

    Text is encoded as it is, without a prefix space. The target length defaults to that of training.
    """

    max_source: int = 1024
    max_target: int = 1024
    max_target_predicting: int | None = None
    max_cell: int = 15
    answer_separator: str = ", "
    lower_case: bool = False
    seed: str = "1"
    tokenizer: Tokenizer = dataclasses.field(default_factory=BuiltIn)

    def process(self, df: DataFrame, key: str = "id", training: bool = False) -> DataFrame:
        """(key, input_ids, attention_mask, labels) of questions (key, question, table, answers).

        In training, answers and question steer which rows of a table over the budget stay: rows that share a cell with
        them and two rows around each are kept, others are dropped, chosen by hash, in the share that the budget asks for.
        """
        return encoding.questions(df, key, dataclasses.asdict(self) | {"tokenizer": self.tokenizer}, training)


@dataclasses.dataclass(frozen=True)
class Pretraining:
    """Pre-training sets of all corpora."""

    settings: encoding.Settings = encoding.Settings()

    def process(self, corpora: dict[str, DataFrame], key: str, methods: dict[str, list[str]] = encoding.CORPUS_METHODS) -> DataFrame:
        return encoding.assemble(corpora, key, self.settings, methods)


@dataclasses.dataclass(frozen=True)
class Scoring:
    """Files of tagged targets and predictions to accuracy, by typed denotations."""

    targets: str
    predictions: str
    ids: str | None = None
    separator: str = ", "

    def process(self, spark: SparkSession) -> DataFrame:
        ids = None if self.ids is None else readers.id_list(spark, self.ids)
        predictions = scoring.predictions_with_ids(readers.numbered_lines(spark, self.predictions), ids)
        joined = scoring.join_targets(predictions, readers.read_targets(spark, self.targets))
        return scoring.accuracy(scoring.denotation_scores(joined, "prediction", "originals", "canonicals", self.separator))


def few_shot(train: DataFrame, ids: DataFrame | None) -> DataFrame:
    return train if ids is None else readers.keep_ids(train, ids)


def predicted(df: DataFrame, model: Callable, key: str) -> DataFrame:
    """(key, prediction) by any callable over Arrow batches, stripped of white space at the ends."""
    out = scoring.predict(df, model, f"{key} string, prediction string")
    return out.withColumn("prediction", X.py_strip(F.col("prediction")))


def options(kind: type, values: dict) -> object:
    """A dataclass of parameters from a mapping; unknown names are errors."""
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return kind(**values)


def parse(argv: list[str]) -> argparse.Namespace:
    """The command line, or all of it in one JSON file."""
    p = argparse.ArgumentParser(prog="gridloom")
    commands = p.add_subparsers(dest="command", required=True)
    pre = commands.add_parser("pretrain", help="three corpora of a folder to encoded Parquet")
    pre.add_argument("root")
    pre.add_argument("output")
    pre.add_argument("--max-context", type=int, default=128)
    tune = commands.add_parser("finetune", help="a split of a question set to encoded Parquet")
    tune.add_argument("--split", default="train", choices=readers.SPLITS)
    say = commands.add_parser("predict", help="predictions of a split by a callable, and their accuracy")
    say.add_argument("--split", default="test", choices=readers.SPLITS[1:])
    say.add_argument("--model", required=True, help="module:function over iterators of pandas frames")
    for sub in (tune, say):
        sub.add_argument("--train-file")
        sub.add_argument("--validation-file")
        sub.add_argument("--test-file")
        sub.add_argument("--dataset", help="a catalog table or a Parquet table with a column split")
        sub.add_argument("--few-shot-ids", help="a file with the ids of the training rows to use")
        sub.add_argument("--max-train-samples", type=int)
        sub.add_argument("--max-predict-samples", type=int)
        sub.add_argument("--max-target", type=int, default=1024)
        sub.add_argument("--max-target-predicting", type=int, help="defaults to --max-target")
        sub.add_argument("--lower-case", action="store_true")
        sub.add_argument("output")
    for sub in (pre, tune, say):
        sub.add_argument("--max-source", type=int, default=1024)
        sub.add_argument("--tokenizer", help="a vocabulary file; the built-in tokenizer by default")
        sub.add_argument("--overwrite", action="store_true")
    score = commands.add_parser("score", help="predictions against tagged targets")
    score.add_argument("targets")
    score.add_argument("predictions")
    score.add_argument("--ids")
    score.add_argument("--separator", default=", ")
    if len(argv) == 1 and argv[0].endswith(".json"):
        with open(argv[0]) as f:
            values = json.load(f)
        sub = commands.choices[values["command"]]
        return argparse.Namespace(**{a.dest: a.default for a in sub._actions if a.dest != "help"} | values)
    return p.parse_args(argv)


def _questions(spark: SparkSession, args: argparse.Namespace, predicting: bool) -> DataFrame:
    """The rows of the split that a command names: few-shot ids and sample limits applied, the first rows by id."""
    files = {s: f for s in readers.SPLITS if (f := getattr(args, f"{s}_file"))}
    rows = readers.named_dataset(spark, args.dataset) if args.dataset else readers.read_questions(spark, files)
    rows = readers.select_split(rows, args.split, predicting)
    if args.split == "train":
        rows = few_shot(rows, readers.id_set(spark, args.few_shot_ids) if args.few_shot_ids else None)
        return head(rows, "id", args.max_train_samples)
    return head(rows, "id", args.max_predict_samples)


def main(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Runs a command and returns what it reports."""
    args = parse(argv)
    if args.command == "score":
        return Scoring(args.targets, args.predictions, args.ids, args.separator).process(spark)
    tokenizer = Vocabulary(args.tokenizer) if args.tokenizer else BuiltIn()
    mode = "overwrite" if args.overwrite else "errorifexists"
    if args.command == "pretrain":
        settings = encoding.Settings(max_source=args.max_source, max_context=args.max_context, tokenizer=tokenizer)
        corpora = {n: readers.content_key(d, *d.columns) for n, d in readers.read_corpora(spark, args.root).items()}
        Pretraining(settings).process(corpora, "key").write.mode(mode).parquet(args.output)
        return spark.read.parquet(args.output).groupBy("corpus", "method").agg(F.count("*").alias("n"), F.sum(F.size("input_ids")).alias("n_tokens"))
    table_qa = TableQA(args.max_source, args.max_target, args.max_target_predicting, lower_case=args.lower_case, tokenizer=tokenizer)
    rows = _questions(spark, args, args.command == "predict")
    if args.command == "finetune":
        table_qa.process(rows, "id", args.split == "train").write.mode(mode).parquet(args.output)
        return spark.read.parquet(args.output).agg(F.count("*").alias("n"), F.sum(F.size("input_ids")).alias("n_tokens"))
    module, _, name = args.model.partition(":")
    said = predicted(table_qa.process(rows, "id"), getattr(importlib.import_module(module), name), "id")
    truth = rows.select("id", X.join_answers(F.col("answers")).alias("ground"))
    scored = scoring.multiset_scores(said.join(truth, "id"), "prediction", "ground")
    scored.select("id", "prediction", "ground", "correct").write.mode(mode).parquet(f"{args.output}/scored")
    scored = spark.read.parquet(f"{args.output}/scored")
    sinks.write_predictions(scored, "id", "prediction", f"{args.output}/predictions", args.overwrite)
    report = scoring.mean_accuracy(scored).crossJoin(F.broadcast(scored.agg(F.count("*").alias("n")))).select(F.col("n").alias(f"{args.split}_samples"), F.col("accuracy").alias(f"{args.split}_accuracy"))
    sinks.write_metrics(report, f"{args.output}/metrics", args.overwrite)
    return report
