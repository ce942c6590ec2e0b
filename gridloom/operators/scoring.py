"""Scoring of predicted answers against targets: by typed denotations, and by multisets of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions import values as V
from gridloom.functions.tokenizers import Tokenizer


def normalized_lookup(strings: DataFrame, column: str) -> DataFrame:
    """(``column``, norm) of the distinct strings: each is normalized once, however often it occurs."""
    return strings.select(column).where(F.col(column).isNotNull()).distinct().withColumn("norm", V.normalize(F.col(column)))


def _texts(column: pd.Series) -> list[list[str]]:
    return [[] if x is None else ["" if s is None else s for s in x] for x in column]


def _typed(originals: pd.Series, canonicals: pd.Series | None, read: Callable[[str, str], V.Value] = V.value_of) -> Iterator[list[V.Value]]:
    """The distinct values of each list; lists of different lengths are refused."""
    first = _texts(originals)
    for o, c in zip(first, first if canonicals is None else _texts(canonicals)):
        if len(o) != len(c):
            raise ValueError("originals and canonical forms differ in number")
        yield V.distinct(map(read, o, c))


def typed(df: DataFrame, originals: str, canonicals: str | None, out: str) -> DataFrame:
    """Adds ``out``: the distinct VALUEs of a list column, typed by the list of canonical forms where given.

    Lists of different lengths are refused; null lists give no values, null entries count as empty strings.
    What the fields of VALUE can't hold is a string.
    """

    def shown(v: V.Value) -> dict:
        kind, x, norm = v
        y, m, d = x if kind == "date" else (None, None, None)
        return dict(kind=kind, norm=norm, num=float(x) if kind == "number" else None, y=y, m=m, d=d)

    def run(o: pd.Series, *c: pd.Series) -> pd.Series:
        return pd.Series([[shown(v) for v in values] for values in _typed(o, c[0] if c else None, V.held_value_of)])

    return df.withColumn(out, F.pandas_udf(run, f"array<{V.VALUE}>")(*([originals] if canonicals is None else [originals, canonicals])))


def denotation_scores(df: DataFrame, prediction: str, targets: str, canonicals: str | None = None, separator: str = ", ") -> DataFrame:
    """Adds correct: whether the prediction string denotes the target values; null predictions count as empty.

    If the targets are one distinct value, the whole prediction is one answer, else it is split. One function over Arrow batches; each different
    string of a worker is normalized and typed once.
    """

    def run(lines: pd.Series, o: pd.Series, *c: pd.Series) -> pd.Series:
        out = []
        for line, values in zip(lines, _typed(o, c[0] if c else None)):
            line = line or ""
            answers = [line] if len(values) == 1 else line.split(separator)
            out.append(V.denotes(values, V.distinct(V.value_of(a, a) for a in answers)))
        return pd.Series(out, dtype=bool)

    return df.withColumn("correct", F.pandas_udf(run, "boolean")(prediction, targets, *([] if canonicals is None else [canonicals])))


def accuracy(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., examples, correct, accuracy): accuracy (correct + 1e-9) / (examples + 1e-9) to 4 places, ties to even; 1 without examples."""
    g = scored.groupBy(*by).agg(F.count("*").alias("examples"), F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).alias("correct"))
    return g.withColumn("accuracy", F.bround((F.col("correct") + 1e-9) / (F.col("examples") + 1e-9), 4))


def multiset_scores(df: DataFrame, prediction: str, ground: str) -> DataFrame:
    """Adds correct: whether prediction and ground string have the same answers equally often; null counts as empty, and nan is never right."""

    def run(lines: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([(m := V.multiset_of(a or "")) is not None and m == V.multiset_of(b or "") for a, b in zip(lines, truths)], dtype=bool)

    return df.withColumn("correct", F.pandas_udf(run, "boolean")(prediction, ground))


def mean_accuracy(scored: DataFrame) -> DataFrame:
    """(accuracy): the share of correct rows, null without rows."""
    return scored.agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def predictions_with_ids(lines: DataFrame, ids: DataFrame | None) -> DataFrame:
    """(ex_id, prediction) of numbered lines (line, value): by the id of the same number in ``ids`` (line, id), or 'nu-<line>' without ids.

    A line beyond the ids has none and is refused.
    """
    if ids is None:
        return lines.select(F.concat(F.lit("nu-"), F.col("line").cast("string")).alias("ex_id"), F.col("value").alias("prediction"))
    known = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("more predictions than ids")).cast("string"))
    return lines.join(ids, "line", "left").select(known.alias("ex_id"), F.col("value").alias("prediction"))


def join_targets(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """Predictions with their targets by ex_id; a prediction without one is an error."""
    found = predictions.join(targets.withColumn("_found", F.lit(True)), "ex_id", "left")
    checked = F.when(F.col("_found"), F.col("ex_id")).otherwise(F.raise_error(F.concat(F.lit("no target for "), F.coalesce("ex_id", F.lit("null")))).cast("string"))
    return found.withColumn("ex_id", checked).drop("_found")


def decode(ids: Column, words: Column, ignore: int = -100, pad: int = 1) -> Column:
    """Predicted ids as text by a MAP<INT, STRING>; ignored places count as padding and vanish."""
    kept = F.filter(F.transform(ids, lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x)), lambda x: x != pad)
    return X.py_strip(F.array_join(F.transform(kept, lambda x: F.coalesce(F.try_element_at(words, x), F.lit(""))), ""))


def decoded(ids: Column, tokenizer: Tokenizer, ignore: int = -100) -> Column:
    """As ``decode``, by a tokenizer; special ids vanish too."""

    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else tokenizer.decode([tokenizer.special.pad if i == ignore else int(i) for i in x]).strip() for x in lists])

    return F.pandas_udf(run, "string")(ids)


def id_scores(df: DataFrame, predicted: str, labels: str, words: Column | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Adds prediction, ground and correct: predicted and label ids as text (by ``words`` or a tokenizer), and whether their answers are the same."""
    if (words is None) == (tokenizer is None):
        raise ValueError("give words or a tokenizer")
    text = (lambda c: decode(F.col(c), words)) if tokenizer is None else (lambda c: decoded(F.col(c), tokenizer))
    return multiset_scores(df.withColumn("prediction", text(predicted)).withColumn("ground", text(labels)), "prediction", "ground")


def predict(df: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Runs any callable (iterator of pandas frames -> iterator of frames) as the predictor."""
    return df.mapInPandas(model, schema)
