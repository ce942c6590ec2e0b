"""Sources: corpora as JSON lines, question sets as CSV, JSON or Parquet, tagged TSV targets, id lists, numbered lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.tables import TABLE

EXAMPLE = f"context string, table {TABLE}, mentions array<array<int>>, answers array<string>"
QUESTION = f"id string, question string, table {TABLE}, answers array<string>"
CORPORA = ("natural", "synthetic", "sql")
SPLITS = ("train", "validation", "test")


def read_corpora(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three corpora of a folder, natural.jsonl, synthetic.jsonl and sql.jsonl, by name."""
    return {name: spark.read.schema(EXAMPLE).json(f"{root}/{name}.jsonl") for name in CORPORA}


def read_questions(spark: SparkSession, files: dict[str, str], test_any: bool = True) -> DataFrame:
    """Question files by split, all in the format of the last one, with a column split.

    Train and validation files must be csv or json; in CSV, table and answers are JSON text.
    """
    if not files:
        raise ValueError("name a dataset or a file")
    for split, path in files.items():
        if split not in SPLITS:
            raise ValueError(f"no split {split!r}")
        if path.rsplit(".", 1)[-1] not in ("csv", "json", "jsonl") and not (split == "test" and test_any):
            raise ValueError(f"{split} file must be csv or json")
    kind = list(files.values())[-1].rsplit(".", 1)[-1]
    out = None
    for split, path in files.items():
        if kind == "csv":
            df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="id string, question string, table string, answers string")
            df = df.select("id", "question", F.from_json("table", TABLE).alias("table"), F.from_json("answers", "array<string>").alias("answers"))
        elif kind in ("json", "jsonl"):
            df = spark.read.schema(QUESTION).json(path)
        else:
            df = spark.read.parquet(path).select("id", "question", "table", "answers")
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def named_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or, for a path, a Parquet table."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def select_split(df: DataFrame, split: str, predicting: bool = False) -> DataFrame:
    """Rows of one split; predictions are for validation and test only."""
    if split not in SPLITS or predicting and split == "train":
        raise NotImplementedError(f"split {split!r}")
    return df.where(F.col("split") == split)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their number in the file from 0; split at newlines only.

    Numbers come from counts per partition and file, so a file may be split over many tasks. What is broadcast has a row for each partition and file.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = counts.select("file", "part", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")).alias("before"))
    return lines.join(before, ["file", "part"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of one text file with their number from 0, stripped."""
    return _numbered(spark, path).select("line", X.py_strip(F.col("value")).alias("value"))


def id_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line."""
    return numbered_lines(spark, path).select(F.col("value").alias("id")).distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids in order: (line, id)."""
    return numbered_lines(spark, path).withColumnRenamed("value", "id")


def read_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged targets (ex_id, originals, canonicals) of all TSV files in a folder; each file has its own header line.

    Fields are found by name (id, targetValue, targetCanon); a shorter line lacks its last fields. Of lines with one id
    the last of the last file counts.
    """
    lines = _numbered(spark, folder).withColumn("value", F.regexp_replace("value", "\r$", ""))
    # The fields' places in a file, from its first line: a row for each file.
    place = lambda name: (F.array_position(F.split("value", "\t", -1), name) - 1).cast("int")
    heads = lines.where("line = 0").select("file", *(place(name).alias(f"at_{name}") for name in ("id", "targetValue", "targetCanon")))
    field = lambda name: F.get(F.split("value", "\t", -1), F.col(f"at_{name}"))
    rows = lines.where("line > 0 and value <> ''").join(heads, "file").select("file", "line", field("id").alias("ex_id"), field("targetValue").alias("o"), field("targetCanon").alias("c"))
    last = last_wins(rows, "ex_id", F.struct("file", "line"), ["o", "c"])
    return last.select("ex_id", X.tsv_unescape_list(F.col("o")).alias("originals"), X.tsv_unescape_list(F.col("c")).alias("canonicals"))


def last_wins(df: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    """One row a key, with the values of its last row by ``order``."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v"))
    return last.select(key, *(F.col(f"_v.{c}").alias(c) for c in values))


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ``ids`` (id); fails if their number isn't that of the ids."""
    ids = ids.select(F.col("id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    kept = df.join(ids, id_col, "left_semi")
    if (n := kept.count()) != (m := ids.count()):
        raise ValueError(f"{n} rows for {m} ids")
    return kept


def from_frame(spark: SparkSession, question: str, table: pd.DataFrame, row_id: str = "0") -> DataFrame:
    """One pandas table and a question as a question row; cells become text."""
    rows = [[None if pd.isna(c) else str(c) for c in r] for r in table.itertuples(index=False)]
    return spark.createDataFrame([(row_id, question, ([str(c) for c in table.columns], rows), [])], QUESTION)


def well_formed(table: Column) -> Column:
    """Whether every row has as many cells as the header."""
    return F.forall(F.coalesce(table["rows"], F.array().cast("array<array<string>>")), lambda r: F.coalesce(F.size(r) == F.size(table["header"]), F.lit(False)))


def grouped_tables(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """(key, table): the rows of each key as a nested table in the given order; values become text. Groups must fit a row."""
    cells = F.array(*(F.col(c).cast("string") for c in columns))
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), cells.alias("cells"))))
    return df.groupBy(key).agg(F.struct(F.array(*map(F.lit, columns)).alias("header"), F.transform(rows, lambda r: r["cells"]).alias("rows")).cast(TABLE).alias("table"))


#: Fewer rows than this on one side are sent to all tasks when tables and questions are paired.
MAX_BROADCAST_ROWS = 100_000


def pair(tables: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question with every table: columns of both. The smaller side, by count, is sent to all tasks; two sides of over ``MAX_BROADCAST_ROWS`` rows are refused."""
    sides = [tables, questions]
    sizes = [df.limit(MAX_BROADCAST_ROWS + 1).count() for df in sides]
    small = sizes.index(min(sizes))
    if sizes[small] > MAX_BROADCAST_ROWS:
        raise ValueError("both sides are too large to pair")
    sides[small] = F.broadcast(sides[small])
    return sides[0].crossJoin(sides[1])


def content_key(df: DataFrame, *columns: str) -> DataFrame:
    """Adds key, a hash of the columns and the ordinal among rows with equal columns: the same on every cluster, whatever the files' splits are."""
    digest = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    ordinal = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return df.withColumn("key", digest).withColumn("key", F.concat_ws("-", "key", ordinal.cast("string")))
