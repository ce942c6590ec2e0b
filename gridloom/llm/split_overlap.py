"""Problem 1: records of evaluation splits that stand, exactly or almost, in the training split.

A weighted cosine join between the splits, for tables (terms are cells) first and then for questions (terms are words) inside pairs
of like tables. A term t weighs w(t), with w(t)² from 1, for a term of all vectors, to 1 + ``SPREAD``, for a term of one: rare
terms count more. What is looked for are pairs of a likeness (shared terms over terms of either) of j or more, so the
cosine that such a pair must have is derived for each vector:

  Let a vector have n terms, L the mean squared weight of its ceil(j n) lightest ones, and c = 2j / (1 + j). A pair of
  likeness j shares k >= j n terms on both sides and k >= c sqrt(n n') (k >= c (n + n') / 2). The k shared terms weigh at least as
  much as the k lightest, whose mean is at least L, so the dot product of the weights is at least k L and k L', hence
  at least k sqrt(L L') >= c sqrt(n L) sqrt(n' L').

Vectors are scaled by 1 / sqrt(c n L), and a pair qualifies if its dot product is 1 or more: no pair of the likeness is lost,
whatever the weights are. Each side indexes a vector from the term on at which the part before could reach 1: terms are taken from the most
frequent to the rarest, and the part so far is bounded by its dot product with the largest weights that vectors of the
other side have for its terms, and by its norm times the largest norm that a vector can have, 1 + SPREAD (1 - j) over c (squared). Since the order of terms is one
for both sides, the rarest shared term of a qualifying pair lies in the indexed part of both;
inverted lists of the indexed parts are joined and the exact dot product decides, and the likeness after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sets import joined_cells, may_be_like, signature, term_sets
from gridloom.llm.stage import stage

TRAIN, EVAL = 0, 1
#: By how much the squared weight of a term of one vector exceeds that of a term of all.
SPREAD = 1.0
_VECTOR = "id bigint, side int, terms array<bigint>, weights array<double>, scale double, index array<bigint>, sign bigint"


def squared_weights(count: np.ndarray, total: int) -> np.ndarray:
    """From 1 to 1 + SPREAD by the logarithm of how rare the terms are among ``total`` vectors."""
    return 1 + SPREAD * (1 - np.log(np.minimum(count, total)) / math.log(max(total, 2)))


def scaling(squares: np.ndarray, likeness: float) -> float:
    """1 / sqrt(c n L) of a vector, see above."""
    n = len(squares)
    light = np.sort(squares)[: math.ceil(likeness * n - 1e-9)]
    return 1 / math.sqrt(2 * likeness / (1 + likeness) * n * light.mean())


def indexed(terms: np.ndarray, squares: np.ndarray, count: np.ndarray, other_least: np.ndarray, likeness: float) -> np.ndarray:
    """Which terms of a vector to index, as a mask.

    ``count``: vectors of both sides with the term, ``other_least``: the fewest terms that a vector of the other side with this term has, 0 if none has it.
    """
    c = 2 * likeness / (1 + likeness)
    order = np.lexsort((terms, count))[::-1]
    x2 = squares * scaling(squares, likeness) ** 2
    # The other side's weights of a term are at most w / sqrt(c n'), as its L' is 1 or more.
    largest = np.where(other_least > 0, np.sqrt(squares / (c * np.maximum(other_least, 1))), 0)
    reach = np.cumsum((np.sqrt(x2) * largest)[order])
    norm = np.sqrt(np.cumsum(x2[order]) * (1 + SPREAD * (1 - likeness)) / c)
    keep = np.zeros(len(terms), bool)
    keep[order[np.minimum(reach, norm) >= 1 - 1e-9]] = True
    return keep & (other_least > 0)


def weighted(vectors: DataFrame, likeness: float) -> DataFrame:
    """Vectors (id, side, terms) with the weights, scale, terms to index and signature of _VECTOR.

    Term statistics are exact, from a grouping of all terms; a term that many vectors hold has one row of them, so its join can be split.
    """
    total = vectors.count()
    flat = vectors.select("id", "side", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    least = [F.min(F.when(F.col("side") == s, F.col("n"))).alias(f"least{s}") for s in (TRAIN, EVAL)]
    stats = flat.groupBy("term").agg(F.count("*").alias("count"), *least)
    other = F.coalesce(F.when(F.col("side") == TRAIN, F.col(f"least{EVAL}")).otherwise(F.col(f"least{TRAIN}")), F.lit(0))
    # All terms of one vector come together again: as many as the record has.
    rows = flat.join(stats, "term").groupBy("id", "side").agg(F.collect_list(F.struct("term", "count", other.cast("bigint").alias("other"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            term, count, other = (x.to_numpy() for x in batch.column(2).values.flatten())
            squares = squared_weights(count, total)
            scales, keeps, signs = [], [np.empty(0, bool)], []
            for a, b in zip(ends, ends[1:]):
                scales.append(scaling(squares[a:b], likeness))
                keeps.append(indexed(term[a:b], squares[a:b], count[a:b], other[a:b], likeness))
                signs.append(signature(term[a:b]))
            keep = np.concatenate(keeps)
            offsets = pa.array(ends - ends[0], pa.int32())
            kept = pa.array(np.concatenate([[0], np.cumsum(keep)])[ends - ends[0]], pa.int32())
            own = slice(ends[0], ends[-1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(term[own])), pa.ListArray.from_arrays(offsets, pa.array(squares[own])), pa.array(scales, pa.float64()), pa.ListArray.from_arrays(kept, pa.array(term[own][keep]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(np.array(signs, np.uint64).view(np.int64))], ["id", "side", "terms", "weights", "scale", "index", "sign"])

    return rows.mapInArrow(run, _VECTOR)


def _qualifying(pairs: DataFrame, vectors: DataFrame, likeness: float, name: str) -> DataFrame:
    """Pairs (a, b, and other BIGINT or DOUBLE columns) whose dot product reaches 1 and whose sets have the likeness; adds ``name``_likeness and ``name``_cosine."""
    x = vectors.where(F.col("side") == TRAIN).select(F.col("id").alias("a"), F.struct("terms", "weights", "scale").alias("va"))
    y = vectors.where(F.col("side") == EVAL).select(F.col("id").alias("b"), F.struct("terms", "weights", "scale").alias("vb"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in (0, 1):
                terms, weights, scale = batch.column(k).flatten()
                sides.append((terms.offsets.to_numpy(), terms.values.to_numpy(), weights.values.to_numpy(), scale.to_numpy()))
            (ea, ta, wa, sa), (eb, tb, _, sb) = sides
            wb = sides[1][2]
            dots, likes, cosines = [], [], []
            for k in range(batch.num_rows):
                one, two = slice(ea[k], ea[k + 1]), slice(eb[k], eb[k + 1])
                _, at, _ = np.intersect1d(ta[one], tb[two], assume_unique=True, return_indices=True)
                dot = wa[one][at].sum()
                dots.append(dot * sa[k] * sb[k])
                likes.append(len(at) / (ea[k + 1] - ea[k] + eb[k + 1] - eb[k] - len(at)))
                cosines.append(dot / math.sqrt(wa[one].sum() * wb[two].sum()))
            likes = np.array(likes, np.float64)
            found = pa.array((np.array(dots) >= 1 - 1e-9) & (likes >= likeness - 1e-12), pa.bool_())
            cols = [*(batch.column(k) for k in range(2, batch.num_columns)), pa.array(likes), pa.array(cosines, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", *rest, f"{name}_likeness", f"{name}_cosine"]).filter(found)

    schema = ", ".join(["a bigint", "b bigint", *(f"{c} {kinds[c]}" for c in rest), f"{name}_likeness double", f"{name}_cosine double"])
    return pairs.join(x, "a").join(y, "b").select("va", "vb", "a", "b", *rest).mapInArrow(run, schema)


def _may(likeness: float):  # noqa: ANN202
    """Whether two listed vectors can have the likeness, by their sizes and signatures."""
    sizes = F.least("na", "nb") >= likeness * F.greatest("na", "nb") - 1e-9
    return sizes & may_be_like(F.col("sa"), F.col("na"), F.col("sb"), F.col("nb"), likeness)


def overlaps(records: DataFrame, likeness: float = 0.6) -> DataFrame:
    """All pairs of a training and an evaluation record with like questions and like tables.

    ``records``: rec_no, split, question, table. Gives train_rec, eval_rec, question_likeness, question_cosine, table_likeness, table_cosine (weighted),
    each pair once. split 'train' is training, 'validation' and 'test' are evaluation; others, null rec_no and
    records without any word in the question or any cell in the table can't be like one and don't come out.
    Rows with equal sets are one class until the end, so a text that fills a third of a split is compared
    once; repeated rows (another rec_no) count as rows of their own.
    """
    side = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("validation", "test"), EVAL)
    rows = records.select(F.col("rec_no").cast("bigint").alias("id"), side.alias("side"), F.col("question").alias("q"), joined_cells("table").alias("t"))
    rows = rows.where("id is not null and side is not null and q is not null and t is not null")
    rows = stage(term_sets(rows, "id", {"q": "words", "t": "cells"}, ["side"]).where("size(q_terms) > 0 and size(t_terms) > 0"))

    # Classes: equal tables of a split, then equal questions on them.
    table_class = rows.groupBy("side", "t_h1", "t_h2").agg(F.min("id").alias("table_id"))
    keys = rows.select("id", "side", "t_h1", "t_h2", "q_h1", "q_h2").join(table_class, ["side", "t_h1", "t_h2"])
    keys = stage(keys.select("id", "side", "table_id", "q_h1", "q_h2"))
    members = keys.join(keys.groupBy("side", "table_id", "q_h1", "q_h2").agg(F.min("id").alias("class_id")), ["side", "table_id", "q_h1", "q_h2"])
    members = stage(members.select("id", "side", "table_id", "class_id"))

    tables = rows.select("id", "side", F.col("t_terms").alias("terms")).join(members.where("id = table_id").select("id"), "id", "left_semi")
    tables = stage(weighted(stage(tables), likeness))
    lists = stage(tables.select("id", "side", F.size("terms").alias("n"), "sign", F.explode("index").alias("term")))
    x = lists.where(F.col("side") == TRAIN).select("term", F.col("id").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa"))
    y = lists.where(F.col("side") == EVAL).select("term", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb"))
    # Pairs that share a listed term but can't be like go inside the join.
    like_tables = stage(_qualifying(x.join(y, "term").where(_may(likeness)).select("a", "b").distinct(), tables, likeness, "table"))

    # Questions, only of records whose table has a like one in the other split.
    used = like_tables.select(F.col("a").alias("table_id"), F.lit(TRAIN).alias("side")).union(like_tables.select("b", F.lit(EVAL))).distinct()
    heads = members.where("id = class_id").join(used, ["table_id", "side"], "left_semi").select("id", "table_id")
    questions = rows.select("id", "side", F.col("q_terms").alias("terms")).join(heads, "id", "left_semi")
    questions = stage(weighted(stage(questions), likeness))
    index = stage(questions.select("id", "side", F.size("terms").alias("n"), "sign", "index").join(heads, "id"))
    x = index.where(F.col("side") == TRAIN).select("table_id", F.col("id").alias("qa"), F.col("n").alias("na"), F.col("sign").alias("sa"), F.explode("index").alias("term"))
    y = index.where(F.col("side") == EVAL).select("table_id", F.col("id").alias("qb"), F.col("n").alias("nb"), F.col("sign").alias("sb"), F.explode("index").alias("term"))
    # A list for each term within a pair of like tables.
    x = like_tables.join(x.withColumnRenamed("table_id", "a"), "a").select("a", "b", "term", "qa", "na", "sa", "table_likeness", "table_cosine")
    y = like_tables.select("a", "b").join(y.withColumnRenamed("table_id", "b"), "b").select("a", "b", "term", "qb", "nb", "sb")
    pairs = x.join(y, ["a", "b", "term"]).where(_may(likeness)).select(F.col("qa").alias("a"), F.col("qb").alias("b"), "table_likeness", "table_cosine").distinct()
    found = stage(_qualifying(pairs, questions, likeness, "question"))
    train = members.where(F.col("side") == TRAIN).select(F.col("class_id").alias("a"), F.col("id").alias("train_rec"))
    held = members.where(F.col("side") == EVAL).select(F.col("class_id").alias("b"), F.col("id").alias("eval_rec"))
    return found.join(train, "a").join(held, "b").select("train_rec", "eval_rec", "question_likeness", "question_cosine", "table_likeness", "table_cosine")


def overlap_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("train_rec", "eval_rec").alias("rec_a"), F.greatest("train_rec", "eval_rec").alias("rec_b"))


def overlap_report(records: DataFrame, found: DataFrame) -> DataFrame:
    """Counts per split and source of the evaluation records: (split, source, n_records, n_overlapping, n_exact, n_same_id).

    n_exact counts records with a training record of equal sets, n_same_id those whose id a like training
    record has too. A null source is a source of its own; splits without overlaps come out with zeros.
    """
    ids = records.select(F.col("rec_no").alias("train_rec"), F.col("id").alias("train_id"))
    own = records.select(F.col("rec_no").alias("eval_rec"), "id")
    hit = found.join(ids, "train_rec").join(own, "eval_rec").groupBy("eval_rec").agg(
        F.max(((F.col("question_likeness") == 1) & (F.col("table_likeness") == 1)).cast("int")).alias("exact"),
        F.max(F.coalesce((F.col("id") == F.col("train_id")).cast("int"), F.lit(0))).alias("same_id"),
    )
    held = records.where(F.col("split").isin("validation", "test")).select(F.col("rec_no").alias("eval_rec"), "split", "source")
    return held.join(hit, "eval_rec", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_records"),
        F.count("exact").alias("n_overlapping"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("n_exact"),
        F.coalesce(F.sum("same_id"), F.lit(0)).alias("n_same_id"),
    )
