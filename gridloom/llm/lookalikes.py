"""Problem 5: one consistent form for text that looks the same, by script-aware repair.

Width forms, composition of accents, invisible characters and kinds of space have one form by rule. Look-alike letters
are repaired token by token, to the dominant script of the token (that of its letters that have no twin elsewhere):

* step 1, ``mixed``: in tokens of mixed scripts the letters of other scripts are replaced by their twins, if
  the result exists in the vocabulary of the corpus as a token that needs no repair;
* step 2, for what step 1 leaves: ``twins``, tokens of one foreign script that consist of twins only and whose result exists in
  that vocabulary, and ``agreed``, tokens whose clean spelling occurs nowhere but is the result of repairing two different spellings.

The steps are counted apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.plainform import CELL_SEP, FOREIGN, is_mixed, repair_token, visible_form
from gridloom.llm.sets import SKETCH_BITS, joined_cells
from gridloom.llm.stage import stage

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
FORM, MIXED, TWINS, AGREED = "form", "mixed", "twins", "agreed"


class _Repairs(dict):
    """token -> its repaired spelling, or None where there is nothing to repair."""

    def __missing__(self, token: str) -> str | None:
        if len(self) > 300_000:
            self.clear()
        fixed = None if token.isascii() or not FOREIGN.search(token) else repair_token(token)
        self[token] = fixed = None if fixed == token else fixed
        return fixed


def suspects(texts: DataFrame) -> DataFrame:
    """(id, token, repaired, kind) of each row's tokens that repair would change, kind MIXED or TWINS; ``texts``: id BIGINT, x STRING."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = _Repairs()
        for batch in batches:
            out: list[tuple[int, str, str, str]] = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x and FOREIGN.search(x):
                    out += [(i, t, r, MIXED if is_mixed(t) else TWINS) for t in set(_TOKEN.findall(visible_form(x))) if (r := repairs[t])]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], ["id", "token", "repaired", "kind"])

    return texts.select("id", "x").mapInArrow(run, "id bigint, token string, repaired string, kind string")


def _bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) & ((1 << SKETCH_BITS) - 1)


def known_tokens(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of ``wanted`` (repaired STRING, distinct) occur in the texts as they are: (repaired).

    Only buckets of hashes are sent to the workers, a set of at most 2**SKETCH_BITS numbers; tokens that pass are joined.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique([_bucket(t) for t in batch.column(0).to_pylist()]).astype(np.int32))], ["b"])

    buckets = wanted.select("repaired").mapInArrow(hashed, "b int").distinct().toArrow().column(0).to_numpy()
    mask = np.zeros(1 << SKETCH_BITS, bool)
    mask[buckets] = True
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(shared.value).tobytes()
        seen: dict[str, bool] = {}
        for batch in batches:
            tokens: set[str] = set()
            for x in batch.column(0).to_pylist():
                if x:
                    tokens.update(_TOKEN.findall(visible_form(x)))
            if len(seen) > 500_000:
                seen.clear()
            new = [t for t in tokens if t not in seen]
            seen.update((t, True) for t in new)
            yield pa.RecordBatch.from_arrays([pa.array([t for t in new if mask[_bucket(t)]], pa.string())], ["repaired"])

    return texts.select("x").mapInArrow(run, "repaired string").distinct().join(wanted, "repaired", "left_semi")


def approved_repairs(texts: DataFrame) -> DataFrame:
    """(id, repairs) of rows with tokens to repair, each with its kind; the vocabulary is that of all ``texts`` (id, x)."""
    found = stage(suspects(texts))
    wanted = stage(found.select("token", "repaired").distinct().groupBy("repaired").agg(F.count("*").alias("spellings")))
    known = known_tokens(texts, wanted.select("repaired")).distinct().withColumn("known", F.lit(True))
    approved = wanted.join(known, "repaired", "left").where("known or spellings > 1").select("repaired", F.coalesce("known", F.lit(False)).alias("known"))
    kind = F.when(F.col("known"), F.col("kind")).otherwise(AGREED).alias("kind")
    # All spellings of one row: bounded by the row's own tokens.
    return found.join(approved, "repaired").groupBy("id").agg(F.collect_set(F.struct("token", "repaired", kind)).alias("repairs"))


def _maps(repairs: list[list[dict] | None]) -> list[dict[str, str]]:
    return [{r["token"]: r["repaired"] for r in m or ()} for m in repairs]


def _fix(s: str | None, repairs: dict[str, str]) -> str | None:
    if s is None:
        return None
    s = visible_form(s)
    return _TOKEN.sub(lambda m: repairs.get(m.group(), m.group()), s) if repairs and not s.isascii() else s


def _texts(records: DataFrame) -> DataFrame:
    header = F.array_join(F.transform(F.col("table.header"), lambda c: F.replace(c, F.lit(CELL_SEP), F.lit(" "))), CELL_SEP)
    x = F.concat_ws(CELL_SEP, F.array_join(F.col("answers"), CELL_SEP), header, joined_cells("table"))
    return records.select(F.col("rec_no").cast("bigint").alias("id"), x.alias("x")).where("id is not null")


def consistent_forms(records: DataFrame) -> DataFrame:
    """Answers, header names and cells in one form: (rec_no, answers, header, rows, n_mixed, n_twins, n_agreed).

    The counts are of the row's different tokens that were repaired in each way. Null records' fields, null rows, cells and answers stay
    null and empty ones empty; places don't change. Rows with a null rec_no are left out; repeated rec_no are repaired alike, with the
    spellings found in any of them.
    """
    repairs = approved_repairs(_texts(records))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
        for batch in batches:
            found = batch.column(4).to_pylist()
            maps = _maps(found)
            answers, header = ([None if a is None else [_fix(s, m) for s in a] for a, m in zip(batch.column(k).to_pylist(), maps)] for k in (1, 2))
            rows = [None if t is None else [None if r is None else [_fix(s, m) for s in r] for r in t] for t, m in zip(batch.column(3).to_pylist(), maps)]
            counts = [pa.array([sum(r["kind"] == kind for r in m or ()) for m in found], pa.int32()) for kind in (MIXED, TWINS, AGREED)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, one), pa.array(header, one), pa.array(rows, two), *counts], ["rec_no", "answers", "header", "rows", "n_mixed", "n_twins", "n_agreed"])

    rows = records.select(F.col("rec_no").cast("bigint").alias("id"), "answers", F.col("table.header").alias("header"), F.col("table.rows").alias("rows")).where("id is not null")
    schema = "rec_no bigint, answers array<string>, header array<string>, rows array<array<string>>, n_mixed int, n_twins int, n_agreed int"
    return rows.join(repairs, "id", "left").select("id", "answers", "header", "rows", "repairs").mapInArrow(run, schema)


def unmatched(records: DataFrame) -> Column:
    """Whether some non-empty answer equals no body cell of the row's own table character for character."""
    cells = F.flatten(F.filter(F.col("table.rows"), lambda r: r.isNotNull()))
    return F.exists("answers", lambda a: (F.length(a) > 0) & ~F.coalesce(F.array_contains(cells, a), F.lit(False))) & cells.isNotNull()


def lookalike_answers(records: DataFrame) -> DataFrame:
    """Answers that equal no cell of their table but look the same as one: (rec_no, ans_pos, kind), ans_pos 0-based.

    Both are brought to the consistent form; those are cases whose forms are equal. kind is the least that makes them equal: FORM (no letter is replaced),
    MIXED (by step 1) or the kind of step 2 that is needed. Null, empty and invisible answers, null tables and cells make no case.
    """
    repairs = approved_repairs(_texts(records))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for i, answers, joined, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                cells = set(joined.split(CELL_SEP))
                steps = [(FORM, {})]
                for kinds in ((MIXED,), (MIXED, TWINS), (MIXED, TWINS, AGREED)):
                    allowed = [r for r in found or () if r["kind"] in kinds]
                    if len(allowed) > len(steps[-1][1]):
                        steps.append((kinds[-1], *_maps([allowed])))
                forms = [{_fix(c, m) for c in cells if c} for _, m in steps]
                for k, a in enumerate(answers):
                    if a and a not in cells:
                        kind = next((kind for (kind, m), all_ in zip(steps, forms) if (f := _fix(a, m)).strip() and f in all_), None)
                        if kind:
                            out.append((i, k, kind))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["rec_no", "ans_pos", "kind"])

    rows = records.where("rec_no is not null").where(unmatched(records)).select(F.col("rec_no").cast("bigint").alias("id"), "answers", joined_cells("table").alias("cells"))
    return rows.join(repairs, "id", "left").select("id", "answers", "cells", "repairs").mapInArrow(run, "rec_no bigint, ans_pos int, kind string")
