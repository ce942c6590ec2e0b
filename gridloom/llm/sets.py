"""Records as sets of hashed terms, counts of terms in a table of fixed size, and connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.plainform import CELL_SEP, plain_cells, plain_words
from gridloom.llm.stage import stage

#: Terms are counted in 2**SKETCH_BITS buckets, so what goes to the driver and the workers has a fixed size.
SKETCH_BITS = 20


def joined_cells(table: str | Column) -> Column:
    """The body cells of a table column as one string, for ``plain_cells``; null tables give null, null rows and cells are left out."""
    rows = F.col(f"`{table}`.rows") if isinstance(table, str) else table["rows"]
    flat = F.flatten(F.filter(rows, lambda r: r.isNotNull()))
    return F.array_join(F.transform(flat, lambda c: F.replace(c, F.lit(CELL_SEP), F.lit(" "))), CELL_SEP)


def _hashes(terms) -> np.ndarray:
    got = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64)
    return np.unique(got).view(np.int64)


def term_sets(df: DataFrame, id_col: str, kinds: dict[str, str], keep: list[str] = []) -> DataFrame:
    """Each text column of ``kinds`` (column -> 'words' or 'cells') as a set of 64-bit term hashes.

    Gives ``id_col``, the columns of ``keep`` and for each text column c: c_terms ARRAY<BIGINT> (sorted, no
    repeats; empty for null), c_h1 and c_h2 BIGINT (128-bit hash of the set).
    """
    types = dict(df.dtypes)
    fields = [f"`{c}` {types[c]}" for c in [id_col, *keep]]
    for c in kinds:
        fields += [f"`{c}_terms` array<bigint>", f"`{c}_h1` bigint", f"`{c}_h2` bigint"]
    names = [id_col, *keep, *(f"{c}_{x}" for c in kinds for x in ("terms", "h1", "h2"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(i) for i in range(1 + len(keep))]
            for i, kind in enumerate(kinds.values(), 1 + len(keep)):
                cut = plain_words if kind == "words" else plain_cells
                sets = [_hashes(cut(s)) for s in batch.column(i).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                both = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
                out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))), pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays(out, names)

    return df.select(id_col, *keep, *kinds).mapInArrow(run, ", ".join(fields))


def bucket_of(term: Column) -> Column:
    return term.bitwiseAND((1 << SKETCH_BITS) - 1)


def bucket_counts(terms: DataFrame, col: str) -> np.ndarray:
    """How many rows hold a term of each bucket; an array of 2**SKETCH_BITS counts, whatever the size of the data."""
    got = terms.select(F.explode(col).alias("t")).groupBy(bucket_of(F.col("t")).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[got.column("b").to_numpy()] = got.column("n").to_numpy()
    return counts


def likeness(a: Column, b: Column) -> Column:
    """Shared members over members of either, of two arrays without repeats; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def signature(terms: np.ndarray) -> np.uint64:
    """64 bits of which each term sets one; two sets differ in at least as many terms as their signatures in bits."""
    return np.bitwise_or.reduce(np.left_shift(np.uint64(1), (terms.view(np.uint64) >> np.uint64(SKETCH_BITS)) & np.uint64(63)), initial=np.uint64(0))


def may_be_like(sign_a: Column, size_a: Column, sign_b: Column, size_b: Column, threshold: float) -> Column:
    """Whether sets of these signatures and sizes can have the likeness: then they differ in a bounded number of terms."""
    return F.bit_count(sign_a.bitwiseXOR(sign_b)) <= (1 - threshold) / (1 + threshold) * (size_a + size_b) + 1e-9


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of an edge list (a, b BIGINT): (node, component), the least node naming the group.

    Alternates large-star and small-star steps, each a grouping and a join on node ids; every round is a
    written table. Nodes without an edge to another node don't come out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        e = stage(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
