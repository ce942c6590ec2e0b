"""Problem 4: groups of records that differ by small edits, by meet-in-the-middle ball hashing.

Two sets of n and m terms of likeness t or more differ in at most (1 - t) / (1 + t) (n + m) terms: the radius. What they share is
the middle: each reaches it by deleting at most ``half_radius`` of its own terms, half the radius for sets of one size. Terms stand in one
fixed order, rare ones first. For each number k of kept terms, the fingerprint of a set is its first
half_radius + k terms, and its ball are all variants of the fingerprint with half_radius deletions. At
most half_radius of these terms aren't shared, so the first k shared terms of both sets are a variant in both balls. Every
fingerprint emits its variants, variants are shuffled, and colliding pairs are deduplicated and verified on the whole sets.

k follows from the terms: a chain of kept terms ends as soon as their estimated joint frequency is low, so rare terms
stand alone and frequent ones are refined, up to ``depth`` terms, the most with which a ball has at most ``MAX_BALL`` variants. The
decision depends on the terms and the sizes that a partner can have only, hence both sides of a pair end in the same variant and no pair is
lost, whatever the counts are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.sets import SKETCH_BITS, bucket_counts, components, joined_cells, likeness, may_be_like, signature, term_sets
from gridloom.llm.stage import stage

#: Records that may share a variant on average before it keeps a further term.
BALL_SIZE = 4
#: Most terms of a variant, and most variants of a ball.
MAX_KEPT, MAX_BALL = 4, 1000
#: A variant of more sets than this is hot.
HOT = 1000
SMALLER, LARGER, EQUAL = 0, 1, 2
_MASK64 = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15
_VARIANT = "variant bigint, first int, id bigint, n int, sign bigint"


def least_shared(n: int, threshold: float) -> int:
    """How many terms a set of n terms shares at least with a like one."""
    return max(1, math.ceil(threshold * n - 1e-9))


def half_radius(n: int, threshold: float) -> int:
    """How many terms of a set of n terms a like one may lack at most."""
    return n - least_shared(n, threshold)


@lru_cache(maxsize=100_000)
def depth(n: int, threshold: float) -> int:
    """The most terms that variants keep, so that a ball has at most MAX_BALL; a single one is always allowed."""
    h = half_radius(n, threshold)
    return max((k for k in range(2, MAX_KEPT + 1) if math.comb(h + k, k) <= MAX_BALL), default=1)


@lru_cache(maxsize=100_000)
def stops(n: int, threshold: float) -> frozenset[int]:
    """The depths at which a set of n terms and its partners, of any size a like set can have, may end."""
    return frozenset(range(depth(math.floor(n / threshold + 1e-9), threshold), depth(least_shared(n, threshold), threshold) + 1))


def ball(terms: np.ndarray, counts: np.ndarray, total: int, threshold: float, noise: float = 0.0) -> tuple[list[int], list[int]]:
    """All variants of one set, and the place of the first kept term of each in the set's order.

    ``counts`` by bucket, ``total`` the number of sets, ``noise`` what other terms add to a bucket on average. The number of variants has a
    bound that the counts don't change: the ball of each depth in ``stops``, and of the least number of shared terms where that is less.
    """
    n = len(terms)
    need, ends = least_shared(n, threshold), stops(n, threshold)
    deepest = max(ends)
    freq = counts[terms & ((1 << SKETCH_BITS) - 1)]
    order = np.lexsort((terms, freq))[: n - need + deepest]
    head, freq = terms[order].tolist(), np.maximum(freq[order] - noise, 1).tolist()
    # A single term's count may also exceed the size by what chance adds to a bucket.
    single = BALL_SIZE + 2 * math.sqrt(noise)
    out: list[int] = []
    first: list[int] = []

    def extend(start: int, mixed: int, expected: float, kept: int, begin: int) -> None:
        # The next kept term is among the first n - need + kept + 1, as n - need at most aren't shared.
        for i in range(start, min(n, n - need + kept + 1)):
            h = ((mixed * _MIX) & _MASK64) ^ (head[i] & _MASK64)
            e = expected * freq[i] / total
            at = begin if kept else i
            rare = e <= (BALL_SIZE if kept else single)
            if rare or kept + 1 in ends or kept + 1 >= need:
                out.append(h)
                first.append(at)
            # A partner can end deeper, so a chain that isn't rare goes on besides.
            if not rare and kept + 1 < deepest:
                extend(i + 1, h, e, kept + 1, at)

    extend(0, 1, total, 0, 0)
    return out, first


def split_by_size(variant: int, n: int, first: int, threshold: float) -> list[tuple[int, int]]:
    """A hot variant of a set of n terms as (variant, role) for each size that a like set may have.

    No term before place ``first`` is shared, which bounds what is, and so the partner's size. Roles: SMALLER or LARGER than the partner, EQUAL.
    """
    most = min(math.floor((n - first) * (1 + threshold) / threshold - n + 1e-9), math.floor(n / threshold + 1e-9))
    out = []
    for m in range(max(1, math.ceil(threshold * n - 1e-9)), most + 1):
        key = (((variant * _MIX) & _MASK64) ^ ((min(n, m) << 32) | max(n, m))) * _MIX & _MASK64
        out.append((key, EQUAL if m == n else SMALLER if n < m else LARGER))
    return out


def variants(sets: DataFrame, threshold: float) -> DataFrame:
    """The balls of all sets (id, terms): the columns of _VARIANT."""
    counts, total = bucket_counts(sets, "terms"), max(1, sets.count())
    noise = float(counts.sum()) / len(counts)
    shared = sets.sparkSession.sparkContext.broadcast(counts.astype(np.int32 if total < 1 << 31 else np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for lo in range(0, len(ids), 1024):
                found, firsts, sizes, signs = [], [], [], []
                for k in range(lo, min(lo + 1024, len(ids))):
                    terms = flat[ends[k] : ends[k + 1]]
                    got, first = ball(terms, counts, total, threshold, noise)
                    found.append(np.array(got, np.uint64))
                    firsts.append(np.array(first, np.int32))
                    sizes.append(len(got))
                    signs.append(signature(terms))
                n = np.diff(ends[lo : lo + len(sizes) + 1]).astype(np.int32)
                rest = (np.repeat(c, sizes) for c in (ids[lo : lo + 1024], n, np.array(signs, np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(found).view(np.int64), np.concatenate(firsts), *rest)], ["variant", "first", "id", "n", "sign"])

    return sets.select("id", "terms").mapInArrow(run, _VARIANT)


def _by_size(hot: DataFrame, threshold: float) -> DataFrame:
    """Variants of _VARIANT as one row (variant, role, id, n, sign) for each size that a like set may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, role, k) for k, (v, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))) for key, role in split_by_size(v & _MASK64, n, first, threshold)]
            keys, roles, at = (np.array(c) for c in zip(*rows)) if rows else (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64))
            at = pa.array(at.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(roles.astype(np.int32)), *(batch.column(c).take(at) for c in (2, 3, 4))], ["variant", "role", "id", "n", "sign"])

    return hot.mapInArrow(run, "variant bigint, role int, id bigint, n int, sign bigint")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of different sets of a likeness of ``threshold`` or more: (a, b, likeness), a < b.

    ``sets`` has id BIGINT (unique) and terms ARRAY<BIGINT> (no repeats, not empty) and is read several times. Variants are counted
    exactly; those of one set go, and those of more than ``HOT`` sets are split by the sizes that the sets and their partners can have, so sets
    of one size that can't be alike aren't paired.
    """
    found = stage(variants(sets, threshold))
    counts = found.groupBy("variant").agg(F.count("*").alias("n_sets")).where("n_sets > 1")
    # Few variants are met twice; a hot one can be split over tasks here, as its other side is one row.
    met = stage(found.join(counts, "variant"))

    def sides(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (v.select("variant", F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sign").alias(f"s{c}")) for c, v in (("a", x), ("b", y)))
        # Most chance collisions go before anything is looked up.
        sizes = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
        return x.join(y, "variant").where(sizes & may_be_like(F.col("sa"), F.col("na"), F.col("sb"), F.col("nb"), threshold))

    few = met.where(F.col("n_sets") <= HOT)
    pairs = sides(few, few).where("a < b").select("a", "b")
    hot = stage(_by_size(met.where(F.col("n_sets") > HOT).drop("n_sets"), threshold))
    equal = hot.where(F.col("role") == EQUAL)
    pairs = pairs.union(sides(equal, equal).where("a < b").select("a", "b"))
    other = sides(hot.where(F.col("role") == SMALLER), hot.where(F.col("role") == LARGER))
    pairs = pairs.union(other.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    left = sets.select(F.col("id").alias("a"), F.col("terms").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("terms").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("ta"), F.col("tb")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def groups(corpora: dict[str, tuple[DataFrame, str, str]], threshold: float = 0.6) -> DataFrame:
    """Groups of near-duplicates of each corpus: (corpus, rec_no, class_id, n_links, group_id), one row a record.

    ``corpora``: name -> (records with rec_no, text column, 'words' or 'cells'). Records of one corpus whose
    term sets have a likeness of ``threshold`` or more are linked, and linked records make a group. class_id is
    the least rec_no with exactly the same set, n_links the number of other classes it is linked with, group_id
    the least class_id of the group. Records with a null rec_no, a null or blank text or without any term take
    no part and don't come out; a row delivered twice with one rec_no comes out twice. Exact copies are collapsed
    to classes by a pre-aggregated grouping before anything is compared, so a hot text costs nothing.
    """
    tagged, names = [], list(corpora)
    for k, (df, col, kind) in enumerate(corpora.values()):
        text = joined_cells(col) if kind == "cells" else F.col(f"`{col}`")
        rows = df.select(F.col("rec_no").cast("bigint"), text.alias("x")).where("rec_no is not null and x is not null")
        rows = term_sets(rows, "rec_no", {"x": kind}).where(F.size("x_terms") > 0)
        # One id space for all corpora, so that one run finds the components of all.
        tagged.append(rows.select(F.lit(k).alias("k"), (F.col("rec_no") * len(names) + k).alias("id"), F.col("x_terms").alias("terms"), F.col("x_h1").alias("h1"), F.col("x_h2").alias("h2")))
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.union(more)
    rows = stage(rows)
    classes = rows.groupBy("k", "h1", "h2").agg(F.min("id").alias("class"))
    members = stage(rows.select("k", "h1", "h2", "id").join(classes, ["k", "h1", "h2"]).select("k", "id", "class"))
    reps = stage(rows.select("k", "id", "terms").join(members.where("id = class").select("id").distinct(), "id", "left_semi"))
    edges = None
    for k in range(len(names)):
        found = similar_sets(reps.where(F.col("k") == k), threshold)
        edges = found if edges is None else edges.union(found)
    edges = stage(edges.select("a", "b").distinct())
    comp = components(edges)
    links = edges.select(F.col("a").alias("class")).union(edges.select("b")).groupBy("class").agg(F.count("*").alias("n_links"))
    known = links.join(comp.withColumnRenamed("node", "class"), "class")
    n = len(names)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return members.join(known, "class", "left").select(
        name.alias("corpus"),
        F.expr(f"id div {n}").alias("rec_no"),
        F.expr(f"class div {n}").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.expr(f"coalesce(component, class) div {n}").alias("group_id"),
    )


def group_pairs(grouped: DataFrame) -> DataFrame:
    """All pairs of records of one group: (corpus, rec_a, rec_b), rec_a < rec_b."""
    grouped = stage(grouped.select("corpus", "group_id", "rec_no").distinct())
    a = grouped.select("corpus", "group_id", F.col("rec_no").alias("rec_a"))
    b = grouped.select("corpus", "group_id", F.col("rec_no").alias("rec_b"))
    return a.join(b, ["corpus", "group_id"]).where("rec_a < rec_b").select("corpus", "rec_a", "rec_b")
