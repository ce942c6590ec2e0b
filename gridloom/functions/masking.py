"""Masking of token ids by spans, with seeded choices that don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.binding import let
from gridloom.functions.tokens import FIRST_ID, MASK, N_IDS, PAD, hash_number

# Of masked tokens, 80 % become the mask, 10 % stay and 10 % become a random token.
MASKED, KEPT = 0.8, 0.9


def masked_id(token: Column, key: Column, strategy: str) -> Column:
    """What stands in place of a token: the mask, or by strategy 'bert' at times the token or a random one."""
    if strategy == "mask":
        return F.lit(MASK)
    if strategy != "bert":
        raise ValueError(f"no masking strategy {strategy!r}")
    u = hash_number(key) / float(1 << 32)
    return F.when(u < MASKED, F.lit(MASK)).when(u < KEPT, token).otherwise((F.lit(FIRST_ID) + hash_number(key, 9) % N_IDS).cast("int"))


def covering(spans: Column, i: Column) -> Column:
    return F.filter(spans, lambda x: (x["s"] <= i) & (x["e"] > i))


def collapse(ids: Column) -> Column:
    """Without mask ids that follow a mask id."""
    return let(ids, lambda all_: F.filter(all_, lambda x, i: ~((x == MASK) & (i > 0) & (F.coalesce(F.get(all_, i - 1), F.lit(-1)) == MASK))))


def mask_ids(ids: Column, spans: Column, key: Column, granularity: str = "span", strategy: str = "mask", merge: bool = False) -> Column:
    """The ids with the tokens of ``spans`` masked: once a span ('span', its further tokens go) or each ('token')."""
    if granularity == "span":
        def one(x: Column, i: Column, over: Column) -> Column:
            return F.when(F.size(over) == 0, x).when(F.element_at(over, -1)["s"] == i, masked_id(x, F.concat_ws(":", key, i.cast("string")), strategy))
    elif granularity == "token":
        def one(x: Column, i: Column, over: Column) -> Column:
            return F.when(F.size(over) == 0, x).otherwise(masked_id(x, F.concat_ws(":", key, i.cast("string")), strategy))
    else:
        raise ValueError(f"no masking granularity {granularity!r}")
    out = let(spans, lambda sp: F.filter(F.transform(ids, lambda x, i: let(covering(sp, i), lambda over: one(x, i, over))), lambda x: x.isNotNull()))
    return collapse(out) if merge else out


def label_ids(ids: Column, spans: Column) -> Column:
    """The ids at masked places, padding elsewhere; as long as the input."""
    return let(spans, lambda sp: F.transform(ids, lambda x, i: F.when(F.size(covering(sp, i)) > 0, x).otherwise(F.lit(PAD))))


def replace_at(ids: Column, flags: Column, by: int = PAD) -> Column:
    """``by`` at places whose flag is 1."""
    return F.zip_with(ids, flags, lambda x, f: F.when(f == 1, F.lit(by)).otherwise(x))


def sample_indices(n: Column, k: Column, key: Column) -> Column:
    """k of the indices 0..n-1 (sorted), those of the least hash; without replacement, the same for the same key."""
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ranked = F.array_sort(F.transform(all_, lambda i: F.struct(F.md5(F.concat_ws(":", key, i.cast("string"))).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, F.greatest(F.least(k, n), F.lit(0))), lambda x: x["i"]))
