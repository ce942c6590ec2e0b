"""Problem 2: sources mixed to target shares, by cube-method balanced sampling.

The largest mix is made in which every source has its share and no record is used more often than its source
allows. That gives each source an expected number of copies a record: all records get the whole part,
and the fraction is an inclusion probability. The flight phase moves the probabilities of three units at a time along
the null-space of the balancing constraints (number of documents, size in characters), with the direction drawn
so that expectations hold, until units reach 0 or 1. Units fly in flocks of bounded size, which follow from
their record numbers alone, in an order that does too; each flock leaves two undecided units, which fly on in fewer flocks
until one is left. The last two of a mix and source are the landing problem, where the size constraint is dropped first; the larger units
fly first in that flock, so that the ones that land are small. Nothing depends on partitions: any cluster makes the same mix.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.splitting import table_chars
from gridloom.llm.stage import stage

_EPS = 1e-9
#: Units of a source that fly together, on average.
FLOCK = 8192


class Flight:
    """The flight phase for units that arrive one by one; balances their number and their size."""

    def __init__(self, seed: str):
        self.random = random.Random(seed).random
        self.units: list[list] = []  # [key, size, probability]

    def add(self, key, size: float, p: float) -> list[tuple]:
        """Units (key, size, 0.0 or 1.0) that are decided now."""
        if p <= _EPS or p >= 1 - _EPS:
            return [(key, size, float(round(p)))]
        self.units.append([key, size, p])
        return self._step() if len(self.units) == 3 else []

    def _move(self, u: list[float]) -> list[tuple]:
        up = down = float("inf")
        for (_, _, p), d in zip(self.units, u):
            if d > 0:
                up, down = min(up, (1 - p) / d), min(down, p / d)
            elif d < 0:
                up, down = min(up, -p / d), min(down, (p - 1) / d)
        move = up if self.random() * (up + down) < down else -down
        done, left = [], []
        for unit, d in zip(self.units, u):
            unit[2] += move * d
            if unit[2] <= _EPS or unit[2] >= 1 - _EPS:
                done.append((unit[0], unit[1], float(round(unit[2]))))
            else:
                left.append(unit)
        self.units = left
        return done

    def _step(self) -> list[tuple]:
        (_, x, _), (_, y, _), (_, z, _) = self.units
        # The null-space of [[1, 1, 1], [x, y, z]]; of equal sizes any move between two units keeps both totals.
        u = [y - z, z - x, x - y]
        return self._move(u if any(u) else [1.0, -1.0, 0.0])

    def land(self) -> list[tuple]:
        """Decides what is left: two units by their number alone, one unit by a draw."""
        done = []
        while self.units:
            done += self._move([1.0, -1.0] if len(self.units) == 2 else [1.0] if len(self.units) == 1 else [1.0, -1.0, 0.0])
        return done


def plan(targets: list[dict], totals: dict[str, dict[str, float]]) -> dict[tuple[int, str], tuple[int, float]]:
    """(mix_id, corpus) -> (copies that every record gets, probability of one more).

    ``targets``: rows of mix_id, corpus, weight, max_repeats, size_unit; ``totals``: corpus -> {'records', 'chars'}.
    Null or negative weights and repeats count 0. If a corpus with a weight has no usable records or may not be used, the mix is empty.
    """
    out: dict[tuple[int, str], tuple[int, float]] = {}
    for mix in sorted({t["mix_id"] for t in targets}):
        own = [t for t in targets if t["mix_id"] == mix and (t["weight"] or 0) > 0]
        if len({t["corpus"] for t in own}) < len(own):
            raise ValueError(f"mix {mix} names a corpus twice")
        weights = sum(t["weight"] for t in own)
        sizes = {t["corpus"]: totals.get(t["corpus"], {}).get(t["size_unit"], 0) for t in own}
        most = min((max(t["max_repeats"] or 0, 0) * sizes[t["corpus"]] * weights / t["weight"] for t in own), default=0)
        for t in own:
            copies = most * t["weight"] / weights / sizes[t["corpus"]] if most else 0.0
            whole = int(copies + _EPS)
            out[mix, t["corpus"]] = (whole, max(0.0, copies - whole))
    return out


#: What makes a record: two records that agree in all of these are one.
CONTENT = ("page_key", "context", "question", "table", "mentions", "answers")


def _usable(table: str) -> Column:
    """Some body cell that isn't blank."""
    cells = F.flatten(F.filter(F.col(f"`{table}`.rows"), lambda r: r.isNotNull()))
    return F.coalesce(F.exists(cells, lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))), F.lit(False))


def units(corpora: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """The usable records (corpus, rec_no, chars), one of each content: (table, text column or None) by corpus.

    Unusable are records with a null rec_no, without a table or without any cell that isn't blank, and with a
    null or blank text where the corpus has a text column. Records delivered again with the same content (all columns but
    rec_no and the times of creation and loading) are one record, kept under its least rec_no, so repeats are counted by content.
    chars are the code points of text, header and cells.
    """
    found = None
    for name, (df, text) in corpora.items():
        ok = _usable("table") if text is None else _usable("table") & F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))
        fields = [c for c in CONTENT if c in df.columns]
        content = F.unhex(F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields)), {"ignoreNullFields": "false"})))
        chars = table_chars("table") + (F.length(text) if text else F.lit(0))
        part = df.where(F.col("rec_no").isNotNull() & ok).select(F.lit(name).alias("corpus"), F.col("rec_no").cast("bigint"), chars.alias("chars"), content.alias("content"))
        found = part if found is None else found.union(part)
    return found.groupBy("corpus", "content").agg(F.min("rec_no").alias("rec_no"), F.first("chars").alias("chars")).select("corpus", "rec_no", "chars")


_FLOWN = "mix_id int, corpus string, rec_no bigint, chars bigint, p double"
_FIELDS = [("mix_id", pa.int32()), ("corpus", pa.string()), ("rec_no", pa.int64()), ("chars", pa.int64()), ("p", pa.float64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])


def _fly(batches: Iterator[pa.RecordBatch], seed: str, land: bool) -> Iterator[pa.RecordBatch]:
    """Flies rows of _FLOWN and their flock, sorted by mix, source and flock; what stays undecided comes out with its probability, or lands."""
    at, flight = None, Flight("")
    for batch in batches:
        out: list[tuple] = []
        for m, c, r, n, p, f in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if at != (m, c, f):
                if at is not None:
                    out += [(*at[:2], *x) for x in (flight.land() if land else flight.units)]
                at, flight = (m, c, f), Flight(f"{seed}:{m}:{c}:{f}")
            out += [(m, c, *x) for x in flight.add((r, n), n, p)]
        yield _batch([(m, c, *key, q) for m, c, key, _, q in out])
    if at is not None:
        yield _batch([(*at[:2], *key, q) for key, _, q in (flight.land() if land else flight.units)])


def _flown(units_: DataFrame, flocks: int, seed: str) -> DataFrame:
    """One round over units of _FLOWN in ``flocks`` flocks a mix and source; the last, of one flock, lands."""
    last = flocks == 1
    # Records by hash of source and number: the same flocks and order whatever the partitions are.
    spread = F.xxhash64(F.lit(seed), "corpus", "rec_no")
    flock = F.lit(0) if last else F.pmod(spread, F.lit(flocks)).cast("int")
    order = [F.desc("chars"), spread, F.col("rec_no")] if last else [spread, F.col("rec_no")]
    rows = units_.withColumn("flock", flock).repartition("mix_id", "corpus", "flock").sortWithinPartitions("mix_id", "corpus", "flock", *order)
    return rows.mapInArrow(lambda b: _fly(b, f"{seed}:{flocks}", last), _FLOWN)


def mixed(corpora: dict[str, tuple[DataFrame, str | None]], targets: DataFrame, seed: int = 1) -> DataFrame:
    """The records of each mix: (mix_id, corpus, rec_no, copies, chars), copies 1 or more.

    Shares are reached up to one or two records a source. Which records are taken depends on the seed and the records only.
    ``targets`` is a table of parameters and goes to the driver, at most 10,000 rows.
    """
    rows = [r.asDict() for r in targets.limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 targets")
    base = stage(units(corpora))
    totals = {r["corpus"]: {"records": r["n"], "chars": r["chars"]} for r in base.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    shares = plan(rows, totals)
    if not shares:
        return base.limit(0).select(F.lit(0).alias("mix_id"), "corpus", "rec_no", F.lit(0).alias("copies"), "chars")
    table = F.create_map(*(F.lit(x) for c in sorted({c for _, c in shares}) for x in (c, F.array(*(F.struct(F.lit(m).alias("m"), F.lit(n).alias("n"), F.lit(p).alias("p")) for (m, k), (n, p) in shares.items() if k == c)))))
    every = base.select("corpus", "rec_no", "chars", F.explode(F.element_at(table, F.col("corpus"))).alias("x")).select(F.col("x.m").alias("mix_id"), "corpus", "rec_no", "chars", "x.n", "x.p")
    whole = F.create_map(*(F.lit(x) for (m, c), (n, _) in shares.items() for x in (f"{m}:{c}", n)))
    decided = every.where(f"n > 0 and p <= {_EPS}").select("mix_id", "corpus", "rec_no", F.col("n").alias("copies"), "chars")
    left = every.where(f"p > {_EPS}").select("mix_id", "corpus", "rec_no", "chars", "p")
    copies = (F.element_at(whole, F.concat_ws(":", "mix_id", "corpus")) + F.col("p")).cast("int").alias("copies")
    flocks = max([-(-t["records"] // FLOCK) for t in totals.values()], default=1)
    while True:
        # Each flock leaves two units, so a round thins what is undecided by a factor of FLOCK / 2.
        flown = stage(_flown(left, flocks, str(seed)))
        decided = decided.union(flown.where("p = 0 or p = 1").select("mix_id", "corpus", "rec_no", copies, "chars").where("copies > 0"))
        if flocks == 1:
            return decided
        left = flown.where("p > 0 and p < 1")
        flocks = -(-2 * flocks // FLOCK)


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, corpus, size_unit, target_share, actual_share, n_records, n_used, chars_used, most_copies) of every target.

    actual_share is in the target's unit; null if the mix is empty.
    """
    used = mix.groupBy("mix_id", "corpus").agg(F.count("*").alias("n_records"), F.sum("copies").alias("n_used"), F.sum(F.col("copies") * F.col("chars")).alias("chars_used"), F.max("copies").alias("most_copies"))
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    t = targets.select("mix_id", "corpus", "size_unit", weight.alias("weight")).join(used, ["mix_id", "corpus"], "left").fillna(0, ["n_records", "n_used", "chars_used", "most_copies"])
    size = F.when(F.col("size_unit") == "chars", F.col("chars_used")).otherwise(F.col("n_used")).cast("double")
    total = t.groupBy("mix_id").agg(F.sum("weight").alias("w"), F.sum(size).alias("s"))
    return t.join(total, "mix_id").select("mix_id", "corpus", "size_unit", (F.col("weight") / F.nullif("w", F.lit(0.0))).alias("target_share"), (size / F.nullif("s", F.lit(0.0))).alias("actual_share"), "n_records", "n_used", "chars_used", "most_copies")


def checked(mix: DataFrame, corpora: dict[str, tuple[DataFrame, str | None]], targets: DataFrame) -> DataFrame:
    """What must hold of a mix, for every target: (mix_id, corpus, target_share, over_cap, repeated, unusable, close).

    over_cap: records used more than max_repeats times, repeated: rows of one record beyond the first, unusable: records that aren't usable, close: whether the actual share is
    that of the target within three records of the largest size.
    """
    ok = units(corpora).select("corpus", "rec_no", F.lit(True).alias("ok"))
    caps = targets.select("mix_id", "corpus", "max_repeats")
    rows = mix.join(ok, ["corpus", "rec_no"], "left").join(caps, ["mix_id", "corpus"])
    per = rows.groupBy("mix_id", "corpus", "rec_no").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("chars").alias("chars"), F.max("max_repeats").alias("cap"), F.max("ok").alias("ok"))
    faults = per.groupBy("mix_id", "corpus").agg(
        F.count_if(F.col("copies") > F.col("cap")).alias("over_cap"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("ok").isNull()).alias("unusable"), F.max("chars").alias("largest")
    )
    largest = F.when(F.col("size_unit") == "chars", F.max("largest").over(Window.partitionBy("mix_id"))).otherwise(F.lit(1))
    size = F.when(F.col("size_unit") == "chars", F.col("chars_used")).otherwise(F.col("n_used"))
    got = shares(mix, targets).join(faults, ["mix_id", "corpus"], "left")
    total = F.sum(size).over(Window.partitionBy("mix_id"))
    close = (F.abs(F.col("actual_share") - F.col("target_share")) <= 3 * largest / total) | (total == 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return got.select("mix_id", "corpus", "target_share", zero("over_cap"), zero("repeated"), zero("unusable"), close.alias("close"))
