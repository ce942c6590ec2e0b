"""Problem 3: tables over a size limit as pieces under it, by balanced targets.

The text of a table is its header names and its cells, row by row; its size is their code points, null
counting 0. A row that fits a piece is never cut; a larger one may be cut between its cells, a larger cell
before its words, and a larger word anywhere. The piece count starts at the least that holds the text
together with what is repeated, with targets of equal length; each target snaps to the strongest boundary near it, and while
any piece breaks the limit a piece is added. Room for the last rows of the piece before is planned from the start:
a piece repeats as many of the wanted ones as fit beside its first own row, and the header too where that leaves room
for it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "piece int, n_pieces int, header array<string>, rows array<array<string>>, n_chars int, header_repeated boolean, overlap_rows int, overlap_short int, start_row int, start_cell int, start_char int, cut string"
_ROW, _CELL, _SPACE, _ANY = "row", "cell", "space", "char"
#: The largest part of the limit that a header may take to be repeated; larger ones stand in the first pieces only.
HEADER_SHARE = 0.5


def table_chars(table: str = "table") -> Column:
    """Code points of all header names and cells as stored; null counts 0, null tables 0."""
    def total(strings: Column) -> Column:
        return F.aggregate(F.coalesce(strings, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(F.length(s), F.lit(0)))

    t = F.col(f"`{table}`")
    rows = F.aggregate(F.coalesce(t["rows"], F.array().cast("array<array<string>>")), F.lit(0).cast("bigint"), lambda n, r: n + total(r))
    return total(t["header"]) + rows


class _Units:
    """What is never cut, in order: (row, cell, char, texts), with sizes and the kinds of the boundaries before them."""

    def __init__(self, header: list[str | None], rows: list[list[str | None]], limit: int, grain: int):
        self.places: list[tuple[int, int, int]] = []
        self.texts: list[list[str | None]] = []
        self.kinds: list[str] = []
        self.sums = [0]
        for r, row in enumerate([header, *rows] if header else rows, -1 if header else 0):
            if sum(len(c or "") for c in row) <= limit:
                self._add(r, 0, 0, row, _ROW)
                continue
            for c, cell in enumerate(row):
                kind = _CELL if c else _ROW
                if len(cell or "") <= limit:
                    self._add(r, c, 0, [cell], kind)
                    continue
                for at, part, how in _parts_of(cell, limit, grain):
                    self._add(r, c, at, [part], how if at else kind)
        # The places of each kind of boundary, and of all at least as strong.
        self.cuts = [(kind, [k for k, x in enumerate(self.kinds) if x == kind]) for kind in (_ROW, _CELL, _SPACE, _ANY)]

    def _add(self, r: int, c: int, at: int, texts: list[str | None], kind: str) -> None:
        self.places.append((r, c, at))
        self.texts.append(texts)
        self.kinds.append(kind)
        self.sums.append(self.sums[-1] + sum(len(x or "") for x in texts))

    def size(self, a: int, b: int) -> int:
        return self.sums[b] - self.sums[a]

    def snap(self, target: float, low: int, high: int, reach: float) -> int:
        """The unit from ``low`` to ``high`` before which to cut: at the strongest boundary within ``reach`` characters of the target, or else in the whole range; the nearest of its kind."""
        sums = self.sums
        near = max(low, bisect_left(sums, target - reach)), min(high, bisect_right(sums, target + reach) - 1)
        middle = bisect_left(sums, target)
        for lo, hi in (near, (low, high)):
            for _, places in self.cuts:
                i, j = bisect_left(places, lo), bisect_right(places, hi)
                if i < j:
                    k = bisect_left(places, middle, i, j)
                    return min((places[x] for x in (k - 1, k) if i <= x < j), key=lambda u: (abs(sums[u] - target), u))
        raise AssertionError("no boundary")

    def last_rows(self, a: int, b: int, n: int) -> list[int]:
        """Sizes of the last n rows (or parts of rows) of the units from a to b, in order."""
        out: list[int] = []
        k = b - 1
        while k >= a and self.places[k][0] >= 0:
            r, size = self.places[k][0], 0
            while k >= a and self.places[k][0] == r:
                size += self.size(k, k + 1)
                k -= 1
            if len(out) == n:
                break
            out.append(size)
        return out[::-1]


def _parts_of(cell: str, limit: int, grain: int) -> Iterator[tuple[int, str, str]]:
    """(place, part, boundary before it) of a cell over the limit: its words with the white space after them, larger ones in parts of ``grain``."""
    starts = [0, *(k for k in range(1, len(cell)) if cell[k - 1].isspace() and not cell[k].isspace()), len(cell)]
    for a, b in zip(starts, starts[1:]):
        if b - a <= limit:
            yield a, cell[a:b], _SPACE
        else:
            for k in range(a, b, grain):
                yield k, cell[k : min(k + grain, b)], _SPACE if k == a else _ANY


class _Layout:
    """Where pieces can end, given what they repeat."""

    def __init__(self, units: _Units, head: int, limit: int, overlap: int):
        self.units, self.head, self.limit, self.overlap = units, head, limit, overlap
        self.n = len(units.places)

    def begin(self, s: int, tail: list[int]) -> tuple[int, bool, int]:
        """(repeated rows, whether the header is repeated, the furthest end) of a piece whose own units begin at s; ``tail``: sizes of the last rows of the piece before."""
        used = self.units.size(s, s + 1)
        again = 0
        if s:
            for size in reversed(tail):
                if used + size > self.limit:
                    break
                used += size
                again += 1
        header = bool(s) and self.units.places[s][0] >= 0 and 0 < self.head <= self.limit - used
        room = self.limit - used - header * self.head
        return again, header, bisect_right(self.units.sums, self.units.sums[s + 1] + room) - 1

    def tail(self, s: int, e: int, before: list[int], again: int) -> list[int]:
        rows = self.units.last_rows(s, e, self.overlap) if self.overlap else []
        if len(rows) < self.overlap and again:
            rows = before[len(before) - again :][len(rows) - self.overlap :] + rows
        return rows[-self.overlap :] if self.overlap else []

    def least(self) -> int:
        """How many pieces there are if each is filled up."""
        s, count, tail = 0, 0, []
        while s < self.n:
            again, _, e = self.begin(s, tail)
            tail = self.tail(s, e, tail, again)
            s, count = e, count + 1
        return count

    def place(self, count: int) -> list[tuple[int, int, bool]] | None:
        """(first unit, repeated rows, repeated header) of at most ``count`` pieces near equal length, or None if the last exceeds the limit."""
        units, out, s, tail = self.units, [], 0, []
        for left in range(count, 0, -1):
            again, header, e = self.begin(s, tail)
            out.append((s, again, header))
            if e == self.n:
                return out
            if left == 1:
                return None
            step = units.size(s, self.n) / left
            cut = units.snap(units.sums[s] + step, s + 1, e, step / 2)
            tail = self.tail(s, cut, tail, again)
            s = cut
        return None

    def pieces(self) -> list[tuple[int, int, bool]]:
        """Adds pieces until all keep the limit; at one unit a piece they do."""
        count = self.least()
        while (found := self.place(count)) is None:
            count = max(count + 1, count * 51 // 50)
        return found


def pieces(header: list[str] | None, rows: list[list[str] | None] | None, max_chars: int, overlap: int, header_share: float = HEADER_SHARE) -> list[dict]:
    """The pieces of one table; a table within the limit is one piece.

    Joining the pieces' own parts (without repeated header and rows) in order gives the table back: a cut inside a
    row splits it into two rows of which the second begins at cell start_cell, one inside a cell splits the cell at
    start_char. overlap_short counts wanted rows of the piece before that don't fit beside the piece's first own row (or part of a row). The header stands in the
    first piece (start_row -1; cut like a row if it exceeds the limit) and again in those with header_repeated, unless it takes more
    than ``header_share`` of the limit.
    """
    header, rows = list(header or []), [list(r) if r is not None else [] for r in rows or []]
    head = sum(len(h or "") for h in header)
    whole = head + sum(len(c or "") for r in rows for c in r)
    if whole <= max_chars:
        return [dict(piece=0, n_pieces=1, header=header, rows=rows, n_chars=whole, header_repeated=False, overlap_rows=0, overlap_short=0, start_row=-1 if header else 0, start_cell=0, start_char=0, cut="none")]
    repeat = head <= header_share * max_chars
    units = _Units(header, rows, max_chars, max(1, (max_chars - repeat * head) // 4))
    layout = _Layout(units, head if repeat else 0, max_chars, overlap)
    starts = layout.pieces()
    out: list[dict] = []
    before: list[list[str | None]] = []
    for k, ((s, again, again_header), e) in enumerate(zip(starts, [*(x[0] for x in starts[1:]), len(units.places)])):
        names: list[str | None] = list(header) if again_header else []
        own: list[list[str | None]] = []
        last = None
        for u in range(s, e):
            r, _, at = units.places[u]
            if r < 0:
                _join(names, units.texts[u], at and u > s)
            elif r == last:
                _join(own[-1], units.texts[u], at)
            else:
                own.append(list(units.texts[u]))
            last = r
        repeated = before[len(before) - again :] if again else []
        size = units.size(s, e) + sum(len(c or "") for r in repeated for c in r) + again_header * head
        row, cell, at = units.places[s]
        out.append(dict(piece=k, n_pieces=len(starts), header=names, rows=repeated + own, n_chars=size, header_repeated=again_header, overlap_rows=again, overlap_short=min(overlap, len(before)) - again, start_row=row, start_cell=cell, start_char=at, cut=units.kinds[s] if k else "none"))
        before = repeated + own
    return out


def _join(row: list[str | None], texts: list[str | None], inside: int) -> None:
    """Adds cells to a row; the first goes on the row's last cell if it begins inside it."""
    if inside:
        row[-1] += texts[0]
    else:
        row += texts


def split_tables(records: DataFrame, max_chars: int, overlap_rows: int, key: str = "rec_no", table: str = "table") -> DataFrame:
    """The pieces of the tables over ``max_chars``: ``key`` and the columns of ``PIECE``, one row a piece.

    Tables within the limit aren't cut and don't come out, nor do null tables. Null rows become rows without cells, null
    cells stay null, rows without cells stay rows. A limit under 1 is refused. Sizes are computed by native expressions, so only oversized tables
    reach Python. The rows that a piece repeats are the last of the piece before, as stored there.
    """
    if max_chars < 1 or overlap_rows < 0:
        raise ValueError("max_chars must be 1 or more, overlap_rows 0 or more")
    names = [f.split(" ")[0] for f in PIECE.split(", ")]
    types = {"header": pa.list_(pa.string()), "rows": pa.list_(pa.list_(pa.string())), "header_repeated": pa.bool_(), "cut": pa.string()}
    key_type = dict(records.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cut = [pieces(h, r, max_chars, overlap_rows) for h, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                keys = part.column(0).take(pa.array([i for i, p in enumerate(cut) for _ in p], pa.int64()))
                rows = [p for ps in cut for p in ps]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([p[n] for p in rows], types.get(n, pa.int32())) for n in names)], [key, *names])

    over = records.where(table_chars(table) > max_chars)
    return over.select(key, F.col(f"`{table}`.header").alias("header"), F.col(f"`{table}`.rows").alias("rows")).mapInArrow(run, f"`{key}` {key_type}, {PIECE}")


def split_corpora(corpora: dict[str, DataFrame], limits: DataFrame) -> DataFrame:
    """(corpus, rec_no, pieces) of each corpus by its row of ``limits`` (corpus, max_chars, overlap_rows); one row of limits a corpus."""
    found = None
    for row in limits.collect():
        if row["corpus"] in corpora:
            part = split_tables(corpora[row["corpus"]], row["max_chars"], row["overlap_rows"]).withColumn("corpus", F.lit(row["corpus"]))
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no limit names one of the corpora")
    return found


def rejoined(pieces_: DataFrame, limits: DataFrame) -> DataFrame:
    """What the pieces of each table amount to: (corpus, rec_no, text_md5, over_limit, wrong_overlap, short, cut_rows), one row a table.

    text_md5 is that of the pieces' own parts in order; over_limit counts pieces over the limit, wrong_overlap pieces whose repeated rows aren't the last of
    the piece before, short pieces that lack wanted rows though they would fit beside the piece's first row, cut_rows rows that were cut though they fit a piece.
    A group is the pieces of one table.
    """
    text = lambda cells: F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "")
    own = F.expr("slice(rows, overlap_rows + 1, size(rows))")
    names = F.when(F.col("header_repeated"), F.lit("")).otherwise(text(F.col("header")))
    sizes = F.transform("rows", lambda r: F.length(text(r)))
    order = Window.partitionBy("corpus", "rec_no").orderBy("piece")
    before = F.lag("rows").over(order)
    p = pieces_.join(F.broadcast(limits.limit(1000).select("corpus", "max_chars", F.col("overlap_rows").alias("wanted"))), "corpus")
    p = p.withColumn("own_text", F.concat(names, text(F.flatten(own)))).withColumn("before", before).withColumn("sizes", sizes)
    p = p.withColumn("had", F.coalesce(F.size("before"), F.lit(0)))
    same = F.expr("slice(before, had - overlap_rows + 1, overlap_rows) <=> slice(rows, 1, overlap_rows)")
    wanted = F.least("wanted", "had")
    needed = F.expr("aggregate(slice(before, had - overlap_rows, 1), 0, (n, r) -> n + aggregate(r, 0, (m, c) -> m + coalesce(length(c), 0)))")
    first = F.coalesce(F.expr("sizes[overlap_rows]"), F.lit(0))
    repeats = F.expr("aggregate(slice(sizes, 1, overlap_rows), 0, (n, x) -> n + x)")
    short = (F.col("piece") > 0) & (F.col("overlap_rows") < wanted) & (repeats + needed + first <= F.col("max_chars"))
    own_row = p.select("corpus", "rec_no", "max_chars", F.greatest("start_row", F.lit(0)).alias("base"), F.posexplode(F.expr("slice(rows, overlap_rows + 1, size(rows))")).alias("i", "r"))
    parts = own_row.groupBy("corpus", "rec_no", "max_chars", (F.col("base") + F.col("i")).alias("row")).agg(F.count("*").alias("parts"), F.sum(F.length(text(F.col("r")))).alias("size"))
    cut = parts.groupBy("corpus", "rec_no").agg(F.sum(((F.col("parts") > 1) & (F.col("size") <= F.col("max_chars"))).cast("int")).alias("cut_rows"))
    whole = p.groupBy("corpus", "rec_no").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own_text"))), lambda x: x["own_text"]), "")).alias("text_md5"),
        F.sum((F.col("n_chars") > F.col("max_chars")).cast("int")).alias("over_limit"),
        F.sum((~(same | (F.col("overlap_rows") == 0))).cast("int")).alias("wrong_overlap"),
        F.sum(short.cast("int")).alias("short"),
    )
    return whole.join(cut, ["corpus", "rec_no"], "left").fillna(0, ["cut_rows"])
