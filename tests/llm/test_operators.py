"""Each operator against a plain version on small tables, with the cases that must not break it."""


import random


import pytest

from gridloom.functions.tables import TABLE
from gridloom.llm import bpe, leaks, lookalikes, mixing, near_duplicates, queries, sentences, split_overlap, splitting
from gridloom.llm.plainform import CELL_SEP, plain_cells, plain_units, plain_words
from gridloom.llm.sets import components

TOKENIZER = queries.TOKENIZER


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def cells(table):
    return plain_cells(CELL_SEP.join(c for r in (table[1] if table else []) or [] for c in r or [] if c)) if table else set()


# 1


def wtq_rows(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the", "of", "what"]
    tables = [(["h", "h"], [[f"c{t}{i}{j}" for j in range(3)] for i in range(r.randint(1, 4))]) for t in range(8)]
    rows = []
    for i in range(n):
        header, body = r.choice(tables)
        body = [[c if r.random() > 0.1 else c + "x" for c in row] for row in body]
        q = " ".join(r.choice(words) for _ in range(r.randint(1, 8))) if r.random() > 0.3 else "What of the W1?"
        rows.append((i, r.choice(["train", "validation", "test"]), r.choice(["a", None]), r.choice(["n1", "n2", None]), q, (header, body)))
    odd = [("train", None, None), ("test", "", ([], [])), ("test", "what of", (None, None)), (None, "what of", (["h"], [["c000"]])), ("train", " ", (["h"], [[None], None, []]))]
    return rows + [(n + i, s, "a", "n1", q, t) for i, (s, q, t) in enumerate(odd)]


SCHEMA1 = f"rec_no bigint, split string, source string, id string, question string, table {TABLE}, side int, t_terms string"


@pytest.mark.parametrize("hot", [False, True])
def test_overlaps_equal_brute_force(spark, hot):
    rows = wtq_rows(150, 1)
    if hot:  # a third of the rows is one text
        rows += [(1000 + i, ["train", "test"][i % 2], "a", "n1", rows[0][4], rows[0][5]) for i in range(60)]
    want = set()
    sets = [(x[0], x[1], set(plain_words(x[4])), cells(x[5])) for x in rows]
    for a in sets:
        for b in sets:
            if a[1] == "train" and b[1] in ("validation", "test") and likeness(a[2], b[2]) >= 0.6 and likeness(a[3], b[3]) >= 0.6:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA1)
    found = split_overlap.overlaps(df)
    got = [(r.rec_a, r.rec_b) for r in split_overlap.overlap_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    report = split_overlap.overlap_report(df, found).collect()
    held = {b for b in (x[0] for x in rows if x[1] in ("validation", "test")) if any(b in p for p in want)}
    assert sum(r.n_overlapping for r in report) == len(held)
    assert sum(r.n_records for r in report) == sum(x[1] in ("validation", "test") for x in rows)


def test_like_vectors_share_a_listed_term():
    """Whatever the statistics are, the dot product of like sets reaches 1 and the rarest term they share is indexed by both."""
    np = pytest.importorskip("numpy")
    r = random.Random(21)
    for _ in range(2000):
        total = r.choice([2, 50, 10**6])
        count = {t: r.choice([1, 2, total // 2, total]) or 1 for t in range(60)}
        a = set(r.sample(range(60), r.randint(1, 20)))
        b = {x for x in a if r.random() > 0.2} | set(r.sample(range(60), r.randint(0, 3)))
        if not b or likeness(a, b) < 0.6:
            continue
        parts, dot = [], 1.0
        squares = lambda s: split_overlap.squared_weights(np.array([count[t] for t in sorted(s)]), total)
        for one, two in ((a, b), (b, a)):
            terms = np.array(sorted(one), np.int64)
            other = np.array([r.randint(1, len(two)) if t in two else r.choice([0, 1, 5]) for t in sorted(one)])
            keep = split_overlap.indexed(terms, squares(one), np.array([count[t] for t in sorted(one)]), other, 0.6)
            parts.append(set(terms[keep].tolist()))
            dot *= split_overlap.scaling(squares(one), 0.6)
        assert dot * squares(a & b).sum() >= 1 - 1e-9
        assert min(a & b, key=lambda t: (count[t], t)) in parts[0] & parts[1]


def test_overlaps_of_nothing(spark):
    assert split_overlap.overlaps(spark.createDataFrame([], SCHEMA1)).count() == 0


# 2

SCHEMA2 = f"rec_no bigint, context string, question string, table {TABLE}, copies int"
TARGETS = "mix_id int, corpus string, weight double, max_repeats int, size_unit string"


def corpus(spark, n, seed, question=False):
    r = random.Random(seed)
    rows = [(i, f"c{i}", f"q{i}" if question else None, (["h"], [["x" * r.randint(1, 60)] for _ in range(r.randint(1, 5))]), 0) for i in range(n)]
    rows += [(n + 1, "c0", rows[0][2], rows[0][3], 0), (n + 2, None, "q", None, 0), (n + 3, None, "q", (["h"], []), 0), (n + 4, None, "q", (["h"], [[" "], [None]]), 0), (None, "c", "q", (["h"], [["x"]]), 0)]
    if question:
        rows += [(n + 5, "c", " ", (["h"], [["x"]]), 0), (n + 6, "c", None, (["h"], [["x"]]), 0)]
    return spark.createDataFrame(rows, SCHEMA2).repartition(3)


def test_mix_reaches_its_shares(spark):
    corpora = {"natural": (corpus(spark, 300, 1), None), "synthetic": (corpus(spark, 500, 2, True), "question"), "sql": (corpus(spark, 700, 3), None)}
    targets = spark.createDataFrame([(1, "natural", 2.0, 2, "records"), (1, "synthetic", 1.0, 1, "records"), (1, "sql", 1.0, 3, "records"), (2, "natural", 0.3, 4, "chars"), (2, "synthetic", 0.3, 2, "chars"), (2, "sql", 0.4, 1, "chars"), (3, "natural", 1.0, 1, "records"), (3, "sql", 0.0, 1, "records"), (4, "natural", 1.0, None, "chars"), (4, "sql", 1.0, 1, "chars")], TARGETS)
    mix = mixing.mixed(corpora, targets)
    rows = mix.collect()
    assert len({(r.mix_id, r.corpus, r.rec_no) for r in rows}) == len(rows)
    limits = {(t.mix_id, t.corpus): t.max_repeats for t in targets.collect()}
    assert all(1 <= r.copies <= limits[r.mix_id, r.corpus] for r in rows)
    for s in mixing.shares(mix, targets).collect():
        if s.mix_id == 4:
            assert s.actual_share is None and s.n_used == 0
        else:
            assert s.actual_share == pytest.approx(s.target_share, abs=0.004)
    assert {r.rec_no for r in rows if r.mix_id == 3} == set(range(300))  # unusable and repeated records are left out
    again = mixing.mixed(corpora, targets).select("mix_id", "corpus", "rec_no", "copies").collect()
    assert {(r.mix_id, r.corpus, r.rec_no, r.copies) for r in rows} == {tuple(r) for r in again}


def test_mix_is_the_same_on_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLOCK", 64)
    targets = spark.createDataFrame([(1, "natural", 2.0, 2, "records"), (1, "sql", 1.0, 1, "records"), (2, "natural", 0.5, 2, "chars"), (2, "sql", 0.5, 1, "chars")], TARGETS)
    found = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            corpora = {"natural": (corpus(spark, 900, 1).repartition(n), None), "sql": (corpus(spark, 1500, 3).repartition(n), None)}
            mix = mixing.mixed(corpora, targets)
            found.add(frozenset((r.mix_id, r.corpus, r.rec_no, r.copies) for r in mix.collect()))
            assert all(s.actual_share == pytest.approx(s.target_share, abs=0.002) for s in mixing.shares(mix, targets).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


def test_records_that_differ_anywhere_are_kept(spark):
    t = (["h"], [["x", None]])
    rows = [(1, "c", t, [[0, 1]], ["a"], 5), (2, "c", t, [[0, 2]], ["a"], 6), (3, "c", t, [[0, 1]], ["b"], 7), (4, "c", t, [[0, 1]], ["a"], 8), (5, "c", t, None, ["a"], 9), (6, "c", (["h"], [["x"]]), [[0, 1]], ["a"], 9)]
    df = spark.createDataFrame(rows, f"rec_no bigint, context string, table {TABLE}, mentions array<array<int>>, answers array<string>, loaded_at int")
    assert {r.rec_no for r in mixing.units({"n": (df, None)}).collect()} == {1, 2, 3, 5, 6}


def test_flight_balances():
    r = random.Random(4)
    sizes = [r.lognormvariate(3, 1) for _ in range(4000)]
    f = mixing.Flight("s")
    done = [x for i, s in enumerate(sizes) for x in f.add(i, s, 0.3)] + f.land()
    assert sorted(x[0] for x in done) == list(range(4000)) and {x[2] for x in done} == {0.0, 1.0}
    assert abs(sum(x[2] for x in done) - 1200) <= 1
    assert abs(sum(x[1] * x[2] for x in done) - 0.3 * sum(sizes)) <= 2 * max(sizes)
    equal = mixing.Flight("e")
    assert sum(x[2] for x in [y for i in range(10) for y in equal.add(i, 1, 0.5)] + equal.land()) == 5
    with pytest.raises(ValueError):
        mixing.plan([dict(mix_id=1, corpus="a", weight=1, max_repeats=1, size_unit="records")] * 2, {"a": {"records": 1}})


# 3


def joined_back(pieces):
    header, rows = [], []
    for p in pieces:
        own = [list(r) for r in p["rows"][p["overlap_rows"] :]]
        if not p["header_repeated"]:
            part = list(p["header"])
            if part and p["start_row"] == -1 and p["start_char"]:
                header[-1] += part.pop(0)
            header += part
        if own and p["piece"] and p["start_row"] >= 0 and (p["start_cell"] or p["start_char"]):
            first = own.pop(0)
            if p["start_char"]:
                rows[-1][-1] += first.pop(0)
            rows[-1] += first
        rows += own
    return header, rows


def test_pieces_round_trip():
    r = random.Random(3)
    chars = lambda row: sum(len(x or "") for x in row)
    word = lambda m: r.choice([None, "", "a b c", " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, m))), "字" * r.randint(0, m), "é😀" * r.randint(0, m)])
    for _ in range(1500):
        n = r.randint(0, 5)
        header, rows = [word(3) for _ in range(n)], [[word(r.choice([2, 2, 30])) for _ in range(r.randint(max(0, n - 1), n + 1))] for _ in range(r.randint(0, 12))]
        limit, overlap = r.choice([1, 5, 20, 60, 200]), r.randint(0, 2)
        out = splitting.pieces(header, rows, limit, overlap)
        size = lambda h, b: sum(len(x or "") for x in h) + sum(len(x or "") for row in b for x in row)
        assert all(size(p["header"], p["rows"]) == p["n_chars"] <= limit for p in out)
        assert all(p["overlap_rows"] <= overlap for p in out)
        assert (len(out) > 1) == (size(header, rows) > limit)
        assert joined_back(out) == (header, rows)
        if all(chars(x) <= limit for x in [header, *rows]):
            assert all(p["cut"] == "row" for p in out[1:])
        for a, b in zip(out, out[1:]):
            k = b["overlap_rows"]
            wanted = min(overlap, len(a["rows"]))
            assert k <= wanted and b["overlap_short"] == wanted - k and (not k or b["rows"][:k] == a["rows"][-k:])
            if k < wanted:  # one more row of the piece before wouldn't fit beside the first own row
                first = b["rows"][k] if len(b["rows"]) > k else []
                assert sum(map(chars, a["rows"][len(a["rows"]) - k - 1 :])) + (chars(first) if b["start_row"] >= 0 else chars(b["header"])) > limit


def test_pieces_are_cut_between_rows_and_overlap():
    rows = [[f"{i:04d}", "x" * 6] for i in range(20)]
    out = splitting.pieces(["ab", "cd"], rows, 64, 2)
    assert all(p["header"] == ["ab", "cd"] for p in out) and {p["cut"] for p in out[1:]} == {"row"}
    for a, b in zip(out, out[1:]):
        assert b["overlap_rows"] == 2 and b["rows"][:2] == a["rows"][-2:]
    # Rows that leave no room for two in a piece make a piece each, however many they are.
    out = splitting.pieces(["h"], [["x" * 60]] * 200, 100, 2)
    assert len(out) == 200 and {p["cut"] for p in out[1:]} == {"row"} and {p["overlap_rows"] for p in out} == {0}


def test_pieces_are_balanced_and_few():
    r = random.Random(13)
    for _ in range(50):
        rows = [["x" * r.randint(1, 9), "y"] for _ in range(r.randint(50, 400))]
        out = splitting.pieces(["h"], rows, 100, 1)
        total = sum(len(c) for row in rows for c in row)
        assert len(out) <= 1.1 * total / (100 - 1 - 10 - 9) + 2
        own = [sum(len(c) for row in p["rows"][p["overlap_rows"] :] for c in row) for p in out]
        assert min(own) >= 0.5 * max(own)


def test_split_tables(spark):
    rows = [(1, (["h"], [["x" * 50]] * 4)), (2, (["h"], [["x"]])), (3, None), (4, (None, None)), (5, ([], [[], None, [None]])), (1, (["h"], [["x" * 50]] * 4)), (6, (["h"], [["y" * 100_000]]))]
    df = spark.createDataFrame([(*x, "piece", 7) for x in rows], f"rec_no bigint, table {TABLE}, piece string, n_chars int")
    got = splitting.split_tables(df, 100, 1)
    assert {r.rec_no for r in got.collect()} == {1, 6} and got.where("rec_no = 6").count() >= 1000
    assert got.where("rec_no = 1 and piece = 0").count() == 2
    assert splitting.split_tables(df.where("false"), 100, 1).count() == 0
    with pytest.raises(ValueError):
        splitting.split_tables(df, 0, 1)


# 4


def test_groups_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "or"] * 3
    base = [[r.choice(words) for _ in range(r.randint(1, 14))] for _ in range(60)]
    texts = []
    for i in range(300):
        w = [x for x in r.choice(base) if r.random() > 0.08]
        r.shuffle(w)
        texts.append(" ".join(w).upper() if i % 2 else "  ".join(w))
    texts += [None, "", " . ", "the", "THE"] + [texts[0]] * 150
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "rec_no bigint, question string, id string, class int").repartition(5)
    tables = spark.createDataFrame([(1, (["h"], [["a", "b"], ["c"]])), (2, (["z"], [["B!"], ["c", "a", None]])), (3, (["h"], [["d"]])), (4, None), (5, ([], [None, []]))], f"rec_no bigint, table {TABLE}")
    got = near_duplicates.groups({"q": (df, "question", "words"), "t": (tables, "table", "cells")})
    sets = {i: frozenset(plain_words(t)) for i, t in enumerate(texts) if plain_words(t)}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and likeness(sets[i], sets[j]) >= 0.6:
                group[max(root(i), root(j))] = min(root(i), root(j))
    rows = got.where("corpus = 'q'").collect()
    assert {x.rec_no: x.group_id for x in rows} == {i: root(i) for i in sets} and len(rows) == len(sets)
    classes = set(sets.values())
    assert all(x.n_links == sum(s != sets[x.rec_no] and likeness(s, sets[x.rec_no]) >= 0.6 for s in classes) for x in rows)
    assert {x.rec_no: x.group_id for x in got.where("corpus = 't'").collect()} == {1: 1, 2: 1, 3: 3}
    pairs = {(x.rec_a, x.rec_b) for x in near_duplicates.group_pairs(got).where("corpus = 'q'").collect()}
    assert pairs == {(i, j) for i in sets for j in sets if i < j and root(i) == root(j)}
    assert near_duplicates.groups({"q": (df.where("false"), "question", "words")}).count() == 0


def test_balls_of_like_sets_meet():
    """At frequencies that make short chains stop at all depths, like sets share a variant."""
    np = pytest.importorskip("numpy")
    r = random.Random(6)
    counts = np.array([r.choice([1, 5, 40, 400, 900]) for _ in range(1 << 20)], np.int64)
    for _ in range(3000):
        a = set(r.sample(range(200), r.randint(1, 16)))
        b = {x for x in a if r.random() > 0.2} | set(r.sample(range(200), r.randint(0, 3)))
        if b and likeness(a, b) >= 0.6:
            one, two = (set(near_duplicates.ball(np.array(sorted(s), np.int64), counts, 1000, 0.6)[0]) for s in (a, b))
            assert one & two


def test_balls_have_a_bound():
    """Sets of frequent terms only, the worst case."""
    np = pytest.importorskip("numpy")
    counts = np.full(1 << 20, 10**5, np.int64)
    for n in (1, 2, 5, 20, 21, 60, 120, 200, 1000):
        got, _ = near_duplicates.ball(np.arange(n, dtype=np.int64), counts, 10**8, 0.6)
        assert len(got) <= 9 * near_duplicates.MAX_BALL + near_duplicates.half_radius(n, 0.6) + 1


@pytest.mark.parametrize("most", [5, 1000])
def test_balls_of_like_sets_meet_at_any_depth(monkeypatch, most):
    np = pytest.importorskip("numpy")
    monkeypatch.setattr(near_duplicates, "MAX_BALL", most)
    near_duplicates.depth.cache_clear(), near_duplicates.stops.cache_clear()
    r = random.Random(16)
    counts = np.full(1 << 20, 900, np.int64)
    for _ in range(300):
        a = set(r.sample(range(200), r.randint(1, 24)))
        b = {x for x in a if r.random() > 0.2} | set(r.sample(range(200), r.randint(0, 4)))
        if b and likeness(a, b) >= 0.6:
            one, two = (set(near_duplicates.ball(np.array(sorted(s), np.int64), counts, 1000, 0.6)[0]) for s in (a, b))
            assert one & two
    monkeypatch.undo()
    near_duplicates.depth.cache_clear(), near_duplicates.stops.cache_clear()


@pytest.mark.parametrize("least", [0, 30])
def test_hot_variants_are_split(spark, monkeypatch, least):
    """Half of the records share a long boilerplate without being alike; some are alike beyond it."""
    monkeypatch.setattr(near_duplicates, "HOT", least)
    monkeypatch.setattr(near_duplicates, "BALL_SIZE", 0)
    r = random.Random(11)
    boiler = [f"b{i}" for i in range(12)]
    texts = [boiler[: r.randint(9, 12)] + [f"u{i}-{j}" for j in range(r.randint(0, 9))] for i in range(150)]
    texts += [t[:-1] + ["z"] for t in texts[:40]] + [[r.choice("abcdefghij") for _ in range(r.randint(1, 9))] for _ in range(100)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rec_no bigint, question string").repartition(3)
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(plain_words(" ".join(t))), i)
    want = {i: sum(s != t and likeness(s, t) >= 0.6 for t in sets) for s, i in sets.items()}
    got = near_duplicates.groups({"q": (df, "question", "words")})
    assert {x.class_id: x.n_links for x in got.collect()} == want


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    group = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(group[a], group[b])
            changed |= (group[a], group[b]) != (m, m)
            group[a] = group[b] = m
    alone = {n for n in group if all(n not in e or e == (n, n) for e in edges)}
    assert got == {n: c for n, c in group.items() if n not in alone}


# 5


def test_lookalikes(spark):
    rows = [
        (1, ["Ａb", "a b", "x", None, ""], (["h"], [["Ab"], ["a b", None], ["X"]])),
        (2, ["wоn"], (["h"], [["won"]])),
        (3, ["wоn"], (["h"], [["wоn"], ["won"]])),
        (4, ["Café", "é"], (["h"], [["Cafe"], ["é"], None])),
        (5, ["q​"], None), (6, None, (["h"], [["a"]])), (7, [], ([], [])), (8, ["​"], (["home"], [["‌"]])), (11, ["РОР"], (["h"], [["POP"]])),
        (9, ["Sаmb", "Рижин"], (["h"], [["Samь"], ["Рижин"]])),
        (10, ["Zеtо"], (["hоme"], [["Zetо"]])),  # the clean spelling occurs nowhere, but two spellings of it do
        (None, ["Ａ"], (["h"], [["A"]])),
    ]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], f"rec_no bigint, answers array<string>, table {TABLE}, id int, x string")
    got = {(r.rec_no, r.ans_pos, r.kind) for r in lookalikes.lookalike_answers(df).collect()}
    assert got == {(1, 0, "form"), (1, 1, "form"), (2, 0, "mixed"), (4, 1, "form"), (10, 0, "agreed"), (11, 0, "twins")}
    forms = {r.rec_no: r for r in lookalikes.consistent_forms(df).collect()}
    assert forms[1].answers == ["Ab", "a b", "x", None, ""] and forms[1].rows == [["Ab"], ["a b", None], ["X"]]
    assert forms[2].answers == ["won"] and forms[3].rows == [["won"], ["won"]] and forms[5].rows is None and forms[6].answers is None
    assert forms[10].header == ["home"] and (forms[10].n_mixed, forms[10].n_twins, forms[10].n_agreed) == (1, 0, 2) and (forms[2].n_mixed, forms[11].n_twins) == (1, 1)
    assert forms[9].answers == ["Sаmb", "Рижин"]  # mixed, but unknown to the corpus
    assert lookalikes.lookalike_answers(df.where("false")).count() == 0


# 6


def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(TOKENIZER)
    reference.encode_special_tokens = True
    r = random.Random(8)
    bits = ["a", "b", "the", " ", "  ", "\n", "é", "中", "😀", "1", "²", "Ⅷ", "\x1c", "\x85", "ing", "'s", "<|endoftext|>", "​", "ต", "zz", "==", "́", "_", "क्"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["a" * 3000, "ab" * 2000, " " * 2000, "😀" * 300, "中" * 5000, "aa" * 7 + "a"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0), (-2, "", 0), (None, "a", 0)], "doc_id bigint, text string, ids int").repartition(3)
    rows = bpe.token_ids(df, "doc_id", "text", TOKENIZER).collect()
    got = {x.doc_id: x.ids for x in rows}
    assert len(rows) == len(texts) + 3 and got[-1] == got[-2] == []
    for i, e in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids
    assert bpe.token_ids(df.where("false"), "doc_id", "text", TOKENIZER).count() == 0


# 7


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(25)] + ["a", "the"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(6, 18)))) for i in range(20)] + [(50, None), (51, ""), (52, "第一二三四五六七八九十行"), (52, "第一二三四五六七八九十行")]
    docs = []
    for i in range(200):
        text = [r.choice(words) for _ in range(r.randint(0, 30))]
        if r.random() < 0.6:
            item = r.choice(items[:20])[1].split()
            k = r.randint(0, 4)
            text[5:5] = item[k : k + r.randint(7, 18)]
        docs.append((i, ", ".join(text).upper() if i % 3 else " ".join(text)))
    docs += [(900, None), (901, ""), (902, "x 一二三四五六七八九十 y"), (903, "一二三四五六七八九"), (904, "the " * 30_000), (0, docs[0][1])]

    def found(d, t):
        a, b = plain_units(d), plain_units(t)
        grams = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
        return any(tuple(a[i : i + 10]) in grams for i in range(len(a) - 9))

    want = {(d, i) for d, x in docs if x for i, t in items if t and found(x, t)}
    d = spark.createDataFrame([(*x, 1, "p") for x in docs], "doc_id bigint, text string, place int, term string").repartition(3)
    e = spark.createDataFrame([(*x, "test", 2) for x in items], "item_id bigint, text string, split string, at int")
    got = leaks.leaks(d, e)
    phrases = got.where("kind = 'phrase'")
    assert {(x.doc_id, x.item_id) for x in phrases.collect()} == want and want and phrases.count() == len(want)
    assert got.select("doc_id", "item_id").distinct().count() == got.count()
    assert leaks.leaks(d.where("false"), e).count() == leaks.leaks(d, e.where("false")).count() == 0
    report = {x.item_id: x.n_docs for x in leaks.leaked_items(got, e).collect()}
    assert all(report[i] == sum(j == i for _, j in want) for i in range(20))


def test_proximity_matches_come_out(spark):
    words = [f"w{i}" for i in range(40)]
    spaced = [x for i, w in enumerate(words) for x in ([w, "foreign"] if i % 9 == 8 else [w])]
    d = spark.createDataFrame([(1, "x " + " ".join(spaced)), (2, " ".join(words[5:16])), (3, " ".join(words[::4])), (4, " ".join(words[::-1]))], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: r for r in leaks.leaks(d, e).collect()}
    assert set(got) == {1, 2} and (got[1].kind, got[1].run, got[2].kind, got[2].run) == ("proximity", 9, "phrase", 11) and got[1].words_near >= 35


def test_intersection_equals_search():
    np = pytest.importorskip("numpy")
    r = random.Random(14)
    for _ in range(500):
        doc, item = [r.randint(0, 3) for _ in range(r.randint(1, 40))], [r.randint(0, 3) for _ in range(r.randint(1, 20))]
        shift = r.randint(-15, 30)
        at = lambda k: doc[k] if 0 <= k < len(doc) else None
        exact = [at(shift + k) == w for k, w in enumerate(item)]
        near = [any(at(shift + k + j) == w for j in range(-3, 4)) for k, w in enumerate(item)]
        run = max(len(x) for x in "".join("x" if e else " " for e in exact).split(" "))
        span = min(leaks.STRETCH, len(item))
        want = run, sum(near), max(sum(near[k : k + span]) for k in range(len(item) - span + 1))
        assert leaks.intersected(np.array(doc), np.array(item), shift) == want


# 8

PARTS = [
    ["Mr. Bell counted 3.5 boats.", "Rows 1–2 vs. rows 3 differ."],
    ["The shop is in the U.S.", "The U.S. Bell Museum lent 4 boats.", "It closed at 3.20 p.m.", "See table_1.csv, please."],
    ["The list names towns, etc.", "444 rows were dropped."],
    ['"Was it 7?" asked Ann, still reading.', "“Check it. It moved.” was the note.", "(See the note on score.)", "Nobody knew why... but he stayed."],
    ["Am 27. Mai 1966 hat Dr. Bell geprüft.", "Siehe Nr. 5 ff. der Akte, z. B. den Eintrag."],
    ["El Sr. Bell ganó en EE. UU. aquel año.", "¡Qué columna tan rara!", "¿Cuántos barcos faltan?"],
    ["Проф. Г. Белл нашёл ещё 5 записей.", "«Строка пуста», — сказал Белов.", "См. рис. 2 на стр. 3."],
    ["Ann wrote: “It is empty.”", "Row 5 ends the table."],
]
TIGHT = [["真是奇怪的一列！", "记录员写道：「这一列是空的。」", "平均值是2.5分，比去年略低。"], ["「列は空です。」と記録係が言った。", "不思議ですね！", "ア……いや、イが正しい。"], ["boats lent 5 more.", "Mrs. Bell agreed."]]


def docs_for(parts, gap):
    return "\n\n".join(gap.join(p) for p in parts), [s for p in parts for s in p]


@pytest.fixture(scope="module")
def model():
    import pyarrow.parquet as pq

    return sentences.train([t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).slice(0, 2000).column("text").to_pylist() if t])


def cut(text, model):
    ends = sentences.sentence_ends([text], model)[0]
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize(("parts", "gap"), [(PARTS, " "), (PARTS, "\n"), (TIGHT, "")])
def test_sentences(parts, gap, model):
    text, want = docs_for(parts, gap)
    assert [s.replace("\n", " ") for s in cut(text, model)] == [s.replace("\n", " ") for s in want]


def test_sentence_blocks(model):
    assert cut("A heading\n\nselect x from w where a = 'B. C'\n\ncol : A. B | C row 1 : d. E | f \n", model) == ["A heading", "select x from w where a = 'B. C'", "col : A. B | C row 1 : d. E | f"]
    assert cut("1. One is here.\n2. Two is here.", model) == ["1. One is here.", "2. Two is here."]
    assert cut("ไม่มีใครรู้ ค่าคือ 86.0 คะแนน ใช่", model) == ["ไม่มีใครรู้", "ค่าคือ 86.0 คะแนน", "ใช่"]
    assert sentences.sentence_ends([None, "", " \n\n "], model) == [[], [], []] and sentences.sentence_ends([], model) == []


@pytest.mark.parametrize("gap", [1, 5, 80, 100, 5000])
def test_gaps_of_any_width(model, gap):
    text = "The first sentence ends here." + " " * gap + "The second one starts here. Third."
    assert sentences.sentence_ends([text], model)[0] == [29, 56 + gap, 63 + gap]
    assert cut("See " + "a" * gap + ".csv and www." + "b.c" * gap + ".org now. The end.", model)[1] == "The end."


def test_invisible_characters_keep_places(model):
    plain, hidden = "The cat sat. The dog ran.", "The c​at sat.​ The dog ran.​"
    assert sentences.sentence_ends([plain, hidden, None], model) == [[12, 25], [14, 28], []]


def test_held_out_seams_are_found(model):
    """Boundaries that are known without any rule, of documents not learned from, in every language."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["lang", "text"]).slice(2000, 3000).to_pylist()
    for lang in ("en", "de", "es", "fr", "ru", "zh", "ja", "ar", "hi", "th"):
        found, all_ = sentences.seam_recall([d["text"] for d in docs if d["lang"] == lang and d["text"]], model)
        assert all_ > 40 and found >= 0.99 * all_


def test_viterbi_equals_search():
    from itertools import product

    r = random.Random(12)
    for _ in range(200):
        places = sorted(r.sample(range(12), r.randint(1, 6)))
        scores = [r.gauss(0, 2) for _ in places]
        step = [[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        step[0][0] = 0.0

        def value(tags):
            full = [0] * (places[-1] + 1)
            for p, t in zip(places, tags):
                full[p] = t
            return sum(s for s, t in zip(scores, tags) if t) + sum(step[a][b] for a, b in zip(full[places[0] :], full[places[0] + 1 :]))

        best = max(product((0, 1), repeat=len(places)), key=value)
        assert value(sentences.viterbi(places, scores, step)) == pytest.approx(value(best))


def test_sentence_table(spark, model):
    text = docs_for(PARTS, " ")[0]
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, " ", 0), (4, "no end", 0), (5, "The cat sat. " * 20_000, 0), (1, text, 0)], "doc_id bigint, text string, end_pos int")
    rows = sentences.sentences(df, model).collect()
    by = {i: sorted(r.end_pos for r in rows if r.doc_id == i) for i in (1, 2, 3, 4, 5)}
    assert by[2] == by[3] == [] and by[4] == [6] and len(by[5]) == 20_000 and max(by[1]) == len(text)
    assert sentences.sentences(df.where("false")).count() == 0 and sentences.sentences(df).count() > 0


def test_registered_queries_with_sql(spark):
    from compare import FOLDER, assert_same

    for name, sql in queries.oracle_sql().items():
        assert_same(queries.queries()[name](spark, FOLDER), sql)
