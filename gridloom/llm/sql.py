"""SQL (DuckDB dialect) that says in a plain way what the operators of problems 1, 4, 5 and 7 find, by brute force over all pairs that share anything.

Plain forms are built in another way than by the operators: look-alike letters are all moved to Latin, whatever the script of their token is.
"""

from __future__ import annotations

from gridloom.llm.plainform import CYRILLIC_LOWER, CYRILLIC_LOWER_LATIN, CYRILLIC_UPPER, CYRILLIC_UPPER_LATIN, GREEK_LOWER, GREEK_LOWER_LATIN, GREEK_UPPER, GREEK_UPPER_LATIN, LOWERED, LOWERED_LATIN
from gridloom.plans.sql import compatible, quoted

_INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"
_WORD = r"[\p{L}\p{N}\p{M}]+"
_CJK = r"([\p{Han}\p{Hiragana}\p{Katakana}ー]\p{M}*)"


def _seen(s: str) -> str:
    return f"regexp_replace({s}, '{_INVISIBLE}', '', 'g')"


def _latin(s: str) -> str:
    twins = CYRILLIC_UPPER + CYRILLIC_LOWER + GREEK_UPPER + GREEK_LOWER
    return f"translate({s}, {quoted(twins)}, {quoted(CYRILLIC_UPPER_LATIN + CYRILLIC_LOWER_LATIN + GREEK_UPPER_LATIN + GREEK_LOWER_LATIN)})"


def plain(s: str) -> str:
    """Without invisible characters, in compatibility form, Latin twins, lower case."""
    one, forms, several = compatible()
    x = _seen(s)
    for c, form in several.items():
        x = f"replace({x}, '{c}', {quoted(form)})"
    x = f"nfc_normalize({_latin(f'nfc_normalize(translate({x}, {quoted(one)}, {quoted(forms)}))')})"
    return f"translate(replace(lower({x}), 'ß', 'ss'), {quoted('ς' + LOWERED)}, {quoted('σ' + LOWERED_LATIN)})"


def words(s: str) -> str:
    return f"list_distinct(regexp_extract_all({plain(s)}, '{_WORD}'))"


def units(s: str) -> str:
    """Words in order; each Han or kana character is one."""
    return f"regexp_extract_all(regexp_replace({plain(s)}, '{_CJK}', ' \\1 ', 'g'), '{_WORD}')"


def cells(table: str) -> str:
    """Body cells without what isn't a letter or digit, as a set."""
    body = f"list_filter(flatten({table}.rows), lambda c_: c_ IS NOT NULL)"
    # One string for all cells, so that the form is written once.
    joined = f"array_to_string(list_transform({body}, lambda c_: replace(c_, chr(31), ' ')), chr(31))"
    return rf"list_filter(list_distinct(string_split(regexp_replace({plain(joined)}, '[^\p{{L}}\p{{N}}\p{{M}}\x1f]+', '', 'g'), chr(31))), lambda c_: c_ <> '')"


def _pairs(left: str, right: str, key: str) -> str:
    """(a, b, likeness) of two tables (rec, terms) whose sets share a term; ``key``: more conditions."""
    return f"""(SELECT x.rec AS a, y.rec AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS likeness
      FROM (SELECT rec, len(terms) AS n, unnest(terms) AS t FROM {left}) x JOIN (SELECT rec, len(terms) AS n, unnest(terms) AS t FROM {right}) y ON x.t = y.t {key} GROUP BY x.rec, y.rec)"""


_P1 = f"""r AS (SELECT rec_no AS rec, split, {words('question')} AS q, {cells('"table"')} AS t FROM wtq WHERE question IS NOT NULL AND "table" IS NOT NULL),
    qt AS (SELECT rec, q AS terms FROM r WHERE split = 'train'), qe AS (SELECT rec, q AS terms FROM r WHERE split IN ('validation', 'test')),
    tt AS (SELECT rec, t AS terms FROM r WHERE split = 'train'), te AS (SELECT rec, t AS terms FROM r WHERE split IN ('validation', 'test')),
    pairs AS (SELECT a, b, q.likeness AS ql, t.likeness AS tl FROM {_pairs('qt', 'qe', '')} q JOIN {_pairs('tt', 'te', '')} t USING (a, b) WHERE q.likeness >= 0.6 - 1e-12 AND t.likeness >= 0.6 - 1e-12)"""

P1_FOUND = f"WITH {_P1} SELECT least(a, b) AS rec_a, greatest(a, b) AS rec_b FROM pairs"

P1_REPORT = f"""
    WITH {_P1}, hit AS (SELECT b, max((ql = 1 AND tl = 1)::INT) AS exact, max(coalesce((x.id = y.id)::INT, 0)) AS same FROM pairs JOIN wtq x ON x.rec_no = a JOIN wtq y ON y.rec_no = b GROUP BY b)
    SELECT split, source, count(*) AS n_records, count(exact) AS n_overlapping, coalesce(sum(exact), 0)::BIGINT AS n_exact, coalesce(sum(same), 0)::BIGINT AS n_same_id
    FROM wtq LEFT JOIN hit ON b = rec_no WHERE split IN ('validation', 'test') GROUP BY split, source"""


def _groups(source: str, terms: str, result: str) -> str:
    """The closure of links: which records each reaches."""
    return f"""(WITH RECURSIVE r AS MATERIALIZED (SELECT rec, terms FROM (SELECT rec_no AS rec, {terms} AS terms FROM {source}) WHERE len(terms) > 0),
    e AS MATERIALIZED (SELECT a, b FROM {_pairs('r', 'r', 'AND x.rec <> y.rec')} WHERE likeness >= 0.6 - 1e-12),
    reach AS (SELECT a AS rec, a AS other FROM e UNION SELECT reach.rec, e.b FROM reach JOIN e ON reach.other = e.a) {result})"""


def _both(result: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {_groups(f'{c}_corpus', t, result.replace('CORPUS', quoted(c)))}" for c, t in (("synthetic", words("question")), ("sql", cells('"table"'))))


P4_FOUND = _both("SELECT CORPUS AS corpus, rec AS rec_a, other AS rec_b FROM reach WHERE rec < other")

P4_GROUPS = _both("""
    , cl AS (SELECT rec, min(rec) OVER (PARTITION BY list_sort(terms)) AS class_id FROM r),
    links AS (SELECT x.class_id, count(DISTINCT y.class_id) AS n FROM e JOIN cl x ON x.rec = e.a JOIN cl y ON y.rec = e.b WHERE x.class_id <> y.class_id GROUP BY x.class_id),
    least_of AS (SELECT rec, min(other) AS least FROM reach GROUP BY rec)
    SELECT CORPUS AS corpus, rec AS rec_no, class_id, coalesce(n, 0) AS n_links, coalesce(least, rec) AS group_id FROM cl LEFT JOIN links USING (class_id) LEFT JOIN least_of USING (rec)""")


def _looks(s: str) -> str:
    """Width forms, composition, invisible characters, kinds of space and twins unified."""
    one, forms, _ = compatible()
    wide = [(c, f) for c, f in zip(one, forms) if 0xFF01 <= ord(c) <= 0xFFEE]
    x = f"translate({_seen(s)}, {quoted(''.join(c for c, _ in wide))}, {quoted(''.join(f for _, f in wide))})"
    # A mark on a look-alike letter is composed once the letter is Latin.
    return f"nfc_normalize({_latin(f'nfc_normalize(regexp_replace({x}, {chr(39)}[{chr(92)}p{{Zs}}{chr(92)}t]{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}))')})"


P5_FOUND = f"""
    WITH a AS (SELECT rec_no, unnest(answers) AS s, unnest(range(0, len(answers)))::INT AS ans_pos FROM wtq), c AS (SELECT DISTINCT rec_no, unnest(flatten("table".rows)) AS s FROM wtq),
    fa AS (SELECT *, {_looks('s')} AS f FROM a WHERE s <> ''), fc AS (SELECT DISTINCT rec_no, {_looks('s')} AS f FROM c WHERE s IS NOT NULL)
    SELECT rec_no, ans_pos FROM fa WHERE trim(f) <> '' AND EXISTS (SELECT 1 FROM fc WHERE fc.rec_no = fa.rec_no AND fc.f = fa.f) AND NOT EXISTS (SELECT 1 FROM c WHERE c.rec_no = fa.rec_no AND c.s = fa.s)"""


def _grams(key: str, source: str) -> str:
    return f"""(SELECT DISTINCT k, array_to_string(u[i_:i_ + 9], ' ') AS g FROM (SELECT k, u, unnest(range(1, len(u) - 8)) AS i_ FROM (SELECT {key} AS k, {units('text')} AS u FROM {source} WHERE text IS NOT NULL)))"""


P7_FOUND = f"""SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM {_grams('doc_id', 'documents')} d JOIN {_grams('item_id', 'eval_items')} i USING (g)"""

P7_ITEMS = f"""
    WITH w AS (SELECT item_id, split, {units('text')} AS u FROM eval_items), d0 AS (SELECT doc_id, {units('text')} AS u FROM documents WHERE text IS NOT NULL),
    d AS (SELECT doc_id, i_ AS pos, array_to_string(u[i_:i_ + 9], ' ') AS g FROM (SELECT doc_id, u, unnest(range(1, len(u) - 8)) AS i_ FROM d0)),
    i AS (SELECT item_id, i_ AS k, array_to_string(u[i_:i_ + 9], ' ') AS g FROM (SELECT item_id, u, unnest(range(1, len(u) - 8)) AS i_ FROM w)),
    m AS (SELECT doc_id, item_id, pos - k AS shift, k, k - row_number() OVER (PARTITION BY doc_id, item_id, pos - k ORDER BY k) AS island FROM d JOIN i USING (g)),
    runs AS (SELECT doc_id, item_id, count(*) + 9 AS run FROM m GROUP BY doc_id, item_id, shift, island),
    hit AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(run)::INT AS longest_run FROM runs GROUP BY item_id)
    SELECT item_id, split, coalesce(n_docs, 0) AS n_docs, coalesce(longest_run, 0) AS longest_run, coalesce(longest_run = len(u), false) AS whole FROM w LEFT JOIN hit USING (item_id)"""
