import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import FOLDER, assert_same
from gridloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(registry.queries()[name](spark, FOLDER), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


# Numbers beyond bigint and double, years beyond int, long zeros, separators as white space, null characters.
ODD_CELLS = ["126e65", "304e73", "-1e81", "1e19", "9223372036854775808", "1e308", "1e309", "9" * 308, "9" * 309, "-" + "1" * 400, "1" * 5000, "0" * 5000 + "7", "0" * 5000 + "7-1-1", "1" * 5000 + "-1-1",
    "2147483647-1-1", "2147483648-1-1", "99999999999-xx-xx", "2147483647-xx-xx", "99999999999", "xx-99999999999-1", "\x1c5\x1f", "\x1c1999-5-5", "5", "5\0", "", "2.9999999"]


def test_cell_values_odd_cells(spark, tmp_path):
    # Half of them as cells, half as answers.
    kind = pa.schema([("table", pa.struct([("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])), ("answers", pa.list_(pa.string()))])
    row = {"table": {"header": ["h"], "rows": [[x] for x in ODD_CELLS[::2]]}, "answers": ODD_CELLS[1::2]}
    pq.write_table(pa.Table.from_pylist([row], kind), tmp_path / "wtq.parquet")
    assert_same(registry.queries()["cell_values"](spark, str(tmp_path)), registry.oracle_sql()["cell_values"], str(tmp_path))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["l_orderkey", "flat"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
