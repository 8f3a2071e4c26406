import sys

import pytest
from compare import assert_same

from brimfold.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    # the zones of the feeds can't be told from the few values of the least tables
    assert_same(spark, "/root/testdata/sf0.01" if name == "p4_found" else FOLDER, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_every_row_of_arbeitnow_is_projected(spark):
    from brimfold.sources.tables import table

    rows = table(spark, FOLDER, "arbeitnow", "created_at").collect()
    got = [x.published_at for x in catalog.QUERIES["q49_arbeitnow_projection"](spark, FOLDER).select("published_at").collect()]
    blank = sum(not (x.created_at or "").strip() for x in rows)
    assert len(got) == len(rows) and got.count("") == blank
    number = lambda x: x.replace(".", "").replace("E", "").strip().isdecimal() and x.count(".") < 2 and x.strip()[:1] == "1" and len(x.strip()) > 10
    assert not [x for x in got if number(x)]


def test_entry_lists_every_query(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["snapshot_date", "id", "change"]


def test_the_core_needs_no_llm():
    import subprocess

    code = "import sys; sys.modules['brimfold.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('p1_')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True).returncode == 0
