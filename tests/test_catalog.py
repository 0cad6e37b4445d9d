"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.duck import SF, assert_same, connect
from weftline import catalog


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert_same(con, catalog.queries()[name](spark, SF), catalog.oracle_sql()[name])


def test_queries_have_rows(spark):
    empty = [name for name in ("lq2_workspace_symbols", "set3_difference", "lq3_definitions", "st3_fresh_or_waiting") if catalog.queries()[name](spark, SF).isEmpty()]
    assert not empty


def test_queries_without_sql_give_rows(spark):
    for name in sorted(catalog.queries().keys() - catalog.oracle_sql().keys()):
        assert catalog.queries()[name](spark, SF).count() > 0


def test_truth_symbols_follow_the_tree(spark):
    rows = catalog.queries()["src6_ground_truth"](spark, SF).collect()
    assert len(rows) == 30
    assert {r["path"] for r in rows if r["level"] == 0} == {r["name"] for r in rows if r["kind_category"] == "Namespace"}
    assert all("/" in r["path"] for r in rows if r["level"] == 1)


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert "change" in df.columns


#: Queries that once ran on what they made up.
READS = ("ent2_command_line", "flt3b_git_probe", "flt3c_gitignore_status", "flt3f_fail_open_warning", "flt6_valid_languages", "lq14_lifecycle", "lq15_client_capabilities", "lq16_default_servers", "src4_load_languages",)


@pytest.mark.parametrize("name", READS)
def test_query_reads_a_table(spark, name):
    assert catalog.queries()[name](spark, SF).inputFiles()


def test_packages_export_what_they_promise():
    from importlib import import_module

    assert "ent5_exports" not in catalog.queries()  # names of packages are in no table
    for module, names in (("weftline", ("WatchConfig", "Workspace", "watch")), ("weftline.sources", ("load_languages",)), ("weftline.streaming", ("wait_for",))):
        assert set(names) <= set(import_module(module).__all__) and all(getattr(import_module(module), n) for n in import_module(module).__all__)
