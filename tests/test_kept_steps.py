from conftest import frames

from panelspark import Warehouse


def test_reports_over_many_tables_read_lines_and_facts_from_files(spark):
    w = Warehouse(spark, frames(spark))
    kept = w.stored()
    assert kept is w.stored() and kept is kept.stored()
    assert kept["lines"].inputFiles() and kept["fct_basket"].inputFiles() and not w["lines"].inputFiles()
    assert kept.written["fct_basket"] == w["fct_basket"].count()
    w.replace("fct_basket", w["fct_basket"].limit(1))
    assert w.stored()["fct_basket"].count() == 1
