from conftest import as_dicts, frames, line

from panelspark import Warehouse


def test_a_week_of_unknown_spend_counts_as_a_week_of_its_window(spark):
    """Weeks 1 to 39, of which 1 to 26 are kept: 10 in the early window, 12 over two weeks in the late one."""
    unknown = list(line(1, 12, 99, 1, 1, 0))
    unknown[5] = None  # SALES_VALUE
    sold = [line(1, 10, 1, 1, 1, 10), line(1, 11, 92, 1, 1, 12), tuple(unknown)]
    sold += [line(hh, hh * 100, 1, 1, 1, 1) for hh in (2, 3, 4, 5)] + [line(2, 201, 267, 1, 1, 1)]
    w = Warehouse(spark, frames(spark, transaction_data=sold))
    assert as_dicts(w["trimmed_segment"], "household_key")[1]["trimmed_segment"] == "High-Value Declining"


def test_discounts_of_a_week_of_unknown_spend_count_in_the_discount_share(spark):
    """Household 1: 220 of 1170, which would be 220 of 950 (0.23, promotion-responsive) without the unknown week."""
    unknown = list(line(1, 11, 15, 1, 1, 0, off=220))
    unknown[5] = None  # SALES_VALUE
    sold = [line(1, 10, 1, 4, 1, 950), tuple(unknown), line(2, 290, 267, 4, 1, 1)]
    sold += [line(hh, hh * 100 + i, 1, 4, 1, 2000) for hh in (2, 3, 4, 5) for i in range(3)]
    w = Warehouse(spark, frames(spark, transaction_data=sold))
    assert as_dicts(w["trimmed_segment"], "household_key")[1]["trimmed_segment"] == "Occasional"


def test_nothing_after_nothing_is_declining(spark):
    """Household 1 has the most spend, all of it between the windows: 0 in the early one, 0 in the late one."""
    sold = [line(1, 10, 1, 1, 1, 0), line(1, 11, 95, 1, 1, 900), line(1, 12, 200, 1, 1, 0)]
    sold += [line(hh, hh * 100, 1, 1, 1, 1) for hh in (2, 3, 4, 5)] + [line(2, 201, 365, 1, 1, 1)]
    w = Warehouse(spark, frames(spark, transaction_data=sold))
    assert as_dicts(w["trimmed_segment"], "household_key")[1]["trimmed_segment"] == "High-Value Declining"
