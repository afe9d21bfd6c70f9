"""Golden statement G1 (FIXTURES.md §3), expected values worked by hand."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlake.operators import accounts, balance, categorize, outliers, quality, stats, temporal

AS_OF = "2024-03-10 00:00:00"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_ingest_types_and_coercion(g1):
    rows = {r.row_id: r for r in g1.collect()}
    assert len(rows) == 8
    by_desc = [r for r in rows.values() if r.main_description is None]
    assert len(by_desc) == 1 and by_desc[0].amount == 0
    bad = [r for r in rows.values() if r.transaction_date is None]
    assert len(bad) == 1 and bad[0].amount == 5
    assert sum(1 for r in rows.values() if r.amount is None) == 1
    assert sum(1 for r in rows.values() if r.balance is None) == 1


def test_overview_and_amounts(g1):
    o = one(stats.basic_statistics(g1))
    assert o["total_transactions"] == 8
    assert o["unique_accounts"] == 2
    assert o["unique_merchants"] == 5
    assert o["currencies"] == "EUR,GBP"
    assert o["earliest_date"] == dt.datetime(2024, 1, 1)
    assert o["latest_date"] == dt.datetime(2024, 3, 1)
    assert o["date_span_days"] == 60
    assert o["unique_dates"] == 5
    assert o["total_value"] == Decimal("15.00")
    assert (o["positive_transactions"], o["negative_transactions"], o["zero_transactions"]) == (2, 4, 1)
    assert o["total_credits"] == Decimal("105.00") and o["total_debits"] == Decimal("-90.00")
    assert o["avg_transaction_size"] == pytest.approx(195 / 7)
    assert o["largest_credit"] == Decimal("100.00") and o["largest_debit"] == Decimal("-30.00")


def test_account_financials(g1):
    rows = {r.account_number: r.asDict() for r in accounts.account_financials(g1).collect()}
    a, b = rows["3995"], rows["5968"]
    assert (a["transaction_count"], a["total_credits"], a["total_debits"], a["net_position"]) == (4, 100, -60, 40)
    assert a["avg_transaction"] == Decimal("10.00") and a["current_balance"] == Decimal("141.00")
    assert (b["transaction_count"], b["total_credits"], b["total_debits"], b["net_position"]) == (4, 5, -30, -25)
    assert b["avg_transaction"] == Decimal("-8.33") and b["current_balance"] == Decimal("70.00")


def test_monthly_and_weekday(g1):
    m = {(r.year, r.month): r.asDict() for r in temporal.monthly_summary(g1).collect()}
    assert (m[(2024, 1)]["transaction_count"], m[(2024, 1)]["total_amount"], m[(2024, 1)]["avg_amount"]) == (3, 70, Decimal("23.33"))
    assert m[(2024, 1)]["active_days"] == 2
    assert (m[(2024, 2)]["transaction_count"], m[(2024, 2)]["total_amount"], m[(2024, 2)]["avg_amount"]) == (3, -60, Decimal("-20.00"))
    assert (m[(2024, 3)]["transaction_count"], m[(2024, 3)]["total_amount"], m[(2024, 3)]["avg_amount"]) == (0, 0, None)
    cf = {(r.year, r.month): (r.income, r.expenses, r.net_flow) for r in temporal.monthly_cash_flow(g1).collect()}
    assert cf[(2024, 1)] == (100, -30, 70) and cf[(2024, 2)] == (0, -60, -60) and cf[(2024, 3)] == (0, 0, 0)
    wd = {r.day_name: r.transaction_count for r in temporal.weekday_patterns(g1).collect()}
    assert wd == {"Monday": 3, "Friday": 1, "Saturday": 3}
    f = one(temporal.daily_frequency(g1))
    assert f["avg_transactions_per_day"] == pytest.approx(1.4)
    assert (f["max_transactions_per_day"], f["min_transactions_per_day"]) == (2, 1)
    assert f["busiest_day"] == dt.date(2024, 1, 1) and f["quietest_day"] == dt.date(2024, 1, 15)


def test_growth(g1):
    g = one(temporal.growth_mom(g1))
    assert g["latest_month_amount"] == 0 and g["previous_month_amount"] == -60
    assert g["month_over_month_change"] == pytest.approx(100.0)


def test_activity(g1):
    ctx = one(accounts.activity_context(g1, as_of=AS_OF))
    assert ctx["analysis_context"] == "Current" and ctx["period_days"] == 60
    assert ctx["threshold_days"] == pytest.approx(30.0) and ctx["is_adaptive"]
    rows = {r.account_number: r.asDict() for r in accounts.activity_accounts(g1, as_of=AS_OF).collect()}
    a, b = rows["3995"], rows["5968"]
    assert (a["days_since_last_transaction"], a["recent_transactions_90_days"], a["account_active_period_days"]) == (36, 0, 34)
    assert a["status"] == "Inactive" and a["criteria_score"] == "1/3" and a["confidence_score"] == pytest.approx(34.9)
    assert a["activity_intensity"] == pytest.approx(0.118)
    assert (b["days_since_last_transaction"], b["recent_transactions_90_days"], b["account_active_period_days"]) == (9, 2, 28)
    assert b["status"] == "Active" and b["criteria_score"] == "2/3" and b["confidence_score"] == pytest.approx(68.3)
    assert b["activity_intensity"] == pytest.approx(0.143)
    s = one(accounts.activity_summary(g1, as_of=AS_OF))
    assert (s["active_accounts"], s["inactive_accounts"], s["active_percentage"]) == (1, 1, 50.0)
    assert (s["high_confidence_active"], s["moderate_confidence_active"], s["low_confidence_active"]) == (0, 1, 0)


def test_quality(g1):
    md = {r.column_name: (r.missing_count, r.missing_percentage) for r in quality.missing_data(g1).collect()}
    for c in ("transaction_date", "main_description", "amount", "balance"):
        assert md[c] == (1, 12.5)
    z = one(stats.zero_amounts(g1))
    assert (z["zero_count"], z["zero_percentage"]) == (1, 12.5)
    cur = {r.currency: (r.transaction_count, r.issue) for r in quality.currency_distribution(g1).collect()}
    assert cur == {"GBP": (7, "Multiple currencies detected"), "EUR": (1, "Multiple currencies detected")}


def test_outliers_and_duplicates(g1):
    o = one(outliers.iqr_outliers(g1))
    assert (o["q25"], o["q75"], o["upper_bound"], o["outlier_count"]) == (Decimal("7.5"), Decimal("30"), Decimal("63.75"), 1)
    assert o["outlier_percentage"] == 12.5
    lt = one(outliers.large_transactions(g1))
    assert lt["threshold"] == Decimal("79") and lt["large_count"] == 1
    d = one(outliers.duplicates(g1))
    assert (d["duplicate_count"], d["duplicate_percentage"]) == (2, 25.0)
    assert outliers.duplicate_rows(g1).count() == 2


def test_balance_check(g1):
    rows = {r.account_number: r.asDict() for r in balance.balance_check(g1).collect()}
    assert rows["3995"]["max_difference"] == Decimal("1.00") and rows["3995"]["avg_difference"] == pytest.approx(0.25)
    assert not rows["3995"]["is_valid"] and rows["3995"]["error_count"] == 1
    assert rows["5968"]["max_difference"] == 0 and rows["5968"]["is_valid"] and rows["5968"]["error_count"] == 0


def test_categories(g1):
    out, cats = categorize.categorize(g1, min_frequency=2)
    table = {r.category_name: r.asDict() for r in categorize.category_table(g1, cats).collect()}
    assert set(table) == {"ACME", "SHOP"}
    acme, shop = table["ACME"], table["SHOP"]
    assert acme["transaction_count"] == 4 and acme["avg_amount"] == pytest.approx(-22.5)
    assert acme["amount_pattern"] == "mostly_negative" and acme["frequency_score"] == 0.5 and acme["confidence_score"] == 0.632
    assert shop["transaction_count"] == 2 and shop["avg_amount"] == pytest.approx(5.0)
    assert shop["amount_pattern"] == "mixed" and shop["frequency_score"] == 0.25 and shop["confidence_score"] == 0.616
    labels = {r.row_id: r.auto_category for r in out.collect()}
    assert sorted(labels.values()).count("UNCATEGORIZED") == 2
    s = one(categorize.categorisation_stats(out))
    assert (s["categorized_transactions"], s["categorized_percentage"]) == (6, 75.0)


def test_quantile_methods_agree(g1):
    exact = one(outliers.iqr_outliers(g1))
    assert one(outliers.iqr_outliers(g1, method="percentile")) == exact
    approx = one(outliers.iqr_outliers(g1, method="approx"))
    assert approx["outlier_count"] == exact["outlier_count"]
    assert one(outliers.large_transactions(g1, method="percentile")) == one(outliers.large_transactions(g1))
    with pytest.raises(ValueError):
        outliers.iqr_outliers(g1, method="nope")
