"""The test tables reach the features that the oracle is to compare."""

import pytest

import __spark_entry__ as E
from tools.check_oracle import duck


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.01")


def rows(con, name, sql):
    return con.sql(f"with q as ({E.oracle_sql()[name]}) {sql}").fetchall()


def test_every_margin_band_occurs(con):
    bands = {r[0] for r in rows(con, "job_margin_bands", "select distinct med_gp_category from q")}
    assert {"High GP Product", "Negative GP Product"} <= bands and len(bands) >= 3
    assert rows(con, "job_band_mix", "select sum(num_other_fills) > 0 from q") == [(True,)]


def test_forms_repeat_per_order_and_category(con):
    most, lists = rows(con, "job_form_summary", "select max(forms), count(*) filter (contains(filtered_body[2:], ',')) from q")[0]
    assert most > 3 and lists > 0


def test_several_reasons_occur(con):
    assert rows(con, "job_classify_text", "select count(distinct reason) >= 1 from q") == [(True,)]
