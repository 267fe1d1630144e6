"""Scorecard queries bound to the test tables (see ``sources.fixtures``)."""

from __future__ import annotations

from opsmetrics.functions import margin as M
from opsmetrics.plans import scorecard as S
from opsmetrics.sources.fixtures import Inputs

# small lists, so that products fall outside the best and the worst: low and other bands occur
P = S.ScorecardParams(band_n=8, band_volume=20)


def _parts(spark, root, persist=False):
    return S.build_parts(Inputs(spark, root), P, persist=persist)


def pipe_scorecard(spark, root):
    t = Inputs(spark, root)
    return S.entity_scorecard(t, P, S.build_parts(t, P, persist=True))


def shared_fact(spark, root):
    t = Inputs(spark, root)
    ta = _parts(spark, root).clinic_ta
    return S.shared_fact(t["fills"], t["products"], t["clinics"], t["patients"], ta, P, persist=False)


def job_margin(spark, root):
    f = Inputs(spark, root)["fills"]
    return f.select("delivery_id", "product_key", "delivered_at",
                    M.revenue().alias("revenue"), M.profit().alias("profit"))


def job_dominant_category(spark, root):
    return _parts(spark, root).clinic_ta


def job_product_kpis(spark, root):
    return _parts(spark, root).kpis


def job_entity_totals(spark, root):
    return _parts(spark, root).money


def job_month_snapshot(spark, root):
    return _parts(spark, root).snapshot


def job_topn_share(spark, root):
    return _parts(spark, root).top.select("clinic_name", "super_clinic_id", "product_name", "brand_vs_generic",
                                          "total_med_fills", "med_rank", "total_vol", "portion_of_vol")


def job_topn_columns(spark, root):
    return _parts(spark, root).top_cols


def job_monthly_pivot(spark, root):
    return _parts(spark, root).pivot


def job_product_margin(spark, root):
    return _parts(spark, root).product_margin


def job_margin_bands(spark, root):
    return _parts(spark, root).bands


def job_band_mix(spark, root):
    return _parts(spark, root).mix


def job_basket_size(spark, root):
    return _parts(spark, root).basket


def job_entity_rollup(spark, root):
    return _parts(spark, root).rollup


def job_crm_match(spark, root):
    return _parts(spark, root).crm


def job_stage_history(spark, root):
    return _parts(spark, root).sales


def job_kth_stage(spark, root):
    return _parts(spark, root).stages


QUERIES = {k: v for k, v in globals().items() if k.startswith(("pipe_", "job_", "shared_")) and callable(v)}
