"""Site scores: survival odds (C1/C2) and the overall site rating.

Everything a site needs -- the newest-100 list size, open stores within the
haversine radius, their ages, long-term share and sector variety, the
same-sector count and the all-sector count -- are sums over the site's circle
(``circles.circle_sums``: no pass over all pairs) added up by ``site_id``.  The
original asked the database three times per site and filtered every open store
in a loop.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.dates import as_date, days_between
from sitelens.operators.circles import circle_sums, located
from sitelens.operators.distance_join import prepare_sites

# The parts of the two scores.
LIST_CAP = 100  # the formulas see at most the newest 100 stores of a radius list; reported counts are exact
SURVIVAL_WEIGHTS = (0.4, 0.3, 0.2, 0.1)  # age, long-term share, little competition, sector variety
RATING_WEIGHTS = (0.4, 0.3, 0.2, 0.1)  # survival, competition band, accessibility, sector fit
FULL_COMPETITION, FULL_ACCESS, LONG_TERM_MONTHS = 20.0, 30.0, 36

# Finding codes and their messages.
SCORE_MESSAGES = {
    "NO_DATA": "반경 내 점포 데이터가 부족합니다. 더 넓은 범위로 분석해보세요.",
    "LOW_SURVIVAL": "생존가능성이 낮은 지역입니다. 신중한 검토가 필요합니다.",
    "CROWDED": "경쟁이 치열한 지역입니다. 차별화 전략이 필요합니다.",
    "SPARSE": "경쟁이 적은 지역입니다. 수요 확인이 필요합니다.",
    "UNSTABLE": "장기 영업 점포 비율이 낮습니다. 지역 안정성 검토가 필요합니다.",
    "MONOTONE": "업종 다양성이 낮습니다. 단일 업종 집중 지역일 수 있습니다.",
    "GOOD": "양호한 지역으로 판단됩니다.",
}
RATING_MESSAGES = {
    "EXCELLENT": ("positive", "매우 좋은 위치로 판단됩니다."),
    "FAVORABLE": ("positive", "양호한 위치입니다."),
    "CAUTION": ("warning", "신중한 검토가 필요한 위치입니다."),
    "RISKY": ("negative", "위험한 위치입니다. 다른 지역을 검토해보세요."),
    "FIERCE_COMPETITION": ("warning", "경쟁이 매우 치열합니다. 차별화 전략이 필수입니다."),
}
RISK_MESSAGES = {
    "OVER_COMPETITION": "과도한 경쟁이 예상됩니다.",
    "SHORT_SURVIVAL": "주변 점포의 평균 생존 기간이 짧습니다.",
    "UNDEVELOPED": "주변 상권이 발달하지 않았습니다.",
}
OPPORTUNITY_MESSAGES = {
    "LOW_COMPETITION": "경쟁이 적어 진입 기회가 있습니다.",
    "ACTIVE_AREA": "상권이 활성화되어 있습니다.",
    "DIVERSE_SECTORS": "다양한 업종이 공존하는 지역입니다.",
}


def _r2(c: Column) -> Column:
    return (F.floor(c * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)).cast("double")


def _pct2(c: Column) -> Column:
    """``Math.round(x * 10000) / 100``: a 0-1 ratio as percent, 2 decimals."""
    return (F.floor(c * F.lit(10000.0) + F.lit(0.5)) / F.lit(100.0)).cast("double")


def _codes(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]), lambda x: x.isNotNull())


def site_aggregates(sites: DataFrame, stores: DataFrame, as_of: str | _dt.date, all_sectors: bool = True) -> DataFrame:
    """Per site (all sites kept; none-found sites get zeros).  Without
    ``all_sectors`` ``n_all`` counts the stores of the site's sector only."""
    s = prepare_sites(sites)
    st = located(stores.select("id", "sector", "open_date", "close_date", "lat", "lng"))
    one = F.lit(1)
    is_open = F.col("close_date").isNull()
    dated = is_open & F.col("open_date").isNotNull()
    asof = as_date(as_of)
    parts = circle_sums(s, st, {
        "n_same": ("spheroid", one),
        "n_open": ("haversine", F.when(is_open, one)),
        "n_valid": ("haversine", F.when(dated, one)),
        "sum_days": ("haversine", F.when(dated, days_between(asof, F.col("open_date")))),
        "n_long": ("haversine", F.when(dated & (F.col("open_date") <= F.add_months(asof, -LONG_TERM_MONTHS)), one)),
    }, by="sector", stored=True)
    if all_sectors:
        parts = parts.unionByName(circle_sums(s, st, {"n_all": ("spheroid", one)}, match_sector=False, stored=True), allowMissingColumns=True)
    else:
        parts = parts.withColumn("n_all", F.col("n_same"))
    agg = parts.groupBy("site_id").agg(
        *[F.sum(c).alias(c) for c in ["n_same", "n_all", "n_valid", "sum_days", "n_long"]],
        F.count_distinct(F.when(F.col("n_open") > 0, F.coalesce(F.col("sector"), F.lit("")))).alias("n_sectors"))
    zero = F.lit(0).cast("long")
    return (s.join(agg, "site_id", "left")
            .select("site_id", "site_lat", "site_lng", "radius_m", "site_sector",
                    *[F.coalesce(F.col(c), zero).cast("long").alias(c)
                      for c in ["n_same", "n_all", "n_valid", "sum_days", "n_long", "n_sectors"]]))


def _score_columns(a: DataFrame) -> DataFrame:
    comp = F.least(F.col("n_same"), F.lit(LIST_CAP))
    nv = F.col("n_valid")
    avg = F.when(nv > 0, F.col("sum_days") / nv).otherwise(F.lit(0.0))
    ratio = F.when(nv > 0, F.col("n_long") / nv).otherwise(F.lit(0.0))
    diversity = F.least(F.col("n_sectors") / F.greatest(comp, F.lit(1)), F.lit(1.0))
    w_age, w_long, w_free, w_mix = map(F.lit, SURVIVAL_WEIGHTS)
    crowd = F.least(comp / F.lit(FULL_COMPETITION) * F.lit(100.0), F.lit(100.0))
    score = (F.least(avg / F.lit(365.0) * F.lit(100.0), F.lit(100.0)) * w_age + ratio * F.lit(100.0) * w_long
             + F.greatest(F.lit(0.0), F.lit(100.0) - crowd) * w_free + diversity * F.lit(100.0) * w_mix)
    no_data = comp == 0
    codes = _codes([(score < 50, "LOW_SURVIVAL"), (comp > 15, "CROWDED"), (comp < 3, "SPARSE"),
                    (ratio < 0.3, "UNSTABLE"), (diversity < 0.3, "MONOTONE")])
    codes = F.when(no_data, F.array(F.lit("NO_DATA"))) \
             .otherwise(F.when(F.size(codes) == 0, F.array(F.lit("GOOD"))).otherwise(codes))
    zero = F.lit(0.0)
    return a.select(
        "*",
        F.when(no_data, F.lit(50.0)).otherwise(_r2(score)).alias("survival_score"),
        F.when(no_data, zero).otherwise(_r2(avg)).alias("avg_survival_days"),
        F.when(no_data, zero).otherwise(_pct2(ratio)).alias("long_term_ratio_pct"),
        F.col("n_same").alias("competition_level"),
        F.when(no_data, zero).otherwise(_pct2(diversity)).alias("sector_diversity_pct"),
        F.when(no_data, zero).otherwise(diversity).alias("_diversity"),
        codes.alias("recommendations"),
    )


def survival_score(sites: DataFrame, stores: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """C1 + C2: survival score 0-100 per site with its breakdown and codes."""
    s = _score_columns(site_aggregates(sites, stores, as_of, all_sectors=False))
    return s.select("site_id", F.col("site_sector").alias("sector"), "radius_m", "survival_score",
                    "avg_survival_days", "long_term_ratio_pct", "competition_level", "sector_diversity_pct",
                    "recommendations")


def _band(n: Column) -> Column:
    return (F.when(n <= 5, 100).when(n <= 10, 80).when(n <= 15, 60).when(n <= 20, 40).otherwise(20)).cast("double")


def site_rating(sites: DataFrame, stores: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """C3 + C4 + C5: overall rating from survival, competition band,
    accessibility (all stores nearby, newest-100 list) and sector fit."""
    s = _score_columns(site_aggregates(sites, stores, as_of))
    nearby = F.least(F.col("n_all"), F.lit(LIST_CAP))
    same = F.col("n_same")
    band = _band(same)
    access = F.least(nearby / F.lit(FULL_ACCESS) * F.lit(100.0), F.lit(100.0))
    w_survival, w_band, w_access, w_fit = map(F.lit, RATING_WEIGHTS)
    fit = F.col("long_term_ratio_pct")  # percent 0-100 (the original multiplied it by 100 again)
    overall = F.col("survival_score") * w_survival + band * w_band + access * w_access + fit * w_fit
    level = F.when(overall >= 80, "EXCELLENT").when(overall >= 60, "FAVORABLE") \
             .when(overall >= 40, "CAUTION").otherwise("RISKY")
    recs = F.when(same > 20, F.array(level, F.lit("FIERCE_COMPETITION"))).otherwise(F.array(level))
    risks = _codes([(same > 20, "OVER_COMPETITION"), (F.col("avg_survival_days") < 365, "SHORT_SURVIVAL"),
                    (nearby < 5, "UNDEVELOPED")])
    opps = _codes([((same <= 20) & (same < 3), "LOW_COMPETITION"), (nearby >= 5, "ACTIVE_AREA"),
                   (F.col("_diversity") > 0.7, "DIVERSE_SECTORS")])
    return s.select(
        "site_id", F.col("site_sector").alias("sector"), "radius_m",
        _r2(overall).alias("overall_score"), "survival_score", band.alias("competition_score"),
        _r2(access).alias("accessibility_score"), _r2(fit).alias("sector_fit_score"),
        F.col("n_all").alias("nearby_stores"), same.cast("long").alias("same_sector_stores"),
        "avg_survival_days", F.col("sector_diversity_pct").alias("sector_diversity_pct"),
        recs.alias("recommendations"), risks.alias("risk_factors"), opps.alias("opportunities"))


def _codes_with_messages(col: str, kind: str, messages: dict, tone: str | None = None) -> Column:
    """Array of (kind, pos, code, message, tone) of a code array column."""
    text = F.create_map(*[F.lit(x) for k, v in messages.items() for x in (k, v if isinstance(v, str) else v[1])])
    tones = F.create_map(*[F.lit(x) for k, v in messages.items() for x in (k, tone if isinstance(v, str) else v[0])])
    return F.transform(col, lambda code, i: F.struct(
        F.lit(kind).alias("kind"), (i + 1).cast("long").alias("pos"), code.alias("code"),
        F.element_at(text, code).alias("message"), F.element_at(tones, code).cast("string").alias("tone")))


def survival_recommendations(scores: DataFrame) -> DataFrame:
    """C2 long form: one row per (site, code) with the message text."""
    codes = _codes_with_messages("recommendations", "recommendation", SCORE_MESSAGES)
    return scores.select("site_id", F.inline(codes)).drop("tone")


def site_rating_findings(rating: DataFrame) -> DataFrame:
    """C5 long form: recommendations, risks and opportunities per site, from
    one pass over the ratings (three arrays joined, exploded once)."""
    return rating.select("site_id", F.inline(F.concat(
        _codes_with_messages("recommendations", "recommendation", RATING_MESSAGES),
        _codes_with_messages("risk_factors", "risk", RISK_MESSAGES, "negative"),
        _codes_with_messages("opportunities", "opportunity", OPPORTUNITY_MESSAGES, "positive"))))


def score_band(score: Column) -> Column:
    """Display band of a score (>70 high, >40 medium, else low)."""
    return F.when(score > 70, "high").when(score > 40, "medium").otherwise("low")


def competition_band(n: Column) -> Column:
    """Display band of a competition count (>20 high, >10 medium)."""
    return F.when(n > 20, "high").when(n > 10, "medium").otherwise("low")


def marker_height(open_date: Column, as_of) -> Column:
    """Bar height of a store marker: years open, at most 3; 0.5
    without an opening date."""
    from sitelens.functions.dates import as_date as _d
    return F.when(open_date.isNull(), F.lit(0.5)) \
            .otherwise(F.least(F.datediff(_d(as_of), open_date) / F.lit(365.0), F.lit(3.0)))


def score_heatmap(stores: DataFrame, as_of, step_deg: float = 0.01, radius_m: float = 500.0,
                  sector: str | None = None) -> DataFrame:
    """Survival score on every node of a grid over the stores' box --
    one job instead of one request per map tile."""
    from sitelens.sources.sites import grid_sites
    sites = grid_sites(stores, step_deg, radius_m, sector)
    s = survival_score(sites, stores, as_of)
    return sites.select("site_id", "lat", "lng").join(s, "site_id").select(
        "site_id", "lat", "lng", "survival_score", "competition_level",
        score_band(F.col("survival_score")).alias("score_band"),
        competition_band(F.col("competition_level")).alias("competition_band"))


def survival_score_snapped(sites: DataFrame, stores: DataFrame, as_of: str | _dt.date) -> DataFrame:
    """C1 with G10 snapping: sites are snapped to 4 decimals of lat/lng and
    each DISTINCT request (snapped point, true radius, sector) is scored
    once, then the scores fan back to every site.  A table of many nearby
    duplicate requests (map tiles, repeated queries) costs one join per
    distinct request.  The request id is the exact text of its parts, with a
    missing sector told apart from any sector name."""
    from sitelens.operators.enrich import request_key, snap_sites
    snapped = snap_sites(sites)
    requests = snapped.select(request_key().alias("site_id"), F.col("snap_lat").alias("lat"),
                              F.col("snap_lng").alias("lng"), "radius_m", "sector").distinct()
    scored = survival_score(requests, stores, as_of).drop("sector", "radius_m")
    return snapped.select(F.col("site_id").alias("_site"), request_key().alias("site_id")).join(scored, "site_id") \
        .drop("site_id").withColumnRenamed("_site", "site_id")
