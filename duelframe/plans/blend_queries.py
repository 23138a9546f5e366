"""Blends of several models on the simplex (ML-11), beside expectation-maximisation in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.operators import metrics as M, simplex as X
from duelframe.operators.ratings import rate
from duelframe.plans.decision_queries import _ll, oof
from duelframe.plans.registry import query
from duelframe.plans.views_sql import define
from duelframe.sources import adapters as A


# the same weights by expectation-maximisation: independent of the Newton passes, and slow but sure
_HIT = "greatest(1e-7, least(1 - 1e-7, CASE WHEN label = 1 THEN {0} ELSE 1 - {0} END))"
define(
    "blend_wide",
    """
SELECT o.match_id, o.fold AS season, o.label, min(o.market) AS market, max(CASE WHEN model = 'a' THEN prob END) AS a, max(CASE WHEN model = 'b' THEN prob END) AS b, min(f.home_elo_prob) AS c
FROM oof o JOIN fold f ON f.match_id = o.match_id AND f.n > 0 WHERE label IS NOT NULL GROUP BY 1, 2, 3""",
)
define(
    "blend_hits",
    f"""
SELECT match_id, season, dense_rank() OVER (ORDER BY season) AS place, count(*) OVER (PARTITION BY season) AS games,
       {_HIT.format("a")} AS qa, {_HIT.format("b")} AS qb, {_HIT.format("c")} AS qc, {_HIT.format("market")} AS qm FROM blend_wide""",
)
_STEP = "sum(s * wa * qa / (wa * qa + wb * qb + wc * qc + wm * qm)), sum(s * wb * qb / (wa * qa + wb * qb + wc * qc + wm * qm)), sum(s * wc * qc / (wa * qa + wb * qb + wc * qc + wm * qm)), sum(s * wm * qm / (wa * qa + wb * qb + wc * qc + wm * qm))"
define(
    "blend_em",
    f"""
SELECT 0 AS i, 0.25::DOUBLE AS wa, 0.25::DOUBLE AS wb, 0.25::DOUBLE AS wc, 0.25::DOUBLE AS wm UNION ALL
SELECT i + 1, {_STEP} FROM blend_em, (SELECT *, 1.0::DOUBLE / games / (SELECT count(DISTINCT season) FROM blend_hits) AS s FROM blend_hits) WHERE i < 1500 GROUP BY i""",
)
define(
    "blend_em_wf",
    f"""
SELECT 0 AS i, place AS target, 0.25::DOUBLE AS wa, 0.25::DOUBLE AS wb, 0.25::DOUBLE AS wc, 0.25::DOUBLE AS wm FROM (SELECT DISTINCT place FROM blend_hits WHERE place > 2) UNION ALL
SELECT i + 1, target, {_STEP} FROM (SELECT e.*, h.*, 1.0::DOUBLE / games / (target - 1) AS s FROM blend_em_wf e JOIN blend_hits h ON h.place < e.target WHERE i < 1500) GROUP BY i, target""",
)


def three_models(spark, sf):
    """Two models of ``oof`` and the ratings beside the market, one row a match."""
    wide = oof(spark, sf).where("label IS NOT NULL").groupBy("match_id", "fold", "label").pivot("model", ["a", "b"]).agg(F.max("prob"))
    market = oof(spark, sf).where("model = 'a'").select("match_id", "market")
    rated = rate(A.matches(spark, sf)).select("match_id", F.col("home_elo_prob").alias("c"))
    return wide.join(market, "match_id").join(rated, "match_id")


@query(
    "ml11_simplex_blend",
    f"""
SELECT wa AS weight_a, wb AS weight_b, wc AS weight_c, wm AS weight_market, log_loss FROM (SELECT * FROM blend_em WHERE i = 1500) w,
 (SELECT avg(l) AS log_loss FROM (SELECT h.season, avg(-ln(wa * qa + wb * qb + wc * qc + wm * qm)) AS l FROM blend_hits h, blend_em e WHERE e.i = 1500 GROUP BY 1))""",
    "weight_a weight_b weight_c weight_market log_loss",
    places=3,
)
def ml11_simplex(spark, sf):
    """Three models and the market, weights of the smallest mean of the seasons' losses."""
    return X.simplex_weights(three_models(spark, sf), ["a", "b", "c"]).drop("fold")


@query(
    "ml11_walk_forward_blend",
    f"""
SELECT w.season, games, weight_a, weight_b, weight_c, weight_market, avg({_ll('p')}) AS log_loss FROM (
 SELECT *, weight_a * a + weight_b * b + weight_c * c + weight_market * market AS p FROM blend_wide JOIN (
  SELECT DISTINCT h.season, h.games, coalesce(wa, 0.05::DOUBLE) AS weight_a, coalesce(wb, 0.05::DOUBLE) AS weight_b, coalesce(wc, 0.05::DOUBLE) AS weight_c, coalesce(wm, 0.85::DOUBLE) AS weight_market
  FROM blend_hits h LEFT JOIN blend_em_wf e ON e.target = h.place AND e.i = 1500) USING (season)) w GROUP BY ALL""",
    "weight_a weight_b weight_c weight_market log_loss",
    places=3,
)
def ml11_walk_forward(spark, sf):
    """Each season blended by the weights of the seasons before it; the first two by fixed ones."""
    wide, models = three_models(spark, sf), ["a", "b", "c"]
    weights = X.simplex_weights(wide, models, walk_forward=True)
    judged = X.blended(wide, weights, models).groupBy(F.col("fold").alias("season")).agg(F.avg(M.log_loss_of(F.col("prob"), F.col("label"))).alias("log_loss"), F.count(F.lit(1)).alias("games"))
    return judged.join(F.broadcast(weights.drop("log_loss")), judged["season"] == weights["fold"]).drop("fold")
