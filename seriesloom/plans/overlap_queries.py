"""Queries of window classes and verified overlaps."""

from __future__ import annotations

from seriesloom.operators import overlaps
from seriesloom.plans.base import BASE, KEY, ROW, base, query

#: Rows of a window.
K = 7
_GRAMS = BASE + f""",
g AS (SELECT user_id AS key, row_idx AS place, list(event_type) OVER w AS codes, count(*) OVER w AS c FROM b WINDOW w AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)),
w AS (SELECT key, place, codes, min({{'key': key, 'place': place}}) OVER (PARTITION BY codes) AS r, count(*) OVER (PARTITION BY codes) AS n FROM g WHERE c = {K}),
m AS (SELECT codes, r.key AS rep_key, r.place AS rep_place, key, place FROM w WHERE n > 1)"""


@query("window_classes", _GRAMS + " SELECT sha256(list_aggregate(list_transform(codes, lambda x: sha256('=' || x)), 'string_agg', ',')) AS gram, rep_key, rep_place, key, place FROM m")
def window_classes(spark, sf_dir):
    return overlaps.window_classes(base(spark, sf_dir), KEY, ROW, "event_type", K)


@query("verified_overlaps", _GRAMS + f""",
p AS (
  SELECT a.key AS rep_key, b2.key AS key, b2.place AS place, b2.place - a.place AS shift, a.key = b2.r.key AND a.place = b2.r.place AS seed
  FROM w a JOIN w b2 ON a.codes = b2.codes AND (a.key < b2.key OR a.key = b2.key AND a.place < b2.place)),
i AS (SELECT *, place - row_number() OVER (PARTITION BY rep_key, key, shift ORDER BY place) AS run FROM p)
SELECT rep_key, min(place) - shift AS rep_from, key, min(place) AS "from", max(place) - min(place) + {K} AS length FROM i GROUP BY rep_key, key, shift, run HAVING bool_or(seed)""")
def verified_overlaps(spark, sf_dir):
    return overlaps.verified_overlaps(base(spark, sf_dir), KEY, ROW, "event_type", K)
