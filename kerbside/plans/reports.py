"""Queries on boxes, zones, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geometry as G
from kerbside.operators import analytics as A
from kerbside.operators import evaluation as V
from kerbside.plans.derived import EVENTS, TRAJECTORIES, event_series, observed
from kerbside.plans.series import _IV, intervals
from kerbside.session import table

ZONE = [(2000, 3800), (6000, 3800), (6000, 4100), (4000, 4000), (4000, 4300), (2000, 4300)]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the first numbers of the embeddings, in thousandths: vec_id, label, x1, y1, x2, y2."""
    # a float times a float is rounded to a float, as in SQL; a double would fall on the other side of some halves
    v = lambda i: F.round((F.element_at(F.col(names[1]), i) * F.lit(1000).cast("float")).cast("double")).cast("bigint")
    e = table(spark, sf_dir, "embeddings")
    names = e.columns
    return e.select(F.col(names[0]).alias("id"), F.col("label"), F.least(v(1), v(2)).alias("x1"), F.least(v(3), v(4)).alias("y1"), F.greatest(v(1), v(2)).alias("x2"), F.greatest(v(3), v(4)).alias("y2"))


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of a label: IoU and the share of the first inside the second."""
    one, two = (boxes(spark, sf_dir).select("label", *[F.col(c).cast("double").alias(f"{c}{k}") if c != "id" else F.col(c).alias(f"{c}{k}") for c in ("id", "x1", "y1", "x2", "y2")]) for k in "ab")
    a, b = ([F.col(f"{c}{k}") for c in ("x1", "y1", "x2", "y2")] for k in "ab")
    pairs = one.join(two, "label").where("ida < idb")
    return pairs.withColumn("iou", G.iou(a, b)).where("iou > 0.3").select("label", F.col("ida").alias("a"), F.col("idb").alias("b"), F.floor(F.col("iou") * 1000 + 1e-6).cast("bigint").alias("iou1000"), F.floor(G.inside_fraction(a, b) * 1000 + 1e-6).cast("bigint").alias("inside1000"))


def in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground points in a concave polygon; its outline belongs to it."""
    rows = observed(spark, sf_dir).withColumn("px", F.round(F.col("gx") * 10)).withColumn("py", F.round(F.col("gy") * 10))
    return rows.where(G.inside(F.col("px"), F.col("py"), G.polygon(ZONE))).groupBy("video_id", "tid").agg(F.count("*").alias("n"))


def line_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which side of a bent line points lie, and how far."""
    p = G.polyline_side(F.col("gx"), F.col("gy"), [(0, 400), (640, 400), (640, 720)])
    return observed(spark, sf_dir).select("video_id", p.alias("p")).groupBy("video_id", F.col("p.on").alias("on"), F.signum("p.side").cast("int").alias("side")).agg(F.count("*").alias("n"))


def _predictions(truth: DataFrame) -> DataFrame:
    """Two of three events, shifted."""
    return truth.where("ord % 3 > 0").withColumn("start", F.col("start") + F.col("ord") % 40).withColumn("end", F.col("end") + F.col("ord") % 17).where("end > start")


def whole_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders as events of their customer's video, and shifted ones as predictions."""
    rows = intervals(spark, sf_dir).select(F.col("cust").cast("string").alias("video_id"), F.col("flag").alias("label"), F.col("order").alias("ord"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).where("end > start")
    return rows, _predictions(rows)


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.event_scores(*whole_truth(spark, sf_dir))
    return s.select(F.coalesce("label", F.lit("all")).alias("label"), F.round(F.col("threshold") * 10).cast("bigint").alias("threshold10"), *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of true and predicted events with at least half in common."""
    return V.match_pairs(*whole_truth(spark, sf_dir), V.KEYS).where("iou >= 0.5").groupBy("label").agg(F.count("*").alias("pairs"), F.count_distinct("i").alias("truths"), F.sum(F.floor(F.col("iou") * 1000 + 1e-6).cast("bigint")).alias("iou1000"))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("score"), (F.col("l_returnflag") == "R").alias("y"))
    return V.average_precision(rows, ["l_linenumber"], "score", "y").select("l_linenumber", F.round(F.col("ap") * 1_000_000).cast("bigint").alias("ap6"), "positives", "n")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select(F.col("user_id").cast("string").alias("video_id"), (F.col("t_us") / 3_600_000_000).alias("t"), F.least(F.col("value100") / 10000, F.lit(1.0)).alias("score"))


def alarm_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms on the users' curves, in whole seconds."""
    return V.alarms(curves(spark, sf_dir), 0.3, 12.0).select("video_id", F.round(F.col("start") * 3600).cast("bigint").alias("start_s"), F.round(F.col("end") * 3600).cast("bigint").alias("end_s"))


def alarm_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alarm_share(curves(spark, sf_dir), ["video_id"], 0.3).select("video_id", F.round(F.col("share") * 10000).cast("bigint").alias("share10000"))


def events_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def counts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by day, as columns."""
    kinds = ["click", "view", "purchase"]
    rows = event_series(spark, sf_dir).withColumn("day", F.floor(F.col("t_us") / (24 * 3_600_000_000)).cast("bigint"))
    return rows.groupBy("day").pivot("event_type", kinds).agg(F.count(F.lit(1))).select("day", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def rate_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.max("t_us") - F.min("t_us")
    rows = event_series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), span.alias("us"))
    return rows.select("user_id", "n", F.coalesce(F.floor(F.try_divide(F.col("n") * 86_400_000_000_000, F.col("us"))), F.lit(0)).cast("bigint").alias("per_1000_days"))


def heat_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a customer's orders, and of which flags, are open in each part of the time."""
    rows = intervals(spark, sf_dir)
    return A.heat_strip(rows.withColumnRenamed("flag", "label").where("start between 0 and 2600 and end <= 2600"), ["cust"], F.lit(2600)).select("cust", F.col("bin").cast("bigint").alias("bin"), "n", "labels")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value100") / 100
    rows = event_series(spark, sf_dir).select(A.lighting(v).alias("lighting"), A.risk_level(v / 100).alias("level"), A.pretty(F.col("event_type")).alias("kind"))
    return rows.groupBy("lighting", "level", "kind").agg(F.count("*").alias("n"))


def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("event_id", A.clock((F.col("t_us") % 3_600_000_000) / 1_000_000).alias("clock"))


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag's six longest orders."""
    rows = intervals(spark, sf_dir)
    return A.top_k(rows, ["flag"], [F.col("start") - F.col("end"), F.col("order")], 6).select("flag", "order", F.col("rank").cast("bigint").alias("rank"))


def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's mean value less the first type's."""
    from pyspark.sql.window import Window

    rows = event_series(spark, sf_dir).groupBy("event_type").agg((F.sum("value100") / F.count("*")).alias("m"))
    first = F.first("m").over(Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row for each type
    return rows.select("event_type", F.round((F.col("m") - first) * 10).cast("bigint").alias("delta10"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value100", [0.5, 0.9, 0.99, 0.999])
    return event_series(spark, sf_dir).groupBy("event_type").agg(p.alias("p")).select("event_type", *[F.round(F.element_at("p", i + 1) * 10).cast("bigint").alias(n) for i, n in enumerate(("p50", "p90", "p99", "p999"))])


def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.otsu_threshold(event_series(spark, sf_dir), ["event_type"], "value100")


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with purchases but no clicks, with both, and with either, by set operations."""
    of = lambda k: table(spark, sf_dir, "events").where((F.col("event_type") == k) & (F.col("value") > 120)).select("user_id")
    parts = {"except": of("purchase").subtract(of("click")), "intersect": of("purchase").intersect(of("click")), "union": of("purchase").union(of("click")).distinct()}
    out = None
    for name, part in parts.items():
        row = part.agg(F.count("*").alias("n"), F.sum("user_id").cast("bigint").alias("ids")).withColumn("op", F.lit(name))
        out = row if out is None else out.union(row)
    return out


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of predictions, in all customers' videos, and of the users' curves."""
    _, predicted = whole_truth(spark, sf_dir)
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), F.lit(2300.0).alias("duration"))
    found = V.violations(predicted, _scored(spark, sf_dir), videos, ["A", "N"])
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' curves in the order of the events' ids; a missing value stays a missing score."""
    score = F.when(F.col("value100").isNotNull(), F.least(F.col("value100") / 10000, F.lit(1.0)))
    return event_series(spark, sf_dir).select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("ord"), F.col("t_us").alias("t"), score.alias("score"))


def prop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a key of the events' JSON."""
    k = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_type", k["k"].try_cast("bigint").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


QUERIES = {
    "box_pairs": box_pairs, "in_zone": in_zone, "line_side": line_side, "event_scores": event_scores, "match_candidates": match_candidates, "average_precision": average_precision, "alarm_starts": alarm_starts, "alarm_shares": alarm_shares,
    "events_per_class": events_per_class, "counts_by_day": counts_by_day, "rate_per_day": rate_per_day, "heat_strip": heat_strip, "levels": levels, "clock_times": clock_times, "longest_events": longest, "ablation_delta": ablation_delta,
    "percentiles": percentiles, "otsu_threshold": otsu, "label_sets": label_sets, "violations": violations, "prop_counts": prop_counts,
}

_TRUTH = f"""{_IV}, tr AS (SELECT cust::VARCHAR AS video_id, flag AS label, "order" AS ord, start::DOUBLE AS start, "end"::DOUBLE AS "end" FROM iv WHERE "end" > start),
pr0 AS (SELECT video_id, label, ord, start + ord % 40 AS start, "end" + ord % 17 AS "end" FROM tr WHERE ord % 3 > 0), pr AS (SELECT * FROM pr0 WHERE "end" > start),
mp AS (SELECT t.label, t.video_id, t.ord AS i, p.ord AS j, (least(t."end", p."end") - greatest(t.start, p.start)) / (t."end" - t.start + p."end" - p.start - (least(t."end", p."end") - greatest(t.start, p.start))) AS iou
  FROM tr t JOIN pr p ON t.video_id = p.video_id AND t.label = p.label AND t.start < p."end" AND p.start < t."end")"""
_EDGES = ", ".join(f"({x0}, {y0}, {x1}, {y1})" for (x0, y0), (x1, y1) in zip(ZONE, ZONE[1:] + ZONE[:1], strict=True))
_CURVES = f"{EVENTS}, cu AS (SELECT user_id::VARCHAR AS video_id, t_us / 3.6e9 AS t, least(value100 / 10000.0, 1.0) AS score FROM ev)"

ORACLE_SQL = {
    "in_zone": f"""WITH {TRAJECTORIES}, e(x0, y0, x1, y1) AS (VALUES {_EDGES}), p AS (SELECT video_id, tid, t_us, round(gx * 10) AS x, round(gy * 10) AS y FROM obs),
      h AS (SELECT video_id, tid, t_us, bool_or((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) = 0 AND x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1)) AS edge,
        sum(CASE WHEN (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)::DOUBLE THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM p, e GROUP BY ALL)
      SELECT video_id, tid, count(*) AS n FROM h WHERE edge OR odd GROUP BY ALL""",
    "line_side": f"""WITH {TRAJECTORIES}, s AS (SELECT video_id, CASE WHEN gx BETWEEN 0 AND 640 THEN gy - 400 END AS d1, CASE WHEN gy BETWEEN 400 AND 720 THEN 640 - gx END AS d2 FROM obs),
      b AS (SELECT video_id, CASE WHEN d1 IS NULL AND d2 IS NULL THEN NULL WHEN d2 IS NULL OR abs(d1) <= abs(d2) THEN d1 ELSE d2 END AS side FROM s)
      SELECT video_id, side IS NOT NULL AS "on", coalesce(sign(side), 0)::INT AS side, count(*) AS n FROM b GROUP BY ALL""",
    "box_pairs": """WITH v AS (SELECT *, list_transform(embedding[1:4], lambda x: round(x * 1000)::BIGINT) AS q FROM embeddings),
      b AS (SELECT vec_id AS id, label, least(q[1], q[2]) AS x1, least(q[3], q[4]) AS y1, greatest(q[1], q[2]) AS x2, greatest(q[3], q[4]) AS y2 FROM v),
      p AS (SELECT a.label, a.id AS a, b.id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM b a JOIN b b ON a.label = b.label AND a.id < b.id)
      SELECT label, a, b, floor(i / (s + t - i + 1e-6) * 1000 + 1e-6)::BIGINT AS iou1000, floor(i / greatest(s, 1e-6) * 1000 + 1e-6)::BIGINT AS inside1000 FROM p WHERE i / (s + t - i + 1e-6) > 0.3""",
    "match_candidates": f'WITH {_TRUTH} SELECT label, count(*) AS pairs, count(DISTINCT i) AS truths, sum(floor(iou * 1000 + 1e-6))::BIGINT AS iou1000 FROM mp WHERE iou >= 0.5 GROUP BY label',
    "average_precision": """WITH g AS (SELECT l_linenumber, round(l_discount * 100)::INT AS score, sum((l_returnflag = 'R')::INT) AS tp, count(*) AS n FROM lineitem GROUP BY ALL),
      c AS (SELECT *, sum(tp) OVER w / sum(n) OVER w AS p, sum(tp) OVER (PARTITION BY l_linenumber) AS pos FROM g WINDOW w AS (PARTITION BY l_linenumber ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
      SELECT l_linenumber, round(sum(tp / pos * p) * 1000000)::BIGINT AS ap6, max(pos)::BIGINT AS positives, sum(n)::BIGINT AS n FROM c GROUP BY 1""",
    "alarm_starts": f"""WITH {_CURVES}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t) AS i FROM cu), b AS (SELECT *, i - row_number() OVER (PARTITION BY video_id ORDER BY t) AS run FROM a WHERE score >= 0.3),
      s AS (SELECT video_id, min(t) AS s, max(t) AS e FROM b GROUP BY video_id, run), f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY video_id ORDER BY s) < 12 THEN 0 ELSE 1 END AS fresh FROM s), g AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY s) AS k FROM f)
      SELECT video_id, round(min(s) * 3600)::BIGINT AS start_s, round(max(e) * 3600)::BIGINT AS end_s FROM g GROUP BY video_id, k""",
    "alarm_shares": f"WITH {_CURVES}, d AS (SELECT *, lead(t) OVER (PARTITION BY video_id ORDER BY t) - t AS dt FROM cu) SELECT video_id, round(coalesce(sum(CASE WHEN score >= 0.3 THEN dt ELSE 0 END) / sum(dt), 0) * 10000)::BIGINT AS share10000 FROM d GROUP BY video_id",
    "events_per_class": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "counts_by_day": f"WITH {EVENTS} SELECT (t_us // 86400000000)::BIGINT AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM ev GROUP BY 1",
    "rate_per_day": f"WITH {EVENTS} SELECT user_id, count(*) AS n, CASE WHEN max(t_us) > min(t_us) THEN (count(*) * 86400000000000::HUGEINT // (max(t_us) - min(t_us)))::BIGINT ELSE 0 END AS per_1000_days FROM ev GROUP BY user_id",
    "heat_strip": f"""WITH {_IV}, r AS (SELECT cust, flag, least(floor(start / 2600.0 * 24), 23)::BIGINT AS a, least(floor("end" / 2600.0 * 24), 23)::BIGINT AS b FROM iv WHERE start BETWEEN 0 AND 2600 AND "end" <= 2600),
      x AS (SELECT cust, flag, unnest(range(a, greatest(a, b) + 1)) AS bin FROM r) SELECT cust, bin, count(*) AS n, string_agg(DISTINCT flag, ',' ORDER BY flag) AS labels FROM x GROUP BY cust, bin""",
    "levels": f"WITH {EVENTS} SELECT CASE WHEN value100 IS NULL THEN '-' WHEN value100 >= 11000 THEN 'day' WHEN value100 >= 6000 THEN 'dusk/overcast' ELSE 'night' END AS lighting, CASE WHEN value100 >= 5000 THEN 'ALARM' WHEN value100 >= 2500 THEN 'ELEVATED' ELSE 'LOW' END AS level, upper(replace(event_type, '_', ' ')) AS kind, count(*) AS n FROM ev GROUP BY ALL",
    "clock_times": f"WITH {EVENTS}, d AS (SELECT event_id, (t_us % 3600000000) // 100000 AS x FROM ev) SELECT event_id, (x // 600)::VARCHAR || ':' || lpad(((x // 10) % 60)::VARCHAR, 2, '0') || '.' || (x % 10)::VARCHAR AS clock FROM d",
    "longest_events": f'WITH {_IV} SELECT flag, "order", rank FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY start - "end", "order") AS rank FROM iv) WHERE rank <= 6',
    "ablation_delta": f"WITH {EVENTS}, m AS (SELECT event_type, sum(value100) / count(*) AS m FROM ev GROUP BY 1) SELECT event_type, round((m - first_value(m) OVER (ORDER BY event_type)) * 10)::BIGINT AS delta10 FROM m",
    "percentiles": f"WITH {EVENTS} SELECT event_type, round(quantile_cont(value100, 0.5) * 10)::BIGINT AS p50, round(quantile_cont(value100, 0.9) * 10)::BIGINT AS p90, round(quantile_cont(value100, 0.99) * 10)::BIGINT AS p99, round(quantile_cont(value100, 0.999) * 10)::BIGINT AS p999 FROM ev GROUP BY 1",
    "otsu_threshold": f"""WITH {EVENTS}, s AS (SELECT event_type, count(*) AS n, min(value100) AS lo, max(value100) AS hi FROM ev GROUP BY 1), q AS (SELECT event_type, floor((value100 - lo) * 255 / (hi - lo)::DOUBLE)::BIGINT AS q, count(*) AS c FROM ev JOIN s USING (event_type) WHERE s.n >= 10 AND hi - lo >= 8 GROUP BY ALL),
      h AS (SELECT *, sum(c) OVER w AS w0, sum(c * q) OVER w AS s0, sum(c) OVER (PARTITION BY event_type) AS w, sum(c * q) OVER (PARTITION BY event_type) AS s FROM q WINDOW w AS (PARTITION BY event_type ORDER BY q ROWS UNBOUNDED PRECEDING)),
      b AS (SELECT *, CASE WHEN w0 < w THEN (s0 * w - s * w0)::DOUBLE * (s0 * w - s * w0)::DOUBLE / (w0 * (w - w0))::DOUBLE ELSE -1 END AS v FROM h)
      SELECT s.event_type, t.q AS threshold_q FROM s LEFT JOIN (SELECT event_type, q, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, q) AS k FROM b) t ON t.event_type = s.event_type AND t.k = 1""",
    "label_sets": """WITH p AS (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 120), c AS (SELECT user_id FROM events WHERE event_type = 'click' AND value > 120)
      SELECT count(*) AS n, sum(user_id)::BIGINT AS ids, 'except' AS op FROM (SELECT * FROM p EXCEPT SELECT * FROM c) UNION ALL SELECT count(*), sum(user_id)::BIGINT, 'intersect' FROM (SELECT * FROM p INTERSECT SELECT * FROM c) UNION ALL SELECT count(*), sum(user_id)::BIGINT, 'union' FROM (SELECT * FROM p UNION SELECT * FROM c)""",
    "violations": f"""WITH {_TRUTH}, {EVENTS}, n AS (SELECT *, lead(start) OVER (PARTITION BY video_id, label ORDER BY start, "end") AS nx FROM pr),
      c AS (SELECT value100, t_us < lag(t_us) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM ev)
      SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN label NOT IN ('A', 'N') THEN 'unknown label' END, CASE WHEN start < 0 OR "end" > 2300 + 1e-6 THEN 'outside the video' END, CASE WHEN nx < "end" THEN 'overlap' END]) AS problem FROM n
        UNION ALL SELECT CASE WHEN back THEN 'time goes back' ELSE 'no score' END FROM c WHERE back OR value100 < 0 OR value100 IS NULL
        UNION ALL SELECT 'no prediction' FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT video_id FROM pr)) WHERE problem IS NOT NULL GROUP BY problem""",
    "prop_counts": "SELECT event_type, count(try_cast(props ->> '$.k' AS BIGINT)) AS n, sum(try_cast(props ->> '$.k' AS BIGINT))::BIGINT AS total, max(try_cast(props ->> '$.k' AS BIGINT)) AS most FROM events GROUP BY 1",
}
