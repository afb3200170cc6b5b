"""Queries on irregular series (events by user) and on intervals (line items by customer): runs, merges, as-of joins and such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.operators import sequences as Q
from kerbside.operators import temporal as T
from kerbside.plans.derived import EVENTS, event_series
from kerbside.session import table

USER = ["user_id"]
HOUR = 3_600_000_000
GAP = 12 * HOUR


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of purchases with gaps of up to 12 hours."""
    return Q.runs(event_series(spark, sf_dir), USER, "t_us", "value100 >= 3000", GAP)


def enter_leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.enter_leave(event_series(spark, sf_dir), USER, "t_us", "value100 >= 3000")


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("user_id", "event_id", Q.hysteresis(USER, "t_us", "value100", 6000, 2000).alias("state"))


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the value crosses 40, by linear interpolation (whole seconds)."""
    rows = event_series(spark, sf_dir).withColumn("side", (F.col("value100") - 4000).cast("double")).withColumn("t", F.col("t_us") / 1_000_000)
    return Q.crossings(rows, USER, "t", "side").groupBy("user_id", "new_sign").agg(F.count("*").alias("n"), F.min(F.floor("t")).alias("first_s"))


def trailing_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("user_id", "event_id", Q.trailing_minimum(USER, "t_us", "value100", 24 * 3600, 12 * 3600).cast("bigint").alias("least"))


def decayed_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running peak with a half-life of a day."""
    rows = event_series(spark, sf_dir).where("value100 > 0").withColumn("days", F.col("t_us") / (24.0 * HOUR))
    return rows.select("user_id", "event_id", F.round(Q.decayed_peak(USER, "days", "value100"), 2).alias("peak")).select("user_id", "event_id", F.round(F.col("peak")).cast("bigint").alias("peak"))


def k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.k_of_n(event_series(spark, sf_dir), USER, "t_us", "value100 >= 3000", 3, 4).select("user_id", "event_id", "persistent")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("user_id", "event_id", Q.held(USER, "t_us", F.col("value100") >= 3000, 2).alias("held"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of any events, gaps of up to 12 hours."""
    return Q.runs(event_series(spark, sf_dir), USER, "t_us", "true", GAP).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max(F.col("end") - F.col("start")).alias("longest_us"), F.max("n").alias("most"))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick each day for each user."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day")).withColumn("tick_us", F.col("day").cast("bigint") * 24 * HOUR)


def _asof(direction: str, clamp: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        right = event_series(spark, sf_dir).select("user_id", "t_us", "event_id", "value100")
        return T.asof(_ticks(spark, sf_dir), right, USER, "tick_us", "t_us", direction, "event_id", clamp).select("user_id", "day", "event_id", "value100")

    return query


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals from the order's date to its last shipment, in days: cust, order, start, end."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("ship"), F.max("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("order"), day("o_orderdate").alias("start"))
    return orders.join(items, F.col("order") == F.col("l_orderkey")).select("cust", "order", "flag", "start", F.greatest("ship", "start").alias("end"))


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.merge_segments(intervals(spark, sf_dir), ["cust"], 30)


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that overlap in time."""
    a = intervals(spark, sf_dir).select("cust", F.col("order").alias("a"), F.col("start").alias("s0"), F.col("end").alias("e0"))
    b = intervals(spark, sf_dir).select("cust", F.col("order").alias("b"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    return T.overlap_join(a, b, ["cust"], ("s0", "e0"), ("s1", "e1"), 90, F.col("a") < F.col("b")).select("cust", "a", "b")


def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open on the first day of each quarter."""
    days = intervals(spark, sf_dir).select("cust").distinct().select("cust", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2400).cast("bigint"), F.lit(91).cast("bigint"))).alias("day"))
    found = T.stab_join(days, intervals(spark, sf_dir), ["cust"], "day", ("start", "end"), 90)
    return found.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("cust").alias("customers"))


def final_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as raw events of their customer's video, cleaned up: clipped, merged per label, short ones dropped."""
    rows = intervals(spark, sf_dir).withColumn("video_id", F.col("cust").cast("string"))
    raw = rows.select("video_id", "start", "end", F.col("flag").alias("label"), F.array(F.col("order").cast("bigint")).alias("tids"))
    videos = rows.select("video_id").distinct().withColumn("duration", F.lit(2000).cast("bigint"))
    out = Q.finalize(raw, videos, {"A": 5.0, "N": 0.0}, {"A": 30.0})
    return out.select("video_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label", F.size("tids").cast("bigint").alias("n_tids"))


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event of a user."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("t_us"))
    return event_series(spark, sf_dir).withColumn("k", k - 1).where("k % 3 = 0").select("user_id", "event_id")


def signal_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the state 'value at least 30' has held at each sample, and when it next ends."""
    own = Window.partitionBy("user_id").orderBy("t_us")
    on = F.col("value100") >= 3000
    off_at = F.when(~on, F.col("t_us"))
    since = F.col("t_us") - F.coalesce(F.last(off_at, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.first("t_us").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    following = F.first(off_at, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))
    return event_series(spark, sf_dir).select("user_id", "event_id", since.alias("red_us"), following.alias("next_green_us"))


QUERIES = {
    "runs": runs, "enter_leave": enter_leave, "hysteresis": hysteresis, "line_crossings_1d": crossings, "trailing_minimum": trailing_minimum, "decayed_peak": decayed_peak, "k_of_n": k_of_n, "held": held,
    "sessions": session_windows, "nearest_asof": _asof("nearest"), "forward_asof": _asof("forward"), "backward_asof": _asof("backward"), "forward_asof_clamped": _asof("forward", True),
    "merge_segments": merged_intervals, "overlap_join": overlap_join, "interval_stab": interval_stab, "finalize": final_events, "thinned": thinned, "signal_age": signal_age,
}

_RUNS = """g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM ev WHERE {flag} WINDOW w AS (PARTITION BY user_id ORDER BY t_us)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t_us) AS run FROM g),
r AS (SELECT user_id, min(t_us) AS start, max(t_us) AS "end", count(*) AS n FROM n GROUP BY user_id, run)"""
_IV = """it AS (SELECT l_orderkey, max(l_shipdate::DATE - DATE '1992-01-01') AS ship, max(l_returnflag) AS flag FROM lineitem GROUP BY 1),
iv AS (SELECT o_custkey AS cust, o_orderkey AS "order", flag, (o_orderdate::DATE - DATE '1992-01-01')::BIGINT AS start, greatest(ship, o_orderdate::DATE - DATE '1992-01-01')::BIGINT AS "end" FROM orders JOIN it ON o_orderkey = l_orderkey)"""
_TICKS = f"ticks AS (SELECT user_id, d::INT AS day, d * {24 * HOUR} AS tick_us FROM (SELECT DISTINCT user_id FROM events), range(30) d(d))"


def _near(order: str, where: str = "true") -> str:
    return f"""WITH {EVENTS}, {_TICKS}, j AS (SELECT t.user_id, t.day, e.event_id, e.value100, row_number() OVER (PARTITION BY t.user_id, t.day ORDER BY {order}) AS k
      FROM ticks t LEFT JOIN ev e ON e.user_id = t.user_id AND {where}) SELECT user_id, day, event_id, value100 FROM j WHERE k = 1"""


ORACLE_SQL = {
    "runs": f'WITH {EVENTS}, {_RUNS.format(gap=GAP, flag="value100 >= 3000")} SELECT * FROM r',
    "sessions": f'WITH {EVENTS}, {_RUNS.format(gap=GAP, flag="true")} SELECT user_id, count(*) AS sessions, max("end" - start) AS longest_us, max(n) AS most FROM r GROUP BY user_id',
    "enter_leave": f"""WITH {EVENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS i FROM ev), b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS run FROM a WHERE value100 >= 3000)
      SELECT user_id, min(t_us) AS start, max(t_us) AS "end", count(*) AS n FROM b GROUP BY user_id, run""",
    "hysteresis": f"WITH {EVENTS} SELECT user_id, event_id, coalesce(last_value(CASE WHEN value100 >= 6000 THEN true WHEN value100 < 2000 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING), false) AS state FROM ev",
    "line_crossings_1d": f"""WITH {EVENTS}, p AS (SELECT user_id, t_us / 1e6 AS t0, value100 - 4000.0 AS s0, lead(t_us / 1e6) OVER w AS t1, lead(value100 - 4000.0) OVER w AS s1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us))
      SELECT user_id, sign(s1)::INT AS new_sign, count(*) AS n, min(floor(t0 + (t1 - t0) * (s0 / (s0 - s1))))::BIGINT AS first_s FROM p WHERE s0 <> 0 AND sign(s0) <> sign(s1) GROUP BY ALL""",
    "trailing_minimum": f"WITH {EVENTS} SELECT user_id, event_id, CASE WHEN t_us - min(t_us) OVER w < {12 * HOUR} THEN 0 ELSE min(value100) OVER w END AS least FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW)",
    "decayed_peak": f"WITH {EVENTS}, a AS (SELECT *, t_us / ({24 * HOUR}::DOUBLE) AS d FROM ev WHERE value100 > 0) SELECT user_id, event_id, round(round(pow(2.0, max(log2(value100) + d) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) - d), 2))::BIGINT AS peak FROM a",
    "k_of_n": f"WITH {EVENTS} SELECT user_id, event_id, value100 >= 3000 AND sum((value100 >= 3000)::INT) OVER (PARTITION BY user_id ORDER BY t_us ROWS 3 PRECEDING) >= 3 AS persistent FROM ev",
    "held": f"WITH {EVENTS} SELECT user_id, event_id, value100 >= 3000 AND coalesce(lead(value100) OVER (PARTITION BY user_id ORDER BY t_us) >= 3000, false) AS held FROM ev",
    "nearest_asof": _near("abs(e.t_us - t.tick_us), e.t_us, e.event_id"),
    "forward_asof": _near("e.t_us, e.event_id", "e.t_us >= t.tick_us"),
    "backward_asof": _near("e.t_us DESC, e.event_id", "e.t_us <= t.tick_us"),
    "forward_asof_clamped": _near("(e.t_us < t.tick_us), abs(e.t_us - t.tick_us), e.event_id"),
    "merge_segments": f"""WITH {_IV}, a AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY cust ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 30 THEN 0 ELSE 1 END AS fresh FROM iv),
      b AS (SELECT *, sum(fresh) OVER (PARTITION BY cust ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT cust, min(start) AS start, max("end") AS "end", count(*) AS n FROM b GROUP BY cust, run""",
    "overlap_join": f'WITH {_IV} SELECT x.cust, x."order" AS a, y."order" AS b FROM iv x JOIN iv y ON x.cust = y.cust AND x."order" < y."order" AND x.start <= y."end" AND y.start <= x."end"',
    "interval_stab": f'WITH {_IV} SELECT d::BIGINT AS day, count(*) AS n, count(DISTINCT cust) AS customers FROM iv, range(0, 2401, 91) d(d) WHERE d BETWEEN start AND "end" GROUP BY d',
    "finalize": f"""WITH {_IV}, raw AS (SELECT cust::VARCHAR AS video_id, greatest(start, 0) AS s, least("end", 2000) AS e, flag AS label, "order" FROM iv),
      a AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= CASE label WHEN 'A' THEN 5 WHEN 'N' THEN 0 ELSE 1 END THEN 0 ELSE 1 END AS fresh FROM raw),
      b AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM a)
      SELECT video_id, min(s) AS start, max(e) AS "end", label, count(DISTINCT "order") AS n_tids FROM b GROUP BY video_id, label, run HAVING max(e) - min(s) >= CASE label WHEN 'A' THEN 30 ELSE 0.5 END""",
    "thinned": f"WITH {EVENTS} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us) - 1 AS k FROM ev) WHERE k % 3 = 0",
    "signal_age": f"""WITH {EVENTS} SELECT user_id, event_id, t_us - coalesce(last_value(CASE WHEN value100 < 3000 THEN t_us END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(t_us) OVER (w ROWS UNBOUNDED PRECEDING)) AS red_us,
      first_value(CASE WHEN value100 < 3000 THEN t_us END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_green_us FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us)""",
}
