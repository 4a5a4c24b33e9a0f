"""Queries over text records, scalar functions and streams, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import geometry as G
from terraloom.plans.inputs import table
from terraloom.plans.registry import query, rounded
from terraloom.sources import text
from terraloom.streaming import cursor, frames


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y, l_tax AS z, l_shipdate::DATE::VARCHAR AS file FROM lineitem WHERE l_linenumber <> 3")
def csv_points(spark, d):
    t = table(spark, d, "lineitem")
    line = F.concat_ws(", ", F.col("l_shipdate").cast("date").cast("string"), "l_tax", F.lit("skipped"), "l_extendedprice", "l_quantity")
    lines = t.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return text.parse_points(lines, "1:file 4:x 5:y 2:z", ("l_orderkey", "l_linenumber"))


@query("SELECT c_custkey, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, c_name || '=' || c_mktsegment AS joined FROM customer")
def settings_map(spark, d):
    t = table(spark, d, "customer")
    line = F.concat(F.lit("SEG="), "c_mktsegment", F.lit("  NATION="), F.col("c_nationkey").cast("string"), F.lit(" JOINED="), "c_name", F.lit("="), "c_mktsegment")
    m = t.select("c_custkey", text.parse_settings(line).alias("m"))
    return m.select("c_custkey", F.col("m")["SEG"].alias("segment"), F.col("m")["NATION"].alias("nation"), F.col("m")["JOINED"].alias("joined"))


@query("SELECT s_name AS image, s_acctbal AS mean, s_nationkey::DOUBLE AS num FROM supplier")
def report_table(spark, d):
    t = table(spark, d, "supplier")
    lines = t.select(F.concat_ws(", ", "s_name", F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string")).alias("value"))
    return text.parse_report(lines, "# image, num, mean", ["image"], ["mean", "num"])


@query("SELECT l_orderkey, l_linenumber, trunc(least(greatest(l_extendedprice - 40000, -32768), 32767))::SMALLINT AS int16, trunc(least(greatest(l_quantity * 7 - 20, 0), 255))::SMALLINT AS uint8, (round((l_extendedprice - 1000) / 0.125) * 0.125)::FLOAT::DOUBLE AS stored FROM lineitem")
def pixel_codes(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", text.as_pixel(F.col("l_extendedprice") - 40000, "int16").alias("int16"), text.as_pixel(F.col("l_quantity") * 7 - 20, "uint8").alias("uint8"), text.rounded_offset(F.col("l_extendedprice"), 1000, 0.125).cast("double").alias("stored"))


_LLH = "q AS (SELECT c_custkey, c_nationkey * 14.5 - 180 AS lon, c_acctbal / 125 AS lat, c_acctbal AS h FROM customer), e AS (SELECT *, 6378137.0 / sqrt(1 - (1 - pow(6356752.314245179 / 6378137.0, 2)) * pow(sin(radians(lat)), 2)) AS n FROM q)"


@query(f"""WITH {_LLH} SELECT c_custkey, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) AS y,
round((pow(6356752.314245179 / 6378137.0, 2) * n + h) * sin(radians(lat)), 3) AS z, round(lon - 360 * round((lon - 100) / 360), 6) AS near_100 FROM e""")
def geodetic_to_cartesian(spark, d):
    q = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 14.5 - 180).alias("lon"), (F.col("c_acctbal") / 125).alias("lat"), F.col("c_acctbal").alias("h"))
    x, y, z = G.cartesian(F.col("lon"), F.col("lat"), F.col("h"))
    out = q.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"), G.recentred(F.col("lon"), 100).alias("near_100"))
    return rounded(rounded(out, "x", "y", "z", digits=3), "near_100")


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 + 1 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(degrees(acos((a + 2 * b + 3 * c) / (sqrt(a * a + b * b + c * c) * sqrt(14)))), 5) AS angle, round(greatest(0, (a + 2 * b + 3 * c) / (sqrt(a * a + b * b + c * c) * sqrt(14))), 6) AS shade,
round(3 * sin(2 * pi() * a / 7 + 0.5) + sin(2 * pi() * a / 2.5), 6) AS jitter, round(pow(least(a, 30) / 30, 1.5), 6) AS weight, round(a * 0.04 + 12, 6) AS at_time FROM q""")
def point_functions(spark, d):
    t = table(spark, d, "lineitem")
    v, w = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100 + 1], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    a = F.col("l_quantity")
    out = t.select("l_orderkey", "l_linenumber", G.angle_between(v, w).alias("angle"), G.lambertian(v, w).alias("shade"), G.jitter(a, [(3, 7, 0.5), (1, 2.5, 0)]).alias("jitter"), G.plateau(a, 30, 1.5).alias("weight"), G.time_of_line(a, 12, 0.04).alias("at_time"))
    return rounded(rounded(out, "shade", "jitter", "weight", "at_time"), "angle", digits=5)


@query("SELECT event_id, round(epoch_us(ts) / 1000000.0 - 946684800, 6)::DOUBLE AS seconds FROM events")
def frame_seconds(spark, d):
    return rounded(table(spark, d, "events").select("event_id", G.seconds_since_2000(F.col("ts")).alias("seconds")), "seconds")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    found = frames.final_state(frames.windowed(frames.frame_stream(spark, d, "events.parquet"), ["event_type"], "value", "1 hour"), "windows")
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", digits=4)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    found = frames.final_state(frames.sessions(frames.frame_stream(spark, d, "events.parquet"), ["user_id"], "30 minutes"), "sessions")
    return found.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("start", "end")})


def _asked(spark, d):
    """Clicks ask for the frames before and after them."""
    stream = frames.frame_stream(spark, d, "events.parquet")
    return stream.select("user_id", F.unix_micros("ts").alias("t"), (F.col("event_type") == "click").alias("asked"), F.col("event_id").alias("id"), "value")


_CURSOR = """c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(event_id) AS ref, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY ALL),
p AS (SELECT c.event_id AS id, c.user_id::VARCHAR AS user_id, c.ts, b.ref AS before, f.ref AS after, b.ts AS bt, f.ts AS ft, b.value AS bv, f.value AS fv
  FROM c ASOF LEFT JOIN v b ON c.user_id = b.user_id AND c.ts >= b.ts ASOF JOIN v f ON c.user_id = f.user_id AND c.ts <= f.ts)"""


@query(f"WITH {_CURSOR} SELECT user_id, id, before, after FROM p")
def cursor_frames(spark, d):
    """A forward-only cursor: the frames before and after each click, for clicks with a later frame."""
    return cursor.run_forward(cursor.between(_asked(spark, d), "user_id", ["value"]), "cursor").select("user_id", "id", "before", "after")


@query(f"WITH {_CURSOR} SELECT user_id, id, round(bv + (CASE WHEN ft > bt THEN (epoch_us(ts) - epoch_us(bt)) / (epoch_us(ft) - epoch_us(bt)) ELSE 0 END) * (fv - bv), 6) AS value FROM p WHERE before IS NOT NULL")
def stream_interpolation(spark, d):
    """Values between the samples around each click, as samples come in."""
    found = cursor.run_forward(cursor.between(_asked(spark, d), "user_id", ["value"]), "interpolation")
    return rounded(cursor.interpolated(found, ["value"]).select("user_id", "id", "value"), "value")
