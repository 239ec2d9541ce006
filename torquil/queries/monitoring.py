"""Profiles, quality, signatures, events, gaps and series."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from torquil import functions as X, plans, sources
from torquil.operators import profile as P, segment as S
from torquil.operators.timeline import Timeline
from torquil.queries import query, readings, table
from torquil.sources import shared, snapshot

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
CUTS = [60.0, 120.0, 300.0, 600.0, 900.0, 1200.0]
BOUNDS = [60.0, 120.0, 180.0, 240.0, 300.0, 600.0, 1200.0]
MEASURES = ("m1", "m1_in", "m2")
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
UNPIVOT = "SELECT {k} '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {t}"


def _long(columns, source, keys=""):
    return " UNION ALL ".join(UNPIVOT.format(k=keys, c=c, t=source) for c in columns)


# events in time order: a null or another value of a break column opens one
EVENTS = """e0 AS (SELECT *, date_diff('microsecond', lag(created_at) OVER w, created_at)/1e6 AS gap_s,
  (row_number() OVER w = 1 OR coalesce(fault <> lag(fault) OVER w, true) OR coalesce(rpm <> lag(rpm) OVER w, true)) AS opens FROM r WINDOW w AS (ORDER BY created_at, id)),
e1 AS (SELECT *, CAST(sum(opens::INT) OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM e0),
ev AS (SELECT event, count(*) AS n, min(created_at) AS start, max(created_at) AS "end", date_diff('microsecond', min(created_at), max(created_at))/1e6 AS duration_s,
  coalesce(max(gap_s) FILTER (NOT opens), 0.0) AS largest_gap_s, arg_min(fault, (created_at, id)) AS fault, arg_min(rpm, (created_at, id)) AS rpm FROM e1 GROUP BY event)"""
SPLIT = """s0 AS (SELECT *, dense_rank() OVER (ORDER BY fault, rpm) AS split_event FROM r)"""


@query("""WITH u AS (SELECT *, (row_number() OVER w = 1 OR coalesce(event_type <> lag(event_type) OVER w, true)) AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(o::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM u),
s AS (SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n, date_diff('microsecond', min(ts), max(ts))/1e6 AS d FROM g GROUP BY user_id, run)
SELECT event_type, count(*) AS runs, CAST(sum(n) AS BIGINT) AS readings, max(n) AS longest, round(sum(d)/3600, 6) AS hours FROM s GROUP BY event_type""")
def entity_runs(spark, d):
    """D-01..D-04 by entity, and G-A20 by label."""
    df = table(spark, d, "events")
    runs = S.numbered(df, Timeline.within(("user_id",), "ts", "event_id"), ("event_type",), "ts", name="run")
    s = runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), X.seconds(F.min("ts"), F.max("ts")).alias("d"))
    return s.groupBy("event_type").agg(F.count("*").alias("runs"), F.sum("n").alias("readings"), F.max("n").alias("longest"), F.round(F.sum("d") / 3600, 6).alias("hours"))


@query("WITH {r}, " + EVENTS + " SELECT event, n, start, \"end\", round(duration_s, 6) AS duration_s, round(duration_s/60, 6) AS duration_min, round(largest_gap_s, 6) AS largest_gap_s, fault, rpm FROM ev")
def events_order_first(spark, d):
    """D-04..D-06: event table."""
    return S.summary(S.events(readings(spark, d))).select("event", "n", "start", "end", *R6("duration_s", "duration_min", "largest_gap_s"), "fault", "rpm")


@query("""WITH {r}, e0 AS (SELECT *, (row_number() OVER w = 1 OR coalesce(fault <> lag(fault) OVER w, true) OR coalesce(date_diff('microsecond', lag(created_at) OVER w, created_at)/1e6 > 600, false)) AS o FROM r WINDOW w AS (ORDER BY created_at, id)),
e1 AS (SELECT *, sum(o::INT) OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS event FROM e0) SELECT id, CAST(event AS BIGINT) AS event FROM e1""")
def events_with_gap(spark, d):
    """D-02, D-03: label and gap of 600 s."""
    return S.events(readings(spark, d), ("fault",), gap_s=600.0).select("id", "event")


@query("""WITH n AS (SELECT *, CASE WHEN event_id%7=0 THEN NULL ELSE event_type END AS l FROM events),
e AS (SELECT *, (row_number() OVER w = 1 OR coalesce(l <> lag(l) OVER w, true)) AS o FROM n WINDOW w AS (ORDER BY ts, event_id))
SELECT event_id, CAST(sum(o::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM e""")
def null_breaks(spark, d):
    """D-01: every null opens a group, and so does the row after it."""
    df = table(spark, d, "events").withColumn("l", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return S.numbered(df, Timeline.by_time("ts", "event_id"), ("l",), "ts", name="grp").select("event_id", "grp")


@query("WITH {r}, " + SPLIT + " SELECT split_event AS event, count(*) AS n, any_value(fault) AS fault, any_value(rpm) AS rpm, min(created_at) AS start FROM s0 GROUP BY 1")
def events_split_first(spark, d):
    """D-07 without a gap."""
    return S.events_split_first(readings(spark, d)).groupBy("event").agg(F.count("*").alias("n"), F.first("fault").alias("fault"), F.first("rpm").alias("rpm"), F.min("created_at").alias("start"))


@query("""WITH {r}, a AS (SELECT *, coalesce(date_diff('microsecond', lag(created_at) OVER w, created_at)/1e6 > 20000, row_number() OVER w = 1) AS o FROM r WINDOW w AS (PARTITION BY fault, rpm ORDER BY created_at, id)),
b AS (SELECT *, sum(o::INT) OVER (ORDER BY fault, rpm, created_at, id ROWS UNBOUNDED PRECEDING) AS event FROM a) SELECT CAST(event AS BIGINT) AS event, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1""")
def events_split_first_gap(spark, d):
    """D-07 with a gap."""
    return S.events_split_first(readings(spark, d), gap_s=20000.0).groupBy("event").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH {r}, a AS (SELECT *, date_diff('microsecond', lag(created_at) OVER w, created_at)/1e6 AS g FROM r WINDOW w AS (PARTITION BY fault ORDER BY created_at, id)),
b AS (SELECT *, sum((coalesce(g > 600, false))::INT) OVER (PARTITION BY fault ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT id, CAST(session AS BIGINT) AS session, round(CASE WHEN g <= 600 THEN g END, 6) AS delta_s FROM b""")
def label_sessions(spark, d):
    """D-08."""
    return S.sessions(readings(spark, d), gap_s=600.0).select("id", "session", *R6("delta_s"))


GAPS = "g AS (SELECT *, date_diff('microsecond', lag(created_at) OVER w, created_at)/1e6 AS gap_s, coalesce(fault = lag(fault) OVER w, false) AS same FROM r WINDOW w AS (ORDER BY created_at, id))"


@query("WITH {r}, " + GAPS + " SELECT count(*) FILTER (same) AS gaps, round(quantile_cont(gap_s, 0.5) FILTER (same), 6) AS median_s, round(max(gap_s) FILTER (same), 6) AS largest_s, round(avg(gap_s) FILTER (same), 6) AS mean_s, round(sum(gap_s) FILTER (same AND gap_s > 600), 6) AS paused_s FROM g")
def same_label_gap_stats(spark, d):
    """D-09: statistics."""
    g = S.same_label_gaps(readings(spark, d)).where("same")
    return S.gap_stats(g, 600.0).select("gaps", *R6("median_s", "largest_s", "mean_s", "paused_s"))


@query("WITH {r}, " + GAPS + " SELECT CAST(c AS DOUBLE) AS cut_s, count(*) FILTER (NOT same OR coalesce(gap_s > c, false)) AS episodes FROM g, (SELECT unnest([60.0,120.0,300.0,600.0,900.0,1200.0]) AS c) GROUP BY c")
def episode_counts(spark, d):
    """D-09: episodes at every cut, in one pass."""
    return S.episode_counts(S.same_label_gaps(readings(spark, d)), CUTS)


@query("WITH {r}, " + GAPS + ", b AS (SELECT unnest([0.0,60.0,120.0,180.0,240.0,300.0,600.0,1200.0]) AS lo, unnest([60.0,120.0,180.0,240.0,300.0,600.0,1200.0,NULL]) AS hi) SELECT CAST(lo AS DOUBLE) AS low_s, CAST(hi AS DOUBLE) AS high_s, count(*) FILTER (same AND gap_s > lo AND (hi IS NULL OR gap_s <= hi)) AS gaps, count(*) FILTER (same AND gap_s > lo AND (hi IS NULL OR gap_s <= hi)) = 0 AS empty FROM g, b GROUP BY lo, hi")
def gap_bands(spark, d):
    """D-09: bands and which are empty."""
    return S.gap_bands(S.same_label_gaps(readings(spark, d)), BOUNDS)


@query("WITH {r}, " + EVENTS + ", t AS (SELECT max(event) AS k FROM e1) SELECT CAST(c AS DOUBLE) AS cut_s, count(DISTINCT event) FILTER (NOT opens AND gap_s > c) AS split, count(*) FILTER (NOT opens AND gap_s > c) AS cuts, any_value(k) + count(*) FILTER (NOT opens AND gap_s > c) AS groups FROM e1, t, (SELECT unnest([60.0,120.0,300.0,600.0,900.0,1200.0]) AS c) GROUP BY c")
def cut_effects(spark, d):
    """D-10."""
    return S.cut_effects(S.events(readings(spark, d)), CUTS)


@query("WITH {r}, " + EVENTS + """, p AS (SELECT gap_s AS g FROM e1 WHERE NOT opens AND gap_s > 0), q AS (SELECT quantile_cont(g, 0.25) AS q1, quantile_cont(g, 0.75) AS q3, quantile_cont(g, 0.5) AS m, quantile_cont(g, 0.998) AS p FROM p),
a AS (SELECT quantile_cont(abs(g - m), 0.5) AS mad FROM p, q), j AS (SELECT v, lead(v) OVER (ORDER BY v) / v AS ratio FROM (SELECT DISTINCT g AS v FROM p)), w AS (SELECT v FROM j WHERE ratio IS NOT NULL ORDER BY ratio DESC, v LIMIT 1)
SELECT 'tukey' AS rule, round(q3 + 1.5*(q3-q1), 6) AS cut_s FROM q UNION ALL SELECT 'tukey_extreme', round(q3 + 3*(q3-q1), 6) FROM q UNION ALL SELECT 'deviation', round(m + 10*mad/0.6745, 6) FROM q, a UNION ALL SELECT 'percentile', round(p, 6) FROM q UNION ALL SELECT 'jump', round(v, 6) FROM w""")
def automatic_cuts(spark, d):
    """D-11."""
    return S.automatic_cuts(S.events(readings(spark, d)).where("not opens")).select("rule", *R6("cut_s"))


@query("WITH {r}, " + EVENTS + ", j AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM (SELECT DISTINCT gap_s AS v FROM e1 WHERE NOT opens AND gap_s > 0)) SELECT round(v, 6) AS low_s, round(nx, 6) AS high_s, round(nx/v, 6) AS ratio FROM j WHERE nx IS NOT NULL ORDER BY nx/v DESC, v LIMIT 5")
def largest_jumps(spark, d):
    """D-11: jumps between neighbouring gaps (a top five)."""
    return S.largest_jumps(S.events(readings(spark, d)).where("not opens"), "gap_s", 5).select(*R6("low_s", "high_s", "ratio"))


@query("WITH {r}, " + EVENTS + """, s AS (SELECT avg(m1) AS a1, stddev_pop(m1) AS b1, avg(m2) AS a2, stddev_pop(m2) AS b2 FROM r), z AS (SELECT event, coalesce((m1-a1)/CASE WHEN b1=0 THEN 1 ELSE b1 END, 0) AS x, coalesce((m2-a2)/CASE WHEN b2=0 THEN 1 ELSE b2 END, 0) AS y FROM e1, s),
c AS (SELECT event, avg(x) AS cx, avg(y) AS cy FROM z GROUP BY event) SELECT event, round(avg(sqrt((x-cx)**2 + (y-cy)**2)), 6) AS dispersion FROM z JOIN c USING (event) GROUP BY event""")
def cohesion(spark, d):
    """D-12."""
    return S.cohesion(S.events(readings(spark, d)), ("m1", "m2")).select("event", *R6("dispersion"))


@query("WITH {r}, " + EVENTS + ", " + SPLIT + ", b AS (SELECT e1.event, split_event FROM e1 JOIN s0 USING (id)) SELECT count(DISTINCT event) AS a, count(DISTINCT split_event) AS b, count(DISTINCT (event, split_event)) AS \"both\", count(DISTINCT event) = count(DISTINCT split_event) AND count(DISTINCT event) = count(DISTINCT (event, split_event)) AS same FROM b")
def same_partition(spark, d):
    """D-13, J-04: both numberings bridged by the reading's id."""
    df = readings(spark, d)
    a, b = S.events(df).select("id", "event"), S.events_split_first(df).select("id", F.col("event").alias("split_event"))
    return S.same_partition(a.join(b, "id"), "event", "split_event")


@query("WITH {r}, " + EVENTS + ", " + SPLIT + """, a AS (SELECT fault, count(DISTINCT event) AS ordered FROM e1 GROUP BY fault), b AS (SELECT CASE WHEN fault = 'L3' THEN 'L3b' ELSE fault END AS fault, count(DISTINCT split_event) AS split FROM s0 GROUP BY 1)
SELECT coalesce(a.fault, b.fault) AS fault, coalesce(ordered, 0) AS ordered, coalesce(split, 0) AS split, coalesce(ordered, 0) - coalesce(split, 0) AS difference FROM a FULL JOIN b ON a.fault = b.fault""")
def label_differences(spark, d):
    """J-05, D-13: events of each label in both versions; a label that one lacks (here a renamed one) counts 0."""
    df = readings(spark, d)
    a = S.events(df).groupBy("fault").agg(F.count_distinct("event").alias("ordered"))
    renamed = F.when(F.col("fault") == "L3", "L3b").otherwise(F.col("fault"))
    b = S.events_split_first(df).withColumn("fault", renamed).groupBy("fault").agg(F.count_distinct("event").alias("split"))
    out = a.join(b, "fault", "full").select("fault", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ordered", "split")])
    return out.withColumn("difference", F.col("ordered") - F.col("split"))


@query("WITH {r}, f AS (SELECT *, rank() OVER (ORDER BY pos, created_at, id) AS ix, rank() OVER (ORDER BY created_at, id, pos) AS rk, date_diff('microsecond', lag(created_at) OVER (ORDER BY pos, created_at, id), created_at)/1e6 AS delta FROM r) SELECT count(*) AS \"rows\", count(*) FILTER (delta < 0) AS backward, round(least(min(delta), 0), 6) AS worst_s, count(*) FILTER (ix <> rk) AS misplaced FROM f")
def disorder(spark, d):
    """D-14."""
    return S.disorder(readings(spark, d), "pos").select("rows", "backward", *R6("worst_s"), "misplaced")


@query("WITH {r}, f AS (SELECT pos, lag(pos) OVER w AS previous_position, lag(created_at) OVER w AS previous_time, created_at AS \"time\", date_diff('microsecond', lag(created_at) OVER w, created_at)/1e6 AS delta_s FROM r WINDOW w AS (ORDER BY pos, created_at)) SELECT previous_position, pos, previous_time, \"time\", round(delta_s, 6) AS delta_s FROM f WHERE delta_s < 0 ORDER BY f.delta_s, pos, previous_position, \"time\" LIMIT 3")
def worst_backward(spark, d):
    """D-15 (a top three)."""
    return S.worst_backward(readings(spark, d), "pos", k=3).select("previous_position", "pos", "previous_time", "time", *R6("delta_s"))


@query("WITH {r}, " + EVENTS + " SELECT event, fault, n, round(largest_gap_s, 6) AS largest_gap_s FROM ev WHERE largest_gap_s > 600")
def suspicious_events(spark, d):
    """D-16."""
    return S.summary(S.events(readings(spark, d))).where("largest_gap_s > 600").select("event", "fault", "n", *R6("largest_gap_s"))


_CHECKS = """k AS (SELECT event, count(DISTINCT fault) + max((fault IS NULL)::INT) AS a, count(DISTINCT rpm) + max((rpm IS NULL)::INT) AS b FROM x GROUP BY event),
c AS (SELECT max(a) <= 1 AS one_fault, max(b) <= 1 AS one_rpm FROM k), n AS (SELECT count(*) FILTER (event IS NULL) = 0 AS assigned, max(event) = count(DISTINCT event) AND min(event) = 1 AS consecutive, count(*) = (SELECT count(*) FROM r) AS complete FROM x)
SELECT unnest(['one_fault', 'one_rpm', 'assigned', 'consecutive', 'complete']) AS "check", unnest([one_fault, one_rpm, assigned, consecutive, complete]) AS passed FROM c, n"""


@query("WITH {r}, " + EVENTS + ", x AS (SELECT * FROM e1), " + _CHECKS)
def event_invariants(spark, d):
    """D-17."""
    df = readings(spark, d)
    return S.invariants(S.events(df), total=df)


@query("WITH {r}, " + EVENTS + ", x AS (SELECT * REPLACE (CASE WHEN id%401 = 0 THEN NULL WHEN id%37 = 0 THEN event + 3 ELSE event END AS event) FROM e1), " + _CHECKS)
def broken_invariants(spark, d):
    """D-17 on events of which some rows went to another event, and some to none."""
    df = readings(spark, d)
    wrong = F.when(F.col("id") % 401 == 0, None).when(F.col("id") % 37 == 0, F.col("event") + 3).otherwise(F.col("event"))
    return S.invariants(S.events(df).withColumn("event", wrong), total=df)


@query("WITH {r}, " + EVENTS + ", " + SPLIT + """, z AS (SELECT split_event, date_diff('microsecond', lag(created_at) OVER (PARTITION BY split_event ORDER BY created_at, id), created_at)/1e6 AS g, * EXCLUDE (split_event) FROM s0)
SELECT 'A' AS version, event, fault, n, round(largest_gap_s, 6) AS largest_gap_s FROM ev UNION ALL SELECT 'B', split_event, any_value(fault), count(*), round(coalesce(max(g), 0), 6) FROM z GROUP BY split_event""")
def both_versions(spark, d):
    """D-18, U-01."""
    df = readings(spark, d)
    tables = [S.summary(e).withColumn("version", F.lit(v)) for v, e in (("A", S.events(df)), ("B", S.events_split_first(df)))]
    return tables[0].unionByName(tables[1]).select("version", "event", "fault", "n", *R6("largest_gap_s"))


@query("WITH {r}, " + EVENTS + " SELECT fault, count(*) AS events, CAST(sum(n) AS BIGINT) AS readings, round(quantile_cont(duration_s/60, 0.5), 6) AS median_min, round(sum(duration_s)/3600, 6) AS hours, min(start) AS first, max(\"end\") AS last, round(sum(n)/count(*), 6) AS readings_per_event FROM ev GROUP BY fault")
def events_per_label(spark, d):
    """G-A20."""
    return S.per_label(S.summary(S.events(readings(spark, d)))).select("fault", "events", "readings", *R6("median_min", "hours"), "first", "last", *R6("readings_per_event"))


SERIES = "b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY {k} ORDER BY created_at, id) - 1)/20) AS BIGINT) AS block FROM {t}), l AS (SELECT {k}, block, created_at, 'm1' AS \"column\", m1 AS v FROM b UNION ALL SELECT {k}, block, created_at, 'm2', m2 FROM b)"


@query("WITH {r}, " + SERIES.replace("{k}", "fault").replace("{t}", "r") + " SELECT fault, block, \"column\", min(created_at) AS time, round(quantile_cont(v, 0.5), 6) AS median, min(v) AS low, max(v) AS high FROM l GROUP BY 1, 2, 3")
def label_series(spark, d):
    """D-19."""
    return P.downsampled(readings(spark, d), ("m1", "m2"), ("fault",), "created_at", "id", 20).select("fault", "block", "column", "time", *R6("median"), "low", "high")


@query("WITH {r}, " + EVENTS + ", " + SERIES.replace("{k}", "event").replace("{t}", "e1") + " SELECT event, event % 2 AS parity, block, \"column\", min(created_at) AS time, round(quantile_cont(v, 0.5), 6) AS median FROM l GROUP BY 1, 2, 3, 4")
def event_series(spark, d):
    """D-20: never across an event, with alternating parity."""
    out = P.downsampled(S.events(readings(spark, d)), ("m1", "m2"), ("event",), "created_at", "id", 20)
    return out.select("event", (F.col("event") % 2).alias("parity"), "block", "column", "time", *R6("median"))


@query("WITH {r}, " + EVENTS + """, s AS (SELECT avg(m1) AS a, stddev_samp(m1) AS sd FROM r), z AS (SELECT event, created_at, id, (m1-a)/CASE WHEN sd=0 THEN 1 ELSE sd END AS z FROM e1, s),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY event ORDER BY created_at, id) - 1)/20) AS BIGINT) AS block FROM z), t AS (SELECT event, min(created_at) AS st FROM z GROUP BY event)
SELECT event, block, 'm1' AS "column", round(date_diff('microsecond', any_value(st), min(created_at))/6e7, 6) AS minutes, round(quantile_cont(z, 0.5), 6) AS z FROM b JOIN t USING (event) GROUP BY event, block""")
def event_profiles(spark, d):
    """D-21, P-04."""
    return P.event_profiles(S.events(readings(spark, d)), ("m1",), "event", "created_at", "id", 20).select("event", "block", "column", *R6("minutes", "z"))


@query("WITH {r}, a AS (SELECT pos, fault, (row_number() OVER w = 1 OR coalesce(fault <> lag(fault) OVER w, true) OR pos - lag(pos) OVER w > 1) AS o FROM r WINDOW w AS (ORDER BY pos, fault)), b AS (SELECT *, sum(o::INT) OVER (ORDER BY pos, fault RANGE UNBOUNDED PRECEDING) AS block FROM a), c AS (SELECT CAST(block AS BIGINT) AS block, any_value(fault) AS fault, min(pos) AS first, max(pos) AS last, count(*) AS n FROM b GROUP BY 1) SELECT *, lead(first) OVER (ORDER BY block) AS next_first, (first + last)/2 AS centre FROM c")
def file_blocks(spark, d):
    """D-22: blocks in file order, whose positions jump."""
    return P.file_blocks(readings(spark, d), "pos")


@query("WITH {r}, t AS (SELECT pos, fault, lag(fault) OVER w AS before, lag(pos) OVER w AS pp FROM r WINDOW w AS (ORDER BY pos, fault)) SELECT before, fault, count(*) AS n FROM t WHERE pp = pos - 1 AND before <> fault GROUP BY ALL")
def label_transitions(spark, d):
    """D-22: transitions between true neighbours."""
    out = Timeline(("pos", "fault")).previous(readings(spark, d), before="fault", pp="pos")
    return out.where("pp = pos - 1 and before <> fault").groupBy("before", "fault").agg(F.count("*").alias("n"))


@query("WITH {r} SELECT count(*) AS \"rows\", CAST(10 AS BIGINT) AS columns, count(DISTINCT fault) AS labels, count(*) FILTER (m1 IS NULL) + count(*) FILTER (m2 IS NULL) AS null_cells FROM r")
def table_summary(spark, d):
    """G-A01."""
    return P.table_summary(readings(spark, d))


@query("WITH n AS (SELECT count(*) AS n FROM events), {r}, c AS (SELECT 'm1' AS \"column\", count(*) FILTER (m1 IS NULL) AS nulls, count(DISTINCT m1) AS distinct_values FROM r UNION ALL SELECT 'fault', count(*) FILTER (fault IS NULL), count(DISTINCT fault) FROM r UNION ALL SELECT 'machine', count(*) FILTER (machine IS NULL), count(DISTINCT machine) FROM r) SELECT \"column\", nulls, round(100*nulls/n, 6) AS null_pct, n - nulls AS filled, distinct_values FROM c, n")
def nulls_by_column(spark, d):
    """G-A02."""
    return P.nulls_by_column(readings(spark, d).select("m1", "fault", "machine")).drop("type")


@query("WITH {r} SELECT fault, count(*) AS n, min(created_at) AS first, max(created_at) AS last, round(date_diff('microsecond', min(created_at), max(created_at))/3.6e9, 6) AS span_h, round(100*count(*)/(SELECT count(*) FROM r), 6) AS pct, fault <> 'L0' AS is_problem FROM r GROUP BY fault")
def label_profile(spark, d):
    """G-A03, P-05."""
    return P.label_profile(readings(spark, d)).select("fault", "n", "first", "last", *R6("span_h", "pct"), "is_problem")


@query("WITH {r}, t AS (SELECT date_trunc('minute', created_at) AS t, pos FROM r), a AS (SELECT t, t < lag(t) OVER (ORDER BY pos) AS b FROM t) SELECT min(t) AS start, max(t) AS \"end\", round(date_diff('microsecond', min(t), max(t))/8.64e10, 6) AS days, count(*) FILTER (b) = 0 AS monotonic, count(DISTINCT t) AS times, count(*) - count(DISTINCT t) AS repeated FROM a")
def time_span(spark, d):
    """G-A04."""
    df = readings(spark, d).withColumn("created_at", F.date_trunc("minute", "created_at").cast("timestamp_ntz"))
    return P.time_span(df, "pos").select("start", "end", *R6("days"), "monotonic", "times", "repeated")


@query("WITH {r}, g AS (SELECT date_diff('microsecond', lag(created_at) OVER (ORDER BY created_at, id), created_at)/1e6 AS g FROM r) SELECT round(quantile_cont(g, 0.5), 6) AS median_s, round(quantile_cont(g, 0.05), 6) AS p05_s, round(quantile_cont(g, 0.95), 6) AS p95_s, round(100*count(*) FILTER (abs(g-180) <= 60)/count(g), 6) AS on_cadence_pct, count(*) FILTER (g > 900) AS cuts, count(*) FILTER (g > 900) + 1 AS sessions, max(g) AS largest_s FROM g")
def sampling_rate(spark, d):
    """G-A05."""
    return P.sampling_rate(readings(spark, d), cadence_s=180.0, slack_s=60.0, cut_s=900.0).select(*R6("median_s", "p05_s", "p95_s", "on_cadence_pct"), "cuts", "sessions", "largest_s")


@query("WITH {r}, g AS (SELECT date_diff('microsecond', lag(created_at) OVER (ORDER BY pos, created_at), created_at)/1e6 AS d FROM r) SELECT count(*) FILTER (d < 0) AS backward, round(100*count(*) FILTER (d < 0)/count(d), 6) AS backward_pct, round(min(d) FILTER (d < 0), 6) AS worst_s, round(quantile_cont(d, 0.5) FILTER (d >= 0), 6) AS median_forward_s FROM g")
def file_jumps(spark, d):
    """G-A06."""
    return P.file_jumps(readings(spark, d), "pos").select("backward", *R6("backward_pct", "worst_s", "median_forward_s"))


@query(f"WITH l AS ({_long(LINE, 'lineitem')}), c AS (SELECT \"column\", value, count(*) AS k FROM l GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM lineitem), t AS (SELECT \"column\", value, k, row_number() OVER (PARTITION BY \"column\" ORDER BY k DESC, value) AS i, count(*) OVER (PARTITION BY \"column\") AS dv FROM c) SELECT \"column\", dv AS distinct_values, value AS mode, round(100*k/n, 6) AS mode_pct, dv <= 1 AS constant FROM t, n WHERE i = 1")
def dominant_values(spark, d):
    """G-A07."""
    return P.dominant_values(table(spark, d, "lineitem"), LINE).select("column", "distinct_values", "mode", *R6("mode_pct"), "constant")


@query("WITH {r} SELECT 'm1_in' AS source, 'm1' AS target, round(max(abs(m1 - m1_in*25.4)), 6) AS max_error, round(avg(abs(m1 - m1_in*25.4)), 6) AS mean_error, max(abs(m1 - m1_in*25.4)) <= 0.02 AS redundant FROM r UNION ALL SELECT 'm2', 'm1', round(max(abs(m1 - m2*25.4)), 6), round(avg(abs(m1 - m2*25.4)), 6), max(abs(m1 - m2*25.4)) <= 0.02 FROM r")
def unit_redundancy(spark, d):
    """G-A08."""
    return P.unit_redundancy(readings(spark, d), [("m1_in", "m1", 25.4, 0.0), ("m2", "m1", 25.4, 0.0)]).select("source", "target", *R6("max_error", "mean_error"), "redundant")


@query("WITH {r}, x AS (SELECT pos, CASE WHEN id%13=0 THEN NULL ELSE fault END AS l, floor(m1/500) AS v FROM r), y AS (SELECT *, coalesce(v = lag(v) OVER w, false) AND coalesce(l = lag(l) OVER w, true) AND row_number() OVER w > 1 AS dup FROM x WINDOW w AS (ORDER BY pos, l NULLS FIRST, v NULLS FIRST)) SELECT l, count(*) AS n, count(*) FILTER (dup) AS duplicates FROM y GROUP BY l")
def consecutive_duplicates(spark, d):
    """G-A09."""
    df = readings(spark, d).select("pos", F.when(F.col("id") % 13 != 0, F.col("fault")).alias("l"), F.floor(F.col("m1") / 500).alias("v"))
    return P.consecutive_duplicates(df, "pos", "l", ("v",))


@query("WITH {r}, x AS (SELECT date_trunc('hour', created_at) AS t, * FROM r) SELECT t, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS labels, min(id) AS first_id, max(id) AS last_id, greatest(count(DISTINCT rpm), count(DISTINCT fault)) = 1 AS identical, count(*) - count(DISTINCT (rpm, fault)) AS repeated, max(id) - min(id) + 1 = count(*) AS contiguous FROM x GROUP BY t HAVING count(*) > 1")
def repeated_times(spark, d):
    """G-A10."""
    df = readings(spark, d).withColumn("t", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
    return P.repeated_times(df, "t", "event_type", "id", ("rpm", "fault"))


_TUKEY = "SELECT {k} \"column\", count(*) AS n, round(any_value(q1-1.5*i), 6) AS low, round(any_value(q3+1.5*i), 6) AS high, count(*) FILTER (value < q1-1.5*i OR value > q3+1.5*i) AS moderate, count(*) FILTER (value < q1-3*i OR value > q3+3*i) AS extreme FROM l JOIN q USING ({u} \"column\") GROUP BY {k} \"column\""


@query(f"WITH l AS ({_long(LINE, 'lineitem')}), q AS (SELECT \"column\", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM l GROUP BY 1) " + _TUKEY.replace("{k}", "").replace("{u}", ""))
def tukey_outliers(spark, d):
    """G-A11."""
    return P.tukey_outliers(table(spark, d, "lineitem"), LINE).select("column", "n", *R6("low", "high"), "moderate", "extreme")


@query(f"WITH l AS ({_long(LINE, 'lineitem', 'l_returnflag,')}), q AS (SELECT l_returnflag, \"column\", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM l GROUP BY 1, 2) " + _TUKEY.replace("{k}", "l_returnflag,").replace("{u}", "l_returnflag,"))
def tukey_outliers_by_label(spark, d):
    """G-A12."""
    return P.tukey_outliers(table(spark, d, "lineitem"), LINE, ("l_returnflag",)).select("l_returnflag", "column", "n", *R6("low", "high"), "moderate", "extreme")


@query("SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice FROM lineitem GROUP BY 1 HAVING count(*) >= 10")
def signatures(spark, d):
    """G-A14."""
    return P.signatures(table(spark, d, "lineitem"), ("l_quantity", "l_extendedprice"), "l_returnflag", 10).select("l_returnflag", "n", *R6("l_quantity", "l_extendedprice"))


@query("WITH {r}, l AS (SELECT fault, 'm1' AS \"column\", m1 AS v FROM r UNION ALL SELECT fault, 'm2', m2 FROM r) SELECT fault, \"column\", count(v) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_samp(v)/nullif(abs(avg(v)), 0), 6) AS cv, min(v) AS min, max(v) AS max FROM l GROUP BY 1, 2")
def described_labels(spark, d):
    """G-A15."""
    return P.described(readings(spark, d), ("m1", "m2"), ("fault",)).select("fault", "column", "n", *R6("median", "q1", "q3", "mean", "std", "cv"), "min", "max")


@query("WITH {r}, l AS (SELECT fault, 'm1' AS \"column\", m1 AS v FROM r UNION ALL SELECT fault, 'm2', m2 FROM r), g AS (SELECT \"column\", quantile_cont(v, 0.5) AS gm FROM l GROUP BY 1), o AS (SELECT fault, \"column\", quantile_cont(v, 0.5) AS m FROM l GROUP BY 1, 2) SELECT fault, \"column\", round(m, 6) AS median, round(gm, 6) AS global_median, round(100*(m-gm)/nullif(abs(gm), 0), 6) AS deviation_pct FROM o JOIN g USING (\"column\")")
def against_global(spark, d):
    """G-A16."""
    return P.against_global(readings(spark, d), ("m1", "m2")).select("fault", "column", *R6("median", "global_median", "deviation_pct"))


@query("WITH {r}, c AS (SELECT max(abs(m1 - m1_in*25.4)) AS e1, max(abs(m1 - m2*25.4)) AS e2, count(DISTINCT m1) AS d1, count(DISTINCT m2) AS d2, count(DISTINCT m1 - m1) AS d0 FROM r), x AS (SELECT 'm1_in' AS \"column\", 'unit copy' AS reason, 1 AS p FROM c WHERE e1 <= 0.02 UNION ALL SELECT 'm2', 'unit copy', 1 FROM c WHERE e2 <= 0.02 UNION ALL SELECT unnest(['id', 'created_at']), 'leak', 2 FROM c UNION ALL SELECT 'm1', 'constant', 3 FROM c WHERE d1 <= 1 UNION ALL SELECT 'm2', 'constant', 3 FROM c WHERE d2 <= 1 UNION ALL SELECT 'zero', 'constant', 3 FROM c WHERE d0 <= 1) SELECT \"column\", arg_min(reason, p) AS reason FROM x GROUP BY 1")
def droppable_columns(spark, d):
    """G-A17: of a pair of units the copy goes, of m1 and m1_in the one in inches."""
    df = readings(spark, d).withColumn("zero", F.col("m1") - F.col("m1"))
    return P.droppable(df, ("m1", "m2", "zero"), [("m1_in", "m1", 25.4, 0.0, "m1_in"), ("m2", "m1", 25.4, 0.0, "m2")], ("id", "created_at"))


@query("WITH {r} SELECT fault, min(pos) AS first_position FROM r GROUP BY fault")
def labels_by_appearance(spark, d):
    """G-A19."""
    return readings(spark, d).groupBy("fault").agg(F.min("pos").alias("first_position")).orderBy("first_position")


@query("WITH {r}, f AS (SELECT *, row_number() OVER (ORDER BY pos, id, created_at, m1 NULLS FIRST, m2 NULLS FIRST) AS ix FROM r WHERE fault IN ('L1', 'L2')) SELECT ix, pos, id, fault, round(m1/nullif(m2, 0), 6) AS axis_ratio FROM f WHERE ix > 50 AND ix <= 150")
def file_slice(spark, d):
    """P-01..P-03: label filter, a slice in file order (its offset and limit are the feature), zero-safe ratio."""
    df = Timeline(("pos", "id", "created_at", "m1", "m2")).row_number(readings(spark, d).where(F.col("fault").isin("L1", "L2")), "ix").where("ix > 50 and ix <= 150")
    return P.with_ratio(df, "m1", "m2").select("ix", "pos", "id", "fault", *R6("axis_ratio"))


@query("WITH {r}, s AS (SELECT avg(m1) AS a, stddev_samp(m1) AS sd FROM r) SELECT id, round(CASE WHEN sd > 0 THEN (m1-a)/sd ELSE 0 END, 6) AS z_m1 FROM r, s")
def z_scores(spark, d):
    """P-04, D-22: z-values by the whole table."""
    return P.standardised(readings(spark, d), ("m1",), zero_as_one=False).select("id", *R6("z_m1"))


@query("WITH {r}, " + EVENTS + ", " + SPLIT + """, b AS (SELECT count(DISTINCT split_event) AS n FROM s0) SELECT 'readings' AS name, '' AS version, count(*) AS n FROM r UNION ALL SELECT 'events', 'A', count(*) FROM ev UNION ALL SELECT 'events', 'B', n FROM b UNION ALL SELECT 'documents', '', count(*) FROM documents UNION ALL SELECT 'sections', '', count(*) FROM embeddings WHERE vec_id%4 <> 0""")
def rebuilt_tables(spark, d):
    """A-05..A-08, A-10, J-03: all tables stored twice in the shared folder, the second time in place of the first, and read back; sections without a vector don't count."""
    path = f"{shared.folder(spark)}/tables-{uuid.uuid4().hex}"
    df = readings(spark, d)
    documents = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    sections = table(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("embedding"))
    plans.rebuild(df.where("id % 2 = 0"), path, ("m1", "m2"))
    plans.rebuild(df, path, ("m1", "m2"), documents, sections)
    now = snapshot.latest(spark, path)
    counted = lambda name, df, version=F.lit(""): df.groupBy(version.alias("version")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "version", "n")
    parts = [counted("readings", now.read("readings")), counted("events", now.read("events"), F.col("version")), counted("documents", now.read("documents")), counted("sections", sources.with_vectors(now.read("sections")))]
    return reduce(lambda a, b: a.unionByName(b), parts)
