"""Queries of grouped summaries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import aggregates as A
from .registry import query

MODES = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4, "refund": 5}


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice) AS mean_price,
 round(count(l_quantity) / sum(1 / greatest(l_quantity, 1e-9)), 6) AS harmonic_quantity FROM lineitem GROUP BY ALL ORDER BY mean_price, l_returnflag, l_linestatus""")
def harmonic_summary(t):
    out = A.codec_summary(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_extendedprice": "mean_price"}, {"l_quantity": "harmonic_quantity"})
    return out.withColumn("harmonic_quantity", F.round("harmonic_quantity", 6)).orderBy("mean_price", "l_returnflag", "l_linestatus")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice, o_orderkey")
def group_detail(t):
    return t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy("o_orderpriority", "o_totalprice", "o_orderkey")


@query("""SELECT event_type, count(v) AS samples, printf('%.1f', CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / count(v)) AS avg_us, min(v) AS min_us, max(v) AS max_us,
 count(*) FILTER (WHERE value = 0) AS zeros FROM (SELECT *, CASE WHEN value > 0 THEN value END AS v FROM (SELECT event_type, CASE WHEN user_id % 10 = 0 THEN 0.0 ELSE value END AS value FROM events)) GROUP BY event_type""")
def metric_bundle(t):
    return A.metric_bundle(t.events.withColumn("value", F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("value"))), ["event_type"], "value")


_THIRD = "CASE l_linenumber % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'middle' ELSE 'end' END"


@query(f"""WITH w AS (SELECT l_returnflag, {_THIRD} AS win, l_quantity FROM lineitem)
 SELECT l_returnflag, CASE WHEN grouping(win) = 1 THEN 'combined' ELSE win END AS win, count(*) AS records, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total,
 min(l_quantity) AS least, max(l_quantity) AS most FROM w GROUP BY GROUPING SETS ((l_returnflag, win), (l_returnflag))""")
def window_rollup(t):
    return A.window_rollup(t.lineitem.select("l_returnflag", F.expr(_THIRD).alias("win"), "l_quantity"), ["l_returnflag"], "win", "l_quantity")


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def nearest_rank_percentiles(t):
    return A.nearest_rank(t.events, ["event_type"], "value", [50, 95, 99])


@query("SELECT o_orderstatus, count(o_totalprice) AS runs, round(median(o_totalprice), 4) AS median FROM orders GROUP BY o_orderstatus")
def median_of_runs(t):
    return A.median_of_runs(t.orders, ["o_orderstatus"], "o_totalprice").withColumn("median", F.round("median", 4))


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_returnflag) AS n_l_returnflag,
 count(DISTINCT l_suppkey) <= 1 AND count(DISTINCT l_returnflag) <= 1 AS consistent FROM lineitem GROUP BY l_partkey""")
def consistency_check(t):
    return A.consistency(t.lineitem, ["l_partkey"], ["l_suppkey", "l_returnflag"])


@query("""SELECT source, count(*) AS packets, count(*) FILTER (WHERE lang = 'en') AS keyframes, CAST(sum(n_chars) AS BIGINT) AS bytes, min(n_chars) AS smallest, max(n_chars) AS largest
 FROM documents GROUP BY source""")
def container_totals(t):
    return A.container_totals(t.documents, ["source"], "n_chars", F.col("lang") == "en")


@query(f"""WITH k(mode, code) AS (VALUES {", ".join(f"('{m}', {c})" for m, c in MODES.items())}), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
 SELECT k.mode, CAST(k.code AS INTEGER) AS code, CAST(coalesce(n, 0) AS BIGINT) AS count, 100.0 * (CAST(coalesce(n, 0) AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM c)) AS percent FROM k LEFT JOIN c ON mode = event_type""")
def mode_histogram(t):
    return A.mode_histogram(t.events, "event_type", MODES)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, concat('{', string_agg(concat('"', event_type, '":', n), ',' ORDER BY event_type), '}') AS modes FROM c GROUP BY 1""")
def mode_map(t):
    return A.mode_map(t.events, ["user_id"], "event_type").select("user_id", F.to_json("modes").alias("modes"))


@query("""SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice,
 CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS l_tax FROM lineitem GROUP BY l_returnflag""")
def counter_merge(t):
    return A.counter_merge(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"])


@query("""WITH c AS (SELECT user_id, event_id, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)
 SELECT user_id, event_id, CAST(total AS DOUBLE) AS total, CAST(total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS DOUBLE) AS delta FROM c""")
def counter_delta(t):
    total = F.sum(F.col("value").cast("decimal(18,2)")).over(Window.partitionBy("user_id").orderBy("event_id"))
    out = A.counter_delta(t.events.select("user_id", "event_id", total.alias("total")), ["user_id"], "event_id", "total")
    return out.select("user_id", "event_id", F.col("total").cast("double").alias("total"), F.col("delta").cast("double").alias("delta"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 40.0 + CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 0.25 AS cost FROM lineitem GROUP BY 1)
 SELECT l_suppkey, n, round(cost, 4) AS cost, round(cost / n, 6) AS cost_each, CASE WHEN cost / n <= 10200 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def weighted_cost(t):
    out = A.weighted_cost(t.lineitem, ["l_suppkey"], {"l_quantity": 40.0, "l_extendedprice": 0.25}, 10200.0)
    return out.withColumn("cost", F.round("cost", 4)).withColumn("cost_each", F.round("cost_each", 6))


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN (CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 40.0 + CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 0.25) / count(*) <= 10200
 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM lineitem GROUP BY l_suppkey) GROUP BY verdict""")
def budget_flag(t):
    return A.weighted_cost(t.lineitem, ["l_suppkey"], {"l_quantity": 40.0, "l_extendedprice": 0.25}, 10200.0).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_shipdate, sum((CAST(l_quantity AS DECIMAL(18,2)) - l_linenumber) * (CAST(l_quantity AS DECIMAL(18,2)) - l_linenumber)) AS s, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT CAST(l_shipdate AS VARCHAR)[1:10] AS day, CAST(s AS DOUBLE) AS sse, n AS samples, round(CASE WHEN s > 0 THEN 10 * log10(65025.0 * n / CAST(s AS DOUBLE)) ELSE 99.0 END, 6) AS psnr FROM g""")
def plane_psnr(t):
    d = F.col("l_quantity").cast("decimal(18,2)") - F.col("l_linenumber")
    rows = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), (d * d).alias("sq"), F.lit(1).alias("one"))
    out = A.plane_psnr(rows, ["day"], "sq", "one", 99.0)
    return out.select("day", F.col("sse").cast("double").alias("sse"), "samples", F.round("psnr", 6).alias("psnr"))


@query("""WITH e AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
 m AS (SELECT *, max(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS since FROM e)
 SELECT CAST(least(pos - since, 8) AS BIGINT) AS distance, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2)) * CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum_squares,
 CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS bias, max(abs(value)) AS worst FROM m WHERE since IS NOT NULL GROUP BY 1""")
def distance_group(t):
    return A.distance_stats(t.events, ["user_id"], "event_id", F.col("event_type") == "error", "value", 8).withColumn("distance", F.col("distance").cast("long"))


@query("SELECT sha256(text) AS content, count(*) AS copies, CAST(sum(n_chars) AS BIGINT) AS weight, min(doc_id) AS first FROM documents GROUP BY 1")
def dup_combine(t):
    return A.combine_duplicates(t.documents, F.sha2("text", 256), "n_chars", "doc_id")


@query("""SELECT CAST(count(*) AS BIGINT) AS slots, count(DISTINCT text) AS distinct_slots, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates,
 CAST(count(*) FILTER (WHERE n_chars > 1000) AS BIGINT) AS used FROM documents""")
def distinct_slots(t):
    return A.slot_counts(t.documents, F.sha2("text", 256), F.col("n_chars") > 1000)


@query("""SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE user_id % 2 = 0) AS DOUBLE) / count(value) FILTER (WHERE user_id % 2 = 0) AS even_avg,
 CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE user_id % 2 = 1) AS DOUBLE) / count(value) FILTER (WHERE user_id % 2 = 1) AS odd_avg FROM events GROUP BY event_type""")
def filtered_average(t):
    return A.filtered_average(t.events, ["event_type"], "value", {"even_avg": F.col("user_id") % 2 == 0, "odd_avg": F.col("user_id") % 2 == 1})


@query("SELECT lower(p_name) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t):
    return A.duplicates(t.part, F.lower("p_name"))


@query("""SELECT user_id, count(*) AS n, round(CASE WHEN max(epoch_us(ts)) > min(epoch_us(ts)) THEN (count(*) - 1) * 1e6 / (max(epoch_us(ts)) - min(epoch_us(ts))) END, 9) AS rate FROM events GROUP BY user_id""")
def observed_rate(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return A.observed_rate(t.events, ["user_id"], micros).withColumn("rate", F.round("rate", 9))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events)
 SELECT user_id, event_type, value, event_type = 'error' AS failed FROM r WHERE p = 1""")
def last_record_check(t):
    return A.last_record(t.events, ["user_id"], "event_id", ["event_type", "value"]).withColumn("failed", F.col("event_type") == "error")


@query("""SELECT l_shipmonth, kbps, fps, error_percent FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 8 / sum(l_quantity) / 1000, 6) AS kbps,
 round(count(*) / sum(l_quantity), 9) AS fps, round(100 * ((count(*) - 700.0) / 700.0), 6) AS error_percent FROM lineitem GROUP BY 1)""")
def rate_projections(t):
    g = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")).agg(S.exact_sum("l_extendedprice").alias("b"), F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    return g.select("l_shipmonth", F.round(S.bitrate_kbps("b", "s"), 6).alias("kbps"), F.round(S.fps("n", "s"), 9).alias("fps"), F.round(S.error_percent("n", F.lit(700.0)), 6).alias("error_percent"))


@query("""SELECT n_regionkey, concat('{"results":[', string_agg(concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '"}'), ',' ORDER BY n_nationkey), ']}') AS report FROM nation GROUP BY 1""")
def report_documents(t):
    return A.report_json(t.nation.select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"])
