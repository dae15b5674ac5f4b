"""Queries of ordered operators: global order, order within keys, folds, ranking, scalar expressions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import cluster, ordered, state
from ..operators import sequences as Q
from .registry import query


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
 SELECT event_id, value FROM e WHERE i IN (SELECT k * n // 500 FROM range(0, 500) AS r(k))""")
def systematic_sample(t):
    return ordered.systematic(t.events.select("event_id", "value"), "event_id", 500)


@query("""SELECT prev AS previous, event_id AS next, event_id - prev - 1 AS missing FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events WHERE event_type <> 'error') WHERE event_id > prev + 1""")
def gap_detect(t):
    return ordered.gaps(t.events.where("event_type <> 'error'"), "event_id")


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), w(win, k) AS (VALUES ('start', 0), ('middle', 1), ('end', 2))
 SELECT event_id, value, win AS "window" FROM e, w WHERE i >= CASE k WHEN 0 THEN 0 WHEN 1 THEN (n - least(600, n)) // 2 ELSE n - least(600, n) END AND i < CASE k WHEN 0 THEN 0 WHEN 1 THEN (n - least(600, n)) // 2 ELSE n - least(600, n) END + least(600, n)""")
def three_windows(t):
    return ordered.three_windows(t.events.select("event_id", "value"), "event_id", 600)


@query("""WITH h AS (SELECT event_id, value, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value > 40)
 SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM h GROUP BY g""")
def merge_ranges(t):
    return ordered.islands(t.events.where("value > 40").select("event_id", "value"), "event_id", S.exact_sum("value").alias("total"))


@query("""SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
 max(CASE WHEN lang = 'fr' THEN doc_id END) OVER (ORDER BY doc_id) AS last_key FROM documents""")
def seek_index(t):
    out = ordered.prefix_sum(t.documents.select("doc_id", "n_chars", "lang"), "doc_id", "n_chars", "offset")
    return ordered.carried(out, "doc_id", F.when(F.col("lang") == "fr", F.col("doc_id")), "last_key").drop("lang")


@query("""WITH i AS (SELECT doc_id, max(CASE WHEN lang = 'fr' THEN doc_id END) OVER (ORDER BY doc_id) AS last_key, max(doc_id) OVER () AS top FROM documents), q AS (SELECT doc_id + 1 AS target FROM documents)
 SELECT target, last_key AS start, doc_id - last_key AS discard FROM q JOIN i ON doc_id = least(target, top)""")
def seek_lookup(t):
    index = ordered.carried(t.documents.select("doc_id", "lang"), "doc_id", F.when(F.col("lang") == "fr", F.col("doc_id")), "start")
    return Q.seek(index, t.documents.select((F.col("doc_id") + 1).alias("target")), "doc_id", "start")  # the last lies beyond the end


@query("""SELECT event_id, (event_id * 16000 * 1001) // 30000 AS start, ((event_id + 1) * 16000 * 1001) // 30000 - (event_id * 16000 * 1001) // 30000 AS samples FROM events""")
def interleave_intervals(t):
    return t.events.select("event_id", S.rational_start("event_id", 16000, 30000, 1001).alias("start"), S.rational_count("event_id", 16000, 30000, 1001).alias("samples"))


@query("""SELECT i // 240 AS frame_window, min(event_id) AS first, count(*) AS n, max(value) AS worst FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1""")
def tumbling_frames(t):
    return ordered.indexed(t.events.select("event_id", "value"), "event_id").groupBy(F.floor(F.col("idx") / 240).alias("frame_window")).agg(F.min("event_id").alias("first"), F.count("*").alias("n"), F.max("value").alias("worst"))


@query("""SELECT event_id, prev IS NULL OR event_id % 48 = 0 OR coalesce(abs(value - prev) >= 100, false) AS cut FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS prev FROM events WHERE event_type <> 'error')""")
def modulo_cut(t):
    return ordered.cuts(t.events.where("event_type <> 'error'").select("event_id", "value"), "event_id", "value", 48, 100.0).select("event_id", "cut")


@query("""SELECT user_id, event_id, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS marker FROM events""")
def carry_forward(t):
    return Q.carry_forward(t.events, ["user_id"], "event_id", F.col("event_type") == "signup", "event_id", "marker").select("user_id", "event_id", "marker")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS group_id FROM events""")
def group_id(t):
    return Q.group_ids(t.events, ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "group_id")


_DAILY = "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL"


@query(f"""WITH d AS ({_DAILY}), m AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY o_orderpriority ORDER BY day)) AS mafd FROM d)
 SELECT o_orderpriority, day, v, round(mafd, 4) AS mafd, round(least(mafd, abs(mafd - coalesce(lag(mafd) OVER (PARTITION BY o_orderpriority ORDER BY day), 0))) / 100, 6) AS score FROM m WHERE mafd IS NOT NULL""")
def scene_score(t):
    d = t.orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("day")).agg(S.exact_sum("o_totalprice").alias("v"))
    out = Q.scene_score(d, ["o_orderpriority"], "day", "v").where("mafd IS NOT NULL")
    return out.select("o_orderpriority", "day", "v", F.round("mafd", 4).alias("mafd"), F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT conv_id, turn, length(text) > 60 AS hit, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 r AS (SELECT conv_id, turn, i - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM e WHERE hit), p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) - 1) // 17 AS part FROM r)
 SELECT conv_id, min(turn) AS first, count(*) AS length FROM p GROUP BY conv_id, g, part""")
def run_lengths(t):
    return Q.run_lengths(t.conversations, ["conv_id"], "turn", F.length("text") > 60)


@query("""SELECT user_id, event_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS repeat FROM events""")
def repeat_flag(t):
    return Q.repeats(t.events, ["user_id"], "event_id", "event_type").select("user_id", "event_id", "repeat")


@query("""WITH e AS (SELECT user_id, event_id, (event_id * 7919) % 1000 AS seq FROM events), m AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
 SELECT user_id, event_id, seq FROM m WHERE seen IS NULL OR seq > seen""")
def late_dedup(t):
    return Q.late(t.events.select("user_id", "event_id", (F.col("event_id") * 7919 % 1000).alias("seq")), ["user_id"], "event_id", "seq")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 40""")
def last_n_ring(t):
    return Q.last_n(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", 40)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank, l_partkey
 FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 128)""")
def top_cost(t):
    return Q.top_cost(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH g AS (SELECT *, o_totalprice >= 250000 - 5000 AS good FROM orders), r AS (SELECT *, max(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS any_good FROM g),
 p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN any_good = 1 AND good THEN 0 ELSE 1 END, CASE WHEN any_good = 1 THEN o_orderkey END, CASE WHEN any_good = 1 THEN abs(o_totalprice - 250000) END, -o_totalprice, o_orderkey) AS n FROM r)
 SELECT o_custkey, o_orderkey, o_orderkey AS size, o_totalprice, any_good = 1 AS met FROM p WHERE n = 1""")
def acceptable_trial(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("size"), "o_totalprice")
    return Q.acceptable(rows, ["o_custkey"], "o_totalprice", "size", 250000.0, 5000.0, "o_orderkey")


@query("SELECT DISTINCT s_name FROM supplier ORDER BY lower(s_name), s_name LIMIT 25")
def name_page(t):
    return Q.name_page(t.supplier, "s_name", 25)


@query("SELECT s_name FROM (SELECT DISTINCT s_name FROM supplier) ORDER BY lower(s_name) DESC, s_name DESC LIMIT 25")
def name_tail(t):
    return Q.name_page(t.supplier, "s_name", 25, tail=True)


@query("""SELECT l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice / l_quantity + 12.5 * l_discount, l_suppkey, l_orderkey, l_linenumber) AS p FROM lineitem) WHERE p = 1""")
def lexi_argmin(t):
    cost = F.col("l_extendedprice") / F.col("l_quantity") + 12.5 * F.col("l_discount")
    return Q.argmin(t.lineitem, ["l_partkey"], [cost, F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")], ["l_suppkey", "l_extendedprice"])


@query("""WITH r AS (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY n_chars, doc_id) AS BIGINT) AS running FROM documents) SELECT doc_id, n_chars, running FROM r WHERE running <= 60000""")
def budget_prefix(t):
    return ordered.within_budget(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 60000)


@query("""WITH s AS (SELECT event_id, greatest(0.0, least(1.0, (value / 10 - 0.75) / 11.25)) AS m, greatest(0.0, least(1.0, (value / 5 - 4.0) / 24.0)) AS d, event_type = 'error' AS cut FROM events),
 p AS (SELECT event_id, m * m * (3 - 2 * m) AS m, d * d * (3 - 2 * d) AS d, cut FROM s)
 SELECT event_id, round(40.0 - 6.0 * CASE WHEN cut THEN least(m * (0.7 + 0.3 * d), 0.4) ELSE m * (0.7 + 0.3 * d) END, 6) AS target FROM p""")
def smoothstep_target(t):
    target = S.adaptive_target(40.0, 6.0, F.col("value") / 10, F.col("value") / 5, F.col("event_type") == "error")
    return t.events.select("event_id", F.round(target, 6).alias("target"))


@query("""WITH q AS (SELECT p_partkey, p_size, round(pow(2.0, (100.0 - greatest(1, least(100, q))) / 12.5)) AS raw FROM (SELECT *, p_size * 3 - 20 AS q FROM part))
 SELECT p_partkey, p_size, CAST(greatest(1, least(255, raw)) AS INTEGER) AS step_y, CAST(greatest(1, least(255, round(raw * 1.35))) AS INTEGER) AS step_uv FROM q""")
def quality_map(t):
    y, uv = S.quality_steps(F.col("p_size") * 3 - 20)
    return t.part.select("p_partkey", "p_size", y.alias("step_y"), uv.alias("step_uv"))


@query("""SELECT c_mktsegment, count(*) AS n, 100.0 * (CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM customer)) AS percent FROM customer GROUP BY 1""")
def percent_of_total(t):
    counts = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.crossJoin(total).select("c_mktsegment", "n", S.percent("n", "__t").alias("percent"))


@query("""SELECT o_orderkey, CASE WHEN v < 1024 THEN printf('%d B', v) WHEN v < 1048576 THEN printf('%.1f KiB', v / 1024.0) ELSE printf('%.2f MiB', v / 1048576.0) END AS label
 FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS BIGINT) AS v FROM orders)""")
def size_label(t):
    return t.orders.select("o_orderkey", S.size_label((F.col("o_orderkey") * F.col("o_orderkey")).cast("long")).alias("label"))


@query("""SELECT event_id, (event_id * 16000 * 1001) // 30000 AS target, CAST(value * 1000 AS BIGINT) + (event_id * 16000 * 1001) // 30000 - 20000 > ((event_id + 1) * 16000 * 1001) // 30000 AS late FROM events""")
def clock_targets(t):
    start = S.rational_start("event_id", 16000, 30000, 1001)
    played = (F.col("value") * 1000).cast("long") + start - 20000
    return t.events.select("event_id", start.alias("target"), (played > S.rational_start(F.col("event_id") + 1, 16000, 30000, 1001)).alias("late"))


@query("""SELECT p_partkey, CAST(greatest(1, floor(p_retailprice / 100 * 29.97 + 0.5)) AS BIGINT) AS frames, CAST(greatest(1, round_even(29.97 * least(10.0, p_size / 29.97), 0)) AS BIGINT) AS in_window,
 CAST(round_even(p_size * 100 / 240.0, 0) AS BIGINT) AS micros, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS floored FROM part""")
def frame_counts(t):
    return t.part.select("p_partkey", S.frames_of(F.col("p_retailprice") / 100, F.lit(29.97)).alias("frames"), S.window_frames(F.lit(29.97), 10.0, F.col("p_size")).alias("in_window"),
                         S.cycles_to_us(F.col("p_size") * 100).alias("micros"), S.floor_div(F.col("p_size") - 25, F.lit(7.0)).alias("floored"))


@query("""SELECT p_partkey, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS rgb565, 77 * r + 150 * g + 29 * b AS luma, CAST(bit_count(r) AS INTEGER) AS bits, CAST(greatest(1, ceil(log2(greatest(p_size, 1)))) AS INTEGER) AS bank_bits FROM (SELECT p_partkey, p_size,
 CAST(p_partkey % 256 AS INTEGER) AS r, CAST((p_partkey * 7) % 256 AS INTEGER) AS g, CAST((p_partkey * 13) % 256 AS INTEGER) AS b FROM part)""")
def colour_codes(t):
    rgb = t.part.select("p_partkey", "p_size", *[(F.col("p_partkey") * k % 256).cast("int").alias(n) for k, n in ((1, "r"), (7, "g"), (13, "b"))])
    return rgb.select("p_partkey", S.rgb565("r", "g", "b").alias("rgb565"), S.luma("r", "g", "b").alias("luma"), F.bit_count("r").alias("bits"), S.bank_bits("p_size").alias("bank_bits"))


_STEPS = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events"


@query(f"""WITH RECURSIVE e AS ({_STEPS}), f AS (SELECT user_id, i, event_id, 1 AS len, 0 AS gop, 'initial' AS reason FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.event_id, CASE WHEN f.len >= 12 OR (f.len >= 3 AND e.value >= 80) THEN 1 ELSE f.len + 1 END, CASE WHEN f.len >= 12 OR (f.len >= 3 AND e.value >= 80) THEN f.gop + 1 ELSE f.gop END,
 CASE WHEN f.len >= 3 AND e.value >= 80 THEN 'scene' WHEN f.len >= 12 THEN 'maximum' END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
 SELECT user_id, event_id, CAST(gop AS INTEGER) AS gop, reason FROM f""")
def gop_plan(t):
    return state.fold(t.events, ["user_id"], ["event_id"], ["value"], lambda: state.GopPlanner(3, 12, 80.0, "value"), "gop int, reason string")


@query(f"""WITH RECURSIVE e AS ({_STEPS}), f AS (SELECT user_id, i, event_id, value AS s FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.event_id, least(f.s + 0.25, greatest(f.s - 0.9, e.value)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id, round(s, 6) AS smoothed FROM f""")
def slew_limit(t):
    return state.fold(t.events, ["user_id"], ["event_id"], ["value"], lambda: state.SlewLimit(), "smoothed double").withColumn("smoothed", F.round("smoothed", 6))


_FOLD = "FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1"


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, event_type = 'signup' AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS buffer, CAST(32 AS BIGINT) AS q FROM e WHERE i = 1 UNION ALL
 SELECT user_id, i, event_id, q0, b, CAST(greatest(1, least(255, CASE WHEN n = q0 AND v - 50 > 4 THEN n + 1 WHEN n = q0 AND v - 50 < -4 THEN n - 1 ELSE n END)) AS BIGINT) FROM
 (SELECT *, CAST(floor(q0 * least(1.25, greatest(0.8, exp(CASE WHEN k THEN 0.06 ELSE 0.16 END * ln((v + 1) / 51) + 0.22 * (b / (50.0 * 24 + 1))))) + 0.5) AS BIGINT) AS n FROM
 (SELECT e.user_id, e.i, e.event_id, e.v, e.k, f.q AS q0, (f.buffer + (e.v - 50)) * (1 - CAST(1 AS DOUBLE) / 24) AS b FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
 SELECT user_id, event_id, used AS q_used, round(buffer, 9) AS buffer, q AS q_next FROM f WHERE i > 0""")
def leaky_bucket(t):
    rows = t.events.select("user_id", "event_id", "value", (F.col("event_type") == "signup").alias("key"))
    out = state.fold(rows, ["user_id"], ["event_id"], ["value", "key"], lambda: state.LeakyBucket(50.0, size="value"), "q_used long, buffer double, q_next long")
    return out.withColumn("buffer", F.round("buffer", 9))


@query(f"""WITH RECURSIVE e AS ({_STEPS}), f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS target, CAST(0 AS DOUBLE) AS error, CAST(0 AS DOUBLE) AS debt FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.event_id, least(75.0, greatest(25.0, 50 - least(12.5, greatest(-12.5, 0.5 * f.debt)))), (e.value - 50) / 51, least(100.0, greatest(-100.0, f.debt + (e.value - 50))) {_FOLD})
 SELECT user_id, event_id, round(target, 6) AS target, round(error, 6) AS error, round(debt, 6) AS debt FROM f WHERE i > 0""")
def window_debt(t):
    out = state.fold(t.events, ["user_id"], ["event_id"], ["value"], lambda: state.WindowDebt(50.0, size="value"), "target double, error double, debt double")
    return out.select("user_id", "event_id", *[F.round(c, 6).alias(c) for c in ("target", "error", "debt")])


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value > 60 AS late, event_type = 'signup' AS k, event_id % 11 = 0 AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, 'show' AS action, 0 AS run, false AS waiting FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.event_id, CASE WHEN late AND NOT k AND nxt THEN 'skip' WHEN f.waiting AND NOT k THEN 'skip' ELSE 'show' END,
 CASE WHEN late AND NOT k AND nxt THEN 0 WHEN f.waiting THEN CASE WHEN k THEN 0 ELSE f.run END WHEN late AND NOT k THEN f.run + 1 ELSE 0 END,
 CASE WHEN late AND NOT k AND nxt THEN true WHEN f.waiting THEN NOT k ELSE late AND NOT k AND f.run + 1 >= 3 END {_FOLD}) SELECT user_id, event_id, action, CAST(run AS INTEGER) AS late_run FROM f WHERE i > 0""")
def catchup_state(t):
    rows = t.events.select("user_id", "event_id", (F.col("value") > 60).alias("late"), (F.col("event_type") == "signup").alias("key"), (F.col("event_id") % 11 == 0).alias("key_next"))
    return state.fold(rows, ["user_id"], ["event_id"], ["late", "key", "key_next"], lambda: state.CatchUp(), "action string, late_run int")


@query(f"""WITH RECURSIVE m(w) AS (SELECT CAST(18446744073709551616 AS HUGEINT)), e AS ({_STEPS}), f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, CAST(88172645463325252 AS HUGEINT) AS x, CAST(0 AS HUGEINT) AS place FROM e WHERE i = 1 UNION ALL
 SELECT user_id, i, event_id, x, CASE WHEN i <= 4 THEN i - 1 ELSE (x * 2685821657736338717) % w % i END FROM (SELECT user_id, i, event_id, w, CASE WHEN i <= 4 THEN x0 ELSE xor(b, b // 134217728) END AS x FROM
 (SELECT *, xor(a, (a * 33554432) % w) AS b FROM (SELECT e.user_id, e.i, e.event_id, w, f.x AS x0, xor(f.x, f.x // 4096) AS a FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 CROSS JOIN m))))
 SELECT user_id, CAST(place AS INTEGER) AS place, max_by(event_id, i) AS event_id FROM f WHERE i > 0 AND place < 4 GROUP BY 1, 2""")
def reservoir_sample(t):
    out = state.fold(t.events, ["user_id"], ["event_id"], [], lambda: state.Reservoir(4), "place int, nth long")
    return out.where("place IS NOT NULL").groupBy("user_id", "place").agg(F.max_by("event_id", "nth").alias("event_id"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value / 10) AS INTEGER) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, false AS hit, CAST(0 AS INTEGER) AS slot, CAST([] AS INTEGER[]) AS held FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.event_id, list_contains(held, x), CAST(CASE WHEN list_contains(held, x) THEN list_position(held, x) - 1 END AS INTEGER),
 CASE WHEN list_contains(held, x) THEN held WHEN len(held) = 8 THEN list_append(held[2:], x) ELSE list_append(held, x) END {_FOLD}) SELECT user_id, event_id, hit, slot FROM f WHERE i > 0""")
def fifo_dictionary(t):
    rows = t.events.select("user_id", "event_id", F.floor(F.col("value") / 10).cast("int").alias("entry"))
    return state.fold(rows, ["user_id"], ["event_id"], ["entry"], lambda: state.FifoDictionary(8), "hit boolean, slot int")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS mad, event_id % 97 AS kc, event_id % 89 AS pc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 f AS (SELECT user_id, i, event_id, true AS keyframe, 1 AS since FROM e WHERE i = 1 UNION ALL SELECT user_id, i, event_id, k, CASE WHEN k THEN 1 ELSE since + 1 END FROM
 (SELECT e.user_id, e.i, e.event_id, f.since, CASE WHEN f.since >= 12 THEN true WHEN f.since < 3 AND mad < 20 THEN false ELSE kc <= pc END AS k {_FOLD})) SELECT user_id, event_id, keyframe FROM f""")
def key_interval(t):
    rows = t.events.select("user_id", "event_id", F.col("value").alias("mad"), (F.col("event_id") % 97).alias("k_cost"), (F.col("event_id") % 89).alias("p_cost"))
    return state.fold(rows, ["user_id"], ["event_id"], ["mad", "k_cost", "p_cost"], lambda: state.KeyInterval(3, 12, 20.0), "keyframe boolean")


@query()
def kmeans_det(t):
    return cluster.kmeans(t.embeddings, "vec_id", "embedding", 6)[1]


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_size * 4 AS r, (p_partkey * 37) % 256 AS g, CAST(floor(p_retailprice) AS BIGINT) % 256 AS b, 1 + p_size % 7 AS u FROM part),
 s AS (SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(sum(u) AS DOUBLE) AS u, min(p_partkey) AS id FROM p GROUP BY 1, 2, 3),
 z AS (SELECT 0 AS step, r, g, b, u, id, CAST(NULL AS DOUBLE) AS near, row_number() OVER (ORDER BY u DESC, r, g, b) = 1 AS pick FROM s UNION ALL
 SELECT step + 1, r, g, b, u, id, near, row_number() OVER (ORDER BY taken, near DESC, u DESC, r, g, b) = 1 FROM (SELECT z.step, z.r, z.g, z.b, z.u, z.id, z.id = c.id OR coalesce(z.near, 1) < 0 AS taken,
 CASE WHEN z.id = c.id OR z.near < 0 THEN -1.0 ELSE least(coalesce(z.near, 1e300), z.u * ((z.r - c.r) * (z.r - c.r) + (z.g - c.g) * (z.g - c.g) + (z.b - c.b) * (z.b - c.b))) END AS near FROM z CROSS JOIN (SELECT * FROM z WHERE pick) c WHERE z.step < 7))
 SELECT CAST(step AS INTEGER) AS slot, id AS p_partkey FROM z WHERE pick""")
def kcenter_bank(t):
    rows = t.part.select("p_partkey", F.array(F.col("p_size") * 4, F.col("p_partkey") * 37 % 256, F.floor("p_retailprice") % 256).alias("v"), (1 + F.col("p_size") % 7).alias("u"))
    chosen = cluster.kcenter(rows, "p_partkey", "v", "u", 8)
    return t.spark.createDataFrame(list(enumerate(chosen)), T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("p_partkey", T.LongType())]))
