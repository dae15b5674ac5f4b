"""Queries of joins, sets and matches."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import content as C
from ..operators import joins as J
from .registry import query


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS sse FROM s a JOIN s b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, round(sse, 6) AS sse, round(sse / 64, 6) AS mse, round(CASE WHEN sse > 0 THEN 10 * log10(65025.0 * 64 / sse) ELSE 99.0 END, 5) AS psnr FROM p""")
def psnr_pairs(t):
    pairs = J.adjacent(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding").withColumn("e", S.sse("embedding", "next_embedding"))
    return pairs.select("vec_id", F.round("e", 6).alias("sse"), F.round(F.col("e") / 64, 6).alias("mse"), F.round(S.psnr("e", F.lit(64), 99.0), 5).alias("psnr"))


@query("SELECT n_name, r_name, o_orderpriority FROM nation CROSS JOIN region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)")
def grid_expand(t):
    return J.grid(t.nation.select("n_name"), t.region.select("r_name"), t.orders.select("o_orderpriority").distinct())


@query("""SELECT n_nationkey, s.c_mktsegment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
 WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c_acctbal > 9000)""")
def resume_anti(t):
    wanted = J.grid(t.nation.select("n_nationkey"), t.customer.select("c_mktsegment").distinct())
    done = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return J.resume(wanted, done, ["n_nationkey", "c_mktsegment"])


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 101 <> 0)
 SELECT coalesce(o.o_orderkey, r.o_orderkey) AS o_orderkey, o_totalprice AS left_value, v AS right_value FROM orders o FULL JOIN r ON o.o_orderkey = r.o_orderkey WHERE o_totalprice IS DISTINCT FROM v""")
def positional_diff(t):
    right = t.orders.where("o_orderkey % 101 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return J.positional_diff(t.orders, right, "o_orderkey", "o_totalprice")


_TARGETS = (905.0, 1000.05, 1250.5, 1400.0, 1999.99)


@query(f"""WITH t(target) AS (VALUES {", ".join(f"(CAST({x} AS DOUBLE))" for x in _TARGETS)}), r AS (SELECT target, p_retailprice, p_partkey,
 row_number() OVER (PARTITION BY target ORDER BY abs(p_retailprice - target), p_retailprice DESC, p_partkey) AS p FROM part CROSS JOIN t) SELECT target, p_retailprice, p_partkey FROM r WHERE p = 1""")
def nearest_match(t):
    targets = t.spark.createDataFrame([(x,) for x in _TARGETS], "target double")
    return J.nearest_match(targets, "target", t.part, "p_retailprice", "p_partkey")


_NEAR = """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), b AS (SELECT label AS slot, list_transform(arg_min(embedding, vec_id), lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings GROUP BY 1),
 d AS (SELECT s.vec_id, slot, round(list_sum(list_transform(list_zip(s.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS error FROM s CROSS JOIN b),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY error, slot) - 1 AS place FROM d) """


def _bank(t):
    """The first vector of each label."""
    return t.embeddings.groupBy(F.col("label").alias("slot")).agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("vec"))


@query(_NEAR + "SELECT vec_id, CAST(place AS INTEGER) AS place, slot, error FROM r WHERE place < 1")
def nn_assign(t):
    return J.bank_neighbours(t.embeddings, "embedding", "vec_id", _bank(t))


@query(_NEAR + "SELECT vec_id, CAST(place AS INTEGER) AS place, slot, error FROM r WHERE place < 3")
def topn_nn(t):
    return J.bank_neighbours(t.embeddings, "embedding", "vec_id", _bank(t), 3)


_BANDS = ((0, -1e9, 0.0), (1, 0.0, 2500.0), (2, 2500.0, 7500.0), (3, 7500.0, 1e9))


@query(f"""WITH b(band, low, high) AS (VALUES {", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({z} AS DOUBLE))" for i, a, z in _BANDS)})
 SELECT c_custkey, c_acctbal, CAST(band AS INTEGER) AS band FROM customer JOIN b ON c_acctbal >= low AND c_acctbal < high""")
def interval_lookup(t):
    return J.interval_lookup(t.customer, "c_acctbal", t.spark.createDataFrame(_BANDS, "band int, low double, high double")).select("c_custkey", "c_acctbal", "band")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
 SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS a, b.n AS b, round(100 * (CAST(b.n - a.n AS DOUBLE) / a.n), 6) AS delta_percent FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def ab_compare(t):
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return J.ab_compare(side("F"), side("O"), ["o_custkey"], "n").withColumn("delta_percent", F.round("delta_percent", 6))


@query("""WITH q AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, n AS listed, CAST(m AS BIGINT) AS found FROM q WHERE n <> m""")
def size_consistency(t):
    q = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("m"))
    return J.differing_sizes(q.select("l_orderkey", "n"), q.select("l_orderkey", F.col("m").alias("n")), "l_orderkey", "n")


@query("""WITH r AS (SELECT l_partkey, l_linenumber = 1 AS base, l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS line, l_quantity, l_tax FROM lineitem),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score, line, l_quantity, l_tax) AS p FROM r WHERE base) WHERE p = 1),
 c AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.l_partkey ORDER BY r.score, r.line, r.l_quantity, r.l_tax) AS p FROM r JOIN b ON r.l_partkey = b.l_partkey
   WHERE NOT r.base AND r.score < b.score AND r.l_quantity <= b.l_quantity AND r.l_tax <= b.l_tax) WHERE p = 1)
 SELECT b.l_partkey, coalesce(c.line, b.line) AS line, coalesce(c.score, b.score) AS score, c.line IS NOT NULL AS overridden FROM b LEFT JOIN c ON b.l_partkey = c.l_partkey""")
def dominance_override(t):
    rows = t.lineitem.select("l_partkey", "l_linenumber", F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_quantity", "l_tax")
    return J.override(rows, "l_partkey", F.col("l_linenumber") == 1, "score", ["l_quantity", "l_tax"], "line")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def key_difference(t):
    return J.unknown(t.orders, "o_custkey", t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def key_union(t):
    return t.orders.select(F.col("o_custkey").alias("k")).unionByName(t.customer.select(F.col("c_custkey").alias("k"))).distinct()


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p = 1""")
def first_wins(t):
    return J.first_wins(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("""WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)
 SELECT doc_id, CAST(off AS BIGINT) AS offset, CAST(least(4096, n - off) AS BIGINT) AS size, sha256(b[off + 1 : least(off + 4096, n)]) AS sha256 FROM d, unnest(range(0, n, 4096)) AS u(off)""")
def block_hash(t):
    return C.block_hashes(t.documents, "doc_id", "text", 4096).drop("crc32")


@query("""WITH RECURSIVE c AS (SELECT p_partkey, CAST(b * 4 AS BIGINT) AS o, substring(p_name, CAST(b * 4 + 1 AS BIGINT), 4) AS s FROM part, range(0, 16) AS r(b) WHERE b * 4 < length(p_name)),
 f AS (SELECT p_partkey, o, s, 0 AS k, CAST(4294967295 AS BIGINT) AS crc FROM c UNION ALL SELECT p_partkey, o, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END FROM
 (SELECT *, CASE WHEN k % 8 = 0 THEN xor(crc, CAST(ord(substring(s, k // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS x FROM f WHERE k < 8 * length(s)))
 SELECT p_partkey, o AS "offset", length(s) AS size, xor(crc, CAST(4294967295 AS BIGINT)) AS crc32 FROM f WHERE k = 8 * length(s)""")
def block_crc(t):
    return C.block_hashes(t.part, "p_partkey", "p_name", 4).drop("sha256")


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, m[i] AS value FROM (SELECT doc_id, regexp_extract_all(text, '([0-9]{2,})', 1) AS m FROM documents), unnest(range(1, len(m) + 1)) AS u(i)""")
def regex_records(t):
    return C.records(t.documents, "doc_id", "text", "([0-9]{2,})")


@query("""SELECT event_id, CAST(list_extract(regexp_extract_all(props, '([0-9])', 1), -1) AS VARCHAR) AS digit FROM events""")
def last_match(t):
    return t.events.select("event_id", C.last_match(F.col("props"), "([0-9])").alias("digit"))


@query("""WITH RECURSIVE f AS (SELECT p_partkey, p_name AS s, 0 AS k, CAST(14695981039346656037 AS HUGEINT) AS h FROM part UNION ALL
 SELECT p_partkey, s, k + 1, (xor(h, CAST(ord(substring(s, k + 1, 1)) AS HUGEINT)) * 1099511628211) % 18446744073709551616 FROM f WHERE k < length(s)) SELECT p_partkey, lpad(lower(hex(CAST(h AS UBIGINT))), 16, '0') AS fnv1a FROM f WHERE k = length(s)""")
def fnv_checksum(t):
    return C.fnv1a(t.part, "p_partkey", "p_name")


@query("""WITH c AS (SELECT p_partkey, concat_ws(';', p_size || '+' || (p_partkey % 7 + 1), (p_size + 100) || '+3') AS cell FROM part)
 SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, CAST(split_part(s[i], '+', 1) AS BIGINT) AS offset, CAST(split_part(s[i], '+', 2) AS BIGINT) AS length FROM (SELECT p_partkey, string_split(cell, ';') AS s FROM c), unnest(range(1, len(s) + 1)) AS u(i)""")
def range_cells(t):
    cell = F.concat_ws(";", F.concat_ws("+", "p_size", F.col("p_partkey") % 7 + 1), F.concat_ws("+", F.col("p_size") + 100, F.lit(3)))
    return C.ranges(t.part.select("p_partkey", cell.alias("cell")), "p_partkey", "cell")
