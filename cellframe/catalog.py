"""Registered queries of the spatial engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.functions import bits, encoding, udf, zranges
from cellframe.functions.metrics import L1, L2, Custom, Decoded
from cellframe.operators import joins, mutate, order, stats
from cellframe.operators.pivots import PivotTable
from cellframe.operators.tables import ArrayTable, BoxTable, MultiTable, SpatialTable, in_ball, same_prefix
from cellframe.plans import bounded
from cellframe.sources import clustered
from cellframe.sources.shared import shared_path
from cellframe.sources.stored import StoredTable
from cellframe.streaming import moving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


LINE_KEYS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_IDS = ("l_orderkey", "l_linenumber")
LOW, HIGH = (10.0, 1000.0, 0.02, 0.0), (20.0, 20000.0, 0.05, 0.04)
WINDOW_SQL = "l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 1000 AND 20000 AND l_discount BETWEEN 0.02 AND 0.05 AND l_tax BETWEEN 0 AND 0.04"
LINE_SQL = "l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey, l_linenumber"


def lines(spark: SparkSession, sf_dir: str) -> SpatialTable:
    return SpatialTable(_read(spark, sf_dir, "lineitem"), LINE_KEYS, LINE_IDS)


def parts(spark: SparkSession, sf_dir: str) -> MultiTable:
    return MultiTable(_read(spark, sf_dir, "part"), ("p_size", "p_retailprice"), ("p_partkey",))


def order_boxes(spark: SparkSession, sf_dir: str) -> BoxTable:
    """Per order the range of ship dates (seconds) and prices."""
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    boxes = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(seconds).alias("lo0"), F.min("l_extendedprice").alias("lo1"), F.max(seconds).alias("hi0"), F.max("l_extendedprice").alias("hi1"))
    return BoxTable(boxes, ("lo0", "lo1"), ("hi0", "hi1"), ("l_orderkey",))


BOX_SQL = """boxes AS (SELECT l_orderkey, min(CAST(epoch(l_shipdate) AS BIGINT)) AS lo0, min(l_extendedprice) AS lo1,
  max(CAST(epoch(l_shipdate) AS BIGINT)) AS hi0, max(l_extendedprice) AS hi1 FROM lineitem GROUP BY l_orderkey)"""

# --- scans ---


@query(f"SELECT {LINE_SQL} FROM lineitem")
def extent(spark, sf_dir):
    return lines(spark, sf_dir).extent()


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def key_scan(spark, sf_dir):
    return lines(spark, sf_dir).key_set()


@query("SELECT count(*) AS n FROM lineitem")
def count_entries(spark, sf_dir):
    return lines(spark, sf_dir).count()


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE false")
def clear_table(spark, sf_dir):
    return lines(spark, sf_dir).clear().extent()


@query(f"WITH {BOX_SQL} SELECT lo0, lo1, hi0, hi1, l_orderkey FROM boxes")
def box_scan(spark, sf_dir):
    return order_boxes(spark, sf_dir).extent()


@query("""SELECT lpad(bin(l_partkey), 64, '0') || ',' || lpad(bin(l_suppkey), 64, '0') || '  v=' || CAST(l_linenumber AS VARCHAR) AS line FROM lineitem""")
def text_dump(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey"), ("l_linenumber",)).dump()


@query("SELECT 4 AS dim, 64 AS bit_depth, count(*) AS n FROM lineitem")
def metadata(spark, sf_dir):
    table = lines(spark, sf_dir)
    return table.count().select(F.lit(table.dim).alias("dim"), F.lit(table.bit_depth).alias("bit_depth"), "n")


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE {WINDOW_SQL}")
def persisted_window(spark, sf_dir):
    """The table written in Z-order, read back and asked."""
    path = shared_path(spark, "clustered")
    clustered.write_clustered(lines(spark, sf_dir).extent(), path, LINE_KEYS)
    return clustered.read_points(spark, path, LINE_KEYS, LINE_IDS).window(LOW, HIGH)


@query("SELECT CAST(s_suppkey AS DOUBLE) AS k, CAST(s_nationkey AS DOUBLE) AS n FROM supplier")
def token_file(spark, sf_dir):
    """Numbers written as lines of text and read back as keys."""
    path = shared_path(spark, "tokens")
    _read(spark, sf_dir, "supplier").select(F.concat_ws("  ", "s_suppkey", "s_nationkey").alias("value")).write.text(path)
    return clustered.read_tokens(spark, path, ["k", "n"])


# --- windows ---


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE {WINDOW_SQL}")
def window_4d(spark, sf_dir):
    return lines(spark, sf_dir).window(LOW, HIGH)


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE false")
def window_contradictory(spark, sf_dir):
    return lines(spark, sf_dir).window(HIGH, LOW)


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE {WINDOW_SQL} AND l_returnflag = 'R'")
def window_filtered(spark, sf_dir):
    return lines(spark, sf_dir).window(LOW, HIGH, where=F.col("l_returnflag") == "R")


@query("SELECT p_size, p_retailprice, p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def window_1d_range(spark, sf_dir):
    table = SpatialTable(_read(spark, sf_dir, "part"), ("p_size",), ("p_retailprice", "p_partkey"))
    return table.window((10,), (20,)).select("p_size", "p_retailprice", "p_partkey")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 100 AND 900 AND l_suppkey BETWEEN 10 AND 60")
def window_long(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey"), LINE_IDS).window((100, 10), (900, 60))


@query(f"""SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM (SELECT * FROM lineitem WHERE {WINDOW_SQL} AND l_returnflag = 'R'
  ORDER BY {LINE_SQL} LIMIT 40)""")
def query_all_limit(spark, sf_dir):
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")
    return lines(spark, sf_dir).query_all(LOW, HIGH, limit=40, where=F.col("l_returnflag") == "R", select=["l_orderkey", net])


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE {WINDOW_SQL}")
def query_all_list(spark, sf_dir):
    return lines(spark, sf_dir).query_all(LOW, HIGH)


def by_part(spark, sf_dir) -> SpatialTable:
    return SpatialTable(_read(spark, sf_dir, "lineitem"), ("l_partkey",), LINE_IDS)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey | 5) = l_partkey AND (l_partkey & 2047) = l_partkey")
def masked_range(spark, sf_dir):
    return by_part(spark, sf_dir).masked((5,), (2047,))


@query("SELECT count(*) > 0 AS found FROM lineitem WHERE (l_partkey | 5) = l_partkey AND (l_partkey & 63) = l_partkey")
def masked_any(spark, sf_dir):
    return by_part(spark, sf_dir).any_masked((5,), (63,))


@query("SELECT p_size, p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 UNION ALL SELECT p_size, p_partkey FROM part WHERE p_size BETWEEN 30 AND 31")
def window_again(spark, sf_dir):
    """One table asked twice, with other bounds."""
    table = SpatialTable(_read(spark, sf_dir, "part"), ("p_size",), ("p_partkey",))
    return table.window((10,), (12,)).unionByName(table.window((30,), (31,)))


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS twice FROM lineitem WHERE {WINDOW_SQL} AND l_orderkey % 2 = 1")
def window_by_callers_functions(spark, sf_dir):
    """A Python filter and a Python mapper, in Arrow batches."""
    odd = udf.predicate(lambda k: k % 2 == 1)
    window = lines(spark, sf_dir).window(LOW, HIGH, where=odd(F.col("l_orderkey")))
    return udf.mapped(window, lambda batch: batch.assign(twice=batch.l_extendedprice * 2)[["l_orderkey", "l_linenumber", "twice"]], "l_orderkey long, l_linenumber int, twice double")


# --- lookups ---


def _probes(spark, sf_dir):
    """Part keys to look for, made from supplier keys; some are beyond the table."""
    return _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 29).alias("p_partkey"))


PROBES = "probes AS (SELECT s_suppkey * 29 AS p_partkey FROM supplier)"


@query(f"WITH {PROBES} SELECT p_partkey, p_name FROM probes JOIN part USING (p_partkey)")
def point_get(spark, sf_dir):
    return joins.lookup(_probes(spark, sf_dir), _read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"])


@query(f"WITH {PROBES} SELECT p_partkey, coalesce(p_name, 'none') AS p_name FROM probes LEFT JOIN part USING (p_partkey)")
def point_get_or_default(spark, sf_dir):
    return joins.lookup_or_default(_probes(spark, sf_dir), _read(spark, sf_dir, "part"), ["p_partkey"], "p_name", "none")


@query(f"WITH {PROBES} SELECT p_partkey FROM probes WHERE EXISTS (SELECT 1 FROM part WHERE part.p_partkey = probes.p_partkey)")
def point_contains(spark, sf_dir):
    return joins.lookup(_probes(spark, sf_dir), _read(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "left_semi")


@query(f"WITH {PROBES} SELECT p_partkey FROM probes WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.p_partkey = probes.p_partkey)")
def point_lacks(spark, sf_dir):
    return joins.lookup(_probes(spark, sf_dir), _read(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "left_anti")


@query("SELECT p_size, p_name FROM part WHERE p_partkey = 7")
def point_get_single(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "part"), ("p_partkey",), ("p_size", "p_name")).get((7,))


@query("SELECT count(*) > 0 AS found FROM part WHERE p_partkey = 7")
def point_contains_single(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "part"), ("p_partkey",), ("p_size",)).holds((7,))


# --- balls and neighbours ---


DIST_P = "sqrt((CAST(p_size AS DOUBLE) - 25.0) * (CAST(p_size AS DOUBLE) - 25.0) + (p_retailprice - 910.0) * (p_retailprice - 910.0))"


@query(f"SELECT * FROM (SELECT p_size, p_retailprice, p_partkey, {DIST_P} AS dist FROM part) WHERE dist <= 12.5")
def range_l2(spark, sf_dir):
    return parts(spark, sf_dir).within((25.0, 910.0), 12.5, L2())


@query("SELECT * FROM (SELECT p_size, p_retailprice, p_partkey, abs(CAST(p_size AS DOUBLE) - 25.0) + abs(p_retailprice - 910.0) AS dist FROM part) WHERE dist <= 12.5")
def range_l1(spark, sf_dir):
    return parts(spark, sf_dir).within((25.0, 910.0), 12.5, L1())


@query("""SELECT * FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, sqrt((CAST(l_partkey AS DOUBLE) - 500) * (CAST(l_partkey AS DOUBLE) - 500) + (CAST(l_suppkey AS DOUBLE) - 50) * (CAST(l_suppkey AS DOUBLE) - 50)) AS dist
  FROM lineitem) WHERE dist <= 25""")
def range_long(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey"), LINE_IDS).within((500, 50), 25)


@query(f"SELECT p_size, p_retailprice, p_partkey, {DIST_P} AS dist FROM part ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 25")
def knn_l2(spark, sf_dir):
    return parts(spark, sf_dir).nearest(25, (25.0, 910.0))


@query(f"SELECT p_size, p_retailprice, p_partkey, {DIST_P} AS dist FROM part ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 25")
def knn_two_pass(spark, sf_dir):
    return bounded.nearest(parts(spark, sf_dir), 25, (25.0, 910.0))


@query("""SELECT k, c_custkey, sqrt((k - 100.0) * (k - 100.0)) AS dist FROM (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS k, c_custkey FROM customer)
WHERE k IS NOT NULL ORDER BY dist, k, c_custkey LIMIT 15""")
def knn_nulls(spark, sf_dir):
    """Rows without a key are no neighbours."""
    rows = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("k"), "c_custkey")
    return SpatialTable(rows, ("k",), ("c_custkey",)).nearest(15, (100.0,))


@query(f"SELECT p_size, p_retailprice, p_partkey, {DIST_P} AS dist FROM part ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 40")
def knn_incremental(spark, sf_dir):
    """Neighbours pulled one by one, a few at a time, until the caller has enough."""
    rows = list(islice(parts(spark, sf_dir).neighbours((25.0, 910.0), batch=15), 40))
    return spark.createDataFrame(rows, "p_size int, p_retailprice double, p_partkey long, dist double")


CHEBYSHEV = "greatest(abs(CAST(p_size AS DOUBLE) - 25.0), abs(p_retailprice - 910.0))"


@query(f"SELECT p_size, p_retailprice, p_partkey, {CHEBYSHEV} AS dist FROM part ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 25")
def knn_own_metric(spark, sf_dir):
    """A metric given as a Column builder."""
    largest = Custom(lambda p, c: F.greatest(*[F.abs(x.cast("double") - y) for x, y in zip(p, c, strict=True)]))
    return parts(spark, sf_dir).nearest(25, (25.0, 910.0), largest)


@query(f"SELECT p_size, p_retailprice, p_partkey, {CHEBYSHEV} AS dist FROM part ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 25")
def knn_python_metric(spark, sf_dir):
    """A metric given as a Python function, in Arrow batches."""
    largest = udf.metric(lambda p, c: (p[0] - c[0]).abs().combine((p[1] - c[1]).abs(), max), 2)
    return parts(spark, sf_dir).nearest(25, (25.0, 910.0), largest)


@query("SELECT p_size, p_retailprice, p_partkey, abs(CAST(p_size AS DOUBLE) - 25.0) + abs(p_retailprice - 910.0) AS dist FROM part ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 25")
def knn_l1(spark, sf_dir):
    return parts(spark, sf_dir).nearest(25, (25.0, 910.0), L1())


@query("SELECT c_acctbal, c_custkey, sqrt((c_acctbal - 100.0) * (c_acctbal - 100.0)) AS dist FROM customer ORDER BY dist, c_acctbal, c_custkey LIMIT 15")
def knn_1d(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "customer"), ("c_acctbal",), ("c_custkey",)).nearest(15, (100.0,))


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, sqrt((CAST(l_partkey AS DOUBLE) - 500) * (CAST(l_partkey AS DOUBLE) - 500) + (CAST(l_suppkey AS DOUBLE) - 50) * (CAST(l_suppkey AS DOUBLE) - 50)) AS dist
  FROM lineitem ORDER BY dist, l_partkey, l_suppkey, l_orderkey, l_linenumber LIMIT 30""")
def knn_long(spark, sf_dir):
    return SpatialTable(_read(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey"), LINE_IDS).nearest(30, (500, 50))


@query(f"SELECT p_size, p_retailprice, p_partkey, {DIST_P} AS dist FROM part WHERE p_size <= 20 ORDER BY dist, p_size, p_retailprice, p_partkey LIMIT 10")
def knn_filtered(spark, sf_dir):
    return parts(spark, sf_dir).nearest(10, (25.0, 910.0), where=F.col("p_size") <= 20)


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q.e), 6) AS dist FROM embeddings, q ORDER BY dist, vec_id LIMIT 20""")
def knn_embedding(spark, sf_dir):
    table = _read(spark, sf_dir, "embeddings")
    first = table.orderBy("vec_id").select("embedding").first()
    return ArrayTable(table, "embedding", ("vec_id",)).nearest(20, first[0], decimals=6).select("vec_id", "dist")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT * FROM (SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q.e), 6) AS dist FROM embeddings, q) WHERE dist <= 1.2""")
def range_embedding(spark, sf_dir):
    table = _read(spark, sf_dir, "embeddings")
    first = table.orderBy("vec_id").select("embedding").first()
    return ArrayTable(table, "embedding", ("vec_id",)).within(first[0], 1.2, decimals=6).select("vec_id", "dist")


EVEN_ODD = """WITH e AS (SELECT vec_id, embedding FROM embeddings), c AS (SELECT embedding, max(-vec_id) AS vec_id FROM e WHERE vec_id % 5 = 0 GROUP BY embedding)"""


def vectors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query("SELECT vec_id FROM embeddings WHERE embedding = (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)")
def embedding_get(spark, sf_dir):
    table = vectors(spark, sf_dir)
    first = table.orderBy("vec_id").select("embedding").first()
    return ArrayTable(table, "embedding", ("vec_id",)).get(first[0])


@query(f"{EVEN_ODD} SELECT vec_id FROM c UNION ALL SELECT vec_id FROM e WHERE embedding NOT IN (SELECT embedding FROM c)")
def embedding_put(spark, sf_dir):
    """Upsert at array keys."""
    table = vectors(spark, sf_dir)
    return mutate.put(table, table.filter("vec_id % 5 = 0").withColumn("vec_id", -F.col("vec_id")), ["embedding"]).select("vec_id")


@query(f"{EVEN_ODD} SELECT vec_id FROM e WHERE embedding NOT IN (SELECT embedding FROM c)")
def embedding_remove(spark, sf_dir):
    table = vectors(spark, sf_dir)
    return mutate.remove(table, table.filter("vec_id % 5 = 0").select("embedding"), ["embedding"]).select("vec_id")


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN len(embedding) + 1 ELSE len(embedding) END AS dims FROM embeddings")
def embedding_move(spark, sf_dir):
    """Keys moved to points of one more dimension."""
    table = vectors(spark, sf_dir)
    moves = table.filter("vec_id % 5 = 0").select("embedding", F.array_append("embedding", F.lit(9.0).cast("float")).alias("to"))
    return mutate.move(table, moves, ["embedding"], ["to"]).select("vec_id", F.size("embedding").alias("dims"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q.e), 6) AS dist FROM embeddings, q WHERE vec_id % 2 = 1 ORDER BY dist, vec_id LIMIT 5""")
def knn_embedding_filtered(spark, sf_dir):
    table = vectors(spark, sf_dir)
    first = table.orderBy("vec_id").select("embedding").first()
    near = ArrayTable(table, "embedding", ("vec_id",)).nearest(5, first[0], decimals=6, where=F.col("vec_id") % 2 == 1)
    return near.select("vec_id", "dist")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x < -0.3 OR x > 0.3)) = 0")
def window_embedding(spark, sf_dir):
    return ArrayTable(_read(spark, sf_dir, "embeddings"), "embedding", ("vec_id",)).window([-0.3] * 64, [0.3] * 64).select("vec_id")


@query(f"SELECT * FROM (SELECT p_size, p_retailprice, p_partkey FROM part WHERE p_size BETWEEN 20 AND 40 AND p_retailprice BETWEEN 900 AND 950 AND {DIST_P} <= 12.5)")
def window_in_ball(spark, sf_dir):
    return parts(spark, sf_dir).window((20, 900.0), (40, 950.0), where=in_ball(["p_size", "p_retailprice"], (25.0, 910.0), 12.5))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey >> 4 = 100 >> 4 AND l_suppkey >> 4 = 5 >> 4")
def prefix_filter(spark, sf_dir):
    table = SpatialTable(_read(spark, sf_dir, "lineitem"), ("l_partkey", "l_suppkey"), LINE_IDS)
    return table.df.filter(same_prefix(table.keys, (100, 5), 4)).select(*table.keys, *table.values)


@query("""WITH k AS (SELECT p_partkey, CAST(trunc(p_size * 10.0::DOUBLE) AS BIGINT) AS a, CAST(trunc(p_retailprice * 10.0::DOUBLE) AS BIGINT) AS b FROM part)
SELECT a, b, p_partkey, sqrt((a * (1 / 10.0::DOUBLE) - 25.0) * (a * (1 / 10.0::DOUBLE) - 25.0) + (b * (1 / 10.0::DOUBLE) - 910.0) * (b * (1 / 10.0::DOUBLE) - 910.0)) AS dist FROM k ORDER BY dist, a, b, p_partkey LIMIT 15""")
def knn_decoded(spark, sf_dir):
    """Keys stored as fixed-point numbers, distances on what they stand for."""
    fixed = encoding.Multiply(10.0)
    stored = _read(spark, sf_dir, "part").select(fixed.pre(F.col("p_size").cast("double"), 0).alias("a"), fixed.pre(F.col("p_retailprice"), 1).alias("b"), "p_partkey")
    return SpatialTable(stored, ("a", "b"), ("p_partkey",), fixed).nearest(15, (25.0, 910.0), Decoded(fixed))


@query("""SELECT k AS c_acctbal, c_custkey, sqrt((k - 100.0) * (k - 100.0)) AS dist FROM (SELECT c_acctbal AS k, c_custkey FROM customer) WHERE sqrt((k - 100.0) * (k - 100.0)) <= 250.0""")
def range_decoded(spark, sf_dir):
    """Keys stored as sortable bits; the ball's box is encoded too, so the scan can skip."""
    bits_of = encoding.Ieee()
    stored = _read(spark, sf_dir, "customer").select(bits_of.pre(F.col("c_acctbal"), 0).alias("k"), "c_custkey")
    near = SpatialTable(stored, ("k",), ("c_custkey",), bits_of).within((100.0,), 250.0, Decoded(bits_of))
    return near.select(bits_of.post(F.col("k"), 0).alias("c_acctbal"), "c_custkey", "dist")


# --- boxes ---


@query("SELECT l_partkey AS a, l_suppkey AS b, l_partkey + l_linenumber AS c, l_suppkey + l_linenumber AS d, l_orderkey FROM lineitem WHERE l_partkey <= 300 AND l_partkey + l_linenumber >= 200 AND l_suppkey <= 20 AND l_suppkey + l_linenumber >= 10")
def points_as_boxes(spark, sf_dir):
    """Points of four dimensions seen as boxes of two."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_partkey") + F.col("l_linenumber")).alias("c"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("d"), "l_orderkey")
    return SpatialTable(rows, ("a", "b", "c", "d"), ("l_orderkey",)).as_boxes().intersect((200, 10), (300, 20))

Q_LOW, Q_HIGH = (760_000_000, 5_000.0), (860_000_000, 60_000.0)


@query(f"WITH {BOX_SQL} SELECT * FROM boxes WHERE lo0 BETWEEN 760000000 AND 860000000 AND hi0 BETWEEN 760000000 AND 860000000 AND lo1 BETWEEN 5000 AND 60000 AND hi1 BETWEEN 5000 AND 60000")
def box_include(spark, sf_dir):
    return order_boxes(spark, sf_dir).include(Q_LOW, Q_HIGH)


@query(f"WITH {BOX_SQL} SELECT * FROM boxes WHERE lo0 <= 860000000 AND hi0 >= 760000000 AND lo1 <= 60000 AND hi1 >= 5000")
def box_intersect(spark, sf_dir):
    return order_boxes(spark, sf_dir).intersect(Q_LOW, Q_HIGH)


@query(f"WITH {BOX_SQL} SELECT l_orderkey FROM (SELECT * FROM boxes WHERE lo0 <= 860000000 AND hi0 >= 760000000 AND lo1 <= 60000 AND hi1 >= 5000 AND l_orderkey % 2 = 0 ORDER BY lo0, lo1, hi0, hi1, l_orderkey LIMIT 30)")
def box_intersect_list(spark, sf_dir):
    return order_boxes(spark, sf_dir).intersect(Q_LOW, Q_HIGH, where=F.col("l_orderkey") % 2 == 0, limit=30, select=["l_orderkey"])


@query(f"""WITH {BOX_SQL}, d AS (SELECT *, greatest(800000000.0 - hi0, lo0 - 800000000.0, 0.0) AS g0, greatest(30000.0 - hi1, lo1 - 30000.0, 0.0) AS g1 FROM boxes)
SELECT lo0, lo1, hi0, hi1, l_orderkey, sqrt(g0 * g0 + g1 * g1) AS dist FROM d ORDER BY dist, lo0, lo1, hi0, hi1, l_orderkey LIMIT 20""")
def box_knn_edge(spark, sf_dir):
    return order_boxes(spark, sf_dir).nearest(20, (800_000_000, 30_000.0))


@query(f"""WITH {BOX_SQL}, d AS (SELECT *, ((lo0 - 800000000::DOUBLE) + (hi0 - 800000000::DOUBLE)) / 2 AS g0, ((lo1 - 30000::DOUBLE) + (hi1 - 30000::DOUBLE)) / 2 AS g1 FROM boxes)
SELECT lo0, lo1, hi0, hi1, l_orderkey, sqrt(g0 * g0 + g1 * g1) AS dist FROM d ORDER BY dist, lo0, lo1, hi0, hi1, l_orderkey LIMIT 20""")
def box_knn_center(spark, sf_dir):
    return order_boxes(spark, sf_dir).nearest(20, (800_000_000, 30_000.0), metric="center")


@query(f"WITH {BOX_SQL}, one AS (SELECT * FROM boxes ORDER BY l_orderkey LIMIT 1) SELECT b.l_orderkey FROM boxes b JOIN one USING (lo0, lo1, hi0, hi1)")
def box_get(spark, sf_dir):
    """A box found by its own bounds, given as an entry."""
    boxes = order_boxes(spark, sf_dir)
    return boxes.get(boxes.extent().orderBy("l_orderkey").first())


@query(f"WITH {BOX_SQL}, one AS (SELECT * FROM boxes ORDER BY l_orderkey LIMIT 1) SELECT b.* FROM boxes b, one WHERE b.lo0 <= one.hi0 AND b.hi0 >= one.lo0 AND b.lo1 <= one.hi1 AND b.hi1 >= one.lo1")
def box_intersect_entry(spark, sf_dir):
    boxes = order_boxes(spark, sf_dir)
    return boxes.intersect(boxes.extent().orderBy("l_orderkey").first())


@query(f"""WITH {BOX_SQL}, d AS (SELECT *, greatest(800000000.0 - hi0, lo0 - 800000000.0, 0.0) AS g0, greatest(30000.0 - hi1, lo1 - 30000.0, 0.0) AS g1 FROM boxes)
SELECT * FROM (SELECT lo0, lo1, hi0, hi1, l_orderkey, sqrt(g0 * g0 + g1 * g1) AS dist FROM d) WHERE dist <= 2000000.0""")
def box_within_edge(spark, sf_dir):
    return order_boxes(spark, sf_dir).within(2_000_000.0, (800_000_000, 30_000.0))


@query(f"""WITH {BOX_SQL}, d AS (SELECT *, ((lo0 - 800000000::DOUBLE) + (hi0 - 800000000::DOUBLE)) / 2 AS g0, ((lo1 - 30000::DOUBLE) + (hi1 - 30000::DOUBLE)) / 2 AS g1 FROM boxes)
SELECT * FROM (SELECT lo0, lo1, hi0, hi1, l_orderkey, sqrt(g0 * g0 + g1 * g1) AS dist FROM d) WHERE dist <= 9000000.0""")
def box_within_center(spark, sf_dir):
    return order_boxes(spark, sf_dir).within(9_000_000.0, (800_000_000, 30_000.0), metric="center")


# --- multimaps ---


def bag(spark, sf_dir) -> MultiTable:
    """Quantity and discount repeat a lot: a natural multimap."""
    return MultiTable(_read(spark, sf_dir, "lineitem"), ("l_quantity", "l_discount"), LINE_IDS)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 17.0 AND l_discount = 0.05")
def multimap_get(spark, sf_dir):
    return bag(spark, sf_dir).get((17.0, 0.05))


@query("SELECT l_quantity, l_discount, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 8 AND l_discount BETWEEN 0.01 AND 0.03")
def multimap_window(spark, sf_dir):
    return bag(spark, sf_dir).window((5.0, 0.01), (8.0, 0.03))


@query("""WITH d AS (SELECT l_quantity, l_discount, l_orderkey, l_linenumber, sqrt((l_quantity - 20.3) * (l_quantity - 20.3) + (l_discount - 0.04) * (l_discount - 0.04)) AS dist FROM lineitem),
r AS (SELECT *, dense_rank() OVER (ORDER BY dist, l_quantity, l_discount) AS k FROM d)
SELECT l_quantity, l_discount, l_orderkey, l_linenumber, dist FROM r WHERE k <= 3""")
def multimap_knn_positions(spark, sf_dir):
    return bag(spark, sf_dir).nearest_positions(3, (20.3, 0.04))


@query("""SELECT l_quantity, l_discount, l_orderkey, l_linenumber, sqrt((l_quantity - 20.3) * (l_quantity - 20.3) + (l_discount - 0.04) * (l_discount - 0.04)) AS dist FROM lineitem
ORDER BY dist, l_quantity, l_discount, l_orderkey, l_linenumber LIMIT 12""")
def multimap_knn_values(spark, sf_dir):
    return bag(spark, sf_dir).nearest(12, (20.3, 0.04))


@query("""SELECT * FROM (SELECT l_quantity, l_discount, l_orderkey, l_linenumber, sqrt((l_quantity - 20.3) * (l_quantity - 20.3) + (l_discount - 0.04) * (l_discount - 0.04)) AS dist FROM lineitem) WHERE dist <= 0.8""")
def multimap_range(spark, sf_dir):
    return bag(spark, sf_dir).within((20.3, 0.04), 0.8)


@query("SELECT l_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity BETWEEN 5 AND 8 AND l_discount BETWEEN 0.01 AND 0.03 ORDER BY l_quantity, l_discount, l_orderkey, l_linenumber LIMIT 20)")
def multimap_query_all(spark, sf_dir):
    return bag(spark, sf_dir).query_all((5.0, 0.01), (8.0, 0.03), limit=20, select=["l_orderkey"])


@query("""WITH n AS (SELECT p_size, p_name, (row_number() OVER (PARTITION BY p_size ORDER BY p_name) - 1) // 16 AS ordinal FROM part WHERE p_size IS NOT NULL)
SELECT p_size, ordinal, list(p_name ORDER BY p_name) AS names FROM n GROUP BY ALL""")
def multimap_collect(spark, sf_dir):
    """The values of every key as arrays of 16 at most."""
    table = MultiTable(_read(spark, sf_dir, "part"), ("p_size",), ("p_name",))
    return table.listed(16).select("p_size", "ordinal", F.transform("values", lambda v: v["p_name"]).alias("names"))


@query("SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity = 17.0 AND l_linenumber = 3")
def multimap_contains(spark, sf_dir):
    return MultiTable(_read(spark, sf_dir, "lineitem"), ("l_quantity",), ("l_linenumber",)).holds_pair((17.0,), 3)


# --- mutations ---


@query(f"""WITH {BOX_SQL}, c AS (SELECT lo0, lo1, hi0, hi1, -l_orderkey AS l_orderkey FROM boxes WHERE l_orderkey % 5 = 0)
SELECT lo0, lo1, hi0, hi1, l_orderkey FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lo0 = b.lo0 AND c.lo1 = b.lo1 AND c.hi0 = b.hi0 AND c.hi1 = b.hi1)
UNION ALL SELECT * FROM c""")
def box_put(spark, sf_dir):
    boxes = order_boxes(spark, sf_dir)
    changes = boxes.extent().filter("l_orderkey % 5 = 0").withColumn("l_orderkey", -F.col("l_orderkey"))
    return mutate.put(boxes.extent(), changes, list(boxes.keys))


@query("""WITH t AS (SELECT DISTINCT l_quantity, l_discount, l_orderkey AS id FROM lineitem)
SELECT * FROM t WHERE id % 3 <> 0 UNION ALL SELECT l_quantity + 0.5, l_discount, id FROM t WHERE id % 3 = 0""")
def multimap_move(spark, sf_dir):
    """Keys with ids: (coordinates, id) is the primary key and moves as one."""
    table = _read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", F.col("l_orderkey").alias("id")).distinct()
    moves = table.filter("id % 3 = 0").withColumns({"q": F.col("l_quantity") + 0.5, "d": F.col("l_discount"), "i": F.col("id")})
    return mutate.move(table, moves, ["l_quantity", "l_discount", "id"], ["q", "d", "i"])


def _base(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")


def _changes(spark, sf_dir):
    """Suppliers as changes of parts, at every 41st key and, for large tables of suppliers, beyond the parts."""
    return _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 41).alias("p_partkey"), F.col("s_nationkey").alias("p_size"), F.col("s_acctbal").alias("p_retailprice"))


BASE = "base AS (SELECT p_partkey, p_size, p_retailprice FROM part), changes AS (SELECT s_suppkey * 41 AS p_partkey, s_nationkey AS p_size, s_acctbal AS p_retailprice FROM supplier)"
K = ["p_partkey"]


@query(f"WITH {BASE} SELECT * FROM base ANTI JOIN changes USING (p_partkey) UNION ALL SELECT * FROM changes")
def put_upsert(spark, sf_dir):
    return mutate.put(_base(spark, sf_dir), _changes(spark, sf_dir), K)


@query(f"""WITH {BASE}, seq AS (SELECT p_partkey % 97 AS p_partkey, p_size, p_retailprice, row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY p_partkey DESC) AS n FROM changes),
last AS (SELECT p_partkey, p_size, p_retailprice FROM seq WHERE n = 1) SELECT * FROM base ANTI JOIN last USING (p_partkey) UNION ALL SELECT * FROM last""")
def put_sequence(spark, sf_dir):
    changes = _changes(spark, sf_dir).withColumn("seq", F.col("p_partkey")).withColumn("p_partkey", F.col("p_partkey") % 97)
    return mutate.put(_base(spark, sf_dir), changes, K, sequence="seq")


@query(f"WITH {BASE} SELECT DISTINCT changes.p_partkey, base.p_size AS previous, base.p_partkey IS NOT NULL AS found FROM changes LEFT JOIN base USING (p_partkey)")
def put_previous(spark, sf_dir):
    return mutate.previous(_base(spark, sf_dir), _changes(spark, sf_dir), K, "p_size")


@query(f"WITH {BASE} SELECT * FROM base UNION ALL SELECT * FROM changes ANTI JOIN base USING (p_partkey)")
def put_if_absent(spark, sf_dir):
    return mutate.put_if_absent(_base(spark, sf_dir), _changes(spark, sf_dir), K)


@query(f"WITH {BASE} SELECT * FROM base ANTI JOIN changes USING (p_partkey)")
def remove_keys(spark, sf_dir):
    return mutate.remove(_base(spark, sf_dir), _changes(spark, sf_dir).select("p_partkey"), K)


@query(f"WITH {BASE} SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.p_partkey = base.p_partkey AND c.p_size IS NOT DISTINCT FROM base.p_size)")
def remove_pairs(spark, sf_dir):
    return mutate.remove_pairs(_base(spark, sf_dir), _changes(spark, sf_dir).select("p_partkey", "p_size"), K, "p_size")


@query(f"WITH {BASE} SELECT base.p_partkey, CASE WHEN c.p_partkey IS NOT NULL THEN c.p_size ELSE base.p_size END AS p_size, base.p_retailprice FROM base LEFT JOIN changes c USING (p_partkey)")
def replace_present(spark, sf_dir):
    return mutate.replace(_base(spark, sf_dir), _changes(spark, sf_dir), K, "p_size")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS old, p_size + 100 AS new FROM part WHERE p_partkey % 3 = 0)
SELECT part.p_partkey, CASE WHEN c.old = p_size THEN new ELSE p_size END AS p_size FROM part LEFT JOIN c USING (p_partkey)""")
def replace_cas(spark, sf_dir):
    base = _base(spark, sf_dir).select("p_partkey", "p_size")
    changes = base.filter("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(-1).alias("old"), (F.col("p_size") + 100).alias("new"))
    return mutate.compare_and_set(base, changes, K, "p_size", "old", "new")


MOVES = "m AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey + 10000000 END AS new_key FROM part WHERE p_partkey % 2 = 0)"


def _moves(base):
    new = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey") + 1).otherwise(F.col("p_partkey") + 10_000_000)
    return base.filter("p_partkey % 2 = 0").select("p_partkey", new.alias("new_key"))


@query(f"""WITH {MOVES}, ok AS (SELECT m.* FROM m WHERE new_key NOT IN (SELECT p_partkey FROM part))
SELECT coalesce(ok.new_key, part.p_partkey) AS p_partkey, p_size FROM part LEFT JOIN ok USING (p_partkey)""")
def update_key(spark, sf_dir):
    base = _base(spark, sf_dir).select("p_partkey", "p_size")
    return mutate.move(base, _moves(base), K, ["new_key"])


@query(f"""WITH {MOVES} SELECT new_key AS p_partkey, p_size FROM part JOIN m USING (p_partkey)
UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM m) AND p_partkey NOT IN (SELECT new_key FROM m)""")
def update_key_overwrite(spark, sf_dir):
    base = _base(spark, sf_dir).select("p_partkey", "p_size")
    return mutate.move(base, _moves(base), K, ["new_key"], on_conflict="overwrite")


ASKED = "b AS (SELECT p_partkey, p_size FROM part), a AS (SELECT s_suppkey * 41 AS p_partkey, s_nationkey AS arg FROM supplier)"


def _asked(spark, sf_dir):
    return _changes(spark, sf_dir).select("p_partkey", F.col("p_size").alias("arg"))


@query(f"""WITH {ASKED}, f AS (SELECT p_partkey, b.p_size AS old, b.p_partkey IS NOT NULL AS held, arg, a.p_partkey IS NOT NULL AS asked FROM b FULL JOIN a USING (p_partkey)),
r AS (SELECT p_partkey, CASE WHEN NOT asked THEN old WHEN arg < 5 THEN NULL ELSE coalesce(old, 0) + arg END AS p_size, asked FROM f)
SELECT p_partkey, p_size FROM r WHERE p_size IS NOT NULL OR NOT asked""")
def compute_merge(spark, sf_dir):
    base = _base(spark, sf_dir).select("p_partkey", "p_size")
    return mutate.compute(base, _asked(spark, sf_dir), K, "p_size", lambda v, held: F.when(F.col("arg") >= 5, F.coalesce(v, F.lit(0)) + F.col("arg")))


@query(f"""WITH {ASKED} SELECT * FROM b UNION ALL SELECT p_partkey, arg * 2 AS p_size FROM a ANTI JOIN b USING (p_partkey)""")
def compute_if_absent(spark, sf_dir):
    base = _base(spark, sf_dir).select("p_partkey", "p_size")
    return mutate.compute(base, _asked(spark, sf_dir), K, "p_size", lambda v, held: F.col("arg") * 2, when="absent")


@query(f"""WITH {ASKED} SELECT p_partkey, CASE WHEN a.p_partkey IS NOT NULL THEN p_size + arg ELSE p_size END AS p_size FROM b LEFT JOIN a USING (p_partkey) WHERE a.p_partkey IS NULL OR arg >= 5""")
def compute_if_present(spark, sf_dir):
    base = _base(spark, sf_dir).select("p_partkey", "p_size")
    return mutate.compute(base, _asked(spark, sf_dir), K, "p_size", lambda v, held: F.when(F.col("arg") >= 5, v + F.col("arg")), when="present")


def _pairs(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber")


@query("SELECT l_quantity, l_linenumber FROM lineitem UNION ALL SELECT l_quantity, 9 AS l_linenumber FROM lineitem WHERE l_quantity < 3")
def bag_put(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return mutate.bag_put(pairs, pairs.filter("l_quantity < 3").withColumn("l_linenumber", F.lit(9)))


@query("SELECT l_quantity, l_linenumber FROM lineitem EXCEPT ALL SELECT DISTINCT l_quantity, l_linenumber FROM lineitem WHERE l_quantity < 10")
def bag_remove(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return mutate.bag_remove(pairs, pairs.filter("l_quantity < 10").distinct())


@query("""WITH n AS (SELECT l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_quantity, l_linenumber) AS k FROM lineitem)
SELECT CASE WHEN k = 1 AND l_quantity < 10 THEN l_quantity + 1000 ELSE l_quantity END AS l_quantity, l_linenumber FROM n""")
def bag_move(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    moves = pairs.filter("l_quantity < 10").distinct().withColumn("new_quantity", F.col("l_quantity") + 1000)
    return mutate.bag_move(pairs, moves, ["l_quantity"], ["new_quantity"])


@query("""WITH n AS (SELECT l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_quantity, l_linenumber) AS k FROM lineitem)
SELECT l_quantity, CASE WHEN k = 1 AND l_quantity < 10 THEN l_linenumber + 50 ELSE l_linenumber END AS l_linenumber FROM n WHERE NOT (k = 1 AND l_quantity < 10 AND l_linenumber = 1)""")
def bag_compute(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    asked = pairs.filter("l_quantity < 10").distinct()
    return mutate.bag_compute(pairs, asked, ["l_quantity"], "l_linenumber", lambda v: F.when(v != 1, v + 50))


PAIRS = "b AS (SELECT l_quantity, l_linenumber FROM lineitem), a AS (SELECT DISTINCT l_quantity, l_linenumber + 4 AS l_linenumber FROM b WHERE l_quantity < 10)"


def _asked_pairs(pairs):
    """Pairs of which about half are in the bag."""
    return pairs.filter("l_quantity < 10").withColumn("l_linenumber", F.col("l_linenumber") + 4).distinct()


@query(f"WITH {PAIRS} SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (l_quantity, l_linenumber)")
def bag_put_if_absent(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return mutate.bag_put_if_absent(pairs, _asked_pairs(pairs))


NUMBERED = "n AS (SELECT l_quantity, l_linenumber, row_number() OVER (PARTITION BY l_quantity, l_linenumber) AS k FROM b)"


@query(f"WITH {PAIRS}, {NUMBERED} SELECT l_quantity, CASE WHEN k = 1 AND l_quantity < 10 AND l_linenumber > 4 THEN -l_linenumber ELSE l_linenumber END AS l_linenumber FROM n")
def bag_replace(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    changes = _asked_pairs(pairs).select("l_quantity", F.col("l_linenumber").alias("old"), (-F.col("l_linenumber")).alias("new"))
    return mutate.bag_replace(pairs, changes, ["l_quantity"], "l_linenumber", "old", "new")


@query(f"WITH {PAIRS} SELECT * FROM b UNION ALL SELECT l_quantity, l_linenumber * 10 FROM a ANTI JOIN b USING (l_quantity, l_linenumber) WHERE l_linenumber <> 9")
def bag_compute_if_absent(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return mutate.bag_compute_if_absent(pairs, _asked_pairs(pairs), ["l_quantity"], "l_linenumber", lambda v: F.when(v != 9, v * 10))


@query(f"""WITH {PAIRS}, {NUMBERED} SELECT l_quantity, CASE WHEN k = 1 AND l_quantity < 10 AND l_linenumber > 4 THEN l_linenumber + 50 ELSE l_linenumber END AS l_linenumber FROM n
UNION ALL SELECT l_quantity, l_linenumber * 10 FROM a ANTI JOIN b USING (l_quantity, l_linenumber)""")
def bag_compute_always(spark, sf_dir):
    """One function for pairs that are held, another for those that are not."""
    pairs = _pairs(spark, sf_dir)
    return mutate.bag_compute(pairs, _asked_pairs(pairs), ["l_quantity"], "l_linenumber", lambda v: v + 50, absent=lambda v: v * 10)


@query("SELECT l_quantity, l_linenumber FROM lineitem WHERE l_quantity >= 10")
def bag_remove_key(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return mutate.remove(pairs, pairs.filter("l_quantity < 10").select("l_quantity").distinct(), ["l_quantity"])


@query("""WITH t AS (SELECT DISTINCT l_extendedprice, l_tax, 0 AS v FROM lineitem), c AS (SELECT DISTINCT l_extendedprice, 0.01::DOUBLE AS l_tax, 1 AS v FROM lineitem WHERE l_discount = 0.05)
SELECT * FROM t ANTI JOIN c USING (l_extendedprice, l_tax) UNION ALL SELECT * FROM c""")
def put_float_keys(spark, sf_dir):
    """Upsert at floating-point keys; the batch repeats keys."""
    rows = _read(spark, sf_dir, "lineitem")
    table = rows.select("l_extendedprice", "l_tax", F.lit(0).alias("v")).distinct()
    return mutate.put(table, rows.filter("l_discount = 0.05").select("l_extendedprice", F.lit(0.01).alias("l_tax"), F.lit(1).alias("v")), ["l_extendedprice", "l_tax"])


@query(f"WITH {BASE}, r AS (SELECT p_partkey % 97 AS p_partkey, max(struct_pack(a := p_size, b := p_retailprice)) AS m FROM changes GROUP BY 1) SELECT * FROM base ANTI JOIN r USING (p_partkey) UNION ALL SELECT p_partkey, m.a, m.b FROM r")
def put_repeated_keys(spark, sf_dir):
    """A batch that changes keys several times, without a sequence: the greatest values count. Null keys are left out."""
    changes = _changes(spark, sf_dir).withColumn("p_partkey", F.col("p_partkey") % 97)
    return mutate.put(_base(spark, sf_dir), changes.unionByName(changes.limit(1).withColumn("p_partkey", F.lit(None).cast("long"))), K)


@query(f"WITH {BASE} SELECT (SELECT count(*) FROM base) AS n_before, (SELECT count(*) FROM base) + (SELECT count(*) FROM changes ANTI JOIN base USING (p_partkey)) AS n_after")
def snapshot(spark, sf_dir):
    """The table as it was is still there after a change of it."""
    before = _base(spark, sf_dir)
    after = mutate.put(before, _changes(spark, sf_dir), K)
    return before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 3 <> 0")
def set_insert_delete(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    inserted = mutate.set_insert(rows.filter("l_partkey % 2 = 0").distinct(), rows)
    return mutate.set_delete(inserted, rows.filter("l_partkey % 3 = 0"))


# --- joins ---


def _windows(spark, sf_dir):
    """A window of part size and price around what each supplier has."""
    s = _read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.col("s_nationkey").cast("double").alias("a0"), (F.col("s_nationkey") + 6.0).alias("b0"), (F.lit(900.0) + F.abs("s_acctbal") / 20).alias("a1"), (F.lit(930.0) + F.abs("s_acctbal") / 15).alias("b1"))


WINDOWS = "w AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS a0, s_nationkey + 6.0::DOUBLE AS b0, 900.0::DOUBLE + abs(s_acctbal) / 20 AS a1, 930.0::DOUBLE + abs(s_acctbal) / 15 AS b1 FROM supplier)"


@query(f"WITH {WINDOWS} SELECT s_suppkey, p_partkey FROM w JOIN part ON p_size BETWEEN a0 AND b0 AND p_retailprice BETWEEN a1 AND b1")
def window_join(spark, sf_dir):
    table = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return joins.window_join(table, _windows(spark, sf_dir), ["p_size", "p_retailprice"], ["a0", "a1"], ["b0", "b1"], units=[1.0, 10.0]).select("s_suppkey", "p_partkey")


@query(f"WITH {WINDOWS} SELECT x.s_suppkey AS x, y.s_suppkey AS y FROM w x JOIN w y ON x.a0 <= y.b0 AND x.b0 >= y.a0 AND x.a1 <= y.b1 AND x.b1 >= y.a1")
def box_join(spark, sf_dir):
    w = _windows(spark, sf_dir)
    x = w.select(*[F.col(c).alias(f"x_{c}") for c in w.columns])
    y = w.select(*[F.col(c).alias(f"y_{c}") for c in w.columns])
    met = joins.box_join(x, y, ["x_a0", "x_a1"], ["x_b0", "x_b1"], ["y_a0", "y_a1"], ["y_b0", "y_b1"], units=[1.0, 10.0])
    return met.select(F.col("x_s_suppkey").alias("x"), F.col("y_s_suppkey").alias("y"))


@query("SELECT s_suppkey, c_custkey, sqrt((c_acctbal - s_acctbal) * (c_acctbal - s_acctbal)) AS dist FROM supplier JOIN customer ON abs(c_acctbal - s_acctbal) <= 40.0")
def distance_join(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return joins.distance_join(c, s, ["c_acctbal"], ["s_acctbal"], 40.0).select("s_suppkey", "c_custkey", "dist")


@query("""SELECT s_suppkey, c_custkey, dist, rank FROM (SELECT s_suppkey, c_custkey, sqrt((c_acctbal - s_acctbal) * (c_acctbal - s_acctbal)) AS dist,
  CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt((c_acctbal - s_acctbal) * (c_acctbal - s_acctbal)), c_custkey) AS INTEGER) AS rank FROM supplier, customer) WHERE rank <= 5""")
def knn_join(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return joins.nearest_join(c, s, ["c_acctbal"], ["s_acctbal"], "s_suppkey", ["c_custkey"], 5).select("s_suppkey", "c_custkey", "dist", "rank")


@query(f"WITH {WINDOWS} SELECT x.s_suppkey AS x, y.s_suppkey AS y FROM w x JOIN w y ON x.a0 >= y.a0 AND x.b0 <= y.b0 AND x.a1 >= y.a1 AND x.b1 <= y.b1")
def box_include_join(spark, sf_dir):
    w = _windows(spark, sf_dir)
    x = w.select(*[F.col(c).alias(f"x_{c}") for c in w.columns])
    y = w.select(*[F.col(c).alias(f"y_{c}") for c in w.columns])
    met = joins.box_join(x, y, ["x_a0", "x_a1"], ["x_b0", "x_b1"], ["y_a0", "y_a1"], ["y_b0", "y_b1"], units=[1.0, 10.0], include=True)
    return met.select(F.col("x_s_suppkey").alias("x"), F.col("y_s_suppkey").alias("y"))


@query(f"WITH {WINDOWS} SELECT s_suppkey, p_partkey FROM w JOIN part ON p_size BETWEEN a0 AND b0 AND p_retailprice BETWEEN a1 AND b1")
def box_join_points(spark, sf_dir):
    """Points as boxes without a width."""
    p = _read(spark, sf_dir, "part").select("p_partkey", *[F.col(c).cast("double").alias(f"{side}{i}") for side in ("lo", "hi") for i, c in enumerate(("p_size", "p_retailprice"))])
    met = joins.box_join(p, _windows(spark, sf_dir), ["lo0", "lo1"], ["hi0", "hi1"], ["a0", "a1"], ["b0", "b1"], units=[1.0, 10.0])
    return met.select("s_suppkey", "p_partkey")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice")
def window_join_points(spark, sf_dir):
    """Windows without a width are lookups."""
    p = _read(spark, sf_dir, "part")
    windows = p.select(F.col("p_partkey").alias("a"), F.col("p_size").alias("s"), F.col("p_retailprice").alias("r"))
    points = p.select(F.col("p_partkey").alias("b"), "p_size", "p_retailprice")
    return joins.window_join(points, windows, ["p_size", "p_retailprice"], ["s", "r"], ["s", "r"]).select("a", "b")


@query("SELECT s_suppkey, c_custkey, 0.0::DOUBLE AS dist FROM supplier JOIN customer ON c_nationkey = s_nationkey")
def distance_join_zero(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return joins.distance_join(c, s, ["c_nationkey"], ["s_nationkey"], 0.0).select("s_suppkey", "c_custkey", "dist")


L1_2D = "abs(CAST(p_size AS DOUBLE) - x) + abs(p_retailprice - y)"


@query(f"""WITH q AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) * 4 - 20 AS x, 800 + s_acctbal / 20 AS y FROM supplier)
SELECT s_suppkey, p_partkey, dist, rank FROM (SELECT s_suppkey, p_partkey, {L1_2D} AS dist, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY {L1_2D}, p_partkey) AS INTEGER) AS rank FROM q, part) WHERE rank <= 3""")
def knn_join_2d(spark, sf_dir):
    """Manhattan neighbours of places inside and far outside the table's extent."""
    q = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey").cast("double") * 4 - 20).alias("x"), (800 + F.col("s_acctbal") / 20).alias("y"))
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return joins.nearest_join(p, q, ["p_size", "p_retailprice"], ["x", "y"], "s_suppkey", ["p_partkey"], 3, L1()).select("s_suppkey", "p_partkey", "dist", "rank")


HOT_PARTS = """hot AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 7.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS x, CASE WHEN p_partkey % 3 = 0 THEN 905.0::DOUBLE ELSE p_retailprice END AS y FROM part)"""


def _hot_parts(spark, sf_dir) -> DataFrame:
    """Parts by size and price, a third of them at one place."""
    hot = F.col("p_partkey") % 3 == 0
    return _read(spark, sf_dir, "part").select("p_partkey", F.when(hot, 7.0).otherwise(F.col("p_size").cast("double")).alias("x"), F.when(hot, 905.0).otherwise(F.col("p_retailprice")).alias("y"))


@query(f"WITH {WINDOWS}, {HOT_PARTS} SELECT s_suppkey, p_partkey FROM w JOIN hot ON x BETWEEN a0 AND b0 AND y BETWEEN a1 AND b1")
def window_join_hot(spark, sf_dir):
    """A third of the points at one place, which some windows hold."""
    return joins.window_join(_hot_parts(spark, sf_dir), _windows(spark, sf_dir), ["x", "y"], ["a0", "a1"], ["b0", "b1"], units=[1.0, 10.0]).select("s_suppkey", "p_partkey")


@query(f"""WITH {HOT_PARTS}, q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 7.0::DOUBLE ELSE CAST(s_nationkey AS DOUBLE) * 2 END AS u, CASE WHEN s_suppkey % 4 = 0 THEN 905.0::DOUBLE ELSE 900 + abs(s_acctbal) / 12 END AS v FROM supplier)
SELECT s_suppkey, p_partkey, dist, rank FROM (SELECT s_suppkey, p_partkey, abs(x - u) + abs(y - v) AS dist, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(x - u) + abs(y - v), p_partkey) AS INTEGER) AS rank FROM q, hot) WHERE rank <= 4""")
def knn_join_hot(spark, sf_dir):
    """Neighbours where a third of the points and a quarter of the queries are at one place."""
    at = F.col("s_suppkey") % 4 == 0
    q = _read(spark, sf_dir, "supplier").select("s_suppkey", F.when(at, 7.0).otherwise(F.col("s_nationkey").cast("double") * 2).alias("u"), F.when(at, 905.0).otherwise(900 + F.abs("s_acctbal") / 12).alias("v"))
    return joins.nearest_join(_hot_parts(spark, sf_dir), q, ["x", "y"], ["u", "v"], "s_suppkey", ["p_partkey"], 4, L1()).select("s_suppkey", "p_partkey", "dist", "rank")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey BETWEEN 300 AND 900 AND l_suppkey BETWEEN 20 AND 60")
def window_packed(spark, sf_dir):
    """A window on one packed key: ranges of a stored Z-order column, the exact window behind them."""
    n_bits, path = 24, shared_path(spark, "packed")
    rows = _read(spark, sf_dir, "lineitem").select(bits.interleave([F.col("l_partkey"), F.col("l_suppkey")], n_bits).alias("z"), "l_orderkey", "l_linenumber")
    rows.repartitionByRange("z").sortWithinPartitions("z").write.parquet(path)
    low, high = (300, 20), (900, 60)
    found = spark.read.parquet(path).filter(zranges.in_ranges(F.col("z"), zranges.z_ranges(low, high, n_bits)))
    partkey, suppkey = bits.deinterleave(F.col("z"), 2, n_bits)
    return found.filter(zranges.inside(F.col("z"), low, high, n_bits)).select(partkey.alias("l_partkey"), suppkey.alias("l_suppkey"), "l_orderkey", "l_linenumber")


BOX_PAIRS = """w AS (SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS a0, s_nationkey + 6.0::DOUBLE AS b0, 900.0::DOUBLE + abs(s_acctbal) / 20 AS a1, 930.0::DOUBLE + abs(s_acctbal) / 15 AS b1 FROM supplier),
q AS (SELECT c_custkey AS c, CAST(c_nationkey AS DOUBLE) * 3 AS u0, c_nationkey * 3.0::DOUBLE + 1 AS v0, abs(c_acctbal) / 9 AS u1, abs(c_acctbal) / 9 + 5 AS v1 FROM customer WHERE c_custkey % 7 = 0),
d AS (SELECT c, id, sqrt(greatest(u0 - b0, a0 - v0, 0.0) * greatest(u0 - b0, a0 - v0, 0.0) + greatest(u1 - b1, a1 - v1, 0.0) * greatest(u1 - b1, a1 - v1, 0.0)) AS edge,
  sqrt((((a0 - u0) + (b0 - v0)) / 2) * (((a0 - u0) + (b0 - v0)) / 2) + (((a1 - u1) + (b1 - v1)) / 2) * (((a1 - u1) + (b1 - v1)) / 2)) AS center FROM w, q)"""


def _box_sides(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").filter("c_custkey % 7 = 0")
    at, money = F.col("c_nationkey").cast("double") * 3, F.abs("c_acctbal") / 9
    q = c.select(F.col("c_custkey").alias("c"), at.alias("u0"), (at + 1).alias("v0"), money.alias("u1"), (money + 5).alias("v1"))
    return _windows(spark, sf_dir).withColumnRenamed("s_suppkey", "id"), q, (["a0", "a1"], ["b0", "b1"], ["u0", "u1"], ["v0", "v1"])


@query(f"WITH {BOX_PAIRS} SELECT c, id, edge AS dist FROM d WHERE edge <= 12.0")
def box_distance_join(spark, sf_dir):
    """Boxes whose edges are near each other."""
    w, q, sides = _box_sides(spark, sf_dir)
    return joins.box_distance_join(w, q, *sides, 12.0).select("c", "id", "dist")


@query(f"WITH {BOX_PAIRS} SELECT c, id, center AS dist FROM d WHERE center <= 30.0")
def box_distance_join_center(spark, sf_dir):
    w, q, sides = _box_sides(spark, sf_dir)
    return joins.box_distance_join(w, q, *sides, 30.0, "center").select("c", "id", "dist")


@query(f"WITH {BOX_PAIRS} SELECT c, id, dist, rank FROM (SELECT c, id, edge AS dist, CAST(row_number() OVER (PARTITION BY c ORDER BY edge, id) AS INTEGER) AS rank FROM d) WHERE rank <= 4")
def box_knn_join(spark, sf_dir):
    """The nearest boxes of each box, by their edges."""
    w, q, sides = _box_sides(spark, sf_dir)
    return joins.box_nearest_join(w, q, *sides, "c", ["id"], 4).select("c", "id", "dist", "rank")


@query(f"WITH {BOX_PAIRS} SELECT c, id, dist, rank FROM (SELECT c, id, center AS dist, CAST(row_number() OVER (PARTITION BY c ORDER BY center, id) AS INTEGER) AS rank FROM d) WHERE rank <= 4")
def box_knn_join_center(spark, sf_dir):
    w, q, sides = _box_sides(spark, sf_dir)
    return joins.box_nearest_join(w, q, *sides, "c", ["id"], 4, "center").select("c", "id", "dist", "rank")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT * FROM (SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q.e), 6) AS dist FROM embeddings, q) WHERE dist <= 1.3""")
def range_embedding_pivots(spark, sf_dir):
    """A ball of array keys, told in part by their distances to a few pivots."""
    table = _read(spark, sf_dir, "embeddings").select("embedding", "vec_id")
    first = table.orderBy("vec_id").select("embedding").first()
    return PivotTable.of(table, "embedding", ("vec_id",)).within(first[0], 1.3, decimals=6).select("vec_id", "dist")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q.e), 6) AS dist FROM embeddings, q ORDER BY dist, vec_id LIMIT 20""")
def knn_embedding_pivots(spark, sf_dir):
    table = _read(spark, sf_dir, "embeddings").select("embedding", "vec_id")
    first = table.orderBy("vec_id").select("embedding").first()
    return PivotTable.of(table, "embedding", ("vec_id",)).nearest(20, first[0], decimals=6).select("vec_id", "dist")


@query("""WITH d AS (SELECT q.vec_id AS q, e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 10 = 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d) SELECT q, vec_id, dist, rank FROM r WHERE rank <= 3""")
def knn_join_embedding(spark, sf_dir):
    """Neighbours of many array keys among others, itself the first."""
    table = _read(spark, sf_dir, "embeddings").select("embedding", "vec_id")
    queries = table.filter("vec_id % 10 = 3").select(F.col("vec_id").alias("q"), F.col("embedding").alias("at"))
    return PivotTable.of(table, "embedding", ("vec_id",)).nearest_join(queries, "at", "q", 3, decimals=6).select("q", "vec_id", "dist", "rank")


# --- stored tables ---


def _stored(spark, sf_dir, keys=("p_partkey", "p_size"), files: int = 16) -> StoredTable:
    return StoredTable.create(_base(spark, sf_dir), shared_path(spark, "stored"), keys, files)


def _priced(spark, sf_dir) -> DataFrame:
    """Suppliers as changes of parts at (key, size); about half of the keys exist."""
    s = _read(spark, sf_dir, "supplier")
    held = _base(spark, sf_dir).filter("p_partkey % 7 = 0").select("p_partkey", "p_size", (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return held.unionByName(s.select((F.col("s_suppkey") * 3).alias("p_partkey"), (F.col("s_nationkey") + 100).alias("p_size"), F.col("s_acctbal").alias("p_retailprice")))


PRICED = """base AS (SELECT p_partkey, p_size, p_retailprice FROM part), changes AS (SELECT p_partkey, p_size, p_retailprice + 1 AS p_retailprice FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT s_suppkey * 3, s_nationkey + 100, s_acctbal FROM supplier)"""


@query(f"WITH {PRICED} SELECT * FROM base ANTI JOIN changes USING (p_partkey, p_size) UNION ALL SELECT * FROM changes")
def stored_put(spark, sf_dir):
    """Upsert into a table in files; the next version read back."""
    return _stored(spark, sf_dir).put(_priced(spark, sf_dir)).read()


RANGES_SQL = "SELECT {k} AS asked, p_size, p_retailprice, p_partkey, abs(p_size - {x}) + abs(p_retailprice - {y}) AS dist FROM part WHERE abs(p_size - {x}) + abs(p_retailprice - {y}) <= {r}"


@query(f"{RANGES_SQL.format(k=1, x=10.0, y=950.0, r=12.0)} UNION ALL {RANGES_SQL.format(k=2, x=40.0, y=1200.0, r=30.0)}")
def range_again(spark, sf_dir):
    """One table asked for two balls."""
    table = parts(spark, sf_dir)
    return table.within((10.0, 950.0), 12.0, L1()).select(F.lit(1).alias("asked"), "*").unionByName(table.within((40.0, 1200.0), 30.0, L1()).select(F.lit(2).alias("asked"), "*"))


@query(f"WITH {PRICED} SELECT * FROM base ANTI JOIN changes USING (p_partkey, p_size)")
def stored_remove(spark, sf_dir):
    return _stored(spark, sf_dir).remove(_priced(spark, sf_dir)).read()


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey + 10000000 END AS new_key FROM part WHERE p_partkey % 2 = 0),
ok AS (SELECT m.* FROM m WHERE new_key NOT IN (SELECT p_partkey FROM part)) SELECT coalesce(ok.new_key, part.p_partkey) AS p_partkey, p_size, p_retailprice FROM part LEFT JOIN ok USING (p_partkey)""")
def stored_move(spark, sf_dir):
    """Entries moved to other keys; moves onto keys that are taken are rejected."""
    return _stored(spark, sf_dir, ("p_partkey",)).move(_moves(_base(spark, sf_dir)), ["new_key"]).read()


@query(f"WITH {PRICED}, after AS (SELECT * FROM base ANTI JOIN changes USING (p_partkey, p_size) UNION ALL SELECT * FROM changes) SELECT 0 AS version, * FROM base UNION ALL SELECT 1, * FROM after UNION ALL SELECT 2, * FROM after WHERE p_partkey % 5 <> 0")
def stored_snapshot(spark, sf_dir):
    """All rows of three versions, read after the last change."""
    first = _stored(spark, sf_dir)
    second = first.put(_priced(spark, sf_dir))
    second.remove(second.read().filter("p_partkey % 5 = 0"))
    versions = [StoredTable.open(spark, first.path, v).read().select(F.lit(v).alias("version"), "*") for v in StoredTable.versions(spark, first.path)]
    return reduce(DataFrame.unionByName, versions)


@query(f"SELECT {LINE_SQL}, sqrt((l_quantity - 15) * (l_quantity - 15) + (l_extendedprice - 10000) * (l_extendedprice - 10000) + (l_discount - 0.03) * (l_discount - 0.03) + (l_tax - 0.02) * (l_tax - 0.02)) AS dist FROM lineitem ORDER BY dist, l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey, l_linenumber LIMIT 50")
def knn_best_first(spark, sf_dir):
    """Neighbours from the blocks whose bounds are nearest."""
    return StoredTable.create(lines(spark, sf_dir).extent(), shared_path(spark, "stored"), LINE_KEYS).nearest(50, (15.0, 10000.0, 0.03, 0.02)).select(*LINE_KEYS, *LINE_IDS, "dist")


RING = (30.0, 60000.0, 0.2, 0.3)  # centre in quantity and price, inner and outer radius in shares of 50 and 100000


@query(f"SELECT {LINE_SQL} FROM lineitem WHERE sqrt(((l_quantity - 30) / 50) * ((l_quantity - 30) / 50) + ((l_extendedprice - 60000) / 100000) * ((l_extendedprice - 60000) / 100000)) BETWEEN 0.2 AND 0.3")
def window_region(spark, sf_dir):
    """A ring: boxes inside its hole and outside of it are not read."""
    x, y, inner, outer = RING

    def gap(low, high, at):
        return F.greatest(low - at, F.lit(at) - high, F.lit(0.0))

    def reach(low, high, at):
        return F.greatest(F.abs(low - at), F.abs(high - at))

    def radius(a, b):
        return F.sqrt((a / 50) * (a / 50) + (b / 100000) * (b / 100000))

    meets = lambda lo, hi: (radius(gap(lo[0], hi[0], x), gap(lo[1], hi[1], y)) <= outer) & (radius(reach(lo[0], hi[0], x), reach(lo[1], hi[1], y)) >= inner)
    inside = lambda k: radius(k[0] - x, k[1] - y).between(inner, outer)
    table = StoredTable.create(_read(spark, sf_dir, "lineitem").select(*LINE_KEYS, *LINE_IDS), shared_path(spark, "stored"), LINE_KEYS[:2])
    return table.region(meets, inside)


# --- encodings, bits, statistics ---


@query("SELECT c_custkey, c_acctbal AS decoded, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def encode_roundtrip(spark, sf_dir):
    table = _read(spark, sf_dir, "customer").select("c_custkey", encoding.sortable_long(F.col("c_acctbal")).alias("key"))
    return order.places(table, ["key", "c_custkey"]).select("c_custkey", encoding.from_sortable_long(F.col("key")).alias("decoded"), "place")


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS decoded FROM customer")
def encode_float(spark, sf_dir):
    """32-bit floats as keys and back."""
    key = encoding.sortable_int(F.col("c_acctbal").cast("float"))
    return _read(spark, sf_dir, "customer").select("c_custkey", encoding.from_sortable_int(key).cast("double").alias("decoded"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal * 100.0::DOUBLE) AS BIGINT) AS key, CAST(trunc(c_acctbal * 100.0::DOUBLE) AS BIGINT) * (1 / 100.0::DOUBLE) AS decoded FROM customer")
def encode_multiply(spark, sf_dir):
    fixed = encoding.Multiply(100.0)
    table = _read(spark, sf_dir, "customer").withColumn("key", fixed.pre(F.col("c_acctbal"), 0))
    return table.select("c_custkey", "key", fixed.post(F.col("key"), 0).alias("decoded"))


HEAD = " | ".join(f"(CAST(coalesce(ord(nullif(substr(p_name, {i + 1}, 1), '')), 0) AS BIGINT) << {56 - 8 * i})" for i in range(6))


@query(f"SELECT p_partkey, {HEAD} | (list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) & 65535) AS key FROM part")
def string_keys(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", encoding.string_key(F.col("p_name")).alias("key"))


@query("SELECT min(p_size) AS min_p_size, min(p_retailprice) AS min_p_retailprice, max(p_size) AS max_p_size, max(p_retailprice) AS max_p_retailprice FROM part")
def dimension_ranges(spark, sf_dir):
    return stats.dimension_ranges(_read(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


Z_BITS = 31  # of each of two keys: what a long holds
ADDRESS = " + ".join(f"((((p_size >> {b}) & 1) * 2 + ((p_partkey >> {b}) & 1)) << {2 * b})" for b in range(Z_BITS))


@query(f"SELECT p_partkey, CAST({ADDRESS} AS BIGINT) AS z, CAST(row_number() OVER (ORDER BY {ADDRESS}, p_partkey) AS BIGINT) AS place FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def zorder_rank(spark, sf_dir):
    keys = [F.col("p_size").cast("long"), F.col("p_partkey")]
    table = _read(spark, sf_dir, "part").select("p_partkey", bits.interleave(keys, Z_BITS).alias("z"))
    return order.places(table, ["z", "p_partkey"])


@query(f"SELECT p_partkey, CAST({ADDRESS} AS BIGINT) AS z FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part) ORDER BY z, p_partkey LIMIT 50")
def zorder_first(spark, sf_dir):
    """The first rows in Z-order."""
    keys = [F.col("p_size").cast("long"), F.col("p_partkey")]
    rows = _read(spark, sf_dir, "part").select("p_partkey", "p_size", bits.interleave(keys, Z_BITS).alias("z"))
    return stats.order_by_z(rows, keys).limit(50).select("p_partkey", "z")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS a, p_partkey AS b FROM part")
def zorder_roundtrip(spark, sf_dir):
    table = _read(spark, sf_dir, "part").withColumn("z", bits.path([F.col("p_size").cast("long"), F.col("p_partkey")]))
    return table.select("p_partkey", bits.from_path(F.col("z"), 0, 2).alias("a"), bits.from_path(F.col("z"), 1, 2).alias("b"))


@query("SELECT l_orderkey, l_linenumber, CAST(length(ltrim(bin(xor(l_partkey, l_suppkey)), '0')) AS INTEGER) AS conflict, bit_count(xor(l_partkey, l_suppkey))::INTEGER AS open, ((((l_partkey | 4503599627369216) + 1) & 1279) | 1) AS following FROM lineitem")
def bit_functions(spark, sf_dir):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    # the oracle fills the same fixed bits up to bit 51, above which part keys have none
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.conflicting_bits([a], [b]).alias("conflict"), bits.free_bits(a, b).cast("int").alias("open"), bits.next_address(a, 1, 1279).alias("following"))


REVERSED = " + ".join(f"(((p_partkey >> {b}) & 1) << {19 - b})" for b in range(20))


@query(f"SELECT p_partkey, CAST({REVERSED} AS BIGINT) AS reversed, CAST(p_size AS BIGINT) AS a, p_partkey AS b, CAST((p_partkey & ~4) + 4 * ((p_size >> 1) & 1) AS BIGINT) AS applied, CAST(p_partkey | 1024 AS BIGINT) AS raised FROM part")
def bit_moves(spark, sf_dir):
    """Reversal, interleaving and back, one bit taken from an address, one bit set."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    a, b = bits.deinterleave(F.col("z"), 2, Z_BITS)
    return _read(spark, sf_dir, "part").withColumn("z", bits.interleave([size, key], Z_BITS)).select("p_partkey", bits.reverse(key, 20).alias("reversed"), a.alias("a"), b.alias("b"), bits.apply_address(key, size, 2, 0, 2).alias("applied"), bits.with_bit(key, 10, True).alias("raised"))


@query("SELECT p_partkey, p_size >= p_partkey % 50 AND p_partkey % 64 >= p_size AS dominates FROM part")
def z_dominance(spark, sf_dir):
    """Whether one point is at least another in both dimensions, told from their addresses."""
    path = lambda x, y: [bits.address([x.cast("long"), y.cast("long")], level) for level in range(7, -1, -1)]
    size, key = F.col("p_size"), F.col("p_partkey")
    return _read(spark, sf_dir, "part").select("p_partkey", bits.dominates(path(size, key % 64), path(key % 50, size)).alias("dominates"))


@query("""SELECT p_partkey, CAST(bit_count(xor(p_partkey, CAST(p_size AS BIGINT))) + bit_count(xor(CAST(p_size AS BIGINT), p_partkey % 7)) AS INTEGER) AS differing,
  p_partkey < p_size OR (p_partkey = p_size AND p_size < p_partkey % 7) AS is_less, p_partkey AS up_high, p_size + 1 AS up_low,
  CASE WHEN p_partkey % 7 = 0 THEN p_size - 1 ELSE CAST(p_size AS BIGINT) END AS down_high, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey % 7 - 1 END AS down_low FROM part""")
def long_addresses(spark, sf_dir):
    """Addresses of 128 bits: differing bits, order, the next one and the one before."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    a, b = F.array(key, size), F.array(size, key % 7)
    up, down = bits.long_increment(a), bits.long_decrement(b)
    return _read(spark, sf_dir, "part").select("p_partkey", bits.long_xor_count(a, b).alias("differing"), bits.long_less(a, b).alias("is_less"), up[0].alias("up_high"), up[1].alias("up_low"), down[0].alias("down_high"), down[1].alias("down_low"))


LEVEL_ROWS = f"""levels AS (SELECT unnest(range(0, 64)) AS level),
cells AS (SELECT level, CASE WHEN level < 63 THEN l_partkey >> (level + 1) ELSE 0 END AS p0, CASE WHEN level < 63 THEN l_suppkey >> (level + 1) ELSE 0 END AS p1,
  ((l_partkey >> level) & 1) * 2 + ((l_suppkey >> level) & 1) AS child FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), levels),
nodes AS (SELECT level, p0, p1, count(DISTINCT child) AS children FROM cells GROUP BY ALL)"""


@query(f"WITH {LEVEL_ROWS} SELECT CAST(level AS INTEGER) AS level, count(*) AS n_nodes, CAST(sum(children) AS BIGINT) AS n_children, max(children) AS max_children FROM nodes WHERE children > 1 OR level = 63 GROUP BY level")
def tree_stats(spark, sf_dir):
    return stats.tree_stats(_read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"])


def _key_pairs(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(f"""WITH {LEVEL_ROWS.replace("count(DISTINCT child) AS children", "count(DISTINCT child) AS children, count(*) AS entries")}
SELECT level || ' ' || right(lpad(bin(p0), 64, '0'), 63 - level) || ',' || right(lpad(bin(p1), 64, '0'), 63 - level) || ' children=' || children || ' entries=' || entries AS line
FROM (SELECT CAST(level AS INTEGER) AS level, p0, p1, children, entries FROM nodes) WHERE children > 1 OR level = 63""")
def tree_dump(spark, sf_dir):
    return stats.tree_dump(_key_pairs(spark, sf_dir), ["l_partkey", "l_suppkey"])


@query(f"WITH {LEVEL_ROWS} SELECT CAST(length(bin(children)) AS INTEGER) AS size_log, count(*) AS n_nodes FROM nodes WHERE children > 1 OR level = 63 GROUP BY size_log")
def node_sizes(spark, sf_dir):
    return stats.node_sizes(_key_pairs(spark, sf_dir), ["l_partkey", "l_suppkey"])


BELOW_ROWS = f"""{LEVEL_ROWS}, n AS (SELECT level, p0, p1 FROM nodes WHERE children > 1 OR level = 63),
up AS (SELECT n.level, p0, p1, l.level AS u, p0 >> (l.level - n.level) AS u0, p1 >> (l.level - n.level) AS u1 FROM n, levels l WHERE l.level > n.level AND l.level < 63
  UNION ALL SELECT level, p0, p1, 63, 0, 0 FROM n WHERE level < 63),
below AS (SELECT up.level, CAST(min(u) - up.level - 1 AS INTEGER) AS infix_len FROM up JOIN n ON n.level = u AND n.p0 = u0 AND n.p1 = u1 GROUP BY up.level, up.p0, up.p1 UNION ALL SELECT 63, 0)"""


@query(f"WITH {BELOW_ROWS} SELECT infix_len, count(*) AS n_nodes FROM below GROUP BY infix_len")
def infix_lengths(spark, sf_dir):
    return stats.infix_lengths(_key_pairs(spark, sf_dir), ["l_partkey", "l_suppkey"])


@query(f"WITH {BELOW_ROWS} SELECT CAST(63 - level - infix_len AS INTEGER) AS depth, count(*) AS n_nodes FROM below GROUP BY depth")
def node_depths(spark, sf_dir):
    return stats.node_depths(_key_pairs(spark, sf_dir), ["l_partkey", "l_suppkey"])


DEPTH_ROWS = """levels AS (SELECT unnest(range(0, 64)) AS level), keys AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
cells AS (SELECT level, l_partkey >> level AS p0, l_suppkey >> level AS p1, count(*) AS n, min(l_partkey) AS a, min(l_suppkey) AS b FROM keys, levels GROUP BY ALL),
depths AS (SELECT max(level) AS level FROM cells WHERE n = 1 GROUP BY a, b)"""


@query(f"WITH {DEPTH_ROWS} SELECT CAST(level AS INTEGER) AS level, count(*) AS n_entries FROM depths GROUP BY level")
def entry_depths(spark, sf_dir):
    return stats.entry_depths(_read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"])


@query(f"WITH {DEPTH_ROWS} SELECT avg(level) AS avg_post_len, 64 - avg(level) AS avg_depth FROM depths")
def average_depth(spark, sf_dir):
    keys = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return stats.average_depth(stats.entry_depths(keys, ["l_partkey", "l_suppkey"]))


@query("""SELECT user_id, count(*) AS n_events, max(value) AS top FROM events WHERE value BETWEEN 10 AND 60 GROUP BY user_id""")
def window_then_group(spark, sf_dir):
    table = SpatialTable(_read(spark, sf_dir, "events"), ("value",), ("user_id",))
    return table.window((10.0,), (60.0,)).groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("value").alias("top"))


# --- streams ---


def _event_stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_latest(spark, sf_dir):
    """The newest event of each user, kept from a stream."""
    path, events = shared_path(spark, "latest"), _event_stream(spark, sf_dir)
    moving.maintain_buckets(events, "user_id", "ts", path, 8, shared_path(spark, "stream")).awaitTermination()
    return moving.read_buckets(spark, path).drop("bucket")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Counts by hour and type, from a stream."""
    path = shared_path(spark, "windows")
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = moving.windowed_counts(events, "ts", "1 day", "1 hour", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    moving.keep_updates(counts, path, shared_path(spark, "stream")).awaitTermination()
    return moving.read_updates(spark, path, ["hour", "event_type"])
