"""A query for each operator of the library, each with SQL that gives the same rows.

Statements that both engines read alike are written once, with {table} for a table; others are written for each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import compat
from millrace.operators import relational as rel
from millrace.plans.cache import CachedTables, CacheMode
from millrace.sources.readers import read_fixed_records, read_manifest, read_mixed, read_sequence, read_text_table, sample_bucket, text_lines
from millrace.sources.scratch import fresh_path
from millrace.sources.sinks import multi_insert, write_buckets, write_directory, write_partitions, write_sequence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement(name: str, sql: str, duck: str | None = None) -> None:
    """Register one SQL statement; `duck` where the other engine words it differently."""
    duck = duck or sql
    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    QUERIES[name] = lambda spark, d: spark.sql(sql, **{t: load(spark, d, t) for t in tables})
    ORACLE[name] = re.sub(r"\{(\w+)\}", r"\1", duck)


def query(duck: str | None = None):
    """Register a function of (spark, sf_dir), under its own name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if duck:
            ORACLE[f.__name__] = duck
        return f

    return keep


# --- scans, projections, filters -------------------------------------------------------------------------------------
statement("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem}")
statement(
    "filter_predicates",
    """SELECT p_partkey, p_name, p_brand, p_size FROM {part}
    WHERE (p_size BETWEEN 5 AND 20 OR p_size IN (1, 50)) AND NOT p_brand LIKE '%#1%' AND p_name RLIKE '[a-m]' AND p_type IS NOT NULL AND p_size <> 7 AND NOT (p_retailprice > 1900)""",
    """SELECT p_partkey, p_name, p_brand, p_size FROM part
    WHERE (p_size BETWEEN 5 AND 20 OR p_size IN (1, 50)) AND NOT p_brand LIKE '%#1%' AND regexp_matches(p_name, '[a-m]') AND p_type IS NOT NULL AND p_size <> 7 AND NOT (p_retailprice > 1900)""",
)
statement("filter_three_valued", "SELECT event_id, user_id FROM {events} WHERE NOT (nullif(user_id % 5, 0) = 2) AND (nullif(user_id % 3, 0) IS NULL OR value > 10)")
statement("subquery_from", "SELECT c_mktsegment, n, round(total, 2) AS total FROM (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM {customer} WHERE c_acctbal > 0 GROUP BY c_mktsegment) t WHERE n > 1")


@query("SELECT p_name, p_brand, p_type FROM part")
def regex_columns(spark, d):
    """Columns chosen by a regular expression."""
    t = load(spark, d, "part")
    return t.select(t.colRegex("`p_(name|brand|type)`"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def view_over_table(spark, d):
    """A named view, then a query over it."""
    load(spark, d, "orders").filter("o_orderstatus = 'F'").createOrReplaceTempView("millrace_finished")
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM millrace_finished GROUP BY o_orderpriority")


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def scan_empty(spark, d):
    """A source without rows keeps its schema."""
    return spark.createDataFrame([], "r_regionkey int, r_name string")


# --- aggregation -----------------------------------------------------------------------------------------------------
PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, CAST(round(sum(PRICE * (UNIT - DISCOUNT)), 2) AS DOUBLE) AS sum_disc,
    CAST(round(sum(PRICE * (UNIT - DISCOUNT) * (UNIT + TAX)), 2) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
#: Money is exact, so its rounding is the same in whatever order rows are added up.
for _name, _value in (("PRICE", "l_extendedprice AS DECIMAL(12, 2)"), ("DISCOUNT", "l_discount AS DECIMAL(4, 2)"), ("TAX", "l_tax AS DECIMAL(4, 2)"), ("UNIT", "1 AS DECIMAL(4, 2)")):
    PRICING = re.sub(rf"\b{_name}\b", f"CAST({_value})", PRICING)
statement("agg_group", PRICING.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), PRICING)
statement("agg_global_empty", "SELECT count(*) AS n, count(o_custkey) AS n_cust, sum(o_totalprice) AS total, min(o_orderkey) AS least, max(o_orderkey) AS most FROM {orders} WHERE o_orderkey < 0")
statement("agg_distinct_multi", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderstatus) AS states, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM {orders} GROUP BY o_orderpriority")
statement("agg_distinct_sum", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS lines, count(DISTINCT l_suppkey, l_linenumber) AS pairs FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, sum(DISTINCT l_linenumber)::bigint AS lines, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs FROM lineitem GROUP BY l_returnflag")
statement(
    "agg_stats",
    """SELECT p_brand, round(stddev_pop(p_retailprice), 4) AS std_pop, round(stddev_samp(p_retailprice), 4) AS std_samp, round(var_pop(p_size), 4) AS v_pop, round(var_samp(p_size), 4) AS v_samp,
    round(corr(p_size, p_retailprice), 5) AS corr, round(covar_pop(p_size, p_retailprice), 3) AS cov_pop, round(covar_samp(p_size, p_retailprice), 3) AS cov_samp FROM {part} GROUP BY p_brand""",
)
statement("agg_percentile", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.5D), 3) AS median, round(percentile(o_totalprice, 0.9D), 3) AS p90 FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(quantile_cont(o_totalprice, 0.9), 3) AS p90 FROM orders GROUP BY o_orderstatus")
statement("agg_collect_set", "SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segments FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY c_nationkey")
statement("agg_null_groups", "SELECT nullif(user_id % 7, 3) AS g, event_type, count(*) AS n, round(max(value), 4) AS most FROM {events} GROUP BY nullif(user_id % 7, 3), event_type")
statement("agg_by_expression", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(avg(o_totalprice), 0) AS mean FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)", "SELECT year(o_orderdate)::int AS y, month(o_orderdate)::int AS m, count(*) AS n, round(avg(o_totalprice), 0) AS mean FROM orders GROUP BY ALL")
statement("agg_complex_key", "SELECT to_json(k) AS k, n FROM (SELECT struct(c_nationkey AS a, c_mktsegment AS b) AS k, count(*) AS n FROM {customer} GROUP BY struct(c_nationkey AS a, c_mktsegment AS b))", "SELECT '{\"a\":' || c_nationkey || ',\"b\":\"' || c_mktsegment || '\"}' AS k, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment")
statement("having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) >= 12 AND sum(o_totalprice) > 100")
statement("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}")


@query("SELECT 'l_returnflag' AS key_name, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::varchar, count(*) FROM lineitem GROUP BY 2")
def agg_multi_group_by(spark, d):
    """Several groupings from one reading."""
    t = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return rel.multi_group_by(t, ["l_returnflag", "l_linestatus", "l_linenumber"], F.count("*"), "n")


@query("SELECT event_type, sum(user_id)::bigint AS users, sum(event_id)::bigint AS ids FROM events GROUP BY event_type")
def agg_salted(spark, d):
    """Sums by a hot key in two steps."""
    return rel.group_salted(load(spark, d, "events").select("event_type", "user_id", "event_id"), ["event_type"], {"users": "user_id", "ids": "event_id"})


@query()
def agg_percentile_approx(spark, d):
    """Sketched percentiles; their error is bounded, their value not fixed."""
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 10000).alias("quantiles"))


@query()
def agg_histogram_numeric(spark, d):
    """A histogram of 10 bins; its bins depend on the order of rows."""
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.histogram_numeric("o_totalprice", F.lit(10)).alias("bins"))


# --- joins -----------------------------------------------------------------------------------------------------------
for _name, _how in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    statement(f"join_{_name}", f"SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM (SELECT * FROM {{customer}} WHERE c_nationkey < 12) c {_how} (SELECT * FROM {{orders}} WHERE o_orderstatus = 'O') o ON c.c_custkey = o.o_custkey")
statement("join_semi", "SELECT c_custkey, c_name FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey, c_name FROM customer c SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey")
statement("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
statement(
    "join_nway",
    """SELECT n_name, s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
    JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND s_nationkey = c_nationkey GROUP BY n_name, s_name""",
)
statement("join_same_key_nway", "SELECT a.l_orderkey, a.n, b.most, o_totalprice FROM (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) a JOIN (SELECT l_orderkey, max(l_quantity) AS most FROM {lineitem} GROUP BY l_orderkey) b ON a.l_orderkey = b.l_orderkey JOIN {orders} ON a.l_orderkey = o_orderkey")
_KEYS_L, _KEYS_R = "(SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS k FROM {customer})", "(SELECT s_suppkey, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey END AS k FROM {supplier})"
statement("join_null_keys", f"SELECT a.c_custkey, a.k, b.s_suppkey FROM {_KEYS_L} a LEFT JOIN {_KEYS_R} b ON a.k = b.k")
statement("join_nullsafe", f"SELECT a.c_custkey, a.k, b.s_suppkey FROM {_KEYS_L} a JOIN {_KEYS_R} b ON a.k <=> b.k", f"SELECT a.c_custkey, a.k, b.s_suppkey FROM {_KEYS_L} a JOIN {_KEYS_R} b ON a.k IS NOT DISTINCT FROM b.k")
statement("join_residual", "SELECT c_custkey, o_orderkey, o_totalprice FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 40 AND o_orderstatus <> 'P'")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, d):
    """A map-side join behind a check of the small side's size."""
    t = rel.join_broadcast(load(spark, d, "supplier"), load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.select("s_suppkey", "s_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark, d):
    """A join dealt over salts, for hot keys."""
    left = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"))
    return rel.join_salted(left, load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", 4).drop("k")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_bucketed(spark, d):
    """A join of two tables bucketed and sorted by its key, which needs no shuffle."""
    sides = []
    for table, key, other in (("orders", "o_custkey", "o_orderkey"), ("customer", "c_custkey", "c_name")):
        name, t = _fresh_table(spark, table), load(spark, d, table).select(key, other)
        write_buckets(t, name, fresh_path(spark, table), key, 8)
        sides.append(spark.table(name))
    return sides[0].join(sides[1].hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey IS NOT DISTINCT FROM s_nationkey AND c_custkey % 10 = s_suppkey % 10 AND c_acctbal < s_acctbal")
def join_mixed_keys(spark, d):
    """Null-safe and plain keys with a residual condition, by the join operator."""
    c, s = load(spark, d, "customer").withColumn("kc", F.col("c_custkey") % 10), load(spark, d, "supplier").withColumn("ks", F.col("s_suppkey") % 10)
    return rel.equi_join(c, s, [("c_nationkey", "s_nationkey"), ("kc", "ks")], null_safe=[True], residual=c.c_acctbal < s.s_acctbal).select("c_custkey", "s_suppkey")


statement("join_mapjoin_hint", "SELECT /*+ MAPJOIN(r) */ n_name, r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")

# --- sets, order, limits ---------------------------------------------------------------------------------------------
statement("union_all", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name FROM {region} UNION ALL SELECT s_name FROM {supplier}")
statement("union_in_subquery", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM {customer} UNION ALL SELECT 's', s_nationkey FROM {supplier}) u GROUP BY kind")


@query("SELECT n_nationkey::double AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier")
def union_widen(spark, d):
    """UNION ALL of whole numbers and doubles gives doubles."""
    return rel.union_widen(load(spark, d, "nation").select(F.col("n_nationkey").alias("v")), load(spark, d, "supplier").select("s_acctbal"))


statement("order_limit", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
statement("order_by_nulls", "SELECT k, o_orderkey FROM (SELECT nullif(o_custkey % 4, 1) AS k, o_orderkey FROM {orders}) ORDER BY k ASC NULLS FIRST, o_orderkey DESC")
statement("limit_zero", "SELECT o_orderkey FROM {orders} LIMIT 0")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_only(spark, d):
    """A global limit after a total order."""
    return rel.top_k(load(spark, d, "orders").select("o_orderkey", "o_custkey"), 10, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_shipdate::date::varchar AS shipped FROM lineitem")
def sort_by(spark, d):
    """Rows sorted within partitions."""
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    return rel.sort_by(t, "shipped", "l_orderkey", distribute=["l_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM orders")
def distribute_by(spark, d):
    """Rows dealt by a key."""
    return spark.sql("SELECT o_custkey, o_orderkey FROM {t} DISTRIBUTE BY o_custkey", t=load(spark, d, "orders"))


@query("SELECT o_custkey, o_orderkey FROM orders")
def cluster_by(spark, d):
    """Rows dealt and sorted by a key."""
    return rel.cluster_by(load(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def sort_by_limit(spark, d):
    """The least rows of each partition, of which the least of all are taken."""
    return rel.top_k(rel.top_k_by_partition(load(spark, d, "orders").select("o_orderkey").repartition(4, "o_orderkey"), 7, "o_orderkey"), 7, "o_orderkey")


# --- lateral views, table functions, scripts -------------------------------------------------------------------------
statement("lateral_explode", "SELECT p_partkey, pos, w FROM {part} LATERAL VIEW posexplode(split(p_name, ' ')) x AS pos, w", "SELECT p_partkey, (pos - 1)::int AS pos, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)")
statement("lateral_multiple", "SELECT n_nationkey, a, b FROM {nation} LATERAL VIEW explode(array(1, 2)) x AS a LATERAL VIEW explode(array(a * 10, a * 20)) y AS b", "SELECT n_nationkey, a, unnest([a * 10, a * 20]) AS b FROM (SELECT n_nationkey, unnest([1, 2]) AS a FROM nation)")
statement("lateral_empty", "SELECT n_nationkey, a FROM {nation} LATERAL VIEW explode(CASE WHEN n_nationkey % 3 = 0 THEN array(1, 2) WHEN n_nationkey % 3 = 1 THEN cast(array() AS array<int>) END) x AS a", "SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 3 = 0 THEN [1, 2] END) AS a FROM nation")
statement("lateral_map", "SELECT r_regionkey, k, v FROM {region} LATERAL VIEW explode(map('key', r_regionkey, 'twice', r_regionkey * 2)) x AS k, v", "SELECT r_regionkey, unnest(['key', 'twice']) AS k, unnest([r_regionkey, r_regionkey * 2]) AS v FROM region")
statement("table_stack", "SELECT s.a, s.b FROM {region} LATERAL VIEW stack(2, r_regionkey, r_name, r_regionkey + 100, upper(r_name)) s AS a, b", "SELECT r_regionkey AS a, r_name AS b FROM region UNION ALL SELECT r_regionkey + 100, upper(r_name) FROM region")
statement("table_json_tuple", "SELECT event_id, j.k FROM {events} LATERAL VIEW json_tuple(props, 'k') j AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
statement("table_inline", "SELECT r_regionkey, x.a, x.b FROM {region} LATERAL VIEW inline(array(named_struct('a', 1, 'b', r_name), named_struct('a', 2, 'b', lower(r_name)))) x AS a, b", "SELECT r_regionkey, 1 AS a, r_name AS b FROM region UNION ALL SELECT r_regionkey, 2, lower(r_name) FROM region")


@query("SELECT n_nationkey, 'www.example.org' AS c0, '/n/' || n_nationkey AS c1, n_name AS c2 FROM nation")
def table_parse_url_tuple(spark, d):
    """Several parts of a URL at once."""
    url = F.concat(F.lit("http://www.example.org/n/"), F.col("n_nationkey").cast("string"), F.lit("?q="), F.col("n_name"), F.lit("&z=1#top"))
    return load(spark, d, "nation").select("n_nationkey", *compat.parse_url_tuple(url, "HOST", "PATH", "QUERY:q"))


@query("SELECT n_nationkey AS k, upper(n_name) AS name FROM nation")
def transform_script(spark, d):
    """Rows through a process's standard input and output, with typed results."""
    return rel.transform_script(load(spark, d, "nation"), ["n_nationkey", "n_name"], "tr a-z A-Z", "k INT, name STRING")


# --- functions -------------------------------------------------------------------------------------------------------
statement(
    "fn_math",
    """SELECT s_suppkey, abs(s_acctbal) AS f_abs, round(acos(s_nationkey / 30.0D), 6) AS f_acos, round(asin(s_nationkey / 30.0D), 6) AS f_asin, round(atan(s_acctbal), 6) AS f_atan, round(sin(s_suppkey), 6) AS f_sin, round(cos(s_suppkey), 6) AS f_cos,
    round(tan(s_suppkey), 4) AS f_tan, round(degrees(s_suppkey), 5) AS f_deg, round(radians(s_suppkey), 6) AS f_rad, round(exp(s_nationkey / 10.0D), 5) AS f_exp, round(ln(s_suppkey + 1), 6) AS f_ln, round(log10(s_suppkey + 1), 6) AS f_log10, round(log2(s_suppkey + 1), 6) AS f_log2,
    round(log(3, s_suppkey + 1), 6) AS f_log, round(pow(s_nationkey, 3), 2) AS f_pow, round(power(s_nationkey, 0.5D), 6) AS f_power, round(sqrt(s_suppkey), 6) AS f_sqrt, round(e(), 6) AS f_e, round(pi(), 6) AS f_pi, sign(s_acctbal) AS f_sign FROM {supplier}""",
    """SELECT s_suppkey, abs(s_acctbal) AS f_abs, round(acos(s_nationkey / 30.0::double), 6) AS f_acos, round(asin(s_nationkey / 30.0::double), 6) AS f_asin, round(atan(s_acctbal), 6) AS f_atan, round(sin(s_suppkey), 6) AS f_sin, round(cos(s_suppkey), 6) AS f_cos,
    round(tan(s_suppkey), 4) AS f_tan, round(degrees(s_suppkey), 5) AS f_deg, round(radians(s_suppkey), 6) AS f_rad, round(exp(s_nationkey / 10.0::double), 5) AS f_exp, round(ln(s_suppkey + 1), 6) AS f_ln, round(log10(s_suppkey + 1), 6) AS f_log10, round(log2(s_suppkey + 1), 6) AS f_log2,
    round(ln(s_suppkey + 1) / ln(3), 6) AS f_log, round(pow(s_nationkey, 3), 2) AS f_pow, round(power(s_nationkey, 0.5), 6) AS f_power, round(sqrt(s_suppkey), 6) AS f_sqrt, round(exp(1), 6) AS f_e, round(pi(), 6) AS f_pi, sign(s_acctbal)::double AS f_sign FROM supplier""",
)
statement(
    "fn_arithmetic",
    """SELECT o_orderkey, o_custkey + 7 AS f_add, o_custkey - 7 AS f_sub, o_custkey * 3 AS f_mul, round(o_custkey / 7, 6) AS f_div, o_custkey div 7 AS f_idiv, o_custkey % 7 AS f_mod, pmod(3 - o_custkey, 7) AS f_pmod, -o_custkey AS f_neg, positive(o_custkey) AS f_pos,
    try_divide(o_custkey, o_custkey % 2) IS NULL AS f_zero, ceil(o_totalprice) AS f_ceil, ceiling(o_totalprice / 3) AS f_ceiling, floor(o_totalprice) AS f_floor, round(o_totalprice) AS f_round, o_custkey & 12 AS f_and, o_custkey | 12 AS f_or, o_custkey ^ 12 AS f_xor, ~o_custkey AS f_not FROM {orders}""",
    """SELECT o_orderkey, o_custkey + 7 AS f_add, o_custkey - 7 AS f_sub, o_custkey * 3 AS f_mul, round(o_custkey / 7, 6) AS f_div, o_custkey // 7 AS f_idiv, o_custkey % 7 AS f_mod, ((3 - o_custkey) % 7 + 7) % 7 AS f_pmod, -o_custkey AS f_neg, o_custkey AS f_pos,
    o_custkey % 2 = 0 AS f_zero, ceil(o_totalprice)::bigint AS f_ceil, ceil(o_totalprice / 3)::bigint AS f_ceiling, floor(o_totalprice)::bigint AS f_floor, round(o_totalprice) AS f_round, o_custkey & 12 AS f_and, o_custkey | 12 AS f_or, xor(o_custkey, 12) AS f_xor, ~o_custkey AS f_not FROM orders""",
)
statement("fn_radix", "SELECT n_nationkey, bin(n_nationkey) AS f_bin, hex(n_nationkey) AS f_hex, hex(n_name) AS f_hexs, cast(unhex(hex(n_name)) AS string) AS f_unhex, conv(cast(n_nationkey AS string), 10, 16) AS f_conv FROM {nation}", "SELECT n_nationkey, bin(n_nationkey) AS f_bin, upper(to_hex(n_nationkey)) AS f_hex, hex(n_name) AS f_hexs, n_name AS f_unhex, upper(to_hex(n_nationkey)) AS f_conv FROM nation")
statement(
    "fn_string",
    """SELECT p_partkey, ascii(p_name) AS f_ascii, concat(p_brand, '-', p_type) AS f_concat, concat(p_brand, nullif(p_size % 2, 0)) IS NULL AS f_concat_null, concat_ws('|', p_brand, cast(nullif(p_size % 2, 0) AS string), p_type) AS f_ws, elt(1 + p_size % 2, p_brand, p_type) AS f_elt, find_in_set('b', 'a,b,c') AS f_set,
    instr(p_name, 'e') AS f_instr, locate('e', p_name, 3) AS f_locate, length(p_name) AS f_len, lower(p_type) AS f_lower, lcase(p_brand) AS f_lcase, upper(p_name) AS f_upper, ucase(p_name) AS f_ucase, lpad(p_brand, 12, '*') AS f_lpad, rpad(p_brand, 12, '*') AS f_rpad, ltrim('  x ') AS f_ltrim, rtrim('  x ') AS f_rtrim, trim('  x ') AS f_trim,
    repeat('ab', p_size % 4) AS f_repeat, reverse(p_name) AS f_reverse, length(space(p_size)) AS f_space, substr(p_name, 2, 3) AS f_substr, substring(p_name, -4) AS f_substring, substring(p_name, 0, 2) AS f_sub0 FROM {part}""",
    """SELECT p_partkey, ascii(p_name) AS f_ascii, concat(p_brand, '-', p_type) AS f_concat, p_size % 2 = 0 AS f_concat_null, concat_ws('|', p_brand, cast(nullif(p_size % 2, 0) AS varchar), p_type) AS f_ws, CASE p_size % 2 WHEN 0 THEN p_brand ELSE p_type END AS f_elt, 2 AS f_set,
    instr(p_name, 'e')::int AS f_instr, CASE WHEN instr(substr(p_name, 3), 'e') > 0 THEN instr(substr(p_name, 3), 'e') + 2 ELSE 0 END::int AS f_locate, length(p_name)::int AS f_len, lower(p_type) AS f_lower, lower(p_brand) AS f_lcase, upper(p_name) AS f_upper, upper(p_name) AS f_ucase, lpad(p_brand, 12, '*') AS f_lpad, rpad(p_brand, 12, '*') AS f_rpad, 'x ' AS f_ltrim, '  x' AS f_rtrim, 'x' AS f_trim,
    repeat('ab', p_size % 4) AS f_repeat, reverse(p_name) AS f_reverse, p_size AS f_space, substr(p_name, 2, 3) AS f_substr, right(p_name, 4) AS f_substring, substr(p_name, 1, 2) AS f_sub0 FROM part""",
)
statement(
    "fn_regex",
    r"""SELECT p_partkey, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS f_extract, regexp_replace(p_name, '[aeiou]', '_') AS f_replace, p_name RLIKE '^[a-m]' AS f_rlike, p_name REGEXP 'n$' AS f_regexp, p_name LIKE '%e_' AS f_like, NOT p_name LIKE 'a%' AS f_not, size(split(p_name, '[ -]')) AS f_split, printf('%s/%05d', p_brand, p_size) AS f_printf FROM {part}""",
    r"""SELECT p_partkey, regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2) AS f_extract, regexp_replace(p_name, '[aeiou]', '_', 'g') AS f_replace, regexp_matches(p_name, '^[a-m]') AS f_rlike, regexp_matches(p_name, 'n$') AS f_regexp, p_name LIKE '%e_' AS f_like, NOT p_name LIKE 'a%' AS f_not, len(regexp_split_to_array(p_name, '[ -]'))::int AS f_split, printf('%s/%05d', p_brand, p_size) AS f_printf FROM part""",
)
statement(
    "fn_date",
    """SELECT o_orderkey, cast(to_date(o_orderdate) AS string) AS f_date, cast(date_add(to_date(o_orderdate), 10) AS string) AS f_add, cast(date_sub(to_date(o_orderdate), 10) AS string) AS f_sub, datediff(to_date(o_orderdate), DATE '1998-01-01') AS f_diff, year(o_orderdate) AS f_year, month(o_orderdate) AS f_month, day(o_orderdate) AS f_day,
    dayofmonth(o_orderdate) AS f_dom, weekofyear(o_orderdate) AS f_week, hour(o_orderdate) AS f_hour, minute(o_orderdate) AS f_minute, second(o_orderdate) AS f_second, unix_timestamp(cast(to_date(o_orderdate) AS string), 'yyyy-MM-dd') - unix_timestamp('1990-01-01', 'yyyy-MM-dd') AS f_unix FROM {orders}""",
    """SELECT o_orderkey, cast(o_orderdate::date AS varchar) AS f_date, cast((o_orderdate::date + 10)::date AS varchar) AS f_add, cast((o_orderdate::date - 10)::date AS varchar) AS f_sub, date_diff('day', DATE '1998-01-01', o_orderdate::date)::int AS f_diff, year(o_orderdate)::int AS f_year, month(o_orderdate)::int AS f_month, day(o_orderdate)::int AS f_day,
    day(o_orderdate)::int AS f_dom, weekofyear(o_orderdate)::int AS f_week, hour(o_orderdate)::int AS f_hour, minute(o_orderdate)::int AS f_minute, second(o_orderdate)::int AS f_second, (epoch(o_orderdate::date) - epoch(DATE '1990-01-01'))::bigint AS f_unix FROM orders""",
)
statement("fn_event_time", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, date_format(ts, 'yyyy-MM-dd HH:mm') AS f FROM {events}", "SELECT event_id, hour(ts)::int AS h, minute(ts)::int AS m, second(ts)::int AS s, strftime(ts, '%Y-%m-%d %H:%M') AS f FROM events")
statement("fn_unixtime", "SELECT n_nationkey, from_unixtime(unix_timestamp('2001-02-03 04:05:06') + n_nationkey, 'yyyy-MM-dd HH:mm:ss') AS t FROM {nation}", "SELECT n_nationkey, strftime(TIMESTAMP '2001-02-03 04:05:06' + to_seconds(n_nationkey), '%Y-%m-%d %H:%M:%S') AS t FROM nation")
statement(
    "fn_conditional",
    """SELECT p_partkey, if(p_size > 20, 'big', 'small') AS f_if, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS f_case, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' END AS f_when, coalesce(nullif(p_size, 7), -1) AS f_coalesce, isnull(nullif(p_size, 7)) AS f_isnull, isnotnull(nullif(p_size, 7)) AS f_notnull,
    p_size IN (1, 2, 3) AS f_in, p_size NOT BETWEEN 5 AND 9 AS f_between, p_size = 5 OR p_size == 6 AS f_eq, p_size <> 5 AND p_size != 6 AS f_ne, NOT p_size >= 5 AS f_ge, p_size <= 5 AS f_le, p_size > 5 AS f_gt, p_size < 5 AS f_lt, ! (p_size = 3) AS f_not FROM {part}""",
    """SELECT p_partkey, if(p_size > 20, 'big', 'small') AS f_if, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS f_case, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' END AS f_when, coalesce(nullif(p_size, 7), -1) AS f_coalesce, p_size = 7 AS f_isnull, p_size <> 7 AS f_notnull,
    p_size IN (1, 2, 3) AS f_in, p_size NOT BETWEEN 5 AND 9 AS f_between, p_size = 5 OR p_size = 6 AS f_eq, p_size <> 5 AND p_size <> 6 AS f_ne, NOT p_size >= 5 AS f_ge, p_size <= 5 AS f_le, p_size > 5 AS f_gt, p_size < 5 AS f_lt, NOT (p_size = 3) AS f_not FROM part""",
)
statement(
    "fn_cast",
    """SELECT o_orderkey, cast(o_custkey % 2 AS boolean) AS f_bool, cast(o_custkey % 100 AS tinyint) AS f_tiny, cast(o_custkey % 1000 AS smallint) AS f_small, cast(o_custkey AS int) AS f_int, cast(o_totalprice AS bigint) AS f_big, cast(o_custkey AS float) AS f_float, cast(o_orderkey AS double) AS f_double, cast(o_custkey AS string) AS f_string,
    try_cast(o_orderpriority AS int) IS NULL AS f_bad, '12' + 3 AS f_implicit, o_custkey = cast(o_custkey AS string) AS f_mixed, cast(o_custkey AS int) + 0.5D AS f_widen FROM {orders}""",
    """SELECT o_orderkey, cast(o_custkey % 2 AS boolean) AS f_bool, cast(o_custkey % 100 AS tinyint) AS f_tiny, cast(o_custkey % 1000 AS smallint) AS f_small, cast(o_custkey AS int) AS f_int, cast(trunc(o_totalprice) AS bigint) AS f_big, cast(o_custkey AS float) AS f_float, cast(o_orderkey AS double) AS f_double, cast(o_custkey AS varchar) AS f_string,
    true AS f_bad, 15::bigint AS f_implicit, true AS f_mixed, o_custkey + 0.5::double AS f_widen FROM orders""",
)
statement(
    "fn_collection",
    """SELECT r_regionkey, array(1, 2, r_regionkey)[2] AS f_index, map('a', r_regionkey, 'b', 9)['a'] AS f_map, struct(r_name AS x).x AS f_struct, named_struct('y', r_regionkey).y AS f_named, array_contains(array(1, 3), r_regionkey) AS f_contains, size(split(r_name, '')) AS f_size, coalesce(size(cast(NULL AS array<int>)), -1) < 1 AS f_size_null,
    array_join(sort_array(array(3, r_regionkey, 1)), ',') AS f_sort, array_join(array_sort(map_keys(map('k', 1, 'j', 2))), ',') AS f_keys, array_join(array_sort(map_values(map('k', 1, 'j', 2))), ',') AS f_values, str_to_map('a:1,b:2', ',', ':')['b'] AS f_str_to_map, get(array(1, 2), 5) IS NULL AS f_out FROM {region}""",
    """SELECT r_regionkey, r_regionkey AS f_index, r_regionkey AS f_map, r_name AS f_struct, r_regionkey AS f_named, r_regionkey IN (1, 3) AS f_contains, length(r_name)::int AS f_size, true AS f_size_null,
    array_to_string(list_sort([3, r_regionkey, 1]), ',') AS f_sort, 'j,k' AS f_keys, '1,2' AS f_values, '2' AS f_str_to_map, true AS f_out FROM region""",
)
statement("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.none') AS none FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::varchar AS none FROM events")
statement(
    "fn_url",
    "SELECT n_nationkey, parse_url(u, 'HOST') AS host, parse_url(u, 'PATH') AS path, parse_url(u, 'QUERY') AS query, parse_url(u, 'QUERY', 'k') AS k, parse_url(u, 'REF') AS ref, parse_url(u, 'PROTOCOL') AS protocol, parse_url(u, 'AUTHORITY') AS authority FROM (SELECT n_nationkey, concat('https://h.example.org:8080/p/', n_nationkey, '?k=', n_regionkey, '&m=2#r') AS u FROM {nation})",
    "SELECT n_nationkey, 'h.example.org' AS host, '/p/' || n_nationkey AS path, 'k=' || n_regionkey || '&m=2' AS query, n_regionkey::varchar AS k, 'r' AS ref, 'https' AS protocol, 'h.example.org:8080' AS authority FROM nation",
)
statement(
    "fn_xpath",
    """SELECT r_regionkey, array_join(xpath(x, 'a/b/text()'), ',') AS f_all, xpath_string(x, 'a/c') AS f_string, xpath_int(x, 'sum(a/b)') AS f_int, xpath_long(x, 'count(a/b)') AS f_long, xpath_short(x, 'a/b[1]') AS f_short, xpath_double(x, 'a/b[2]') AS f_double, xpath_float(x, 'a/b[2]') AS f_float, xpath_boolean(x, 'a/c') AS f_bool
    FROM (SELECT r_regionkey, concat('<a><b>', r_regionkey, '</b><b>2</b><c>', r_name, '</c></a>') AS x FROM {region})""",
    """SELECT r_regionkey, r_regionkey || ',2' AS f_all, r_name AS f_string, r_regionkey + 2 AS f_int, 2::bigint AS f_long, r_regionkey::smallint AS f_short, 2::double AS f_double, 2::float AS f_float, true AS f_bool FROM region""",
)
statement("fn_reflect", "SELECT n_nationkey, reflect('java.lang.Math', 'max', n_nationkey, 10) AS f_reflect, java_method('java.lang.Integer', 'toHexString', n_nationkey) AS f_method FROM {nation}", "SELECT n_nationkey, greatest(n_nationkey, 10)::varchar AS f_reflect, lower(to_hex(n_nationkey)) AS f_method FROM nation")
statement("fn_sentences", "SELECT r_regionkey, to_json(sentences(concat(r_name, ' is here. Is it?'))) AS s FROM {region}", """SELECT r_regionkey, '[["' || replace(r_name, ' ', '","') || '","is","here"],["Is","it"]]' AS s FROM region""")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 0 END AS place FROM customer")
def fn_field(spark, d):
    """The place of a value among options."""
    return load(spark, d, "customer").select("c_custkey", compat.field(F.col("c_mktsegment"), F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("AUTOMOBILE")).alias("place"))


@query("SELECT n_nationkey, (n_nationkey % 2)::int AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS v0, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey END AS v1 FROM nation")
def fn_create_union(spark, d):
    """Tagged unions, taken apart."""
    u = load(spark, d, "nation").select("n_nationkey", compat.create_union(F.col("n_nationkey") % 2, F.col("n_name"), F.col("n_regionkey")).alias("u"))
    return u.select("n_nationkey", "u.tag", compat.union_value(F.col("u"), 0).alias("v0"), compat.union_value(F.col("u"), 1).alias("v1"))


@query("SELECT o_orderkey, (xor(o_orderkey >> 32, o_orderkey) & 4294967295)::int AS h, ((xor(o_orderkey >> 32, o_orderkey) & 2147483647) % 8)::int AS b FROM orders")
def fn_hash(spark, d):
    """The dialect's hash and bucket of a key."""
    t = load(spark, d, "orders")
    return t.select("o_orderkey", compat.hive_hash(t, "o_orderkey").alias("h"), compat.bucket(compat.hive_hash(t, "o_orderkey"), 8).alias("b"))


@query("""SELECT g AS ngram, n::double AS estfrequency FROM (SELECT w[i] || ' ' || w[i + 1] AS g, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(p_name, ' ') AS w FROM part)) GROUP BY 1) ORDER BY n DESC, g LIMIT 15""")
def fn_ngrams(spark, d):
    """The most frequent pairs of words."""
    t = load(spark, d, "part").select(F.array(F.split("p_name", " ")).alias("s"))
    return compat.ngrams(t, "s", 2, 15).select(F.array_join("ngram", " ").alias("ngram"), "estfrequency")


@query("""SELECT g AS ngram, n::double AS estfrequency FROM (SELECT w[i + 1] AS g, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(p_name, ' ') AS w FROM part)) WHERE w[i] = (SELECT min(string_split(p_name, ' ')[1]) FROM part) GROUP BY 1) ORDER BY n DESC, g LIMIT 10""")
def fn_context_ngrams(spark, d):
    """The words that most often follow a given one."""
    t = load(spark, d, "part").select(F.array(F.split("p_name", " ")).alias("s"), F.split("p_name", " ")[0].alias("first"))
    word = t.agg(F.min("first")).first()[0]
    return compat.context_ngrams(t, "s", [word, None], 10).select(F.array_join("ngram", " ").alias("ngram"), "estfrequency")


# --- user-defined functions ------------------------------------------------------------------------------------------
@query("SELECT s_suppkey, round(s_acctbal * 1.19, 4) AS gross FROM supplier")
def udf_pandas(spark, d):
    """A vectorised scalar function."""

    @F.pandas_udf("double")
    def gross(v: pd.Series) -> pd.Series:
        return v * 1.19

    return load(spark, d, "supplier").select("s_suppkey", F.round(gross("s_acctbal"), 4).alias("gross"))


@query("SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_custkey")
def udaf_pandas(spark, d):
    """A user-defined aggregate. A group's values meet in one task, so it is for keys of many small groups."""

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return load(spark, d, "orders").groupBy("o_custkey").agg(F.round(spread("o_totalprice"), 2).alias("spread"))


@query("SELECT r_regionkey, unnest(string_split(r_name, 'A')) AS part FROM region")
def udtf_python(spark, d):
    """A user-defined table function."""

    class Cut:
        def eval(self, text: str):
            for p in text.split("A"):
                yield (p,)

    spark.udtf.register("millrace_cut", F.udtf(Cut, returnType="part string"))
    return spark.sql("SELECT r_regionkey, c.part FROM {t}, LATERAL millrace_cut(r_name) c", t=load(spark, d, "region"))


# --- sampling, formats, sinks ----------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey FROM orders WHERE (xor(o_custkey >> 32, o_custkey) & 2147483647) % 4 = 1")
def sample_bucket_on(spark, d):
    """Bucket 2 of 4 on a column."""
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return sample_bucket(t, 2, 4, compat.integer_hash(F.col("o_custkey")))


@query()
def sample_percent(spark, d):
    """A tenth of the rows, by chance with a fixed seed."""
    return load(spark, d, "orders").sample(0.1, 7).select("o_orderkey")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def text_round_trip(spark, d):
    """A table through delimited text with nulls."""
    t = load(spark, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    path = fresh_path(spark, "text")
    write_directory(t, path)
    return read_text_table(spark, path, t.schema)


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' '))::int AS n, p_brand AS brand FROM part")
def text_nested(spark, d):
    """Arrays and maps through delimited text."""
    t = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.create_map(F.lit("brand"), F.split("p_brand", "~")).alias("m"))
    path = fresh_path(spark, "nested")
    text_lines(t).write.mode("overwrite").text(path)
    back = read_text_table(spark, path, "p_partkey bigint, words array<string>, m map<string,array<string>>")
    return back.select("p_partkey", F.col("words")[0].alias("first"), F.size("words").alias("n"), F.col("m")["brand"][0].alias("brand"))


@query("SELECT s_suppkey, s_name, nullif(s_nationkey % 5, 0)::int AS k FROM supplier")
def sequence_round_trip(spark, d):
    """A table through SequenceFiles of delimited values, with nulls."""
    t = load(spark, d, "supplier").selectExpr("s_suppkey", "s_name", "cast(nullif(s_nationkey % 5, 0) AS int) AS k")
    path = fresh_path(spark, "sequence") + "/files"  # must not be there yet
    write_sequence(t, path)
    return read_sequence(spark, path, t.schema)


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def manifest_scan(spark, d):
    """Files named by a manifest."""
    one, two, listing = (fresh_path(spark, n) for n in ("a", "b", "manifest"))
    load(spark, d, "nation").select("n_name").write.mode("overwrite").text(one)
    load(spark, d, "region").select("r_name").write.mode("overwrite").text(two)
    spark.createDataFrame([(one,), (two,)], "value string").coalesce(1).write.mode("overwrite").text(listing)
    return read_manifest(spark, listing)


@query("SELECT n_nationkey, n_name, 'text' AS fmt FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, n_name, 'orc' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name, 'parquet' FROM nation WHERE n_regionkey > 1")
def mixed_formats(spark, d):
    """Partitions of one table in three formats."""
    t, parts = load(spark, d, "nation"), []
    for fmt, rows in (("text", "n_regionkey = 0"), ("orc", "n_regionkey = 1"), ("parquet", "n_regionkey > 1")):
        path = fresh_path(spark, fmt)
        write_directory(t.filter(rows).select("n_nationkey", "n_name"), path, fmt)
        parts.append(({"fmt": fmt}, fmt, path))
    return read_mixed(spark, parts, "n_nationkey int, n_name string")


@query("SELECT ((count(*) * 10 + 999) // 1000)::bigint AS records, least(1000, count(*) * 10)::int AS longest, (count(*) * 10)::bigint AS total FROM customer")
def fixed_records(spark, d):
    """Binary records of 1000 bytes, the last one shorter."""
    path = fresh_path(spark, "records")
    load(spark, d, "customer").select(F.lit("123456789").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    found = read_fixed_records(spark, path)
    size = F.octet_length(found.columns[-1])
    return found.agg(F.count("*").alias("records"), F.max(size).alias("longest"), F.sum(size).alias("total"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def insert_dynamic_partition(spark, d):
    """Partitions made from a column, one replaced later."""
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = fresh_path(spark, "partitions")
    write_partitions(t.filter("o_orderstatus = 'F' or (o_orderstatus = 'O' and o_orderkey < 100)"), path, ["o_orderstatus"])
    write_partitions(t.filter("o_orderstatus = 'O'"), path, ["o_orderstatus"])
    return spark.read.schema(t.schema).parquet(path)


@query("SELECT 'big' AS sink, o_orderkey AS k FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def insert_multi(spark, d):
    """Two sinks from one reading."""
    big, urgent = fresh_path(spark, "big"), fresh_path(spark, "urgent")
    to = lambda path: lambda df: df.write.mode("overwrite").parquet(path)
    multi_insert(load(spark, d, "orders"), [(lambda t: t.filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("k")), to(big)), (lambda t: t.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k")), to(urgent))])
    read = lambda name, path: spark.read.schema("k bigint").parquet(path).select(F.lit(name).alias("sink"), "k")
    return read("big", big).union(read("urgent", urgent))


@query("SELECT n_nationkey, n_name FROM nation")
def insert_directory(spark, d):
    """INSERT OVERWRITE DIRECTORY, then read."""
    path = fresh_path(spark, "directory")
    spark.sql("INSERT OVERWRITE DIRECTORY '" + path + "' USING orc SELECT n_nationkey, n_name FROM {t}", t=load(spark, d, "nation"))
    return spark.read.orc(path)


def _fresh_table(spark: SparkSession, name: str) -> str:
    import uuid

    return f"millrace_{name}_{uuid.uuid4().hex[:12]}"


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ctas(spark, d):
    """CREATE TABLE AS SELECT, here over a path of its own."""
    name, path = _fresh_table(spark, "ctas"), fresh_path(spark, "ctas")
    spark.sql("CREATE TABLE " + name + " USING parquet LOCATION '" + path + "' AS SELECT n_regionkey, count(*) AS n FROM {t} GROUP BY n_regionkey", t=load(spark, d, "nation"))
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate::date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def cached_scan_pruned(spark, d):
    """A table in memory, clustered by date: batches whose range misses the predicate are skipped."""
    t = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    t = t.repartitionByRange("day").sortWithinPartitions("day").persist()
    return t.filter("day BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'").select("o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def cached_insert(spark, d):
    """A cached table that gets more rows."""
    name, cached = _fresh_table(spark, "held"), CachedTables(spark)
    t = load(spark, d, "nation").select("n_nationkey", "n_name")
    cached.create(name, t, CacheMode.HEAP)
    cached.insert(name, load(spark, d, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name"))
    return spark.table(name)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def cached_overwrite(spark, d):
    """A cached table overwritten from itself."""
    name, cached = _fresh_table(spark, "held"), CachedTables(spark)
    cached.create(name, load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), CacheMode.HEAP, "MEMORY_ONLY")
    cached.insert(name, spark.table(name).filter("n_regionkey = 1"), overwrite=True)
    return spark.table(name).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def partition_pruned_scan(spark, d):
    """A partitioned table of which a filter leaves one folder to read."""
    t, path = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), fresh_path(spark, "pruned")
    write_partitions(t, path, ["o_orderstatus"])
    return spark.read.schema(t.schema).parquet(path).filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def insert_compressed(spark, d):
    """Compressed text, read back."""
    t, path = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), fresh_path(spark, "gzip")
    write_directory(t, path, compression="gzip")
    return read_text_table(spark, path, t.schema)


@query("SELECT 'n_nationkey' AS col_name, 'int' AS data_type UNION ALL SELECT 'n_name', 'string' UNION ALL SELECT 'n_regionkey', 'int'")
def ddl_describe(spark, d):
    """DESCRIBE of a view."""
    load(spark, d, "nation").createOrReplaceTempView("millrace_described")
    return spark.sql("DESCRIBE millrace_described").select("col_name", "data_type")


@query("SELECT 'kind=' || r AS part FROM (SELECT unnest(['F', 'O', 'P']) AS r)")
def ddl_show_partitions(spark, d):
    """SHOW PARTITIONS after an insert with dynamic partitions."""
    name, path = _fresh_table(spark, "parts"), fresh_path(spark, "parts")
    spark.sql(f"CREATE TABLE {name} (k BIGINT, kind STRING) USING parquet PARTITIONED BY (kind) LOCATION '{path}'")
    spark.sql("INSERT INTO " + name + " PARTITION (kind) SELECT o_orderkey, o_orderstatus FROM {t}", t=load(spark, d, "orders"))
    return spark.sql(f"SHOW PARTITIONS {name}").select(F.col("partition").alias("part"))


@query("SELECT 'kind=' || r AS part FROM (SELECT unnest(['F', 'later']) AS r)")
def ddl_alter_partitions(spark, d):
    """ALTER TABLE: a partition dropped and another renamed."""
    name = _fresh_table(spark, "altered")
    spark.sql(f"CREATE TABLE {name} (k BIGINT, kind STRING) USING parquet PARTITIONED BY (kind) LOCATION '{fresh_path(spark, 'altered')}'")
    spark.sql("INSERT INTO " + name + " PARTITION (kind) SELECT o_orderkey, o_orderstatus FROM {t}", t=load(spark, d, "orders"))
    spark.sql(f"ALTER TABLE {name} DROP PARTITION (kind = 'O')")
    spark.sql(f"ALTER TABLE {name} PARTITION (kind = 'P') RENAME TO PARTITION (kind = 'later')")
    return spark.sql(f"SHOW PARTITIONS {name}").select(F.col("partition").alias("part"))


@query("SELECT 'k' AS col_name, 'bigint' AS data_type UNION ALL SELECT 'v', 'string' UNION ALL SELECT 'more', 'int'")
def ddl_alter_table(spark, d):
    """CREATE TABLE LIKE, RENAME TO and ADD COLUMNS."""
    name, like, last = (_fresh_table(spark, n) for n in ("first", "like", "last"))
    spark.sql(f"CREATE TABLE {name} (k BIGINT, v STRING) USING parquet LOCATION '{fresh_path(spark, 'first')}'")
    spark.sql(f"CREATE TABLE {like} LIKE {name} LOCATION '{fresh_path(spark, 'like')}'")
    spark.sql(f"ALTER TABLE {like} RENAME TO {last}")
    spark.sql(f"ALTER TABLE {last} ADD COLUMNS (more INT)")
    return spark.sql(f"DESCRIBE {last}").select("col_name", "data_type")


@query("SELECT 'held' AS found")
def ddl_database(spark, d):
    """CREATE DATABASE, a table in it, and DROP ... CASCADE."""
    db = _fresh_table(spark, "db")
    spark.sql(f"CREATE DATABASE {db} LOCATION '{fresh_path(spark, 'db')}'")
    spark.sql(f"CREATE TABLE {db}.held (k BIGINT) USING parquet")
    found = [r.tableName for r in spark.sql(f"SHOW TABLES IN {db}").collect() if not r.isTemporary]
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.createDataFrame([(t,) for t in found], "found string")


@query("SELECT count(*) AS n FROM orders")
def ddl_analyze(spark, d):
    """ANALYZE TABLE: the row count kept in the catalog."""
    name = _fresh_table(spark, "analyzed")
    load(spark, d, "orders").select("o_orderkey").write.option("path", fresh_path(spark, "analyzed")).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    stats = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'")
    return stats.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("n"))


@query("SELECT 'upper' AS function")
def ddl_show_functions(spark, d):
    """SHOW FUNCTIONS with a pattern."""
    return spark.sql("SHOW SYSTEM FUNCTIONS LIKE 'upper'")


@query()
def explain_plan(spark, d):
    """The physical plan of a query, as text."""
    return spark.sql("EXPLAIN FORMATTED SELECT count(*) FROM {t} WHERE n_regionkey = 1", t=load(spark, d, "nation"))


statement("fn_rand", "SELECT n_nationkey, rand(7) >= 0 AND rand(7) < 1 AS inside FROM {nation}", "SELECT n_nationkey, true AS inside FROM nation")
statement("join_stream_hint", "SELECT /*+ STREAMTABLE(o) */ o_orderkey, c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
statement("order_by_total", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey")
statement("order_by_aggregate_limit", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
statement("union_with_lateral", "SELECT n_nationkey, v FROM (SELECT n_nationkey, n_name FROM {nation} UNION ALL SELECT r_regionkey + 100, r_name FROM {region}) u LATERAL VIEW explode(array(n_name, lower(n_name))) x AS v", "SELECT n_nationkey, unnest([n_name, lower(n_name)]) AS v FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region)")
statement("join_outer_filtered", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey WHERE c_nationkey = 3 AND (o_orderkey IS NULL OR o_orderkey > 500)")
statement("fn_null_logic", "SELECT event_id, nullif(user_id % 2, 0) = 1 OR value > 1000 AS f_or, nullif(user_id % 2, 0) = 1 AND value > 0 AS f_and, NOT (nullif(user_id % 2, 0) = 1) AS f_not FROM {events}")
statement("fn_implicit_cast", "SELECT p_partkey, p_size + '1' AS f_int, p_size < 10.5D AS f_mixed, concat(p_size, '') AS f_string FROM {part}", "SELECT p_partkey, (p_size + 1)::bigint AS f_int, p_size < 10.5 AS f_mixed, p_size::varchar AS f_string FROM part")


# --- beyond the dialect ----------------------------------------------------------------------------------------------
statement("extra_window", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM {orders}")
statement("extra_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM {nation} GROUP BY ROLLUP (n_regionkey, n_nationkey)")
statement("extra_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
statement("extra_set_ops", "(SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0")
statement("extra_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AND c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3)")
statement("extra_lateral_outer", "SELECT n_nationkey, a FROM {nation} LATERAL VIEW OUTER explode(CASE WHEN n_nationkey % 2 = 0 THEN array(1, 2) END) x AS a", "SELECT n_nationkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [1, 2] ELSE [NULL] END) AS a FROM nation")
statement("extra_anti_join", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")


# --- the dialect's SQL, through a Warehouse --------------------------------------------------------------------------
def _warehouse(spark: SparkSession, d: str, *tables: str):
    from millrace.plans.session import Warehouse

    for t in tables:
        load(spark, d, t).createOrReplaceTempView(t)
    return Warehouse(spark)


@query("SELECT n_name, (ascii(n_name[1:1]) * 31 + ascii(n_name[2:2])) * 31 + n_nationkey AS h FROM nation")
def sql_hash(spark, d):
    """The dialect's hash() of strings and whole numbers."""
    return _warehouse(spark, d, "nation").sql_to_df("SELECT n_name, hash(substr(n_name, 1, 2), n_nationkey) AS h FROM nation")


@query("SELECT n_name FROM nation WHERE (ascii(n_name[1:1]) * 961 + ascii(n_name[2:2]) * 31 + ascii(n_name[3:3])) % 4 = 1")
def sql_sample_bucket(spark, d):
    """TABLESAMPLE by the hash of a string column."""
    w = _warehouse(spark, d, "nation")
    w.spark.sql("SELECT n_name, substr(n_name, 1, 3) AS c FROM nation").createOrReplaceTempView("nation_c")
    return w.sql_to_df("SELECT n_name FROM nation_c TABLESAMPLE (BUCKET 2 OUT OF 4 ON c)")


_GRAMS = "SELECT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(p_name, ' ') AS w FROM part))"


@query(f"SELECT gram, count(*)::double AS n FROM ({_GRAMS}) GROUP BY gram ORDER BY n DESC, gram LIMIT 20")
def sql_ngrams(spark, d):
    """ngrams() in SQL: the most frequent pairs of words."""
    rows = _warehouse(spark, d, "part").sql_to_df("SELECT explode(ngrams(array(split(p_name, ' ')), 2, 20)) AS x FROM part")
    return rows.select(F.array_join("x.ngram", " ").alias("gram"), F.col("x.estfrequency").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def sql_load_delimited(spark, d):
    """CREATE TABLE ... ROW FORMAT DELIMITED, and LOAD DATA into it."""
    name, path, w = _fresh_table(spark, "loaded"), fresh_path(spark, "load"), _warehouse(spark, d, "nation")
    rows = spark.sql("SELECT concat_ws('|', n_nationkey, n_name) AS value FROM nation")
    rows.write.mode("overwrite").text(path)
    w.sql_to_df(f"CREATE TABLE {name} (n_nationkey int, n_name string) ROW FORMAT DELIMITED FIELDS TERMINATED BY '|' STORED AS TEXTFILE")
    w.sql_to_df(f"LOAD DATA INPATH '{path}' OVERWRITE INTO TABLE {name}")
    return spark.table(name)


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def sql_ctas_clauses(spark, d):
    """CREATE TABLE AS with a format, partitions and properties."""
    name, w = _fresh_table(spark, "made"), _warehouse(spark, d, "nation")
    w.sql_to_df(f"CREATE TABLE {name} USING parquet PARTITIONED BY (n_regionkey) TBLPROPERTIES ('made.by' = 'ctas') AS SELECT n_name, n_regionkey FROM nation")
    spark.sql(f"SHOW PARTITIONS {name}")  # fails if the table has none
    return spark.table(name).filter("n_regionkey = 3")
