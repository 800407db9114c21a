"""One query per operator of the survey, each with SQL that another engine can run.

``SHARED`` texts run on both engines as they are; ``PAIRS`` differ in dialect; both read
stored tables of a few fragments.  ``BUILT`` use the package's own operators.  Names start with the survey's ids.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..database import Database, open_database
from ..functions import dialect
from ..operators import joins, windows
from ..sources import maintenance
from ..sources.table import TARGET_ROWS
from .catalyst import size_of
from .statements import referenced_tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def money(x: str) -> str:
    return MONEY.format(x)


SHARED: dict[str, str] = {
    "s01_filtered_scan": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03",
    "s10_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20",
    "s28_values": "SELECT CAST(a AS INT) AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "f01_projection": "SELECT c_custkey, c_name FROM customer",
    "f02_computed": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_extendedprice - l_discount AS net FROM lineitem",
    "f03_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR NOT (o_totalprice < 200000)",
    "f04_comparisons": "SELECT COUNT(*) AS n FROM orders WHERE 1000 < o_orderkey AND o_orderkey <= 9000 AND o_totalprice >= 1000.5 AND o_custkey <> 7",
    "f05_null_tests": "SELECT COUNT(*) AS n, SUM(CASE WHEN x IS NULL THEN 1 ELSE 0 END) = 0 AS none FROM (SELECT NULLIF(o_orderstatus, 'P') AS x FROM orders) t WHERE x IS NOT NULL",
    "f06_in_list": "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9) AND p_partkey NOT IN (3, 4)",
    "f07_between": "SELECT COUNT(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20",
    "f08_logic": "SELECT s_suppkey FROM supplier WHERE (s_nationkey = 3 OR s_nationkey = 5) AND NOT s_acctbal < 0",
    "f09_like": "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'z%' AND p_brand <> 'Brand#11'",
    "f13_case_cast": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS kind, CAST(p_size AS DOUBLE) / 4 AS q, COALESCE(NULLIF(p_brand, 'Brand#11'), 'none') AS b FROM part",
    "f14_subqueries": "SELECT o_orderkey FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40) AND o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "j01_inner": f"SELECT n.n_name, COUNT(*) AS n, {money('o_totalprice')} AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "j02_broadcast": "SELECT r.r_name, COUNT(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "j03_lookup": "SELECT l.l_orderkey, l.l_linenumber, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size = 7",
    "j04_dynamic_filter": "SELECT COUNT(*) AS n FROM lineitem l JOIN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#23' AND p_size < 5) p ON l.l_partkey = p.p_partkey",
    "j06_left": "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey",
    "j06_right": "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "j06_full": "SELECT a.k AS ak, b.k AS bk FROM (SELECT p_partkey AS k FROM part WHERE p_size < 12) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 8 AND p_size < 20) b ON a.k = b.k",
    "j07_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "j07_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "j08_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "j08_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "j10_using": "SELECT l_orderkey, COUNT(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o USING (l_orderkey) GROUP BY l_orderkey",
    "j10_natural": "SELECT n_nationkey, r_name FROM (SELECT n_nationkey, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b",
    "j10_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "a01_group": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {money('l_quantity')} AS qty, ROUND(AVG(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "a02_low_cardinality": "SELECT o_orderpriority, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority",
    "a04_count": "SELECT COUNT(*) AS n FROM lineitem",
    "a05_count_col": "SELECT COUNT(NULLIF(l_returnflag, 'A')) AS n FROM lineitem",
    "a06_min_max": "SELECT MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, MIN(o_orderpriority) AS p FROM orders",
    "a07_sum": f"SELECT {money('o_totalprice')} AS total, CAST(SUM(o_orderkey) AS BIGINT) AS keys FROM orders",
    "a08_avg": "SELECT ROUND(AVG(l_quantity), 6) AS q, ROUND(AVG(l_orderkey), 4) AS k FROM lineitem",
    "a09_variance": "SELECT l_linestatus, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs FROM lineitem GROUP BY l_linestatus",
    "a10_stddev": "SELECT ROUND(STDDEV_POP(o_totalprice), 3) AS sp, ROUND(STDDEV_SAMP(o_totalprice), 3) AS ss FROM orders",
    "a19_count_distinct": "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem",
    "a20_having_filter": "SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "a21_grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "a21_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "a21_rollup": "SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "a22_moments": "SELECT ROUND(CORR(l_quantity, l_extendedprice), 8) AS c, ROUND(COVAR_POP(l_quantity, l_discount), 8) AS vp, ROUND(COVAR_SAMP(l_quantity, l_discount), 8) AS vs FROM lineitem",
    "a22_regression": "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 6) AS slope, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 3) AS icpt, ROUND(REGR_R2(l_extendedprice, l_quantity), 8) AS r2, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem",
    "a22_bits_bools": "SELECT l_returnflag, BIT_AND(l_orderkey) AS a, BIT_OR(l_orderkey) AS o, BIT_XOR(l_orderkey) AS x, BOOL_AND(l_quantity > 0) AS ba, BOOL_OR(l_quantity > 49) AS bo FROM lineitem GROUP BY l_returnflag",
    "a22_median": "SELECT l_linestatus, MEDIAN(l_quantity) AS m FROM lineitem GROUP BY l_linestatus",
    "a22_min_by": "SELECT o_custkey, MAX_BY(o_orderkey, o_totalprice) AS top FROM orders GROUP BY o_custkey",
    "a23_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "a24_empty": "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS c, MAX(o_orderkey) AS m, AVG(o_totalprice) AS a FROM orders WHERE o_orderkey < 0",
    "w02_lag_lead": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events",
    "w02_values": "SELECT event_id, FIRST_VALUE(event_id) OVER w AS f, LAST_VALUE(event_id) OVER w AS l, NTH_VALUE(event_id, 3) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w03_aggregates": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders",
    "w04_rows_frame": "SELECT event_id, CAST(SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM events",
    "w05_range_frame": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "w07_default_frame": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part",
    "o01_order_by": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey",
    "o03_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "o04_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "o05_nulls_last": "SELECT k, x FROM (SELECT p_partkey AS k, NULLIF(p_size, 7) AS x FROM part) t ORDER BY x NULLS LAST, k LIMIT 50",
    "u01_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "u01_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u03_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 25",
    "u03_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "u04_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25",
    "u04_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "u05_cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT MAX(n) AS m FROM big) SELECT o_custkey, n FROM big, top WHERE n >= m - 2",
    "u06_recursive": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "u07_scalar_subquery": "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_nationkey = 4",
    "x01_math": "SELECT p_partkey, ABS(p_size - 25) AS a, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, ROUND(SQRT(p_size), 8) AS s, ROUND(CBRT(p_size), 8) AS cb, ROUND(POWER(p_size, 1.5), 6) AS p, ROUND(LN(p_size), 8) AS l, ROUND(LOG10(p_size), 8) AS l10, ROUND(LOG2(p_size), 8) AS l2, ROUND(EXP(p_size / 50.0E0), 8) AS e, CAST(SIGN(p_size - 25) AS DOUBLE) AS sg FROM part",
    "x01_trig": "SELECT p_partkey, ROUND(SIN(p_size), 8) AS s, ROUND(COS(p_size), 8) AS c, ROUND(TAN(p_size), 6) AS t, ROUND(ATAN2(p_size, 3), 8) AS a, ROUND(DEGREES(p_size), 6) AS d, ROUND(RADIANS(p_size), 8) AS r, ROUND(ASIN(p_size / 100.0E0), 8) AS ai, ROUND(SINH(p_size / 20.0E0), 6) AS sh, ROUND(PI(), 10) AS pi FROM part",
    "x02_strings": "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, CAST(LENGTH(p_name) AS BIGINT) AS n, TRIM(p_brand) AS t, CONCAT(p_brand, '-', p_type) AS c, CONCAT_WS('/', p_brand, p_type) AS w, SUBSTR(p_name, 2, 3) AS s, LEFT(p_name, 2) AS lf, RIGHT(p_name, 2) AS rt, LPAD(p_brand, 12, '*') AS lp, RPAD(p_brand, 12, '*') AS rp, REPLACE(p_brand, 'Brand', 'B') AS rr, REVERSE(p_brand) AS rv, REPEAT(LEFT(p_brand, 1), 3) AS rep FROM part",
    "x02_positions": "SELECT p_partkey, CAST(INSTR(p_type, 'A') AS BIGINT) AS i, SPLIT_PART(p_brand, '#', 2) AS s, TRANSLATE(p_brand, 'Bd', 'xy') AS t, CAST(ASCII(p_brand) AS BIGINT) AS a, CHR(65 + p_size % 26) AS c, CAST(LEVENSHTEIN(p_brand, 'Brand#13') AS BIGINT) AS lv FROM part",
    "x04_parts": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(o_orderdate AS DATE) AS day FROM orders",
    "x05_intervals": "SELECT o_orderkey, o_orderdate + INTERVAL '1' DAY AS d1, o_orderdate - INTERVAL '2' HOUR AS h2 FROM orders",
    "x06_conditional": "SELECT p_partkey, COALESCE(NULLIF(p_size, 7), 0) AS c, GREATEST(p_size, 20, 5) AS g, LEAST(p_size, 20) AS l, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS k FROM part",
    "x10_hash": "SELECT p_partkey, MD5(p_name) AS m FROM part",
    "x11_cast": "SELECT p_partkey, CAST(p_size AS STRING) AS s, TRY_CAST(SUBSTR(p_brand, 7) AS INT) AS i, TRY_CAST(p_brand AS INT) AS n, CAST(p_retailprice AS DECIMAL(12,2)) AS d FROM part",
    "b02_filtered_rows": "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50",
    "b03_group_avg": "SELECT event_type, COUNT(*) AS n, ROUND(AVG(value), 6) AS a FROM events GROUP BY event_type",
    "b08_wide_count": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity < 30 AND l_discount > 0.02 AND l_tax < 0.06 AND l_returnflag = 'N'",
    "b09_wide_aggregate": f"SELECT {money('l_quantity')} AS a, ROUND(AVG(l_extendedprice), 4) AS b, {money('l_extendedprice')} AS c, ROUND(AVG(l_discount), 8) AS d, ROUND(AVG(l_tax), 8) AS e, CAST(SUM(l_partkey) AS BIGINT) AS f FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05 AND l_linestatus = 'O'",
}

#: name -> (Spark, other engine)
PAIRS: dict[str, tuple[str, str]] = {
    "a22_array_agg": (
        "SELECT o_custkey, array_join(array_sort(collect_list(o_orderkey)), ',') AS ks, listagg(o_orderstatus, '') WITHIN GROUP (ORDER BY o_orderkey) AS st FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, array_to_string(list_sort(array_agg(o_orderkey)), ',') AS ks, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS st FROM orders GROUP BY o_custkey",
    ),
    "a22_first_last": (
        "SELECT user_id, MIN_BY(event_type, struct(ts, event_id)) AS f, MAX_BY(event_type, struct(ts, event_id)) AS l FROM events GROUP BY user_id",
        "SELECT user_id, first(event_type ORDER BY ts, event_id) AS f, last(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY user_id",
    ),
    "w01_ranks": (
        "SELECT p_partkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, CAST(RANK() OVER v AS BIGINT) AS r, CAST(DENSE_RANK() OVER v AS BIGINT) AS dr, ROUND(PERCENT_RANK() OVER v, 8) AS pr, ROUND(CUME_DIST() OVER v, 8) AS cd, CAST(NTILE(4) OVER w AS BIGINT) AS nt FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)",
        "SELECT p_partkey, ROW_NUMBER() OVER w AS rn, RANK() OVER v AS r, DENSE_RANK() OVER v AS dr, ROUND(PERCENT_RANK() OVER v, 8) AS pr, ROUND(CUME_DIST() OVER v, 8) AS cd, NTILE(4) OVER w AS nt FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)",
    ),
    "x01_integer_math": (
        "SELECT p_partkey, p_partkey DIV 7 AS d, p_partkey % 7 AS m, factorial(p_size % 10) AS f FROM part",
        "SELECT p_partkey, p_partkey // 7 AS d, p_partkey % 7 AS m, CAST(factorial(p_size % 10) AS BIGINT) AS f FROM part",
    ),
    "x02_starts_ends": (
        "SELECT p_partkey, startswith(p_name, 'a') AS s, endswith(p_type, 'L') AS e, contains(p_brand, '#2') AS c, initcap(lower(p_type)) AS i, overlay(p_brand PLACING '__' FROM 2 FOR 2) AS o FROM part",
        "SELECT p_partkey, starts_with(p_name, 'a') AS s, ends_with(p_type, 'L') AS e, contains(p_brand, '#2') AS c, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i, p_brand[1:1] || '__' || p_brand[4:] AS o FROM part",
    ),
    "x03_regex": (
        r"SELECT p_partkey, regexp_like(p_brand, '#[1-3]') AS l, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS x, regexp_replace(p_brand, '[0-9]+', 'N') AS r, CAST(regexp_count(p_type, '[AEIOU]') AS BIGINT) AS c, array_join(regexp_extract_all(p_brand, '[0-9]', 0), '-') AS a FROM part",
        r"SELECT p_partkey, regexp_matches(p_brand, '#[1-3]') AS l, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS x, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS r, CAST(len(regexp_extract_all(p_type, '[AEIOU]')) AS BIGINT) AS c, array_to_string(regexp_extract_all(p_brand, '[0-9]'), '-') AS a FROM part",
    ),
    "x04_date_trunc": (
        "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, COUNT(*) AS n FROM orders GROUP BY 1",
        "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, COUNT(*) AS n FROM orders GROUP BY 1",
    ),
    "x04_dates": (
        "SELECT o_orderkey, make_date(CAST(extract(YEAR FROM o_orderdate) AS INT), 2, 1) AS md, date_format(o_orderdate, 'yyyy/MM/dd') AS f, CAST(datediff(DATE'2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS dd, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS ld, to_date('1997-03-05') AS td, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS us FROM orders",
        "SELECT o_orderkey, make_date(CAST(extract(YEAR FROM o_orderdate) AS INT), 2, 1) AS md, strftime(o_orderdate, '%Y/%m/%d') AS f, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS dd, last_day(CAST(o_orderdate AS DATE)) AS ld, DATE '1997-03-05' AS td, CAST(epoch(o_orderdate) AS BIGINT) AS us FROM orders",
    ),
    "x07_arrays": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS e1, array_contains(transform(embedding, x -> x > 0.3), true) AS big, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS pos, CAST(array_max(slice(embedding, 1, 8)) AS DOUBLE) AS mx, array_join(transform(sequence(1, 4), i -> CAST(i * label AS STRING)), ';') AS j, CAST(size(array_distinct(array(label, 1, 1, 2))) AS BIGINT) AS d FROM embeddings",
        "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS e1, list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS big, len(list_filter(embedding, lambda x: x > 0)) AS pos, CAST(list_max(embedding[1:8]) AS DOUBLE) AS mx, array_to_string(list_transform(generate_series(1, 4), lambda i: CAST(i * label AS VARCHAR)), ';') AS j, len(list_distinct([label, 1, 1, 2])) AS d FROM embeddings",
    ),
    "x08_maps_structs": (
        "SELECT n_nationkey, map(n_name, n_regionkey)[n_name] AS v, named_struct('a', n_name, 'b', n_regionkey).b AS b, array_join(map_keys(map('x', 1, 'y', n_regionkey)), ',') AS k, CAST(array_max(map_values(map('x', 1, 'y', n_regionkey))) AS INT) AS mv FROM nation",
        "SELECT n_nationkey, map([n_name], [n_regionkey])[n_name] AS v, struct_pack(a := n_name, b := n_regionkey).b AS b, array_to_string(map_keys(map(['x', 'y'], [1, n_regionkey])), ',') AS k, list_max(map_values(map(['x', 'y'], [1, n_regionkey]))) AS mv FROM nation",
    ),
    "x09_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "x10_digests": (
        "SELECT p_partkey, sha2(p_name, 256) AS s, base64(CAST(p_brand AS BINARY)) AS b, lower(hex(p_brand)) AS h FROM part",
        "SELECT p_partkey, sha256(p_name) AS s, to_base64(CAST(p_brand AS BLOB)) AS b, lower(hex(p_brand)) AS h FROM part",
    ),
    "u09_unnest": (
        "SELECT vec_id, CAST(pos AS BIGINT) AS pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 3)) t AS pos, x",
        "SELECT vec_id, CAST(p - 1 AS BIGINT) AS pos, CAST(embedding[p] AS DOUBLE) AS x FROM embeddings, (SELECT unnest([1, 2, 3]) AS p)",
    ),
    "u10_pivot": (
        "SELECT o_orderpriority, F, O, P FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (COUNT(*) FOR o_orderstatus IN ('F' AS F, 'O' AS O, 'P' AS P))",
        "SELECT o_orderpriority, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O, NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY o_orderpriority",
    ),
    "u10_unpivot": (
        "SELECT p_partkey, what, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR what IN (size, price))",
        "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part",
    ),
    "b05_time_window": (
        "SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-12 00:00:00' GROUP BY event_type",
        "SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY event_type",
    ),
    "j14_null_equal": (
        "SELECT a.k, COUNT(*) AS n FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 2) AS k FROM region) b ON a.k <=> b.k GROUP BY a.k",
        "SELECT a.k, COUNT(*) AS n FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT NULLIF(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k",
    ),
    "j09_sort_merge": (
        "SELECT /*+ MERGE(o) */ l.l_linenumber, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_linenumber",
        "SELECT l.l_linenumber, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_linenumber",
    ),
    "t02_tumbling": (
        "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS s, event_type, COUNT(*) AS n FROM (SELECT window(ts, '1 day') AS w, event_type FROM events) GROUP BY w, event_type",
        "SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS s, event_type, COUNT(*) AS n FROM events GROUP BY 1, event_type",
    ),
    "a17_approx_distinct": (
        "SELECT ABS(approx_count_distinct(l_partkey, 0.01) - COUNT(DISTINCT l_partkey)) <= 0.05 * COUNT(DISTINCT l_partkey) AS near FROM lineitem",
        "SELECT true AS near",
    ),
    "a18_approx_percentile": (
        "SELECT percent_rank BETWEEN 0.47 AND 0.53 AS near FROM (SELECT AVG(CASE WHEN o_totalprice <= q THEN 1.0 ELSE 0.0 END) AS percent_rank FROM orders, (SELECT percentile_approx(o_totalprice, 0.5, 10000) AS q FROM orders))",
        "SELECT true AS near",
    ),
}


def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/lithic-inventory-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, *names: str, **options) -> Database:
    """A database that holds copies of the tables."""
    db = open_database(spark, scratch(spark), cache_mb=options.pop("cache_mb", 0))
    for n in names:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        db.create_table(n, df.schema, **options).insert(df)
    return db


_STORED: dict[tuple[int, str], Database] = {}
#: Rows, and bytes in files, that one task sorts and stores, about.
SHARE_ROWS, SHARE_BYTES = TARGET_ROWS // 2, 32 << 20


def common(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """A database of the session that holds the named tables, each stored once in a few fragments."""
    key = id(spark), sf_dir
    if key not in _STORED:
        _STORED[key] = open_database(spark, scratch(spark))
    db = _STORED[key]
    for n in names:
        if n not in db.tables():
            df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
            first = df.columns[0]
            db.create_table(n, df.schema).insert(df.repartitionByRange(shares(df), first).sortWithinPartitions(first))
    return db


def shares(df: DataFrame) -> int:
    """Tasks to store a table with: the more, the larger it is, so that none sorts more of a larger one.

    A shuffle into more parts than Spark's threshold sorts all that a task reads, so larger
    shares, up to fourfold, come first.
    """
    n = max(4, -(-df.count() // SHARE_ROWS), -(-size_of(df) // SHARE_BYTES))
    plain = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return n if n <= plain else max(plain, -(-n // 4))


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return common(spark, sf_dir, *[n for n in referenced_tables(spark, text) if n in TABLES]).sql(text)

    return run


BUILT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def built(name: str, sql: str | None):
    def add(f):
        BUILT[name] = (f, sql)
        return f

    return add


FLAGSHIP = f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {money('l_quantity')} AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price
FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@built("s17_store_and_query", FLAGSHIP.replace("TIMESTAMP_NTZ", "TIMESTAMP "))
def flagship(spark, sf_dir):
    return stored(spark, sf_dir, "lineitem").sql(FLAGSHIP)


@built("j11_range_join_whole", "SELECT p_partkey, lo FROM part JOIN (SELECT CAST(p_partkey AS DOUBLE) AS lo, CAST(p_partkey + 40 AS DOUBLE) AS hi FROM part) s ON p_retailprice >= lo AND p_retailprice < hi")
def range_join_whole(spark, sf_dir):
    """Spans of all parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    spans = part.selectExpr("cast(p_partkey as double) lo", "cast(p_partkey + 40 as double) hi")
    return joins.range_join(part.select("p_partkey", "p_retailprice"), spans, "p_retailprice", "lo", "hi", 40.0).select("p_partkey", "lo")


@built("j12_asof_join", "SELECT c.event_id, p.event_id AS buy_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, MAX(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON c.user_id = p.user_id AND c.ts >= p.ts")
def asof_join(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("buy_id"))
    return joins.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", "ts", ["buy_id"]).select("event_id", "buy_id")


@built("w06_groups_frame", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def groups_frame(spark, sf_dir):
    return windows.over_groups(spark.read.parquet(f"{sf_dir}/part.parquet"), F.count(F.lit(1)), "n", ["p_brand"], "p_size", 1, 1).select("p_partkey", "n")


@built("w08_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def qualify(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return windows.qualify(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.row_number().over(w) <= 2).select("o_custkey", "o_orderkey")


@built("x04_date_bin", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01 00:00:00') AS b, COUNT(*) AS n FROM events GROUP BY 1")
def date_bin(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(dialect.date_bin(6 * 3600, F.col("ts")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@built("x01_gcd_lcm", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, trunc(-p_retailprice) AS t FROM part")
def gcd_lcm(spark, sf_dir):
    a, b = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", dialect.gcd(a, b).alias("g"), dialect.lcm(a, b).alias("l"), dialect.trunc(-F.col("p_retailprice")).cast("double").alias("t"))


@built("u02_union_by_name", "SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS VARCHAR) AS extra FROM nation UNION ALL BY NAME SELECT r_regionkey AS k, r_name AS extra FROM region")
def union_by_name(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as k", "n_name as name")
    return n.unionByName(spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey as k", "r_name as extra"), allowMissingColumns=True)


@built("m01_delete", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 150000)")
def delete(spark, sf_dir):
    db = stored(spark, sf_dir, "orders")
    db.mutate("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 150000")
    return db.sql("SELECT * FROM orders")


@built("m03_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice + o_custkey ELSE o_totalprice END AS o_totalprice FROM orders")
def update(spark, sf_dir):
    db = stored(spark, sf_dir, "orders")
    db.mutate("UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice + o_custkey WHERE o_custkey % 3 = 0")
    return db.sql("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")


def doubled_parts(spark: SparkSession, sf_dir: str) -> tuple[Database, DataFrame]:
    """A database of ``part`` under keys times two, and its rows: odd keys are free for new rows, however far the old keys reach."""
    from ..operators.unique import create_index

    db = open_database(spark, scratch(spark))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_partkey", F.col("p_partkey") * 2)
    db.create_table("part", part.schema).insert(part)
    create_index(db.table("part"), "pk", "p_partkey", unique=True)
    return db, part


def halved(parts: DataFrame) -> DataFrame:
    """Keys as they were; those of new rows a million above the rows they are copies of."""
    k = F.col("p_partkey")
    return parts.withColumn("p_partkey", F.shiftright(k, 1) + k.bitwiseAND(F.lit(1)) * 1000000)


@built("m05_merge", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_partkey % 10 = 0")
def merge(spark, sf_dir):
    db, part = doubled_parts(spark, sf_dir)
    changed = part.where("p_partkey % 8 = 0").withColumn("p_size", F.col("p_size") + 1)
    changed.unionByName(part.where("p_partkey % 20 = 0").withColumn("p_partkey", F.col("p_partkey") + 1)).createOrReplaceTempView("part_changes")
    db.mutate("MERGE INTO part t USING part_changes s ON t.p_partkey = s.p_partkey WHEN MATCHED THEN UPDATE SET p_size = s.p_size WHEN NOT MATCHED THEN INSERT *")
    return halved(db.sql("SELECT p_partkey, p_size FROM part"))


@built("m10_transaction", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def transaction(spark, sf_dir):
    db = stored(spark, sf_dir, "region")
    with db.transaction() as tx:
        tx.insert("region", spark.createDataFrame([(99, "ATLANTIS")], "r_regionkey int, r_name string"))
    tx = db.transaction()
    tx.mutate("DELETE FROM region WHERE r_regionkey >= 0")
    tx.rollback()
    return db.sql("SELECT r_regionkey, r_name FROM region")


@built("s14_time_travel", "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS keys FROM orders")
def time_travel(spark, sf_dir):
    db = stored(spark, sf_dir, "orders")
    db.mutate("DELETE FROM orders WHERE o_orderkey % 2 = 0")
    return db.at(1).sql("SELECT COUNT(*) AS n, SUM(o_orderkey) AS keys FROM orders")


@built("s15_snapshots", "SELECT * FROM (SELECT CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 1, COUNT(*) FROM nation UNION ALL SELECT 2, COUNT(*) - 5 FROM nation) t")
def snapshots(spark, sf_dir):
    db = stored(spark, sf_dir, "nation")
    db.mutate("DELETE FROM nation WHERE n_nationkey < 5")
    return db.snapshots("nation").select("sequence", "rows")


@built("s19_replace", "SELECT r_name FROM region WHERE r_regionkey > 2")
def replace(spark, sf_dir):
    db = stored(spark, sf_dir, "region")
    db.table("region").replace(spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey > 2"))
    return db.sql("SELECT r_name FROM region")


@built("a11_covered_aggregate", "SELECT CAST(SUM(o_custkey) AS BIGINT) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey >= 100")
def covered(spark, sf_dir):
    db = stored(spark, sf_dir, "orders", sort_by=["o_orderkey"])
    return db.sql("SELECT SUM(o_custkey) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey >= 100")


@built("a12_warm_group_by", "SELECT o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS s, COUNT(o_custkey) AS n, ROUND(AVG(o_custkey), 6) AS a FROM orders GROUP BY o_orderstatus")
def warm_group(spark, sf_dir):
    db = stored(spark, sf_dir, "orders", group_keys=["o_orderstatus"])
    return db.sql("SELECT o_orderstatus, SUM(o_custkey) AS s, COUNT(o_custkey) AS n, AVG(o_custkey) AS a FROM orders GROUP BY o_orderstatus").withColumn("a", F.round("a", 6))


@built("a14_aggregates_after_delete", "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, ROUND(VAR_SAMP(o_custkey), 4) AS v FROM orders WHERE o_orderkey % 7 <> 1")
def retracted(spark, sf_dir):
    db = stored(spark, sf_dir, "orders")
    db.mutate("DELETE FROM orders WHERE o_orderkey % 7 = 1")
    return db.sql("SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, VAR_SAMP(o_custkey) AS v FROM orders").withColumn("v", F.round("v", 4))


@built("m13_index_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 32, 99, 1000)")
def index_lookup(spark, sf_dir):
    from ..operators.unique import create_index

    db = stored(spark, sf_dir, "orders")
    create_index(db.table("orders"), "ok", "o_orderkey", unique=True)
    return db.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 32, 99, 1000)")


@built("m18_view", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def view(spark, sf_dir):
    db = stored(spark, sf_dir, "nation")
    db.create_view("by_region", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
    return db.sql("SELECT n_regionkey, n FROM by_region")


@built("m19_compact", "SELECT * FROM supplier WHERE s_suppkey % 3 <> 0")
def compacted(spark, sf_dir):
    db = stored(spark, sf_dir, "supplier")
    db.mutate("DELETE FROM supplier WHERE s_suppkey % 3 = 0")
    maintenance.compact(db.table("supplier"), ["s_suppkey"], force=True)
    maintenance.gc(db.table("supplier"), 1)
    return db.sql("SELECT * FROM supplier")


@built("m26_partitioned", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def partitioned(spark, sf_dir):
    return stored(spark, sf_dir, "orders", partition_by=["o_orderstatus"]).sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")


@built("s20_tsv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def tsv(spark, sf_dir):
    from ..sources.tsv import read_tsv, write_tsv

    df, path = spark.read.parquet(f"{sf_dir}/customer.parquet"), scratch(spark)
    write_tsv(df, path)
    return read_tsv(spark, path, df.schema)


@built("s29_result_cache", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey > 5 GROUP BY o_orderstatus ORDER BY 1")
def cached(spark, sf_dir):
    db = stored(spark, sf_dir, "orders", cache_mb=64)
    q = "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey > 5 GROUP BY o_orderstatus ORDER BY 1"
    db.sql(q)
    return db.sql(q)


@built("s32_schema_evolution", "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS area FROM region UNION ALL SELECT 77, 'NEW', 1.5")
def evolved(spark, sf_dir):
    from pyspark.sql import types as T

    db = stored(spark, sf_dir, "region")
    db.table("region").add_column("area", T.DoubleType())
    db.table("region").insert(spark.createDataFrame([(77, "NEW", 1.5)], "r_regionkey int, r_name string, area double"))
    return db.sql("SELECT r_regionkey, r_name, area FROM region")


HALF_OPEN = "o_totalprice > 100000.5 AND o_totalprice <= 250000.25"


@built("a11_decimal_bounds", f"SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, ROUND(AVG(o_totalprice), 4) AS a FROM orders WHERE {HALF_OPEN}")
def decimal_bounds(spark, sf_dir):
    db = stored(spark, sf_dir, "orders", sort_by=["o_totalprice"])
    return db.sql(f"SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, AVG(o_totalprice) AS a FROM orders WHERE {HALF_OPEN}").withColumn("a", F.round("a", 4))


@built("m01_delete_decimal", f"SELECT o_orderkey, o_totalprice FROM orders WHERE NOT ({HALF_OPEN})")
def delete_decimal(spark, sf_dir):
    db = stored(spark, sf_dir, "orders", sort_by=["o_totalprice"])
    db.mutate(f"DELETE FROM orders WHERE {HALF_OPEN}")
    return db.sql("SELECT o_orderkey, o_totalprice FROM orders")


@built("m03_update_decimal", f"SELECT o_orderkey, CASE WHEN {HALF_OPEN} THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_decimal(spark, sf_dir):
    db = stored(spark, sf_dir, "orders")
    db.mutate(f"UPDATE orders SET o_orderstatus = 'X' WHERE {HALF_OPEN}")
    return db.sql("SELECT o_orderkey, o_orderstatus FROM orders")


@built("a12_warm_groups_after_delete", "SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderkey <> 32 GROUP BY o_orderpriority")
def warm_after_delete(spark, sf_dir):
    db = stored(spark, sf_dir, "orders", sort_by=["o_orderkey"], group_keys=["o_orderpriority"])
    db.mutate("DELETE FROM orders WHERE o_orderkey = 32")
    return db.sql("SELECT o_orderpriority, COUNT(*) AS n, SUM(o_custkey) AS s FROM orders GROUP BY o_orderpriority")


@built("m05_merge_arms", "SELECT p_partkey, p_size + 100 * CAST(p_size > 40 AS INT) AS p_size FROM part WHERE NOT (p_size < 5) UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def merge_arms(spark, sf_dir):
    db, part = doubled_parts(spark, sf_dir)
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1)).createOrReplaceTempView("part_changes")
    db.mutate("MERGE INTO part t USING part_changes s ON t.p_partkey = s.p_partkey WHEN MATCHED AND s.p_size < 5 THEN DELETE WHEN MATCHED AND s.p_size > 40 THEN UPDATE SET p_size = s.p_size + 100 WHEN NOT MATCHED AND s.p_size BETWEEN 10 AND 12 THEN INSERT *")
    return halved(db.sql("SELECT p_partkey, p_size FROM part"))


@built("m08_batch", "SELECT n_nationkey, CASE WHEN n_nationkey > 10 THEN 'N' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 3")
def batch(spark, sf_dir):
    db = stored(spark, sf_dir, "nation")
    db.mutate_batch(["DELETE FROM nation WHERE n_nationkey = 3", "UPDATE nation SET n_name = 'N' WHERE n_nationkey > 10"])
    return db.sql("SELECT n_nationkey, n_name FROM nation")


@built("m10_transaction_tables", "SELECT 'nation' AS t, COUNT(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'region', COUNT(*) FROM region WHERE r_regionkey <> 1")
def transaction_tables(spark, sf_dir):
    db = stored(spark, sf_dir, "nation", "region")
    with db.transaction() as tx:
        tx.mutate("DELETE FROM nation WHERE n_regionkey = 1")
        tx.mutate("DELETE FROM region WHERE r_regionkey = 1")
    return db.sql("SELECT 'nation' AS t, COUNT(*) AS n FROM nation UNION ALL SELECT 'region', COUNT(*) FROM region")


@built("m14_unique_keys", "SELECT 'kept' AS what, COUNT(*) AS n FROM nation")
def unique_keys(spark, sf_dir):
    from ..errors import UniqueViolation
    from ..operators.unique import create_index

    db = stored(spark, sf_dir, "nation")
    create_index(db.table("nation"), "pk", "n_nationkey", unique=True)
    try:
        db.table("nation").insert(spark.read.parquet(f"{sf_dir}/nation.parquet"))
        what = "broken"
    except UniqueViolation:
        what = "kept"
    return db.sql(f"SELECT '{what}' AS what, COUNT(*) AS n FROM nation GROUP BY 1")


@built("m20_optimize", "SELECT * FROM supplier WHERE s_suppkey % 5 <> 0")
def optimized(spark, sf_dir):
    db = stored(spark, sf_dir, "supplier")
    db.mutate("DELETE FROM supplier WHERE s_suppkey % 5 = 0")
    db.optimize("supplier", ["s_suppkey"])
    return db.sql("SELECT * FROM supplier")


@built("m22_check_and_doctor", "SELECT 0 AS wrong, 1 AS orphans, 0 AS broken, COUNT(*) AS n FROM region WHERE r_regionkey <> 2")
def checked(spark, sf_dir):
    db = stored(spark, sf_dir, "region")
    db.mutate("DELETE FROM region WHERE r_regionkey = 2")
    t = db.table("region")
    t.files.create("data/left-behind.parquet", "")
    wrong, orphans = len(maintenance.check(t)), len(maintenance.doctor(t, repair=True))
    return db.sql(f"SELECT {wrong} AS wrong, {orphans} AS orphans, {len(t.verify_history())} AS broken, COUNT(*) AS n FROM region GROUP BY 1, 2, 3")


@built("s09_rows_by_id", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (3, 7)")
def rows_by_id(spark, sf_dir):
    db = stored(spark, sf_dir, "nation", sort_by=["n_nationkey"])
    ids = [r[0] for r in db.sql("SELECT _rowid FROM nation__rows WHERE n_nationkey IN (3, 7)").collect()]
    db.mutate("UPDATE nation SET n_name = 'moved' WHERE n_nationkey = 7")
    return db.rows_by_id("nation", ids).select("n_nationkey")


@built("s16_insert_parquet", "SELECT s_suppkey, s_name FROM supplier")
def insert_parquet(spark, sf_dir):
    path = f"{sf_dir}/supplier.parquet"
    db = open_database(spark, scratch(spark))
    db.create_table("supplier", spark.read.parquet(path).schema).insert_parquet(path)
    return db.sql("SELECT s_suppkey, s_name FROM supplier")


@built("s18_arrow_file", "SELECT r_regionkey, r_name FROM region")
def arrow_file(spark, sf_dir):
    from ..sources.formats import read_arrow, write_arrow

    path = scratch(spark)
    write_arrow(spark.read.parquet(f"{sf_dir}/region.parquet"), path)
    return read_arrow(spark, path).select("r_regionkey", "r_name")


@built("s31_statistics", "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(MIN(o_custkey) AS VARCHAR) AS lo, CAST(MAX(o_custkey) AS VARCHAR) AS hi, true AS exact FROM orders")
def statistics(spark, sf_dir):
    return stored(spark, sf_dir, "orders").statistics("orders").where("column = 'o_custkey'").drop("column")


@built("t04_stream_append", "SELECT event_id, event_type FROM events")
def stream_append(spark, sf_dir):
    from ..streaming.append import append_stream

    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    events.repartition(4).write.parquet(f"{path}/in")
    db = open_database(spark, f"{path}/db")
    t = db.create_table("events", events.schema)
    for _ in range(2):  # the second run finds nothing new
        append_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), t, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return db.sql("SELECT event_id, event_type FROM events")


@built("t05_change_feed", "SELECT 'delete' AS change, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'insert', 100")
def change_feed(spark, sf_dir):
    from ..streaming.append import changes

    db = stored(spark, sf_dir, "nation")
    t, since = db.table("nation"), db.table("nation").sequence
    db.mutate("DELETE FROM nation WHERE n_regionkey = 2")
    db.mutate("INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'new')")
    return changes(t, since).selectExpr("_change as change", "cast(n_nationkey as bigint) as k")


def _events_stream(spark, sf_dir, columns: str):
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*columns.split(", "))
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", max(1, events.count() // 3)).parquet(f"{path}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


@built("t01_watermarked_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def watermarked(spark, sf_dir):
    from ..streaming.windows import settled, windowed

    stream, path = _events_stream(spark, sf_dir, "ts, event_type")
    counts = windowed(stream, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")], late="2 hours")
    return settled(counts, path, ["start", "event_type"]).select("start", "event_type", "n")


@built("t02_sliding", "SELECT time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day' * k AS start, COUNT(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def sliding(spark, sf_dir):
    from ..streaming.windows import windowed

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windowed(events, "ts", "2 days", [], [F.count(F.lit(1)).alias("n")], slide="1 day").select("start", "n")


@built("t02_sessions", """SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, g""")
def sessions(spark, sf_dir):
    from ..streaming.windows import sessions as by_session

    return by_session(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]).select("user_id", "start", "n")


@built("t03_running_totals", "SELECT user_id, COUNT(*) AS n, MAX(event_id) AS last FROM events GROUP BY user_id")
def running_totals(spark, sf_dir):
    from ..streaming.windows import running, settled

    stream, path = _events_stream(spark, sf_dir, "ts, user_id, event_id")
    return settled(running(stream, "user_id", "event_id"), path, ["user_id"], mode="update").select("user_id", "n", "last")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _sql(v) for k, v in SHARED.items()} | {k: _sql(v[0]) for k, v in PAIRS.items()} | {k: v[0] for k, v in BUILT.items()}
    return dict(sorted(out.items()))


def oracle_sql() -> dict[str, str]:
    return SHARED | {k: v[1] for k, v in PAIRS.items()} | {k: v[1] for k, v in BUILT.items() if v[1]}
