"""The 22 decision-support shapes over the tables at hand: part-supplier pairs come from lineitem, comments and phones from names."""

from __future__ import annotations

_PS = "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"
_REVENUE = "l_extendedprice * (1 - l_discount)"

SAME: dict[str, str] = {
    "q01": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_REVENUE}), 2) AS sum_disc,
        round(sum({_REVENUE} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q03": f"""SELECT l_orderkey, round(sum({_REVENUE}), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
        AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderdate < l_shipdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05": f"""SELECT n_name, round(sum({_REVENUE}), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
        AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name ORDER BY revenue DESC""",
    "q06": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "q07": f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, {_REVENUE} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31') AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08": f"""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_7' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
        SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {_REVENUE} AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA'
        AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year ORDER BY o_year""",
    "q09": f"""SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
        SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, {_REVENUE} - p_retailprice * l_quantity / 10 AS amount FROM part, supplier, lineitem, orders, nation
        WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%anvil%') AS profit GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q10": f"""SELECT c_custkey, c_name, round(sum({_REVENUE}), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3'
        GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.002 FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3') ORDER BY value DESC, l_partkey""",
    "q12": """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_returnflag ORDER BY l_returnflag""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URG%NT%' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14": f"""SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""",
    "q15": f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REVENUE}), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue) ORDER BY s_suppkey""",
    "q16": f"""SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PS} ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#23' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
        AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#13' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
        AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": f"""SELECT round(sum({_REVENUE}), 2) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 20 AND p_size BETWEEN 1 AND 25)
        OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 30) OR (p_partkey = l_partkey AND p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 45)""",
    "q20": """SELECT s_name, s_suppkey FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%an%')
        GROUP BY l_partkey, l_suppkey HAVING sum(l_quantity) > 0.5 * 90) AND s_nationkey = n_nationkey AND n_regionkey = 2 ORDER BY s_name, s_suppkey""",
    "q21": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
        AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": """SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (SELECT substring(c_name, 17, 2) AS cntrycode, c_acctbal FROM customer WHERE substring(c_name, 17, 1) IN ('1', '3', '5', '7')
        AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)) AS custsale GROUP BY cntrycode ORDER BY cntrycode""",
}

#: For Spark, pairs of the parts wanted only, and the least balance of each part's suppliers in the same pass.
PAIRS: dict[str, tuple[str, str]] = {
    "q02": (
        """WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 12 AND p_type = 'PROMO'),
        offers AS (SELECT s_acctbal, s_name, n_name, l_partkey AS p_partkey, min(s_acctbal) OVER (PARTITION BY l_partkey) AS least FROM ps
            JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
        SELECT s_acctbal, s_name, n_name, p_partkey FROM offers WHERE s_acctbal = least ORDER BY s_acctbal DESC NULLS LAST, n_name, s_name, p_partkey LIMIT 100""",
        f"""SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, {_PS} ps, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 12 AND p_type = 'PROMO' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
        AND s_acctbal = (SELECT min(s_acctbal) FROM supplier, {_PS} ps, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    ),
}
