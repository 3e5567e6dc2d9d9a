"""SQL that passes through to Spark: joins, aggregates, windows, set operations, paging, and JSON and type filters.

One text is both the Spark statement and the oracle, unless the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.plans.registry import query, statement
from skein.session import load

statement("join_inner", "select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by n_name")
statement("join_multiway", "select r_name, count(distinct c_custkey) as customers, count(*) as orders, round(sum(o_totalprice), 2) as total from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by r_name")
statement("join_left", "select c_custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by c_custkey")
statement("join_right", "select n_name, count(s_suppkey) as suppliers from supplier right join nation on s_nationkey = n_nationkey group by n_name")
statement("join_full", "select coalesce(a.k, b.k) as k, a.n as suppliers, b.n as customers from (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 0 group by 1) a full join (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by 1) b on a.k = b.k")
statement("join_semi", "select c_custkey from customer left semi join orders on o_custkey = c_custkey and o_totalprice > 300000", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
statement("join_anti", "select c_custkey from customer left anti join orders on o_custkey = c_custkey", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
statement("join_cross", "select r_name, n_name from region cross join nation")
statement("join_using", "select count(*) as n, round(sum(l_extendedprice), 2) as total from (select o_orderkey as k from orders where o_orderpriority = '1-URGENT') a join (select l_orderkey as k, l_extendedprice from lineitem) b using (k)")
statement("join_theta", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
# Prices are counted once each and meet suppliers by ranges of 50, so no supplier is compared with every part.
statement("join_range", """with p as (select p_retailprice as price, floor(p_retailprice / 50) as bin, count(*) as n from part group by 1, 2),
s as (select s_suppkey, s_acctbal, explode(sequence(floor(s_acctbal / 50), floor((s_acctbal + 50) / 50))) as bin from supplier)
select s_suppkey, sum(n) as parts from s join p on s.bin = p.bin and price between s_acctbal and s_acctbal + 50 group by s_suppkey""", "select s_suppkey, count(*) as parts from supplier join part on p_retailprice between s_acctbal and s_acctbal + 50 group by s_suppkey")  # fmt: skip
statement("subquery_scalar", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
statement("subquery_not_in", "select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
statement("subquery_correlated", "select p_partkey from part p where p_retailprice = (select max(p_retailprice) from part q where q.p_brand = p.p_brand)")
statement("cte_recursive", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select n, n * n as square from t")
statement("agg_pricing_summary", """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")  # fmt: skip
statement("agg_rollup", "select n_regionkey, n_name, count(*) as n from nation join customer on c_nationkey = n_nationkey group by rollup (n_regionkey, n_name)")
statement("agg_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
statement("agg_grouping_sets", "select l_returnflag, l_linestatus, grouping(l_returnflag) as g, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())", "select l_returnflag, l_linestatus, grouping(l_returnflag) as g, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
statement("agg_distinct", "select o_orderpriority, count(distinct o_custkey) as customers, count(distinct o_orderstatus) as states from orders group by o_orderpriority")
statement("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= 15")
statement("agg_filter", "select event_type, count(*) filter (where value > 50) as high, count(*) as n from events group by event_type")
statement("agg_percentile", "select event_type, round(percentile(value, 0.5), 6) as median, round(percentile(value, 0.9), 6) as p90 from events group by event_type", "select event_type, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as p90 from events group by event_type")
statement("agg_statistics", "select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as var, round(corr(value, user_id), 6) as r, round(covar_pop(value, user_id), 6) as cov from events group by event_type")
statement("agg_argmax", "select p_brand, max_by(p_partkey, struct(p_retailprice, p_partkey)) as p_partkey from part group by p_brand", "select p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) as p_partkey from part group by p_brand")
statement("agg_string", "select n_regionkey, array_join(array_sort(collect_list(n_name)), ',') as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
statement("agg_pivot", "select * from (select o_orderstatus, o_orderpriority from orders) pivot (count(*) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
statement("win_rank", "select p_partkey, rank() over (partition by p_brand order by p_size desc) as r, dense_rank() over (partition by p_brand order by p_size desc) as d, row_number() over (partition by p_brand order by p_size desc, p_partkey) as n from part")
statement("win_ntile", "select c_custkey, ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as q, round(percent_rank() over (partition by c_mktsegment order by c_acctbal), 6) as pr, round(cume_dist() over (partition by c_mktsegment order by c_acctbal), 6) as cd from customer")
statement("win_lag", "select event_id, lag(value) over w as before, lead(value, 2, -1.0) over w as after from events window w as (partition by user_id order by ts, event_id)")
statement("win_values", "select event_id, first_value(event_id) over w as f, last_value(event_id) over w as l, nth_value(event_id, 2) over w as n from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)")
statement("win_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as running from orders")
statement("win_range", "select event_id, count(*) over (partition by user_id order by ts range between interval '1' day preceding and current row) as n from events", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n from events")
statement("win_running_share", "select n_nationkey, round(sum(s) over (order by s desc, n_nationkey rows between unbounded preceding and current row) / sum(s) over (), 6) as share from (select n_nationkey, sum(c_acctbal) as s from nation join customer on c_nationkey = n_nationkey group by 1) t")
statement("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
statement("set_union_all", "select k, count(*) as n from (select c_nationkey as k from customer union all select s_nationkey from supplier) t group by k")
statement("set_intersect", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select c_custkey from customer where c_acctbal < 0")
statement("set_except", "select c_custkey as k from customer except select o_custkey from orders")
statement("set_intersect_all", "select k, count(*) as n from (select l_suppkey as k from lineitem where l_quantity = 1 intersect all select l_suppkey from lineitem where l_quantity = 2) t group by k")
statement("set_except_all", "select k, count(*) as n from (select l_suppkey as k from lineitem where l_quantity = 1 except all select l_suppkey from lineitem where l_quantity = 2) t group by k")
statement("page_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
statement("auto_limit", "select o_orderkey, o_orderdate from orders order by o_orderkey limit 20")
statement("predicate_ilike", "select p_partkey from part where p_type ilike '%BRASS%' or p_name ilike 'a%'")
statement("predicate_mixed", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate between timestamp '1995-01-01' and timestamp '1996-06-30' and not o_orderstatus = 'P'")
statement("case_bucket", "select case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'mid' else 'high' end as band, count(*) as n from customer group by 1")
statement("type_casts", "select cast(l_quantity as bigint) as q, count(*) as n, round(cast(sum(cast(l_tax as decimal(12, 4))) as double), 4) as tax from lineitem group by 1")
statement("date_parts", "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by 1, 2")
statement("date_truncation", "select cast(date_trunc('week', o_orderdate) as date) as w, count(*) as n from orders group by 1")
statement("lookup_dimension", "select l_returnflag, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2")
statement("top_customers", "select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where o_orderdate >= timestamp '1995-01-01' and l_returnflag = 'R' group by 1, 2 order by revenue desc, c_custkey limit 20")
statement("shipping_priority", "select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15' and l_shipdate > timestamp '1995-03-15' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10")
statement("revenue_forecast", "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")


@query("join_lateral", "select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t")
def join_lateral(spark, sf_dir):
    """Each customer's dearest order. Spark plans a lateral subquery's ORDER BY and LIMIT as a global sort before a shuffle, which loses the order; a window's own order holds."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())
    best = load(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r = 1")
    return load(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("agg_approx_distinct")
def agg_approx_distinct(spark, sf_dir):
    """Distinct customers a priority, within a few hundredths."""
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@query("join_asof", """select e.event_id, p.event_id as purchase_id from (select * from events where event_type = 'error') e asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts""")
def join_asof(spark, sf_dir):
    """Each error with its user's last purchase at or before it: a running last value over both logs, one shuffle."""
    e = load(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "error", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = e.withColumn("purchase_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return out.where("event_type = 'error'").select("event_id", "purchase_id")


_K = "cast(json_extract(props, '$.k') as int)"


@query("json_filter", f"select event_id from events where {_K} = 42 order by event_id limit 200")
def json_filter(spark, sf_dir):
    """Containment of a scalar in a JSON column, the first 200 by id (the operator's own limit)."""
    from skein.operators.filters import metadata_filter

    rows = metadata_filter(load(spark, sf_dir, "events"), "props", {"k": 42})
    return rows.select("event_id").orderBy("event_id").limit(200)


@query("json_filter_any", f"select event_id from events where {_K} in (1, 2, 3)")
def json_filter_any(spark, sf_dir):
    from skein.operators.filters import metadata_filter

    return metadata_filter(load(spark, sf_dir, "events"), "props", {"k": [1, 2, 3]}).select("event_id")


@query("json_missing_key", "select count(*) as n from events where json_extract(props, '$.zzz') is null")
def json_missing_key(spark, sf_dir):
    from skein.operators.filters import metadata_filter

    return metadata_filter(load(spark, sf_dir, "events"), "props", {"zzz": None}).agg(F.count("*").alias("n"))


@query("filter_count", f"select count(*) as n from events where {_K} = 7 and event_type = 'view'")
def filter_count(spark, sf_dir):
    from skein.operators.filters import metadata_filter

    return metadata_filter(load(spark, sf_dir, "events").where("event_type = 'view'"), "props", {"k": 7}).agg(F.count("*").alias("n"))


@query("json_aggregate", f"select {_K} % 10 as bucket, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def json_aggregate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("tag_filter", "select o_orderkey from (select o_orderkey, [o_orderstatus, o_orderpriority] as tags from orders) where list_has_all(tags, ['F', '1-URGENT'])")
def tag_filter(spark, sf_dir):
    from skein.operators.filters import has_all_tags

    o = load(spark, sf_dir, "orders").withColumn("tags", F.array("o_orderstatus", "o_orderpriority"))
    return has_all_tags(o, "tags", ["F", "1-URGENT"]).select("o_orderkey")


@query("tag_counts", "select unnest([o_orderstatus, o_orderpriority]) as tag, count(*) as n from orders group by 1")
def tag_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("prefix_lookup", "select p_partkey, count(*) over () as found from part where p_name like 'part_1%' or cast(p_partkey as varchar) like '19%'")
def prefix_lookup(spark, sf_dir):
    p = load(spark, sf_dir, "part").where("p_name like 'part_1%' or cast(p_partkey as string) like '19%'")
    return p.select("p_partkey", F.count("*").over(Window.partitionBy(F.lit(0))).alias("found"))


@query("role_policy", "select o_orderkey, case when o_orderpriority = '5-LOW' then 'denied' when o_orderstatus = 'P' then 'allowed' else 'no policy' end as decision from orders")
def role_policy(spark, sf_dir):
    """Tools by role: no policy allows, deny beats allow."""
    from skein.operators.filters import apply_policy

    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "5-LOW"), "clerk").otherwise("guest").alias("role"), F.col("o_orderpriority").alias("tool"))
    policy = spark.createDataFrame([("clerk", ["*"], ["5-LOW"])], "role string, allow array<string>, deny array<string>")
    return apply_policy(o, policy).select("o_orderkey", "decision")


@query("vector_statistics", "select label, count(*) as n, round(avg(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as mean_square from embeddings group by 1")
def vector_statistics(spark, sf_dir):
    from skein.functions.vectors import dot

    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("embedding"), F.col("embedding"))), 6).alias("mean_square"))
