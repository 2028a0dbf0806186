"""Queries over the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .proxies import GRID_SQL, POS_SQL, SCORED_SQL, grid, pos, scored
from .registry import query, r, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(cols, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in cols)


@query("a1_value_counts", f"""select o_orderpriority, count(*) as count,
 {r("count(*)*100.0/(select count(*) from orders)")} as pct from orders group by 1""")
def _(t):
    return P.value_counts(t.orders, "o_orderpriority", dropna=False, digits=6)


@query("a1_value_counts_top", f"""select p_type, count(*) as count,
 {r("count(*)*100.0/(select count(*) from part)")} as pct from part where p_type is not null group by 1
 order by count desc, p_type limit 10""")
def _(t):
    return P.value_counts(t.part, "p_type", n=10, digits=6)


_SUMMARY = """select '{c}' as "column", count({c}) as count, round(avg({c}),6) as mean, round(stddev_samp({c}),6) as std,
 min({c}) as min, max({c}) as max, round(quantile_cont({c},0.05),6) as p5, round(quantile_cont({c},0.25),6) as q1,
 round(quantile_cont({c},0.5),6) as median, round(quantile_cont({c},0.75),6) as q3, round(quantile_cont({c},0.95),6) as p95,
 round(quantile_cont({c},0.99),6) as p99, round(quantile_cont({c},0.75)-quantile_cont({c},0.25),6) as iqr,
 cast(0 as bigint) as inf_count from lineitem"""


@query("a2_numeric_summary", _each(LINE, _SUMMARY))
def _(t):
    return rounded(P.numeric_summary(t.lineitem, LINE).drop("var"))


_SHAPE = """select '{c}' as "column", round(g1*sqrt(n*(n-1))/(n-2),6) as skewness,
 round((n-1)/((n-2)*(n-3))*((n+1)*g2+6),6) as kurtosis, abs(g1*sqrt(n*(n-1))/(n-2))>2 as highly_skewed,
 abs((n-1)/((n-2)*(n-3))*((n+1)*g2+6))>7 as heavy_tailed from
 (select n, m3/power(m2,1.5) as g1, m4/(m2*m2)-3 as g2 from
 (select cast(count(*) as double) as n, avg(power({c}-mu,2)) as m2, avg(power({c}-mu,3)) as m3, avg(power({c}-mu,4)) as m4
 from lineitem, (select avg({c}) as mu from lineitem)))"""


@query("a3_shape_moments", _each(LINE, _SHAPE))
def _(t):
    return rounded(P.shape_moments(t.lineitem, LINE))


_FENCE = """select '{c}' as "column", round(max(lo),6) as low, round(max(hi),6) as high, count(*) filter (where {c}<lo or {c}>hi) as outliers,
 %s as outlier_pct from {tab}, (select q1-{f}*(q3-q1) as lo, q3+{f}*(q3-q1) as hi from
 (select quantile_cont({c},0.25) as q1, quantile_cont({c},0.75) as q3 from {tab}))""" % r("count(*) filter (where {c}<lo or {c}>hi)*100.0/count(*)", 4)


@query("a4_iqr_outliers", " union all ".join(_FENCE.format(c=c, f="1.5", tab="orders") for c in ["o_totalprice"]))
def _(t):
    return rounded(P.iqr_outliers(t.orders, ["o_totalprice"], 1.5))


@query("a4_iqr_outliers_wide", " union all ".join(_FENCE.format(c=c, f="3.0", tab="lineitem") for c in LINE))
def _(t):
    return rounded(P.iqr_outliers(t.lineitem, LINE))


def _sparse(t):
    late = F.when(F.col("l_linenumber") <= 5, F.col("l_tax"))
    status = F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", late.alias("late_tax"), status.alias("closed"), F.when(F.col("l_quantity") > 50, 1).alias("huge"))


_SPARSE = """sparse as (select l_orderkey, case when l_linenumber<=5 then l_tax end as late_tax,
 nullif(l_linestatus,'O') as closed, case when l_quantity>50 then 1 end as huge from lineitem)"""
_TIER = "case when m>=90 then 'critical' when m>=75 then 'high' when m>=50 then 'moderate' when m>=25 then 'low' when m>0 then 'minimal' else 'complete' end"
_MISS = f"""miss as (select c as "column", n-p as missing, {r("(n-p)*100.0/n", 4)} as m, p as present, {r("100.0-(n-p)*100.0/n", 4)} as present_pct from
 (select 'l_orderkey' as c, count(*) as n, count(l_orderkey) as p from sparse union all
  select 'late_tax', count(*), count(late_tax) from sparse union all select 'closed', count(*), count(closed) from sparse
  union all select 'huge', count(*), count(huge) from sparse))"""


@query("a5_missing_summary", f"""with {_SPARSE}, {_MISS} select "column", missing, m as missing_pct, present, present_pct, {_TIER} as tier from miss""")
def _(t):
    return P.missing_summary(_sparse(t))


@query("a5_tier_breakdown", f"with {_SPARSE}, {_MISS} select {_TIER} as tier, count(*) as columns from miss group by 1")
def _(t):
    return P.tier_breakdown(P.missing_summary(_sparse(t)))


@query("a6_exact_duplicates", """select cast(sum(n) as bigint) as rows, count(*) as distinct_rows, cast(sum(n)-count(*) as bigint) as duplicates from
 (select count(*) as n from documents group by text, lang, source, n_chars)""")
def _(t):
    return P.exact_duplicates(t.documents.select("text", "lang", "source", "n_chars"))


@query("a7_distinct_counts", """select 'p_brand' as "column", count(distinct p_brand) as "distinct" from part union all
 select 'p_type', count(distinct p_type) from part union all select 'p_size', count(distinct p_size) from part union all
 select 'p_name', count(distinct p_name) from part""")
def _(t):
    return P.distinct_counts(t.part, ["p_brand", "p_type", "p_size", "p_name"])


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


_NUMBERS = ("p_partkey", "p_size", "p_retailprice")


def _quality(c: str) -> str:
    number = c in _NUMBERS
    spread = f"coalesce(stddev_samp({c})<1e-10, false), coalesce(min({c})=0 and max({c})=0 and count({c})=count(*), false)" if number else "false, false"
    negative = f"count(*) filter (where {c}<0)" if c in ("p_size", "p_retailprice") else "0"
    return f"""select '{c}', count(distinct {c}), (count(*)-count({c}))*100.0/count(*), count(distinct {c})<=1,
 case when count(distinct {c})<=1 then 0 else (select max(n) from (select count(*) as n from part where {c} is not null group by {c}))*1.0/count({c}) end,
 {spread}, {"false" if number else f"count(distinct {c})>100"}, {negative} from part"""


@query("a8_column_quality", f"""with q("column", "unique", gone, is_constant, top, zero_variance, all_zeros, high_cardinality, negative_count) as
 ({" union all ".join(_quality(c) for c in _PART)}),
 f as (select *, top>=0.98 as is_near_constant, concat_ws('; ', case when is_constant then 'CONSTANT' end, case when top>=0.98 then 'NEAR_CONSTANT' end,
 case when zero_variance then 'ZERO_VARIANCE' end, case when all_zeros then 'ALL_ZEROS' end,
 case when high_cardinality then 'HIGH_CARD(' || "unique" || ')' end, case when negative_count>0 then 'NEG(' || negative_count || ')' end) as flags from q)
 select "column", "unique", {r("gone", 4)} as missing_pct, is_constant, is_near_constant, {r("top", 4)} as dominant_fraction, zero_variance, all_zeros,
 high_cardinality, cast(0 as bigint) as inf_count, cast(negative_count as bigint) as negative_count, flags, if(flags='', 'PASS', 'REVIEW') as status from f""")
def _(t):
    return P.column_quality(t.part, _PART)


@query("a9_duplicate_columns", """select 'l_orderkey' as a, 'copy_key' as b""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.col("l_orderkey").alias("copy_key"))
    return P.duplicate_columns(df)


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string", "c_latest": "string"}


def _column_facts(c: str, dtype: str, table: str) -> str:
    kind = "'Numeric'" if dtype != "string" else f"""case when count({c})=0 then 'Unknown'
 when count(distinct {c})*1.0/count({c})>0.5 or count(distinct {c})>200 then 'Text' else 'Categorical' end"""
    return f"""select '{c}' as "column", '{dtype}' as dtype, {kind} as semantic_type, min({c}::varchar) as example,
 count(distinct {c}) as "unique", count({c}) as present, count(*)-count({c}) as missing, {r(f"(count(*)-count({c}))*100.0/count(*)", 4)} as missing_pct from {table}"""


_CUSTOMER_SQL = "c as (select *, case when c_nationkey>4 then c_mktsegment end as c_latest from customer), f as (" + " union all ".join(
    _column_facts(c, kind, "c") for c, kind in _CUSTOMER.items() if c != "c_acctbal"
) + ")"


def _customers(t):
    return t.customer.withColumn("c_latest", F.expr("case when c_nationkey > 4 then c_mktsegment end"))


@query("a10_schema_profile", f"""with {_CUSTOMER_SQL} select *, case "column" when 'c_custkey' then 'Key of the customer'
 when 'c_latest' then 'Latitude coordinate' else 'No description available' end as description from f""")
def _(t):
    cols = [c for c in _CUSTOMER if c != "c_acctbal"]
    return P.schema_profile(_customers(t), cols, {"c_custkey": "Key of the customer"})


@query("a11_dataset_overview", """select (select count(*) from lineitem) as rows, dtype, cast(n as bigint) as columns from
 (values ('bigint',3),('int',1),('double',4),('string',2),('timestamp_ntz',1)) v(dtype,n)""")
def _(t):
    return P.dataset_overview(t.lineitem)


@query("a11_semantic_counts", f"with {_CUSTOMER_SQL} select semantic_type, count(*) as columns from (select semantic_type from f union all select 'Numeric') group by 1")
def _(t):
    return P.semantic_counts(_customers(t), list(_CUSTOMER))


@query("a12_categorical_summary", """with c as (select 'o_orderpriority' as "column", o_orderpriority as v, count(*) as n from orders group by 2
 union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by 2),
 k as (select *, row_number() over (partition by "column" order by n desc, v) as rn from c),
 tot as (select count(*) as rows from orders)
 select "column", count(*) as "unique", 0.0::double as missing_pct, max(case when rn=1 then v end) as top_category,
 max(case when rn=1 then n end) as top_count, %s as top_share,
 string_agg(v || ': ' || n, '; ' order by rn) filter (where rn<=5) as top_five from k, tot group by 1""" % r("max(case when rn=1 then n end)*1.0/max(rows)", 4))
def _(t):
    return P.categorical_summary(t.orders, ["o_orderpriority", "o_orderstatus"])


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query("a13_pearson_pairs", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a},{b}),6) as r from lineitem" for a, b in _PAIRS))
def _(t):
    return rounded(P.pearson_pairs(t.lineitem, LINE))


@query("a13_pearson_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a},{b}),6) as r from lineitem where l_returnflag='A'" for x in _PAIRS for a, b in (x, x[::-1])))
def _(t):
    return rounded(P.pearson_matrix(t.lineitem.where(F.col("l_returnflag") == "A"), LINE))


@query("a14_spearman", """with k as (select
 rank() over (order by p_size) + (count(*) over (partition by p_size) - 1)/2.0 as a,
 rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1)/2.0 as b from part)
 select 'p_size' as a, 'p_retailprice' as b, round(corr(k.a, k.b),6) as r from k""")
def _(t):
    return rounded(P.spearman_pairs(t.part, ["p_size", "p_retailprice"]))


_GAPS = {
    "quantity": ("l_returnflag = 'N'", "l_quantity"),
    "price": ("l_discount = 0.05", "l_extendedprice"),
    "discount": ("l_returnflag = 'N'", "l_discount"),
    "tax": ("l_linenumber > 4", "l_tax"),
    "line": ("false", "l_linenumber"),
}
_GAP_COLUMNS = ", ".join(f"case when {gap} then null else {c} end as {n}" for n, (gap, c) in _GAPS.items())


@query("a14_spearman_gaps", f"with g as (select {_GAP_COLUMNS} from lineitem) " + " union all ".join(f"""select '{a}' as a, '{b}' as b, round(corr(x, y), 6) as r from
 (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1)/2.0 as x,
 rank() over (order by {b}) + (count(*) over (partition by {b}) - 1)/2.0 as y from g where {a} is not null and {b} is not null)"""
 for i, a in enumerate(_GAPS) for b in list(_GAPS)[i + 1 :]))
def _(t):
    df = t.lineitem.selectExpr(*[f"case when {gap} then null else {c} end as {n}" for n, (gap, c) in _GAPS.items()])
    return rounded(P.spearman_pairs(df, list(_GAPS)))


@query("a15_high_corr_pairs", """select 'l_quantity' as a, 'double_qty' as b, 1.0::double as r, 1.0::double as abs_r union all
 select 'l_quantity','minus_qty',-1.0,1.0 union all select 'double_qty','minus_qty',-1.0,1.0""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_tax", (F.col("l_quantity") * 2).alias("double_qty"), (-F.col("l_quantity")).alias("minus_qty"))
    return rounded(P.high_corr_pairs(P.pearson_pairs(df, ["l_quantity", "l_tax", "double_qty", "minus_qty"]), 0.9))


@query("a16_corr_with", " union all ".join(f"select '{c}' as \"column\", round(corr({c}, l_extendedprice),6) as r from lineitem" for c in LINE if c != "l_extendedprice"))
def _(t):
    return rounded(P.corr_with(t.lineitem, LINE, "l_extendedprice"))


@query("a17_top_variance", " union all ".join(f"select '{c}' as \"column\", round(var_samp({c}),2) as variance from lineitem" for c in ("l_extendedprice", "l_quantity")))
def _(t):
    return rounded(P.top_variance(t.lineitem, LINE, 2), 2)


@query("a18_effect_size", " union all ".join(f"""select '{c}' as "column", round(abs(avg({c}) filter (where l_returnflag='R') - avg({c}) filter (where l_returnflag<>'R'))
 / (sqrt((var_samp({c}) filter (where l_returnflag='R') + var_samp({c}) filter (where l_returnflag<>'R'))/2)+1e-10),6) as cohens_d from lineitem""" for c in LINE))
def _(t):
    df = t.lineitem.withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(P.effect_size(df, LINE, "g"))


@query("a19_mann_whitney", """with k as (select l_returnflag='R' as g, count(*) over (partition by l_quantity) as same,
 rank() over (order by l_quantity) + (count(*) over (partition by l_quantity)-1)/2.0 as rk from lineitem),
 s as (select sum(rk) filter (not g) as r0, cast(count(*) filter (not g) as double) as n0, cast(count(*) filter (g) as double) as n1,
 cast(count(*) as double) as n, sum(same*same*1.0 - 1) as ties from k),
 z as (select r0 - n0*(n0+1)/2 as u, greatest(abs(r0 - n0*(n0+1)/2 - n0*n1/2) - 0.5, 0)/sqrt(n0*n1/12*(n+1 - ties/(n*(n-1))))/sqrt(2) as x from s)
 select 'l_quantity' as "column", round(u, 1) as u, round((select 1 - 2/sqrt(pi())*x/6000*sum(exp(-power(x*i/2000.0, 2)) *
 case when i in (0, 2000) then 1 when i%2=1 then 4 else 2 end) from range(2001) w(i)), 4) as p_value from z""")
def _(t):
    df = t.lineitem.withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return P.mann_whitney(df, ["l_quantity"], "g").select("column", F.round("u", 1).alias("u"), F.round("p_value", 4).alias("p_value"))


_PERIOD = """select {p} as period, count(*) as count, round(sum(o_totalprice),2) as total, round(avg(o_totalprice),2) as mean,
 {pct} as pct, round(quantile_cont(o_totalprice,0.5),2) as median from orders group by 1"""


@query("a20_counts_by_year", _PERIOD.format(p="cast(year(o_orderdate) as integer)", pct=r("count(*)*100.0/(select count(*) from orders)", 2)))
def _(t):
    return rounded(P.counts_by_period(t.orders, F.year("o_orderdate"), "o_totalprice"), 2)


@query("a20_counts_by_month", f"""select cast(month(o_orderdate) as integer) as period, count(*) as count, {r("count(*)*100.0/(select count(*) from orders)", 2)} as pct from orders group by 1""")
def _(t):
    return P.counts_by_period(t.orders, F.month("o_orderdate"))


@query("a20_counts_by_season", f"""select case when month(o_orderdate) in (12,1,2) then 'Winter' when month(o_orderdate)<=5 then 'Spring'
 when month(o_orderdate)<=8 then 'Summer' else 'Fall' end as period, count(*) as count, {r("count(*)*100.0/(select count(*) from orders)", 2)} as pct from orders group by 1""")
def _(t):
    from ..functions.timefn import season_name

    return P.counts_by_period(t.orders, season_name(F.month("o_orderdate")))


@query("a20_counts_by_weekday", f"""select dayname(o_orderdate) as period, count(*) as count, {r("count(*)*100.0/(select count(*) from orders)", 2)} as pct from orders group by 1""")
def _(t):
    from ..functions.timefn import day_name

    return P.counts_by_period(t.orders, day_name("o_orderdate"))


_MONTHS = list(range(1, 13))


@query("a21_pivot_counts", "select cast(year(o_orderdate) as integer) as year, " + ", ".join(f"count(*) filter (where month(o_orderdate)={m}) as \"{m}\"" for m in _MONTHS) + " from orders group by 1")
def _(t):
    df = t.orders.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return P.pivot_counts(df, "year", "month", _MONTHS)


@query("a22_duration_stats", """with x as (select date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as days from lineitem join orders on l_orderkey=o_orderkey)
 select round(avg(u),6) as mean, cast(max(u) as integer) as max, count(u) as with_duration, count(*) filter (where days is null) as missing,
 round(quantile_cont(u::double,0.5),6) as median, round(quantile_cont(u::double,0.9),6) as p90, round(quantile_cont(u::double,0.95),6) as p95
 from (select days, case when days between 0 and 3649 then days end as u from x)""")
def _(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderdate", "l_shipdate")
    return rounded(P.duration_stats(df, "o_orderdate", "l_shipdate"))


@query("a23_median_by_top_region", """with c as (select c_nationkey, count(*) as count, quantile_cont(c_acctbal,0.5) as m from customer group by 1)
 select c_nationkey, count, round(m,6) as median from c order by count desc, c_nationkey limit 20""")
def _(t):
    return rounded(P.median_by_top(t.customer, "c_nationkey", "c_acctbal", 20))


@query("a23_coordinate_stats", f"with {GRID_SQL} " + _each(("lat", "lon"), """select '{c}' as "column", round(avg({c}),6) as mean, round(quantile_cont({c},0.5),6) as median,
 round(stddev_samp({c}),6) as std, round(min({c}),6) as min, round(max({c}),6) as max, round(quantile_cont({c},0.25),6) as q1, round(quantile_cont({c},0.75),6) as q3, count({c}) as count from grid"""))
def _(t):
    return P.coordinate_stats(grid(t), ["lat", "lon"])


@query("a23_counts_by_region", f"""select n_name, count(*) as count, {r("count(*)*100.0/(select count(*) from customer)")} as pct from customer join nation on c_nationkey=n_nationkey group by 1""")
def _(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return P.value_counts(df, "n_name", digits=6)


_CUT = "case " + " ".join(
    f"when s>{a}{'' if b is None else f' and s<={b}'} then {i}" for i, (a, b) in enumerate(zip(P.SIZE_EDGES, (*P.SIZE_EDGES[1:], None)))
) + " end"


@query("a24_bin_counts", f"""with x as (select l_extendedprice/100 as s from lineitem), b as (select cast({_CUT} as integer) as bin from x)
 select bin, count(*) as count, list_extract({list(P.SIZE_LABELS)}, bin+1) as label, {r("count(*)*100.0/(select count(s) from x)", 1)} as pct from b where bin is not null group by bin""")
def _(t):
    return P.bin_counts(t.lineitem.select((F.col("l_extendedprice") / 100).alias("s")), "s")


@query("a24_percentile_list", " union all ".join(f"select cast({p} as integer) as percentile, round(quantile_cont(o_totalprice,{p / 100}),6) as value from orders" for p in P.SIZE_PERCENTILES))
def _(t):
    return rounded(P.percentile_list(t.orders, "o_totalprice"))


@query("a29_rate_by_month", f"""select cast(month(o_orderdate) as integer) as key, cast(sum(y) as bigint) as positives, count(*) as rows, {r("sum(y)*100.0/count(*)", 2)} as rate_pct
 from (select o_orderdate, cast(o_orderpriority='1-URGENT' as integer) as y from orders) group by 1""")
def _(t):
    df = t.orders.withColumn("y", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return P.rate_by(df, F.month("o_orderdate"), "y")


_FEATS = """feats as (select case when l_linenumber<=5 then l_tax end as f1, case when l_quantity>10 then l_discount end as f2,
 case when l_returnflag<>'N' then l_quantity end as f3, nullif(l_linestatus,'O') as f4, cast(l_returnflag='R' as integer) as y from lineitem)"""


def _feats(t):
    return t.lineitem.select(
        F.when(F.col("l_linenumber") <= 5, F.col("l_tax")).alias("f1"),
        F.when(F.col("l_quantity") > 10, F.col("l_discount")).alias("f2"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("f3"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("f4"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


_FS = ["f1", "f2", "f3", "f4"]


@query("a30_missing_by_class", f"with {_FEATS}, m as (" + " union all ".join(f"""select '{c}' as "column", {r(f"(count(*)-count({c}))*100.0/count(*)", 4)} as pct_all,
 {r(f"count(*) filter (where y=1 and {c} is null)*100.0/count(*) filter (where y=1)", 4)} as pct_pos,
 {r(f"count(*) filter (where y=0 and {c} is null)*100.0/count(*) filter (where y=0)", 4)} as pct_neg from feats""" for c in _FS) + ") select *, pct_neg > pct_pos + 10 as biased from m")
def _(t):
    return P.missing_by_class(_feats(t), _FS, "y")


@query("a31_completeness_histogram", f"""with {_FEATS}, k as (select y, cast((f1 is null)::int+(f2 is null)::int+(f3 is null)::int+(f4 is null)::int as integer) as missing from feats)
 select missing, count(*) as rows, count(*) filter (where y=1) as positives, count(*) filter (where y=0) as negatives,
 case when missing=0 then 'COMPLETE' when missing<=2 then 'GOOD' else 'POOR' end as band, missing<=2 as kept from k group by missing""")
def _(t):
    return P.completeness_histogram(_feats(t), _FS, "y")


@query("a34_fill_contamination", """select 'l_extendedprice' as "column", count(*) filter (where l_extendedprice>9000) as over_9000, count(*) filter (where l_extendedprice>=32000) as over_32000 from lineitem
 union all select 'l_quantity', count(*) filter (where l_quantity>9000), count(*) filter (where l_quantity>=32000) from lineitem""")
def _(t):
    return P.fill_contamination(t.lineitem, ["l_extendedprice", "l_quantity"])


@query("a35_grouped_mean_pivot", """select cast(year(o_orderdate) as integer) as year, round(avg(o_totalprice) filter (where o_orderstatus='F'),4) as F,
 round(avg(o_totalprice) filter (where o_orderstatus='O'),4) as O from orders group by 1""")
def _(t):
    return rounded(P.grouped_mean_pivot(t.orders.withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus", ["F", "O"], "o_totalprice"), 4)


@query("a39_histogram", """with b as (select l_returnflag, cast(least(floor((l_quantity-0)/5.0),9) as integer) as bin from lineitem where l_quantity between 0 and 50)
 select l_returnflag, bin, bin*5.0::double as "left", count(*) as count, round(count(*)/(sum(count(*)) over (partition by l_returnflag)*5.0),6) as density from b group by 1,2""")
def _(t):
    return rounded(P.histogram(t.lineitem, "l_quantity", 10, 0.0, 50.0, "l_returnflag"))


@query("a39_auto_histogram", """with p as (select quantile_cont(o_totalprice,0.01) as lo, quantile_cont(o_totalprice,0.99) as hi, cast(least(60, greatest(20, floor(power(count(*),0.4)))) as integer) as k from orders),
 b as (select cast(least(floor((o_totalprice-lo)/((hi-lo)/k)),k-1) as integer) as bin, lo, (hi-lo)/k as w from orders, p where o_totalprice between lo and hi)
 select bin, round(max(bin*w+lo),4) as "left", count(*) as count, round(count(*)/(sum(count(*)) over ()*max(w)),4) as density from b group by 1""")
def _(t):
    return rounded(P.auto_histogram(t.orders, "o_totalprice"), 4)


@query("a40_box_stats", """with q as (select l_returnflag, quantile_cont(l_extendedprice,0.25) as q1, quantile_cont(l_extendedprice,0.5) as median, quantile_cont(l_extendedprice,0.75) as q3 from lineitem group by 1),
 x as (select l_returnflag, l_extendedprice as v, q1, median, q3, l_extendedprice between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) as ok from lineitem join q using (l_returnflag))
 select l_returnflag, round(max(q1),4) as q1, round(max(median),4) as median, round(max(q3),4) as q3, min(v) filter (where ok) as whisker_low, max(v) filter (where ok) as whisker_high,
 count(*) filter (where not ok) as fliers from x group by 1""")
def _(t):
    return rounded(P.box_stats(t.lineitem, "l_extendedprice", "l_returnflag"), 4)


@query("a41_density_curve", """with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi, stddev_samp(o_totalprice) as sd, count(*) as n from orders),
 k as (select *, sd*power(n,-0.2) as h, (hi-lo)/4096 as w from s),
 b as (select cast(least(floor((o_totalprice-lo)/w),4095) as integer) as bin, count(*) as c from orders, k group by 1),
 g as (select i, i*((hi-lo)/299)+lo as x from k, range(300) t(i))
 select round(x,4) as x, round(1e9*sum(c*exp(power((x-((bin+0.5)*w+lo))/h,2)*-0.5))/(max(n)*max(h)*sqrt(2*pi())),2) as density_e9 from g, b, k group by x""")
def _(t):
    out = P.density_curve(t.orders, "o_totalprice")
    return out.select(F.round("x", 4).alias("x"), F.round(F.col("density") * 1e9, 2).alias("density_e9"))


@query("a42_split_stats", f"""with {POS_SQL}, x as (select *, case when year(date_utc)<=1998 then 'train' when year(date_utc)=1999 then 'val' else 'test' end as split, cast(o_totalprice>200000 as integer) as y from pos)
 select split, count(*) as rows, count(*) filter (where y=1) as positives, count(*) filter (where y=0) as negatives, {r("count(*) filter (where y=1)*100.0/count(*)", 2)} as positive_pct from x group by 1""")
def _(t):
    from ..operators.sampling import chronological_split

    df = chronological_split(pos(t), F.year("date_utc"), 1998, 1999).withColumn("y", (F.col("o_totalprice") > 200000).cast("int"))
    return P.split_stats(df, "split", "y")


@query("a42_column_stats_by_split", """with x as (select case when year(o_orderdate)<=1998 then 'train' when year(o_orderdate)=1999 then 'val' else 'test' end as split, o_totalprice from orders)
 select split, 'o_totalprice' as "column", count(*) filter (where o_totalprice is null) as nulls, min(o_totalprice) as min, max(o_totalprice) as max, round(avg(o_totalprice),4) as mean from x group by 1""")
def _(t):
    from ..operators.sampling import chronological_split

    df = chronological_split(t.orders, F.year("o_orderdate"), 1998, 1999)
    return rounded(P.column_stats_by(df, "split", ["o_totalprice"]), 4)


@query("a43_null_overview", f"""with {_SPARSE}, {_MISS} select count(*) filter (where missing>0) as columns_with_nulls, {r("avg(m)", 4)} as mean_missing_pct, max(m) as max_missing_pct from miss""")
def _(t):
    return P.null_overview(_sparse(t))


@query("a44_headline_stats", """select round(avg(o_totalprice),4) as mean_measure, cast(min(year(o_orderdate)) as integer) as first_year, cast(max(year(o_orderdate)) as integer) as last_year,
 (select cast(y as integer) from (select year(o_orderdate) as y, count(*) as n from orders group by 1) order by n desc, y limit 1) as peak_year,
 (select cast(y as integer) from (select month(o_orderdate) as y, count(*) as n from orders group by 1) order by n desc, y limit 1) as peak_month from orders""")
def _(t):
    return rounded(P.headline_stats(t.orders, "o_orderdate", "o_totalprice"), 4)


@query("j18_stats_merge", """select cast(year(l_shipdate) as integer) as period, count(*) as count, round(sum(l_extendedprice),2) as total, round(avg(l_extendedprice),2) as mean,
 %s as pct, round(quantile_cont(l_extendedprice,0.5),2) as median from lineitem group by 1""" % r("count(*)*100.0/(select count(*) from lineitem)", 2))
def _(t):
    return rounded(P.counts_by_period(t.lineitem, F.year("l_shipdate"), "l_extendedprice"), 2)


@query("p28_large_event_flag", "select cast(o_totalprice>=100000 as integer) as large, count(*) as n from orders group by 1")
def _(t):
    from ..functions.scalars import large_event_flag

    return t.orders.groupBy(large_event_flag("o_totalprice", 100000.0).alias("large")).agg(F.count(F.lit(1)).alias("n"))


@query("p29_useless_columns", """select 'c_custkey' as "column", 'all unique' as reason union all select 'c_name', 'all unique' union all select 'one','constant' union all select 'rare','mostly missing'""")
def _(t):
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.lit(1).alias("one"), F.when(F.pmod("c_custkey", F.lit(50)) == 0, F.col("c_custkey")).alias("rare"))
    return P.useless_columns(df)


@query("p30_semantic_type", """select 'p_partkey' as "column", 'Numeric' as semantic_type, count(distinct p_partkey) as "unique", count(p_partkey) as present from part union all
 select 'p_brand', case when count(distinct p_brand)*1.0/count(p_brand)>0.5 or count(distinct p_brand)>200 then 'Text' else 'Categorical' end, count(distinct p_brand), count(p_brand) from part union all
 select 'p_name', case when count(distinct p_name)*1.0/count(p_name)>0.5 or count(distinct p_name)>200 then 'Text' else 'Categorical' end, count(distinct p_name), count(p_name) from part""")
def _(t):
    return P.semantic_type(t.part, ["p_partkey", "p_brand", "p_name"])


@query("e_score_histogram", f"""with {SCORED_SQL}, b as (select label, cast(least(floor(score/0.0125),79) as integer) as bin from scored)
 select label, bin, round(bin*0.0125::double,6) as "left", count(*) as count, round(count(*)/(sum(count(*)) over (partition by label)*0.0125::double),6) as density from b group by 1,2""")
def _(t):
    return rounded(P.histogram(scored(t), "score", 80, 0.0, 1.0, "label"))
