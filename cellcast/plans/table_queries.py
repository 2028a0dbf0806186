"""Queries over sources, cleaning, joins, sets, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geo as G
from ..functions import scalars as S
from ..functions import timefn as TF
from ..functions import weather as WX
from ..operators import catalog as K
from ..operators import clean as CL
from ..operators import dataset as D
from ..operators import joins as J
from ..operators import spatial as SP
from ..operators import windows as W
from ..operators.ordered import top_n
from ..operators.profile import column_quality, missing_summary, pearson_pairs
from ..session import work_path
from ..sources import readers as RD
from ..sources import sinks as SK
from .proxies import GRID_SQL, PIXELS_SQL, POS_SQL, SITES_SQL, TEXAS_BOX, WEATHER_SQL, cell_px, grid, pixels, pos, sites, weather
from .registry import query, r, rounded

# ---------------------------------------------------------------- sources and sinks


def _place(t, name: str) -> str:
    return work_path(t.spark, name)


@query("s1_read_events", """select cast(year(o_orderdate) as integer) as source_year, count(*) as rows, count(case when year(o_orderdate)=1995 and o_orderkey%97=0 then 1 when year(o_orderdate)=1997 and o_orderkey%89=0 then 1 end) as corrupt,
 cast(sum(o_orderkey) as bigint) as keys, count(case when year(o_orderdate)<>1996 then o_orderstatus end) as states, count(case when year(o_orderdate)=1996 then 1 end) as news, count(*) as dated, false as missing
 from orders where year(o_orderdate) between 1995 and 1997 group by 1 union all select 1990, 0, 0, 0, 0, 0, 0, true""")
def _(t):
    base, key, price = _place(t, "yearly"), F.col("o_orderkey"), F.col("o_totalprice")
    # the last field of a broken line holds a bare comma: one field too many
    status = lambda n: F.when(key % n == 0, F.concat("o_orderstatus", F.lit(",x"))).otherwise(F.col("o_orderstatus"))
    layouts = {
        1995: [key.alias("fod_id"), price.alias("FIRE_SIZE"), status(97).alias("State")],
        1996: [F.lit(1996).alias("FIRE_YEAR"), price.alias("fire_size"), key.alias("FOD_ID"), F.col("o_orderpriority").alias("NEW")],
        1997: [price.alias("FIRE_SIZE"), key.alias("FOD_ID"), status(89).alias("STATE")],
    }
    for year, columns in layouts.items():
        rows = t.orders.where(F.year("o_orderdate") == year).select(*columns)
        rows.write.option("quote", "").csv(f"{base}/{year}_FPA_FOD_cons.csv", header=True)
    events, absent = RD.read_events(t.spark, base, years=[1990, 1995, 1996, 1997])
    found = events.groupBy("source_year").agg(
        F.count(F.lit(1)).alias("rows"), F.count("corrupt_line").alias("corrupt"), F.sum(F.col("FOD_ID").cast("long")).alias("keys"),
        F.count("STATE").alias("states"), F.count("NEW").alias("news"), F.count(F.when(F.col("FIRE_YEAR") == F.col("source_year"), 1)).alias("dated"),
        F.lit(False).alias("missing"),
    )
    gaps = t.spark.range(len(absent)).select(F.element_at(F.array(*map(F.lit, absent)), F.col("id").cast("int") + 1).alias("source_year"))
    zero = F.lit(0).cast("long")
    return found.unionByName(gaps.select("source_year", *[zero.alias(c) for c in found.columns[1:-1]], F.lit(True).alias("missing")))


@query("s2_read_table", "select l_returnflag, count(*) as n from lineitem group by 1")
def _(t):
    return RD.read_table(t.spark, f"{t.folder}/lineitem.parquet").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("s3_write_table", "select cast(year(o_orderdate) as integer) as year, count(*) as n, round(sum(o_totalprice),2) as total from orders where year(o_orderdate) between 1996 and 1997 group by 1")
def _(t):
    path = _place(t, "orders")
    SK.write_table(t.orders.withColumn("year", F.year("o_orderdate")), path, ["year"], ["o_orderdate"])
    back = t.spark.read.parquet(path).where(F.col("year").between(1996, 1997))
    return rounded(back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("s4_read_points", f"with {GRID_SQL} select cell, lat, lon, date '2024-03-05' + cast(idx%20 as integer) as acq_date, 1 as \"Fire\" from grid where idx%7<>0")
def _(t):
    return RD.clean_points(_raw_points(t), "lat", "lon", "acq_date", 2024)


@query("s4_read_points_file", f"with {GRID_SQL} select cast(cell as varchar) as cell, lat, lon, date '2024-03-05' + cast(idx%20 as integer) as acq_date, 1 as \"Fire\" from grid where idx%7<>0")
def _(t):
    path = _place(t, "points")
    _raw_points(t).write.csv(path, header=True)
    return RD.read_points(t.spark, path, 2024, "lat", "lon", "acq_date")


def _raw_points(t):
    return grid(t).select(
        "cell",
        F.when(F.pmod("idx", F.lit(7)) != 0, F.col("lat").cast("string")).otherwise("n/a").alias("lat"),
        F.col("lon").cast("string").alias("lon"),
        F.date_add(F.lit("2024-03-05").cast("date"), F.pmod("idx", F.lit(20)).cast("int")).cast("string").alias("acq_date"),
    )


_RAW_SQL = f"""{WEATHER_SQL}, raw as (select 'erc' as var, d as date, px, cast(case when floor(erc)=17 then 32767 else floor(erc*10) end as integer) as raw from weather
 union all select 'tmmx', d, px, cast(floor(tmmx/4) as integer) from weather)"""


def _raw_grid(t):
    w = weather(t)
    erc = F.when(F.floor("erc") == 17, 32767).otherwise(F.floor(F.col("erc") * 10)).cast("int")
    both = F.array(
        F.struct(F.lit("erc").alias("var"), erc.alias("raw")),
        F.struct(F.lit("tmmx").alias("var"), F.floor(F.col("tmmx") / 4).cast("int").alias("raw")),
    )
    return w.select(F.col("d").alias("date"), "px", F.explode(both).alias("m")).select("m.var", "date", "px", "m.raw")


@query("s5_read_grid_long", f"with {_RAW_SQL} select var, cast(month(date) as integer) as month, count(*) as n, cast(sum(raw) as bigint) as total from raw where var='erc' and date between date '1997-01-01' and date '1997-12-31' group by 1,2")
def _(t):
    path = _place(t, "weather")
    _raw_grid(t).withColumn("year", F.year("date")).write.partitionBy("var", "year").parquet(path)
    df = RD.read_grid_long(t.spark, path, ["erc"], "1997-01-01", "1997-12-31")
    return df.groupBy("var", F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total"))


@query("s6_mosaic_pixels", """with x as (select 'NDVI' as layer, l_returnflag as tile, cast(l_suppkey as integer) as "row", l_linenumber as col, l_quantity as value from lineitem),
 k as (select *, row_number() over (partition by layer, "row", col order by tile, value) as rn from x) select layer, "row", col, value from k where rn=1""")
def _(t):
    tiles = t.lineitem.select(
        F.lit("NDVI").alias("layer"), F.col("l_returnflag").alias("tile"), F.lit(0).alias("row_off"), F.lit(0).alias("col_off"),
        F.col("l_suppkey").cast("int").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value"),
    )
    return RD.mosaic_pixels(tiles)


@query("s7_write_report", "select p_brand, count(*) as n from part group by 1")
def _(t):
    base = _place(t, "report")
    SK.write_report({"brands": t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))}, base, "json")
    return t.spark.read.schema("p_brand string, n long").json(f"{base}/brands")


@query("s9_preview", "select least(10000, count(*)) as n from lineitem")
def _(t):
    return SK.preview(t.lineitem).agg(F.count(F.lit(1)).alias("n"))


@query("s10_daily_scalar", "with m as (select cast(o_orderdate as date) as date, max(o_totalprice) as pdsi from orders group by 1) select cast(l_shipdate as date) as date, count(*) as n, max(pdsi) as pdsi from lineitem left join m on m.date=cast(l_shipdate as date) group by 1")
def _(t):
    daily = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("pdsi"))
    rows = J.date_join(t.lineitem.select(F.col("l_shipdate").cast("date").alias("date")), daily)
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.max("pdsi").alias("pdsi"))


@query("s10_read_daily_scalar", "select cast(o_orderdate as date) as date, nullif(max(o_totalprice), min(o_totalprice)) as value from orders group by 1")
def _(t):
    path = _place(t, "daily")
    span = F.when(F.max("o_totalprice") != F.min("o_totalprice"), F.max("o_totalprice").cast("string")).otherwise("n/a")
    t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(span.alias("value")).write.csv(path, header=True)
    return RD.read_daily_scalar(t.spark, path)


# ---------------------------------------------------------------- schema and cleaning


@query("p1_canonical_columns", 'select c_custkey as "FOD_ID", c_mktsegment as "STATE", c_acctbal as "FIRE_SIZE", c_name as other from customer')
def _(t):
    df = t.customer.select(F.col("c_custkey").alias("fod_id"), F.col("c_mktsegment").alias("State"), F.col("c_acctbal").alias("Fire_Size"), F.col("c_name").alias("other"))
    return CL.canonical_columns(df)


@query("p2_schema_report", """with y as (select year(o_orderdate) as source, count(*) as rows, count(nullif(o_orderstatus,'P')) as status from orders where year(o_orderdate) in (1995,1996,1997) group by 1),
 m as (select source::varchar as source, 'key' as "column", 'bigint' as dtype, rows, rows as present from y union all select source::varchar, 'price', case when source=1997 then 'string' else 'double' end, rows, rows from y union all select source::varchar, 'status', 'string', rows, status from y where source=1996)
 select "column", string_agg(source, ',' order by source) as present_in, coalesce((select string_agg(z.source::varchar, ',' order by z.source) from y z where z.source::varchar not in (select k.source from m k where k."column"=m."column")),'') as missing_in,
 array_to_string(list_sort(list(distinct dtype)), ',') as dtypes, count(distinct dtype)>1 as dtype_mismatch, count(*)=3 as in_all, cast(sum(rows) as bigint) as rows, cast(sum(present) as bigint) as present from m group by 1""")
def _(t):
    key, price = F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")
    year = lambda y: t.orders.where(F.year("o_orderdate") == y)
    frames = {
        "1995": year(1995).select(key, price),
        "1996": year(1996).select(key, price, F.nullif("o_orderstatus", F.lit("P")).alias("status")),
        "1997": year(1997).select(key, price.cast("string").alias("price")),
    }
    return CL.schema_report(t.spark, frames)


@query("p3_resolve_column", "select o_orderkey, o_totalprice as size from orders")
def _(t):
    size = CL.resolve_column(t.orders, ["FIRE_SIZE", "Fire_Size", "o_totalprice"])
    return t.orders.select("o_orderkey", F.col(size).alias("size"))


@query("p4_filter_partition", "select c_custkey, c_mktsegment from customer where upper(trim(c_mktsegment))='BUILDING'")
def _(t):
    return CL.filter_partition(t.customer.select("c_custkey", F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("c_mktsegment")), "c_mktsegment", "BUILDING").select(
        "c_custkey", F.upper(F.trim("c_mktsegment")).alias("c_mktsegment")
    )


@query("p5_filter_events", f"with {POS_SQL} select o_orderkey from pos where o_totalprice>=100000 and year(date_utc) between 1996 and 1999 and window_hour<>18")
def _(t):
    df = pos(t).withColumn("year", F.year("date_utc")).withColumn("lat", F.when(F.col("window_hour") != 18, F.col("cell")))
    return CL.filter_events(df, "o_totalprice", "year", "lat", "cell", 100000.0, (1996, 1999)).select("o_orderkey")


@query("p6_to_number", "select c_custkey, case when c_custkey%3=0 then null else c_acctbal end as v from customer")
def _(t):
    text = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.concat(F.lit("x"), F.col("c_acctbal"))).otherwise(F.col("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", S.to_number(text).alias("v"))


@query("p7_to_date", "select o_orderkey, case when o_orderkey%5=0 then null else cast(o_orderdate as date) end as d from orders")
def _(t):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    us = F.date_format("o_orderdate", "MM/dd/yyyy")
    text = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "soon").when(F.pmod("o_orderkey", F.lit(2)) == 0, us).otherwise(iso)
    return t.orders.select("o_orderkey", S.to_date(text, ("yyyy-MM-dd", "MM/dd/yyyy")).alias("d"))


def _rules(t):
    return {
        "balance": CL.number_rule("c_acctbal", 0.0, 9000.0),
        "segment": CL.equals_rule("c_mktsegment", "BUILDING"),
        "nation": CL.member_rule("c_nationkey", list(range(0, 20))),
        "phone": CL.null_rule("maybe"),
    }


_RULES = {
    "balance": "c_acctbal<0 or c_acctbal>9000",
    "segment": "upper(trim(c_mktsegment))<>'BUILDING'",
    "nation": "c_nationkey>=20",
    "phone": "c_custkey<100",
}


def _ruled(t):
    return t.customer.withColumn("maybe", F.when(F.col("c_custkey") >= 100, F.col("c_name")))


@query("p8_validate", " union all ".join(f"select '{n}' as rule, count(*) filter (where {c}) as invalid, {r(f'count(*) filter (where {c})*100.0/count(*)', 4)} as pct from customer" for n, c in _RULES.items()))
def _(t):
    return CL.validation_summary(_ruled(t), _rules(t))


@query("p8_violation_samples", "select rule, row_id from (" + " union all ".join(f"select '{n}' as rule, c_custkey as row_id, row_number() over (order by c_custkey) as rn from customer where {c}" for n, c in _RULES.items()) + ") where rn<=50")
def _(t):
    return CL.violation_samples(_ruled(t), _rules(t), "c_custkey").select("rule", "row_id")


_QF = f"""{GRID_SQL}, q as (select idx, round(lat,0) as lat, round(lon,0) as lon, cast(region%2 as integer) as y, case when idx%4<>0 then c_acctbal end as f1,
 case when idx%6<>0 then c_acctbal end as f2, case when idx%12<>0 then c_acctbal end as f3 from grid)"""


def _qf(t):
    def f(m):
        return F.when(F.pmod("idx", F.lit(m)) != 0, F.col("c_acctbal"))

    return grid(t).select(
        "idx", F.rint("lat").alias("lat"), F.rint("lon").alias("lon"), F.pmod("region", F.lit(2)).cast("int").alias("y"),
        f(4).alias("f1"), f(6).alias("f2"), f(12).alias("f3"),
    )


for _strict, _limit in ((False, 2), (True, 1)):

    @query(
        "p9_quality_filter" + ("_strict" if _strict else ""),
        f"""with {_QF.replace("round(lat,0)", "round_even(lat,0)").replace("round(lon,0)", "round_even(lon,0)")}, k as (select *, row_number() over (partition by lat, lon, y order by idx) as rn from q
 where (f1 is null)::int+(f2 is null)::int+(f3 is null)::int<={_limit} and lat between 25 and 37 and lon between -107.5 and -92.5) select idx, lat, lon, y from k where rn=1""",
    )
    def _(t, strict=_strict):
        return CL.quality_filter(_qf(t), ["f1", "f2", "f3"], "lat", "lon", "y", ["idx"], strict).select("idx", "lat", "lon", "y")


@query("p10_forbid_columns", "select o_orderkey, o_orderdate from orders")
def _(t):
    df = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.col("o_totalprice").alias("FIRE_SIZE"), F.col("o_orderstatus").alias("CONT_DATE"))
    return CL.forbid_columns(df)[0]


@query("p11_drop_redundant", f"with {WEATHER_SQL} select px, d, round(erc,6) as erc from weather")
def _(t):
    return rounded(CL.drop_redundant(weather(t).select("px", "d", "erc", F.col("vs").alias("bi"), F.col("tmmx").alias("tmmn"))))


@query("p12_select_features", "select p_partkey, p_size, p_retailprice from part")
def _(t):
    return CL.select_features(t.part, ["p_size", "p_retailprice", "absent"], ["p_partkey"])[0]


@query("p13_enforce_schema", "select p_size, p_partkey, p_brand from part")
def _(t):
    return CL.enforce_schema(t.part.select("p_partkey", "p_brand", "p_size"), ["p_size", "gone", "p_partkey"])


@query("p14_fill_policy", "select c_custkey, case when c_acctbal<0 then 0 else c_acctbal end as burn, cast(case when c_nationkey<5 then -1 else c_nationkey end as integer) as cover, case when c_custkey%2=0 then 0.0::double else c_acctbal end as num from customer")
def _(t):
    df = t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("burn"),
        F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("cover"),
        F.when(F.pmod("c_custkey", F.lit(2)) == 0, "bad").otherwise(F.col("c_acctbal").cast("string")).alias("num"),
    )
    return CL.fill_policy(df, ["burn"], ["cover"], ["num"])


@query("p15_missing_flag", "select cast(l_linenumber>5 as integer) as gone, count(*) as n from lineitem group by 1")
def _(t):
    df = t.lineitem.select(F.when(F.col("l_linenumber") <= 5, F.col("l_tax")).alias("x"))
    return df.groupBy(S.missing_flag("x").alias("gone")).agg(F.count(F.lit(1)).alias("n"))


@query("p16_availability_flag", "select c_custkey, case when c_custkey%3=0 then 0 else 1 end as available, case when c_custkey%3=0 then 0.0::double else c_acctbal end as hpbl from customer")
def _(t):
    df = t.customer.select("c_custkey", F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.col("c_acctbal")).alias("hpbl"))
    return CL.availability_flag(df, "hpbl", ["hpbl"], "available")


@query("p16_availability_training", "select c_custkey, c_acctbal as hpbl from customer where c_custkey%3<>0")
def _(t):
    df = t.customer.select("c_custkey", F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.col("c_acctbal")).alias("hpbl"))
    return CL.availability_flag(df, "hpbl", ["hpbl"], "available", training=True)


_DECODED_SQL = f"""{_RAW_SQL}, decoded as (select var, date, px, case when raw<>32767 and raw*(case var when 'erc' then 0.1 else 0.5 end)::double<=9000 then raw*(case var when 'erc' then 0.1 else 0.5 end)::double end as value from raw)"""


def _decoded(t):
    scale = F.when(F.col("var") == "erc", 0.1).otherwise(0.5)
    return _raw_grid(t).withColumn("value", WX.decode_grid("raw", F.lit(32767), scale, F.lit(0.0))).drop("raw")


@query("p17_decode_grid", f"with {_DECODED_SQL} select var, px, count(*) as n, count(value) as present, round(sum(value),3) as total from decoded group by 1,2")
def _(t):
    out = _decoded(t).groupBy("var", "px").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.sum("value").alias("total"))
    return rounded(out, 3)


@query("p18_kelvin_to_c", f"""with {_DECODED_SQL}, m as (select var, date, avg(value) as mu from decoded group by 1,2)
 select var, date, count(value) as n, round(sum(case when var='tmmx' and mu>6000 then value-273.15 else value end),3) as total from decoded join m using (var,date) group by 1,2""")
def _(t):
    out = W.kelvin_to_c(_decoded(t), limit=6000.0)
    return rounded(out.groupBy("var", "date").agg(F.count("value").alias("n"), F.sum("value").alias("total")), 3)


@query("p19_physical_scale", """select layer, count(*) as n, round(sum(case when layer='NDVI' then case when abs(v)>2 then v*0.0001 else v end
 when layer='LST' then case when v>1000 then v*0.02-273.15 when v>150 then v-273.15 else v end when layer='Temperature' then case when v>150 then v-273.15 else v end else v end),2) as total
 from (select case l_linenumber%4 when 0 then 'NDVI' when 1 then 'LST' when 2 then 'Temperature' else 'Wind' end as layer, l_extendedprice/10 as v from lineitem) group by 1""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("NDVI", "LST", "Temperature", "Wind")])
    df = t.lineitem.select(F.element_at(names, F.pmod("l_linenumber", F.lit(4)) + 1).alias("layer"), (F.col("l_extendedprice") / 10).alias("v"))
    return rounded(df.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(WX.physical_scale("layer", "v")).alias("total")), 2)


RING = [(-106.0, 26.0), (-94.0, 26.5), (-97.0, 31.0), (-94.5, 36.0), (-105.5, 35.5), (-101.0, 30.0)]


def _ring_sql(lat, lon):
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]):
        parts.append(f"((({y1}>{lat}) <> ({y2}>{lat})) and {lon} < ({lat}-({y1}))*({(x2 - x1) / (y2 - y1)!r}::double)+({x1}))::int")
    return "(" + "+".join(parts) + ")%2=1"


@query("p20_in_polygon", f"with {GRID_SQL} select cell, lat, lon from grid where {_ring_sql('lat', 'lon')}")
def _(t):
    return grid(t).where(G.in_polygon("lat", "lon", RING)).select("cell", "lat", "lon")


@query("p20_in_bbox", f"with {GRID_SQL} select cell from grid where lat between 27 and 33 and lon between -104 and -97")
def _(t):
    return grid(t).where(G.in_bbox("lat", "lon", 27, 33, -104, -97)).select("cell")


_WORDS = [("STEEL", "metal"), ("BRASS", "metal"), ("STANDARD", "plain"), ("TIN", "soft"), ("COPPER", "metal"), ("ECONOMY", "cheap")]


@query("p23_keyword_first", "select category, count(*) as n from (select case " + " ".join(f"when lower(p_type) like '%{w.lower()}%' then '{c}'" for w, c in _WORDS) + " else 'UNKNOWN' end as category from part) group by 1")
def _(t):
    return K.keyword_classify(t.part, "p_type", _WORDS).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("p23_keyword_longest", "select category, count(*) as n from (select case " + " ".join(f"when lower(p_type) like '%{w.lower()}%' then '{c}'" for w, c in sorted(_WORDS, key=lambda x: -len(x[0]))) + " else 'UNKNOWN' end as category from part) group by 1")
def _(t):
    return K.keyword_classify(t.part, "p_type", _WORDS, "longest").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("p23_keyword_priority", "select category, count(*) as n from (select case " + " ".join(f"when lower(p_type) like '%{w.lower()}%' then '{c}'" for p in ("cheap", "soft", "plain", "metal") for w, c in _WORDS if c == p) + " else 'UNKNOWN' end as category from part) group by 1")
def _(t):
    out = K.keyword_classify(t.part, "p_type", _WORDS, "priority", priority=("cheap", "soft", "plain", "metal"))
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("p23_keyword_table", """with w as (select n_nationkey as rule_no, lower(substr(n_name,1,3+n_nationkey%2)) as keyword, n_name as category from nation),
 h as (select d.doc_id, arg_min(w.category, w.rule_no) as category from documents d join w on contains(lower(d.text), w.keyword) group by 1)
 select d.doc_id, coalesce(h.category,'none') as category from documents d left join h using (doc_id)""")
def _(t):
    keyword = F.lower(F.substring("n_name", F.lit(1), 3 + F.pmod("n_nationkey", F.lit(2)).cast("int")))
    rules = t.nation.select(F.col("n_nationkey").alias("rule_no"), keyword.alias("keyword"), F.col("n_name").alias("category"))
    return K.keyword_classify_table(t.documents.select("doc_id", "text"), "text", rules, default="none").select("doc_id", "category")


@query("p31_contains_ci", "select count(*) as n from part where contains(lower(p_type),'brass')")
def _(t):
    return t.part.where(S.contains_ci("p_type", "Brass")).agg(F.count(F.lit(1)).alias("n"))


# column names as they occur in event tables, attached to real profile rows below
_NAMES = ("FIRE_SIZE", "CONT_DATE", "tmmx", "Slope_1km", "road_US_dis", "FIRE_CODE", "SOURCE_SYSTEM", "erc", "vpd_station", "far_dis", "MTBS_ID")
_FREQ = ("Event-based", "Daily", "Static (5 years)", "Monthly", "Post-fire", "Annual")


def _catalog(t):
    """One row per supplier: a column name and its measured missing share and cardinality."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    freq = F.array(*[F.lit(f) for f in _FREQ])
    base = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.element_at(names, (F.pmod("s_suppkey", F.lit(len(_NAMES))) + 1).cast("int")).alias("column"),
        F.element_at(freq, (F.pmod("s_suppkey", F.lit(len(_FREQ))) + 1).cast("int")).alias("frequency"),
    )
    late = F.count(F.when(F.pmod("l_orderkey", F.lit(100)) < F.pmod(F.col("l_suppkey") * 37, F.lit(101)), 1))
    stats = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(
        F.round(late * 100.0 / F.count(F.lit(1)), 4).alias("missing_pct"), F.countDistinct("l_linenumber").alias("unique")
    )
    return base.join(stats, "id")


_CATALOG_SQL = f"""cat as (select s_suppkey as id, list_extract({list(_NAMES)}, cast(s_suppkey%{len(_NAMES)}+1 as integer)) as col, list_extract({list(_FREQ)}, cast(s_suppkey%{len(_FREQ)}+1 as integer)) as frequency, missing_pct, uniq from supplier join
 (select l_suppkey, {r("count(*) filter (where l_orderkey%100 < (l_suppkey*37)%101)*100.0/count(*)", 4)} as missing_pct, count(distinct l_linenumber) as uniq from lineitem group by 1) on l_suppkey=s_suppkey)"""
_LEAK_SQL = "case when col in ('FIRE_SIZE','CONT_DATE','MTBS_ID') then 'Definite Leakage' when col='FIRE_CODE' then 'Possible Leakage' else 'Definitely Safe' end"


@query("p24_leakage_readiness", f"""with {_CATALOG_SQL}, l as (select *, {_LEAK_SQL} as leakage from cat) select id, leakage, case when col='SOURCE_SYSTEM' then 'Administrative'
 when leakage='Definite Leakage' then 'Likely Remove' when missing_pct>=75 then 'Review Later' when uniq<=1 then 'Likely Remove' when leakage='Possible Leakage' then 'Review Later'
 when col in ('Slope_1km','road_US_dis','erc') then 'Candidate Feature' else 'Review Later' end as readiness from l""")
def _(t):
    df = _catalog(t).withColumn("leakage", K.leakage_class(F.col("column")))
    ready = K.readiness_class(F.col("column"), F.col("leakage"), F.col("missing_pct"), F.col("unique") <= 1, F.col("unique"))
    return df.select("id", "leakage", ready.alias("readiness"))


@query("p25_missing_root_cause", f"""with {_CATALOG_SQL}, c as (select *, case when col in ('CONT_DATE','MTBS_ID') then 'event_conditional' when col='road_US_dis' then 'geographic_coverage' when col='FIRE_CODE' then 'administrative'
 when col in ('tmmx','vpd_station') and missing_pct>5 and missing_pct<60 then 'sensor_gap' when missing_pct>85 and (contains(lower(col),'_dis') or contains(lower(col),'station')) then 'geographic_coverage'
 when missing_pct>95 then 'event_conditional' else 'unknown' end as cause from cat) select id, cause, case when cause='event_conditional' and contains(lower(col),'mtbs') then 'EXCLUDE' when cause='event_conditional' then 'BINARY_FLAG'
 when cause='geographic_coverage' then 'SENTINEL_999' when cause='administrative' then 'EXCLUDE' when cause='sensor_gap' then 'GRIDMET_FALLBACK' else 'REVIEW' end as action from c""")
def _(t):
    df = _catalog(t).withColumn("cause", K.missing_root_cause(F.col("column"), F.col("missing_pct")))
    return df.select("id", "cause", K.missing_action(F.col("column"), F.col("cause")).alias("action"))


_UPDATE_RULES = {"STATIC": ("slope", "road_"), "DAILY": ("erc", "tmmx", "vpd"), "MONTHLY": ("pdsi",)}
_AVAIL_SQL = f"""{_CATALOG_SQL}, av as (select *, case when {_LEAK_SQL}='Definite Leakage' then 'POST_FIRE_ONLY' when col='far_dis' then 'EXCLUDE' when col='SOURCE_SYSTEM' then 'ADMIN_ONLY' when col='Slope_1km' then 'PRE_FIRE_STATIC'
 when contains(lower(frequency),'daily') or contains(lower(frequency),'monthly') then 'PRE_FIRE_DYNAMIC' when contains(lower(frequency),'annual') or contains(lower(frequency),'5 years') then 'PRE_FIRE_STATIC'
 when contains(lower(frequency),'post-fire') then 'POST_FIRE_ONLY' else 'PRE_FIRE_DYNAMIC' end as availability from cat)"""


def _available(t):
    df = _catalog(t).withColumn("leakage", K.leakage_class(F.col("column")))
    label = K.availability_class(F.col("column"), F.col("leakage"), F.col("frequency"), ("far_dis",), ("SOURCE_SYSTEM",), {"PRE_FIRE_STATIC": ("Slope_1km",)})
    return df.withColumn("availability", label)


@query("p26_availability_update", f"""with {_AVAIL_SQL} select id, availability, case when availability in ('POST_FIRE_ONLY','EXCLUDE','ADMIN_ONLY') then 'EVENT_BASED' when col in ('erc','tmmx','vpd_station') then 'DAILY'
 when col in ('Slope_1km','road_US_dis') then 'STATIC' when frequency='Daily' then 'DAILY' when frequency='Monthly' then 'MONTHLY' when frequency in ('Annual','Static (5 years)') then 'ANNUAL' when frequency in ('Event-based','Post-fire') then 'EVENT_BASED' else 'DAILY' end as update_category from av""")
def _(t):
    df = _available(t)
    return df.select("id", "availability", K.update_category(F.col("column"), F.col("frequency"), F.col("availability"), _UPDATE_RULES).alias("update_category"))


@query("p21_gate_feasibility", f"""with {_AVAIL_SQL} select id, case when availability='POST_FIRE_ONLY' then 'POST_FIRE' when availability='EXCLUDE' then 'EXCLUDE' when availability='ADMIN_ONLY' then 'ADMIN' when col='erc' then 'CORRUPTED (list)' when uniq<=1 then 'CONSTANT' end as gate1_reason,
 case when availability in ('POST_FIRE_ONLY','EXCLUDE','ADMIN_ONLY') or col='erc' or uniq<=1 then 'REMOVED' else 'RETAINED' end as gate1 from av""")
def _(t):
    df = _available(t).withColumn("is_constant", F.col("unique") <= 1)
    return K.gate_feasibility(df, lists={"CORRUPTED": ("erc",)}).select("id", "gate1_reason", "gate1")


@query("p22_gate_redundancy", """with c as (select abs(corr(l_quantity*2, -l_quantity)) as dm, abs(corr(l_quantity*2, l_tax)) as dt, abs(corr(-l_quantity, l_tax)) as mt from lineitem)
 select 'l_quantity' as "column", cast(null as varchar) as reason union all select 'l_extendedprice', 'same as l_quantity'
 union all select 'double_qty', case when dm>=0.99 then 'correlated with minus_qt' when dt>=0.99 then 'correlated with l_tax' end from c
 union all select 'minus_qt', case when dm<0.99 and mt>=0.99 then 'correlated with l_tax' end from c union all select 'l_tax', null""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_tax", "l_extendedprice", (F.col("l_quantity") * 2).alias("double_qty"), (-F.col("l_quantity")).alias("minus_qt"))
    pairs = pearson_pairs(df, ["double_qty", "minus_qt", "l_tax"])
    names = t.spark.createDataFrame([(c,) for c in df.columns], "column string")
    listed = t.spark.createDataFrame([("l_extendedprice", "same as l_quantity")], "column string, reason string")
    return K.gate_redundancy(names, pairs, listed=listed)


@query("p27_schema_fix", """select c_custkey as id, 'customer' as origin from customer where c_custkey<>3 and c_custkey<>7 union all select s_suppkey+1400, 'supplier' from supplier where s_suppkey+1400 not in (select c_custkey from customer where c_custkey not in (3,7))""")
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    add = t.supplier.select((F.col("s_suppkey") + 1400).alias("id"), F.lit("supplier").alias("origin"))
    return K.apply_schema_fix(base, [3, 7], add, "id")


@query("j13_assemble_catalog", " union all ".join(f"""select '{c}' as "column", {m} as missing_pct, {u} as "unique", 'none' as cause from part""" for c, m, u in (
    ("p_partkey", "0.0::double", "count(distinct p_partkey)"), ("p_size", "0.0::double", "count(distinct p_size)"), ("p_brand", "0.0::double", "count(distinct p_brand)"))))
def _(t):
    cols = ["p_partkey", "p_size", "p_brand"]
    df = t.part.select(*cols)
    miss = missing_summary(df)
    cause = miss.where(F.col("missing") > 0).select("column", K.missing_root_cause(F.col("column"), F.col("missing_pct")).alias("cause"))
    base = miss.select("column")
    return K.assemble_catalog(base, [(miss, {"missing_pct": 0.0}), (column_quality(df).select("column", "unique"), {"unique": 0}), (cause, {"cause": "none"})])


# ---------------------------------------------------------------- joins

_S_SQL = "(select count(*) from supplier)"


@query("j1_join_static", f"with {POS_SQL}, {GRID_SQL} select p.o_orderkey, p.cell, g.region, round(g.lat,6) as lat from pos p left join grid g on g.cell=p.cell and g.c_acctbal>0")
def _(t):
    static = grid(t).where(F.col("c_acctbal") > 0).select("cell", "region", "lat")
    return rounded(J.join_static(pos(t), static).select("o_orderkey", "cell", "region", "lat"))


@query("j2_join_weather", f"with {POS_SQL}, {WEATHER_SQL} select o_orderkey, round(erc,6) as erc from pos left join weather on px=cell%{_S_SQL} and d=date_utc")
def _(t):
    w = weather(t).select(F.col("px"), F.col("d").alias("date_utc"), "erc")
    return rounded(J.join_weather(pos(t).withColumn("px", cell_px(t)), w, ("px", "date_utc")).select("o_orderkey", "erc"))


@query("j3_map_lookup", f"with {POS_SQL}, {GRID_SQL} select cell, coalesce(n,0) as event_count from grid left join (select cell, count(*) as n from pos group by 1) using (cell)")
def _(t):
    counts = pos(t).groupBy("cell").agg(F.count(F.lit(1)).alias("event_count"))
    return J.map_lookup(grid(t).select("cell"), counts, "cell", "event_count")


@query("j4_nearest_join", f"""with {GRID_SQL}, {SITES_SQL}, k as (select cell, sid, sqrt((lat-slat)*(lat-slat)+(lon-slon)*(lon-slon)) as dist, row_number() over (partition by cell order by (lat-slat)*(lat-slat)+(lon-slon)*(lon-slon), sid) as rn from grid, sites)
 select cell, sid as site_id, round(dist,6) as distance from k where rn=1""")
def _(t):
    return rounded(SP.nearest_join(grid(t), sites(t), "lat", "lon", "slat", "slon", "sid").select("cell", "site_id", "distance"))


_HAV = "2*6371*asin(sqrt(power(sin(radians(slat-lat)/2),2)+cos(radians(lat))*cos(radians(slat))*power(sin(radians(slon-lon)/2),2)))"


@query("j5_grid_snap_join", f"""with {GRID_SQL}, {PIXELS_SQL}, s as (select cell, cast(floor((36.5-lat)/0.625+0.5) as integer) as "row", cast(floor((lon+106.65)/0.625+0.5) as integer) as col from grid) select cell, "row", col, value from s left join pixels using ("row", col)""")
def _(t):
    return J.grid_snap_join(grid(t).select("cell", "lat", "lon"), pixels(t), "lat", "lon", 36.5, -106.65, 0.625).select("cell", "row", "col", "value")


@query("j6_curvilinear_map", f"""with {GRID_SQL}, {SITES_SQL}, c as (select * from grid where region<10), k as (select cell, sid, row_number() over (partition by cell order by (lat-slat)*(lat-slat)+(lon-slon)*(lon-slon), sid) as rn from c, sites) select cell, sid as site_id from k where rn=1""")
def _(t):
    return SP.curvilinear_map(grid(t).where(F.col("region") < 10), sites(t), "lat", "lon", "slat", "slon", "sid", margin_deg=90.0).select("cell", "site_id")


_MAPPED = "lat between 28.5 and 31.5 and lon between -101.5 and -97.5"


@query("j6_stored_mapping", f"""with {GRID_SQL}, {SITES_SQL}, c as (select * from grid where {_MAPPED}), b as (select min(lat)-0.5 as s, max(lat)+0.5 as n, min(lon)-0.5 as w, max(lon)+0.5 as e from c),
 near as (select sites.* from sites, b where slat between s and n and slon between w and e),
 k as (select cell, sid, row_number() over (partition by cell order by (lat-slat)*(lat-slat)+(lon-slon)*(lon-slon), sid) as rn from c, near),
 v as (select l_suppkey as sid, year(l_shipdate) as win, sum(l_linenumber) as value from lineitem group by 1,2)
 select c.cell, k.sid as site_id, cast(win as integer) as win, cast(value as bigint) as value from c left join k on k.cell=c.cell and rn=1 left join v on v.sid=k.sid""")
def _(t):
    mapping = SP.curvilinear_map(grid(t).where(_MAPPED), sites(t), "lat", "lon", "slat", "slon", "sid")
    values = t.lineitem.groupBy(F.col("l_suppkey").alias("site_id"), F.year("l_shipdate").alias("win")).agg(F.sum("l_linenumber").alias("value"))
    stored = SK.store_bucketed(mapping.select("cell", "site_id"), "site_id", "mapping")
    return J.map_values(stored, SK.store_bucketed(values, "site_id", "gridded")).select("cell", "site_id", "win", "value")


_AFF = {"a": 0.2, "c": -106.65, "e": -0.7, "f": 36.5, "width": 66, "height": 16, "nodata": 7.0}


@query("j7_sample_pixels", f"""with {GRID_SQL}, {PIXELS_SQL}, s as (select cell, cast(floor((lat-36.5)/-0.7) as integer) as "row", cast(floor((lon+106.65)/0.2) as integer) as col from grid) select cell, coalesce(value,-9.0)::double as whp from s left join (select * from pixels where value<>7) using ("row", col)""")
def _(t):
    px = pixels(t).withColumn("layer", F.lit("whp"))
    return J.sample_pixels(grid(t).select("cell", "lat", "lon"), px, "whp", "lon", "lat", _AFF, -9.0).select("cell", "whp")


@query("j8_anti_join", f"with {POS_SQL} select o_orderkey from orders where not exists (select 1 from pos where pos.cell=o_custkey and pos.date_utc=cast(o_orderdate as date))")
def _(t):
    df = t.orders.select("o_orderkey", F.col("o_custkey").alias("cell"), F.col("o_orderdate").cast("date").alias("date_utc"))
    return J.anti_join(df, pos(t), ("cell", "date_utc")).select("o_orderkey")


@query("j9_exclude_within", f"with {GRID_SQL}, {SITES_SQL} select cell from grid where not exists (select 1 from sites where {_HAV}<=60)")
def _(t):
    return SP.exclude_within(grid(t), sites(t), "lat", "lon", "slat", "slon", "sid", 60.0).select("cell")


@query("j9_exclude_unplaced", f"with {GRID_SQL}, {SITES_SQL} select cell from grid where cell%7<>0 and not exists (select 1 from sites where {_HAV}<=60)")
def _(t):
    points = grid(t).withColumn("lat", F.when(F.col("cell") % 7 != 0, F.col("lat")))
    events = sites(t).withColumn("sid", F.when(F.col("sid") % 2 == 0, F.col("sid")))
    return SP.exclude_within(points, events, "lat", "lon", "slat", "slon", "sid", 60.0).select("cell")


@query("j10_distance_to_nearest", f"with {GRID_SQL}, {SITES_SQL}, m as (select cell, min({_HAV}) as dist from grid, sites group by 1) select round(min(dist),5) as min_km, round(avg(dist),5) as mean_km from m")
def _(t):
    return rounded(SP.distance_to_nearest(grid(t), sites(t), "lat", "lon", "slat", "slon", "sid"), 5)


@query("j11_distance_to_features", f"with {GRID_SQL}, {SITES_SQL} select cell, round(min({_HAV})*1000,2) as distance_m from grid, sites group by 1")
def _(t):
    return rounded(SP.distance_to_features(grid(t), sites(t), "lat", "lon", "slat", "slon", "sid").select("cell", "distance_m"), 2)


@query("j12_date_join", f"with {POS_SQL}, m as (select cast(l_shipdate as date) as date_utc, count(*) as shipped from lineitem group by 1) select o_orderkey, shipped from pos left join m using (date_utc)")
def _(t):
    daily = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("date_utc")).agg(F.count(F.lit(1)).alias("shipped"))
    return J.date_join(pos(t), daily, "date_utc").select("o_orderkey", "shipped")


@query("j14_merge_weather_vars", f"with {_DECODED_SQL} select date, px, round(max(value) filter (where var='erc'),6) as erc, round(max(value) filter (where var='tmmx'),6) as tmmx from decoded group by 1,2")
def _(t):
    return rounded(J.merge_weather_vars(_decoded(t), ["erc", "tmmx"], ("date", "px")))


@query("j15_point_in_tile", f"""with {GRID_SQL}, tl as (select 'T'||lpad(s_suppkey::varchar,8,'0') as tile, s_suppkey%13-107.0 as "left", s_suppkey%13-105.5 as "right", s_suppkey%11+25.0 as bottom, s_suppkey%11+26.5 as top from supplier)
 select cell, min(tile) as tile from grid left join tl on lon between "left"-1e-9 and "right"+1e-9 and lat between bottom-1e-9 and top+1e-9 group by 1""")
def _(t):
    k = F.col("s_suppkey")
    tiles = t.supplier.select(
        F.concat(F.lit("T"), F.lpad(k.cast("string"), 8, "0")).alias("tile"),
        (F.pmod(k, F.lit(13)) - 107.0).alias("left"), (F.pmod(k, F.lit(13)) - 105.5).alias("right"),
        (F.pmod(k, F.lit(11)) + 25.0).alias("bottom"), (F.pmod(k, F.lit(11)) + 26.5).alias("top"),
    )
    return SP.point_in_tile(grid(t).select("cell", "lat", "lon"), tiles, "lon", "lat").select("cell", "tile")


_BOUNDS = [{"layer": "NDVI", "left": -106.0, "right": -94.0, "bottom": 26.0, "top": 36.0}, {"layer": "LST", "left": -107.0, "right": -93.0, "bottom": 25.0, "top": 37.0}]
_BSQL = {b["layer"]: f"not (lon between {b['left']} and {b['right']} and lat between {b['bottom']} and {b['top']})" for b in _BOUNDS}


@query("j16_coverage_join", f"with {GRID_SQL} " + " union all ".join(f"select count(*) as rows, '{n}' as layer, count(*) filter (where {c} and region%2=1) as outside_pos, count(*) filter (where {c} and region%2=0) as outside_neg from grid" for n, c in _BSQL.items()))
def _(t):
    return J.coverage_join(grid(t).withColumn("y", F.pmod("region", F.lit(2))), _BOUNDS, "lon", "lat", "y")


@query("a32_coverage_gaps", f"with {GRID_SQL} " + " union all ".join(f"select count(*) as rows, '{n}' as layer, count(*) filter (where {c} and region%2=1) as outside_pos, count(*) filter (where {c} and region%2=0) as outside_neg, {r(f'count(*) filter (where {c})*100.0/count(*)', 4)} as outside_pct, count(*) filter (where {c})*100.0/count(*)>2 as flagged from grid" for n, c in _BSQL.items()))
def _(t):
    return J.coverage_gaps(grid(t).withColumn("y", F.pmod("region", F.lit(2))), _BOUNDS, "lon", "lat", "y")


@query("j19_with_slot", f"with {GRID_SQL} select cell, date '2020-07-04' as date_utc, 18 as window_hour from grid")
def _(t):
    return J.with_slot(grid(t).select("cell"), "2020-07-04", 18)


@query("j20_count_within", f"with {GRID_SQL}, {SITES_SQL} select cell, " + ", ".join(f"count(*) filter (where {_HAV}<={k}) as within_{k}" for k in (5, 20, 60, 150)) + " from grid, sites group by 1")
def _(t):
    return SP.count_within(grid(t), sites(t), "lat", "lon", "slat", "slon", "sid", [5, 20, 60, 150], leaf_sites=16).select("cell", "within_5", "within_20", "within_60", "within_150")


@query("j21_polygon_join", f"""with {GRID_SQL}, {SITES_SQL} select cell, sid from grid, sites where abs(lat-slat)+abs(lon-slon)<0.7003""")
def _(t):
    corners = [(0.0, 0.7003), (0.7003, 0.0), (0.0, -0.7003), (-0.7003, 0.0)]
    ring = F.array(*[F.struct((F.col("slon") + dx).alias("lon"), (F.col("slat") + dy).alias("lat")) for dx, dy in corners])
    return SP.polygon_join(grid(t).select("cell", "lat", "lon"), sites(t).select("sid", ring.alias("ring")), "lat", "lon", "ring").select("cell", "sid")


@query("t1_in_grid_flag", f"with {POS_SQL} select o_orderkey, cast(c_acctbal>0 as integer) as in_grid from pos join customer on c_custkey=cell")
def _(t):
    return J.in_grid(pos(t), grid(t).where(F.col("c_acctbal") > 0)).select("o_orderkey", "in_grid")


# ---------------------------------------------------------------- set operations


@query("u1_merge_sources", "select o_orderkey as id, o_totalprice as price, null::varchar as flag, 1995 as source_year from orders where year(o_orderdate)=1995 union all select l_orderkey, l_extendedprice, l_returnflag, 1996 from lineitem where year(l_shipdate)=1996")
def _(t):
    a = t.orders.where(F.year("o_orderdate") == 1995).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = t.lineitem.where(F.year("l_shipdate") == 1996).select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    return CL.merge_sources({1995: a, 1996: b})


# ---------------------------------------------------------------- windows


@query("w1_trailing_stats", f"""with {POS_SQL}, {WEATHER_SQL}, q as (select distinct cell%{_S_SQL} as px, date_utc as d from pos)
 select q.px, q.d, round(avg(erc),6) as "erc_5D_mean", round(max(erc),6) as "erc_5D_max", round(avg(vs),6) as "vs_5D_mean", round(max(vs),6) as "vs_5D_max", round(min(tmmx),6) as "tmmx_5D_min"
 from q left join weather w on w.px=q.px and w.d between q.d-5 and q.d-1 group by 1,2""")
def _(t):
    want = pos(t).select(cell_px(t).alias("px"), F.col("date_utc").alias("d"))
    return rounded(W.trailing_stats(weather(t), want, "px", "d", {"erc": ("mean", "max"), "vs": ("mean", "max"), "tmmx": ("min",)}))


@query("w2_rolling_mean", f"with {WEATHER_SQL} select px, d, round(avg(erc) over (partition by px order by d rows between 4 preceding and current row),6) as erc_roll5 from weather")
def _(t):
    return rounded(W.rolling_mean(weather(t).select("px", "d", "erc"), "px", "d", ["erc"]).drop("erc"))


@query("w3_rolling_3d", f"""with {WEATHER_SQL} select px, d, round(max(tmmx) over w,6) as temp_max_3d, round(min(erc) over w,6) as rh_min_3d, round(avg(vs) over w,6) as wind_mean_3d from weather window w as (partition by px order by d rows between 2 preceding and current row)""")
def _(t):
    return rounded(W.rolling_3d(weather(t), "px", "d", "tmmx", "erc", "vs").select("px", "d", "temp_max_3d", "rh_min_3d", "wind_mean_3d"))


@query("w4_impute_series", f"""with {WEATHER_SQL}, x as (select px, d, case when erc<=35 then erc end as v from weather)
 select px, d, round(coalesce(last_value(v ignore nulls) over (partition by px order by d rows between unbounded preceding and current row), first_value(v ignore nulls) over (partition by px order by d rows between current row and unbounded following), 0),6) as v from x""")
def _(t):
    df = weather(t).select("px", "d", F.when(F.col("erc") <= 35, F.col("erc")).alias("v"))
    return rounded(W.impute_series(df, "px", "d", ["v"]))


@query("w4_impute_bands", """select l_orderkey, l_linenumber, round(coalesce(case when l_linenumber<=5 then l_quantity end, (select quantile_cont(l_quantity,0.5) from lineitem where l_linenumber<=5)),6) as v from lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") <= 5, F.col("l_quantity")).alias("v"))
    return rounded(W.impute_bands(df, ["v"]))


_BURN = f"""{WEATHER_SQL}, b as (select px, d, cast(erc>38 as integer) as burned from weather), s as (select *, lead(burned,1) over w as n1, lead(burned,2) over w as n2,
 coalesce(lag(burned,1) over w, first_value(burned) over w) as p1, coalesce(lag(burned,2) over w, first_value(burned) over w) as p2 from b window w as (partition by px order by d))"""


def _burn(t):
    return weather(t).select("px", "d", (F.col("erc") > 38).cast("int").alias("burned"))


@query("w5_ignition_label", f"""with {_BURN} select px, d, burned, case when n2 is not null then cast((n1=1 and burned=0 and p1=0 and p2=0) or (n2=1 and n1=0 and burned=0 and p1=0) as integer) end as ignition,
 case when n2 is null then 1 else cast(burned=1 as integer) end as exclude from s""")
def _(t):
    return W.ignition_label(_burn(t), "px", "d", "burned")


@query("j17_label_join", f"""with {_BURN}, l as (select px, d, case when n2 is not null then cast((n1=1 and burned=0 and p1=0 and p2=0) or (n2=1 and n1=0 and burned=0 and p1=0) as integer) end as ignition,
 case when n2 is null then 1 else cast(burned=1 as integer) end as exclude from s) select px, d, round(erc,6) as erc, ignition from weather join l using (px,d) where ignition is not null and exclude=0""")
def _(t):
    labels = W.ignition_label(_burn(t), "px", "d", "burned").drop("burned")
    out = J.label_join(weather(t).select("px", "d", "erc"), labels, ("px", "d"))
    return rounded(out.where(F.col("ignition").isNotNull() & (F.col("exclude") == 0)).drop("exclude"))


@query("w6_lag_flag", f"with {_BURN} select px, d, burned, lag(burned) over (partition by px order by d) as burned_yesterday from s")
def _(t):
    return W.lag_flag(_burn(t), "px", "d", "burned")


_N8 = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


@query("w7_focal_3x3", f"""with {PIXELS_SQL}, n as (select o."row", o.col, o.value, p."row"-o."row" as dr, p.col-o.col as dc, p.value as v from pixels o join pixels p on abs(p."row"-o."row")<=1 and abs(p.col-o.col)<=1),
 g as (select "row", col, value, sqrt(sum((v-value)*(v-value))/greatest(count(*)-1,1)) as tri, max(v) filter (where dr=-1 and dc=0) as n, max(v) filter (where dr=1 and dc=0) as s, max(v) filter (where dr=0 and dc=-1) as w, max(v) filter (where dr=0 and dc=1) as e from n group by 1,2,3),
 k as (select *, coalesce((s-n)/60.0, (s-value)/30.0, (value-n)/30.0, 0) as dy, coalesce((e-w)/60.0, (e-value)/30.0, (value-w)/30.0, 0) as dx from g)
 select "row", col, value, round(degrees(atan(sqrt(dx*dx+dy*dy))),6) as slope, round(sin(atan2(dy,-dx)),6)+0.0 as aspect_sin, round(cos(atan2(dy,-dx)),6)+0.0 as aspect_cos, round(tri,6) as tri from k""")
def _(t):
    return rounded(W.focal_3x3(pixels(t), "value", 30.0))


@query("w10_sample_per_group", "select o_orderkey from (select o_orderkey, row_number() over (partition by o_orderpriority order by (o_orderkey*7919)%104729, o_orderkey) as rn from orders) where rn<=200")
def _(t):
    order = [F.pmod(F.col("o_orderkey") * 7919, F.lit(104729)), F.col("o_orderkey")]
    return top_n(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", order, 200).select("o_orderkey")


@query("w10_sample_per_group_large", "select o_orderkey from (select o_orderkey, row_number() over (partition by o_orderpriority order by (o_orderkey*7919)%104729, o_orderkey) as rn from orders) where rn<=2000")
def _(t):
    order = [F.pmod(F.col("o_orderkey") * 7919, F.lit(104729)), F.col("o_orderkey")]
    return top_n(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", order, 2000).select("o_orderkey")


@query("w11_dedupe", "select doc_id, md5(text) as fp from (select doc_id, text, row_number() over (partition by text order by doc_id) as rn from documents) where rn=1")
def _(t):
    return CL.dedupe(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("fp"))


# ---------------------------------------------------------------- scalar functions


def _local(t):
    hhmm = F.when(F.pmod("event_id", F.lit(11)) == 0, F.lit(None)).otherwise(F.pmod(F.col("event_id") * 37, F.lit(2400)))
    fips = F.when(F.pmod("user_id", F.lit(3)) == 0, 48141).otherwise(48001)
    state = F.when(F.pmod("user_id", F.lit(2)) == 0, "TX").otherwise("CA")
    return t.events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), hhmm.cast("string").alias("hhmm"), fips.alias("fips"), state.alias("state"))


_LOCAL = """loc as (select event_id, user_id, cast(ts as date) as day, case when event_id%11=0 then 12 else least((event_id*37)%2400//100,23) end as h, case when event_id%11=0 then 0 else least((event_id*37)%2400%100,59) end as m,
 case when user_id%2<>0 then 8 when user_id%3=0 then 7 else 6 end as off from events), utc as (select *, day + to_hours(cast(h+off as integer)) + to_minutes(cast(m as integer)) as u from loc)"""


@query("f1_local_to_utc_window", f"with {_LOCAL} select event_id, cast(u as date) as date_utc, cast(hour(u)//6*6 as integer) as window_hour, cast(epoch(u) as bigint) as instant from utc")
def _(t):
    df = _local(t).withColumn("u", TF.local_to_utc("day", "hhmm", TF.tz_of("state", "fips")))
    parts = TF.utc_window("u")
    return df.select("event_id", parts["date_utc"].alias("date_utc"), parts["window_hour"].alias("window_hour"), F.unix_timestamp("u").alias("instant"))


@query("f2_parse_hhmm", f"with {_LOCAL} select event_id, cast(h as integer) as hour, cast(m as integer) as minute from loc")
def _(t):
    h, m = TF.parse_hhmm("hhmm")
    return _local(t).select("event_id", h.alias("hour"), m.alias("minute"))


@query("f3_tz_of", "select case when user_id%2<>0 then 'America/Los_Angeles' when user_id%3=0 then 'America/Denver' else 'America/Chicago' end as tz, count(*) as n from events group by 1")
def _(t):
    return _local(t).groupBy(TF.tz_of("state", "fips").alias("tz")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_window_distribution", "select cast(hour(ts)//6*6 as integer) as window_hour, count(*) as n from events group by 1")
def _(t):
    return t.events.groupBy(TF.floor_6h(F.hour("ts")).alias("window_hour")).agg(F.count(F.lit(1)).alias("n"))


_COS31 = repr(C._scale(31.0))
_KPD = repr(C.KM_PER_DEG)


def _axial_sql(x: str, y: str, edge: float, src: str, keep: str) -> str:
    """Cube rounding as three chained selects."""
    import math

    k1, k2, k3 = repr(math.sqrt(3.0) / 3.0), repr(1.0 / 3.0), repr(2.0 / 3.0)
    return f"""ax0 as (select {keep}, ({x}*{k1}::double-{y}*{k2}::double)/{edge}::double as qf, {y}*{k3}::double/{edge}::double as rf from {src}),
 ax1 as (select *, -qf-rf as sf, floor(qf+0.5) as q, floor(rf+0.5) as r, floor((-qf-rf)+0.5) as s from ax0),
 ax as (select *, cast(case when abs(q-qf)>abs(r-rf) and abs(q-qf)>abs(s-sf) then -r-s else q end as bigint) as hq,
 cast(case when abs(q-qf)>abs(r-rf) and abs(q-qf)>abs(s-sf) then r when abs(r-rf)>abs(s-sf) then -q-s else r end as bigint) as hr from ax1)"""


def _cell_sql(res: int, keep: str = "cell") -> str:
    edge = C.EDGE_KM[res]
    return _axial_sql(f"(lon*{_COS31}::double)", f"(lat*{_KPD}::double)", edge, "grid", keep)


def _pack_sql(res: int) -> str:
    return f"({res << 58}::bigint + (hq+{1 << 28})*{1 << 29}::bigint + (hr+{1 << 28}))"


@query("f5_cell_id", f"with {GRID_SQL}, {_cell_sql(8)} select cell as id, {_pack_sql(8)} as hex from ax")
def _(t):
    return grid(t).select(F.col("cell").alias("id"), C.cell_id("lat", "lon", 8).alias("hex"))


@query("f6_cell_center", f"with {GRID_SQL}, {_cell_sql(6)} select cell as id, round(hr*1.5*3.229::double/{_KPD}::double,5) as lat, round((hq+hr/2.0)*sqrt(3.0)*3.229::double/{_COS31}::double,5) as lon from ax")
def _(t):
    lat, lon = C.cell_center("hex", digits=5)
    hexes = grid(t).select(F.col("cell").alias("id"), C.cell_id("lat", "lon", 6).alias("hex"))
    return hexes.select("id", lat.alias("lat"), lon.alias("lon"))


@query("f7_cell_parent", f"""with g0 as (select 1), {GRID_SQL.replace("grid as", "grid0 as", 1)}, {_axial_sql(f"(lon*{_COS31}::double)", f"(lat*{_KPD}::double)", C.EDGE_KM[8], "grid0", "cell").replace("ax0", "bx0").replace("ax1", "bx1").replace(" ax as", " bx as")},
 grid as (select cell, hr*1.5*0.4614::double/{_KPD}::double as lat, (hq+hr/2.0)*sqrt(3.0::double)*0.4614::double/{_COS31}::double as lon from bx), {_cell_sql(5)} select cell as id, {_pack_sql(5)} as parent from ax""")
def _(t):
    hexes = grid(t).select(F.col("cell").alias("id"), C.cell_id("lat", "lon", 8).alias("hex"))
    return hexes.select("id", C.cell_parent("hex", 5).alias("parent"))


@query("f8_cell_resolution", "select cast(c_custkey%9 as integer) as res, count(*) as n from customer group by 1")
def _(t):
    pick = None
    for res in range(9):
        hit = F.pmod("idx", F.lit(9)) == res
        pick = F.when(hit, C.cell_id("lat", "lon", res)) if pick is None else pick.when(hit, C.cell_id("lat", "lon", res))
    return grid(t).groupBy(C.cell_resolution(pick).alias("res")).agg(F.count(F.lit(1)).alias("n"))


@query("f9_cell_boundary", f"with {GRID_SQL}, {_cell_sql(5)} select cell as id, 6 as corners, round(hr*1.5*8.544::double/{_KPD}::double,3) as mean_lat from ax")
def _(t):
    hexes = grid(t).select(F.col("cell").alias("id"), C.cell_id("lat", "lon", 5).alias("hex"))
    rings = hexes.select("id", C.cell_boundary("hex").alias("ring"))
    mean = F.aggregate("ring", F.lit(0.0), lambda a, v: a + v["lat"]) / 6
    return rings.select("id", F.size("ring").alias("corners"), F.round(mean, 3).alias("mean_lat"))


@query("f10_cyclic", "select cast(month(o_orderdate) as integer) as month, round(sin(2*pi()*month(o_orderdate)/12),9)+0.0 as s, round(cos(2*pi()*month(o_orderdate)/12),9)+0.0 as c, count(*) as n from orders group by month(o_orderdate)")
def _(t):
    s, c = TF.cyclic("month", 12)
    out = t.orders.groupBy(F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(out.select("month", s.alias("s"), c.alias("c"), "n"), 9)


@query("f11_calendar_parts", "select cast(month(o_orderdate) as integer) as month, cast(case when month(o_orderdate)=12 then 0 else month(o_orderdate)//3 end as integer) as season, strftime(o_orderdate,'%b') as month_name, strftime(o_orderdate,'%A') as day_name, cast(month(o_orderdate) in (2,3,4,10,11) as integer) as peak, count(*) as n from orders group by all")
def _(t):
    m = F.month("o_orderdate")
    return t.orders.groupBy(
        m.alias("month"), TF.season_code(m).alias("season"), TF.month_name("o_orderdate").alias("month_name"), TF.day_name("o_orderdate").alias("day_name"), TF.peak_flag(m).alias("peak")
    ).agg(F.count(F.lit(1)).alias("n"))


def _wx(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 300 + 5).alias("temp"), (F.col("l_quantity") * 2).alias("rh"), (F.col("l_tax") * 100).alias("wind")
    )


_WX = "wx as (select l_orderkey, l_linenumber, l_discount*300+5 as temp, l_quantity*2 as rh, l_tax*100 as wind from lineitem)"
_VPD = "greatest(0.61078::double*exp(17.27::double*temp/(temp+237.3::double))*(1-rh/100.0), 0)"


@query("f12_vpd", f"with {_WX} select l_orderkey, l_linenumber, round({_VPD},6)+0.0 as vpd, round(wind*{_VPD},6)+0.0 as hdw from wx")
def _(t):
    return rounded(_wx(t).select("l_orderkey", "l_linenumber", WX.vpd("temp", "rh").alias("vpd"), WX.hdw("temp", "rh", "wind").alias("hdw")))


@query("f13_vpd_tetens", f"with {_WX} select l_orderkey, l_linenumber, round(0.6108::double*exp(17.27::double*temp/(temp+237.3::double))*(1-rh/100.0),6)+0.0 as vpd from wx")
def _(t):
    return rounded(_wx(t).select("l_orderkey", "l_linenumber", WX.vpd_tetens(F.col("temp") + 273.15, "rh").alias("vpd")))


@query("f15_ffwi", f"""with {_WX}, a as (select *, temp*1.8+32 as tf, wind*2.23694 as mph from wx), b as (select *, case when rh<10 then 0.03229::double+0.281073*rh-0.000578*rh*tf when rh<=50 then 2.22749::double+0.160107*rh-0.014784*tf else 21.0606::double+0.005531*rh*rh-0.100276*rh-0.001436*rh*tf end as m from a),
 c as (select *, case when m>30 then 0 else 1-2*(m/30)+1.5*power(m/30,2)-0.5*power(m/30,3) end as n from b) select l_orderkey, l_linenumber, round(least(greatest(n*sqrt(1+mph*mph)/0.3002::double,0),100),5)+0.0 as ffwi from c""")
def _(t):
    return rounded(_wx(t).select("l_orderkey", "l_linenumber", WX.ffwi("temp", "rh", "wind").alias("ffwi")), 5)


@query("f16_wind_speed", "select l_orderkey, l_linenumber, round(sqrt(l_quantity*l_quantity+l_tax*l_tax),6) as w from lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", WX.wind_speed("l_quantity", "l_tax").alias("w")))


@query("f17_one_hot", "select " + ", ".join(f"cast(sum(cast(p_size={v} as integer)) as bigint) as {n}" for n, v in (("a", 21), ("b", 41), ("c", 1))) + " from part")
def _(t):
    flags = S.one_hot("p_size", {"a": 21, "b": 41, "c": 1})
    return t.part.select(*[c.alias(n) for n, c in flags.items()]).agg(*[F.sum(n).alias(n) for n in flags])


@query("f18_haversine", f"with {GRID_SQL}, p as (select cell, lat, lon, 30.0::double as slat, -97.0::double as slon from grid) select cell, round({_HAV},5) as km from p")
def _(t):
    return rounded(grid(t).select("cell", G.haversine_km("lat", "lon", F.lit(30.0), F.lit(-97.0)).alias("km")), 5)


@query("f19_unit_xyz", f"with {GRID_SQL} select cell, round(cos(radians(lat))*cos(radians(lon)),9) as x, round(cos(radians(lat))*sin(radians(lon)),9) as y, round(sin(radians(lat)),9) as z, round(2*sin((c_acctbal+1000)/12742.0),9) as chord from grid")
def _(t):
    x, y, z = G.unit_xyz("lat", "lon")
    return rounded(grid(t).select("cell", x.alias("x"), y.alias("y"), z.alias("z"), G.km_to_chord(F.col("c_acctbal") + 1000).alias("chord")), 9)


@query("f20_pixel_index", f"""with {GRID_SQL}, p as (select cell, cast(floor((lat-36.5)/-0.7) as integer) as "row", cast(floor((lon+106.65)/0.2) as integer) as col from grid) select cell, "row", col, round(-106.65+(col+0.5)*0.2::double,6) as x, round(36.5-("row"+0.5)*0.7::double,6) as y from p""")
def _(t):
    row, col = G.pixel_index("lon", "lat", 0.2, -106.65, -0.7, 36.5)
    x, y = G.pixel_center("row", "col", 0.2, -106.65, -0.7, 36.5)
    return rounded(grid(t).select("cell", row.alias("row"), col.alias("col")).select("*", x.alias("x"), y.alias("y")))


@query("f21_risk_band", "select case when s>=0.8 then 'CRITICAL' when s>=0.65 then 'HIGH' when s>=0.5 then 'MEDIUM-HIGH' when s>=0.35 then 'MEDIUM' when s>=0.2 then 'LOW-MEDIUM' else 'LOW' end as band, count(*) as n from (select (n_chars%1000)/1000.0 as s from documents) group by 1")
def _(t):
    return t.documents.groupBy(S.risk_band(F.pmod("n_chars", F.lit(1000)) / 1000.0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("f22_clean_num", f"select c_custkey, case when c_custkey%10=0 then null else {r('c_acctbal/7', 3)} end as v from customer")
def _(t):
    v = F.when(F.pmod("c_custkey", F.lit(20)) == 0, float("nan")).when(F.pmod("c_custkey", F.lit(10)) == 0, float("inf")).otherwise(F.col("c_acctbal") / 7)
    return t.customer.select("c_custkey", S.clean_num(v).alias("v"))


@query("f23_log1p_clip", "select c_custkey, round(ln(1+greatest(c_acctbal,0)),9) as v from customer")
def _(t):
    return rounded(t.customer.select("c_custkey", S.log1p_clip("c_acctbal").alias("v")), 9)


@query("f24_truncate_example", "select doc_id, md5(case when length(text)>80 then substr(text,1,77)||'...' else text end) as fp from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(S.truncate_example("text")).alias("fp"))


_N, _CC, _RHO0, _E, _E2 = G._albers_constants()


@query("f25_reproject", f"""with {GRID_SQL}, q as (select cell, lon, {1 - _E2!r}::double*(sin(radians(lat))/(1-{_E2!r}::double*sin(radians(lat))*sin(radians(lat)))-ln((1-{_E!r}::double*sin(radians(lat)))/(1+{_E!r}::double*sin(radians(lat))))/(2*{_E!r}::double)) as q from grid),
 p as (select cell, 6378137.0::double/{_N!r}::double*sqrt({_CC!r}::double-{_N!r}::double*q) as rho, {_N!r}::double*radians(lon+96) as th from q) select cell, round(rho*sin(th),3) as x, round({_RHO0!r}::double-rho*cos(th),3) as y from p""")
def _(t):
    x, y = G.reproject("lat", "lon", "albers")
    return rounded(grid(t).select("cell", x.alias("x"), y.alias("y")), 3)


@query("f27_parse_row", "select o_orderkey as id, case when o_orderkey%4=0 then 0 else o_totalprice end as price, o_orderstatus as status from orders")
def _(t):
    price = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "oops").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), price, "o_orderstatus")
    return t.orders.select(S.parse_row(line, "id bigint, price double, status string").alias("r")).select("r.*")


@query("f28_wrap_lon", "select c_custkey, case when c_custkey%360>180 then c_custkey%360-360 else c_custkey%360 end as lon from customer")
def _(t):
    return t.customer.select("c_custkey", G.wrap_lon(F.pmod("c_custkey", F.lit(360))).alias("lon"))


@query("f29_coalesce_year", "select cast(case when o_orderkey%3=0 then 1900 else year(o_orderdate) end as integer) as year, count(*) as n from orders group by 1")
def _(t):
    d = F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.col("o_orderdate").cast("date"))
    return t.orders.groupBy(TF.coalesce_year(d, F.lit(1900)).alias("year")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- grid and labels


@query("a25_cell_event_count", f"with {GRID_SQL}, {_cell_sql(4)} select {_pack_sql(4)} as cell, count(*) as event_count from ax group by 1")
def _(t):
    return D.cell_event_count(grid(t), "lat", "lon", 4)


@query("a25_asof_event_count", f"with {POS_SQL}, a as (select distinct cell, date_utc from pos) select a.cell, a.date_utc, cast(count(p.cell) as bigint) as events_before from a left join pos p on p.cell=a.cell and p.date_utc<a.date_utc group by 1,2")
def _(t):
    return D.asof_event_count(pos(t), pos(t))


def _small_grid(t):
    return D.build_grid(t.spark, grid(t), "lat", "lon", "cell", "region", 4, TEXAS_BOX, RING, "TX")


_EDGE4 = repr(C.EDGE_KM[4])
_COVER_SQL = f"""cov0 as (select r, q, r*{_EDGE4}::double*1.5/{_KPD}::double as clat, (q+r/2.0)*({_EDGE4}::double*sqrt(3.0::double))/{_COS31}::double as clon
 from range(70, 140) a(r), range(-420, -230) b(q)), cov as (select {4 << 58}::bigint + (q+{1 << 28})*{1 << 29}::bigint + (r+{1 << 28}) as cell, clat, clon from cov0
 where clat between {TEXAS_BOX[0]} and {TEXAS_BOX[1]} and clon between {TEXAS_BOX[2]} and {TEXAS_BOX[3]} and {_ring_sql("clat", "clon")})"""
_BUILT_SQL = f"""{GRID_SQL}, {_COVER_SQL}, {_cell_sql(4)}, cnt as (select {_pack_sql(4)} as cell, count(*) as n from ax group by 1),
 near as (select cov.cell, region, row_number() over (partition by cov.cell order by (round(clat,6)-lat)*(round(clat,6)-lat)+(round(clon,6)-lon)*(round(clon,6)-lon), grid.cell) as rn from cov, grid),
 built as (select cov.cell, 'TX' as state, 4 as resolution, round(clat,6) as centroid_lat, round(clon,6) as centroid_lon, region::varchar as region, coalesce(n,0) as event_count, n is not null as has_history, true as burnable
 from cov join near on near.cell=cov.cell and rn=1 left join cnt on cnt.cell=cov.cell)"""


@query("n0_build_grid", f"with {_BUILT_SQL} select * from built")
def _(t):
    return _small_grid(t)


@query("a26_grid_summary", f"with {_BUILT_SQL} select count(*) as cells, count(*) filter (where event_count>0) as cells_with_history, min(centroid_lat) as min_lat, max(centroid_lat) as max_lat, min(centroid_lon) as min_lon, max(centroid_lon) as max_lon from built")
def _(t):
    return D.grid_summary(_small_grid(t))


@query("a26_region_breakdown", f"with {POS_SQL}, {GRID_SQL}, x as (select region, coalesce(n,0) as n from grid left join (select cell, count(*) as n from pos group by 1) using (cell)) select region, count(*) as cells, count(*) filter (where n>0) as event_cells, {r('count(*) filter (where n>0)*100.0/count(*)', 2)} as event_pct from x group by 1")
def _(t):
    counts = pos(t).groupBy("cell").agg(F.count(F.lit(1)).alias("event_count"))
    return D.region_breakdown(J.map_lookup(grid(t), counts, "cell", "event_count"), "region")


@query("a36_hexbin", f"with {GRID_SQL}, {_axial_sql('lon', 'lat', 0.5, 'grid', 'cell')} select hq as q, hr as r, count(*) as n from ax group by 1,2")
def _(t):
    q, rr = C.hex_axial(F.col("lon"), F.col("lat"), 0.5)
    return grid(t).groupBy(q.alias("q"), rr.alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query("n_event_labels", f"""with {_LOCAL}, {GRID_SQL.replace("grid as", "g as", 1)}, grid as (select event_id as cell, lat, lon from events join g on g.idx=user_id), {_cell_sql(6)}
 select {_pack_sql(6)} as cell, cast(u as date) as date_utc, cast(hour(u)//6*6 as integer) as window_hour, cast(year(u) as integer) as year, 1 as label, case when user_id%2=0 then 'TX' else 'CA' end as state from ax join utc u on u.event_id=ax.cell""")
def _(t):
    spots = grid(t).select(F.col("idx").alias("user_id"), "lat", "lon")
    out = D.event_labels(_local(t).join(spots, "user_id"), "lat", "lon", "day", "hhmm", "state", "fips", 6)
    return out.select("cell", "date_utc", "window_hour", "year", "label", "state")


@query("n_labelling_losses", f"with {GRID_SQL} select count(*) as rows, count(*) filter (where event_id%5=0) as bad_date, count(*) filter (where event_id%3=0) as bad_place from events")
def _(t):
    df = t.events.select(
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("?").alias("day"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("value")).alias("lat"),
        F.col("value").alias("lon"),
    )
    return D.labelling_losses(df.withColumn("lon", F.coalesce("lon", F.lit(0.0))), "lat", "lon", "day")
