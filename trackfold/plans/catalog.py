"""All queries of the engine by name, and their SQL.

Tables stand in for measurements: orders are colonies and their lines cells; events of
a user are a series in time; line items are pixels with two labels; embeddings' first
two components are places in a plane. Numbers are rounded to six decimals on both
sides, as sums differ in their last bits with the order of adding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold import schema
from trackfold.functions import plates, scalar
from trackfold.operators import conditions, describe, growth, guards, lineage, lysis, scoring, segmentation, series, spatial, timebin
from trackfold.sources import tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def big(df: DataFrame) -> DataFrame:
    """Integers of one width on both sides."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def shown(df: DataFrame) -> DataFrame:
    return big(rounded(df))


# a series of each user: microseconds since the first event, an area, a path in a forest of fifteen roots
def events(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.select(F.min(us)).scalar()
    path = F.when(F.col("user_id") < 15, F.col("user_id").cast("string")).otherwise(F.concat_ws(".", F.col("user_id") % 15, F.floor(F.col("user_id") / 15)))
    return e.select((F.col("user_id") % 5).cast("string").alias("label"), F.col("user_id").alias("series_key"), path.alias("lineage"), "event_id", "event_type", (us - first).alias("us"), ((us - first) / 1e6).alias("time"), F.col("value").alias("area"))


EVENTS = """e as (select (user_id % 5)::varchar as label, user_id as series_key,
  case when user_id < 15 then user_id::varchar else (user_id % 15)::varchar || '.' || (user_id // 15)::varchar end as lineage, event_id, event_type,
  epoch_us(ts) - (select min(epoch_us(ts)) from events) as us, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 1e6 as time, value as area from events)"""


def _stats(m: str, x: str) -> str:
    return f"""count({x})::bigint as {m}_count, round(avg({x}), 6) as {m}_mean, round(stddev_samp({x}), 6) as {m}_std, min({x}) as {m}_min,
  round(quantile_cont({x}, 0.25), 6) as {m}_p25, round(quantile_cont({x}, 0.5), 6) as {m}_p50, round(quantile_cont({x}, 0.75), 6) as {m}_p75, max({x}) as {m}_max"""


@query(f"""select o_orderkey, {_stats("price", "l_extendedprice")}, {_stats("quantity", "l_quantity")},
  round(avg(l_extendedprice) * count(l_extendedprice), 6) as price_total, t as time, round(t / 3600, 6) as time_hours, round(t / 86400, 6) as time_days,
  (floor(t / 900) * 900)::bigint as round_time, round(floor(t / 900) * 900 / 3600, 6) as round_time_hours, round(floor(t / 900) * 900 / 86400, 6) as round_time_days,
  round(floor(floor(t / 900) * 900 / 3600 * 60 / 30) * 30 / 60, 6) as time_bin_30min, round(floor(floor(t / 900) * 900 / 3600 * 60 / 15) * 15 / 60, 6) as time_bin_15min
from (select o_orderkey, (epoch_us(o_orderdate) - epoch_us(timestamp '1992-01-01')) / 1e6 as t from orders) o left join lineitem on l_orderkey = o_orderkey group by o_orderkey, t""")
def describe_owned(s, d):
    """J1, A1, P2, P4, P5."""
    o = read(s, d, "orders").select("o_orderkey", timebin.elapsed_seconds(F.col("o_orderdate"), F.to_timestamp(F.lit("1992-01-01"))).alias("time"))
    li = read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return shown(timebin.with_time_bins(timebin.with_units(describe.describe_owned(o, li, ["o_orderkey"], ["price", "quantity"]))))


@query(f"select l_returnflag, l_linestatus, {_stats('price', 'l_extendedprice')} from lineitem group by all")
def describe_groups(s, d):
    """A1."""
    return shown(describe.describe(read(s, d, "lineitem").withColumnRenamed("l_extendedprice", "price"), ["l_returnflag", "l_linestatus"], ["price"]))


@query("select o_orderkey, o_totalprice, l_linenumber::bigint as l_linenumber from orders join lineitem on l_orderkey = o_orderkey")
def zipped(s, d):
    """J2."""
    return big(describe.zipped(read(s, d, "orders").select("o_orderkey", "o_totalprice"), read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), ["o_orderkey"]))


@query("select l_orderkey, list(l_quantity order by l_linenumber, l_quantity) as history from lineitem group by l_orderkey")
def histories(s, d):
    """A10."""
    return describe.contents_by_group(read(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], "l_quantity", "history")


@query("select c_nationkey::bigint as c_nationkey, list(c_custkey order by c_custkey) as positions from customer group by c_nationkey having count(*) > 1")
def duplicate_keys(s, d):
    """A9."""
    return big(describe.duplicates(read(s, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey"))


@query("""select l_returnflag, round(coalesce(case when n >= 3 then (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) end, 0), 4) as a, round(coalesce(case when n >= 3 then (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) end, 0), 4) as b from (
  select l_returnflag, count(*) as n, sum(x * x) - sum(x) * sum(x) / count(*) as sxx, sum(y * y) - sum(y) * sum(y) / count(*) as syy, sum(x * y) - sum(x) * sum(y) / count(*) as sxy,
  sum(x * z) - sum(x) * sum(z) / count(*) as sxz, sum(y * z) - sum(y) * sum(z) / count(*) as syz from (select l_returnflag, l_quantity as x, l_linenumber::double as y, l_discount * 100 as z from lineitem) group by l_returnflag)""")
def tilt_plane(s, d):
    """A15."""
    li = read(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_discount") * 100).alias("z"))
    return describe.plane(li, ["l_returnflag"], "x", "y", "z").select("l_returnflag", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"with {EVENTS} select event_id, round(time, 6) as time, round(time / 3600, 6) as time_hours, round(floor(floor(time / 900) * 900 / 3600 * 60 / 30) * 30 / 60, 6) as time_bin_30min, round(floor(floor(time / 900) * 900 / 3600 * 60 / 15) * 15 / 60, 6) as time_bin_15min from e")
def time_bins(s, d):
    """P4, P5."""
    return shown(timebin.with_time_bins(timebin.with_units(events(s, d))).select("event_id", "time", "time_hours", "time_bin_30min", "time_bin_15min"))


@query(f"""with {EVENTS} select series_key, min(us) as first_at, max(us) as last_at, round(arg_min(area, us), 6) as first_value, round(arg_max(area, us), 6) as last_value,
  min(us) filter (where area = m) as max_at, round(max(area), 6) as max_value from (select *, max(area) over (partition by series_key) as m from e) group by series_key""")
def series_edges(s, d):
    """W3."""
    return shown(series.edges(events(s, d), ["series_key"], "us", "area"))


@query(f"""with {EVENTS}, f as (select *, row_number() over (partition by series_key order by us, event_id) as n, coalesce(lead(event_id % 7 = 0) over (partition by series_key order by us, event_id), false) as a from e)
select event_id, n = min(case when a then n end) over (partition by series_key) is true as terminates from f""")
def termination_markers(s, d):
    """W1."""
    e = events(s, d).withColumn("flag", F.col("event_id") % 7 == 0)
    return series.termination(e, ["series_key"], ["us", "event_id"], "flag").select("event_id", "terminates")


@query(f"with {EVENTS} select event_id, row_number() over (partition by series_key order by us desc, event_id desc) = 1 as is_last from e")
def last_rows(s, d):
    """W2."""
    return series.last_row(events(s, d), ["series_key"], ["us", "event_id"]).select("event_id", "is_last")


@query(f"with {EVENTS} select event_id, round((max(us) over w - min(us) over w) / 1e6, 6) as present_for_duration, round(sum(area) over w, 4) as sum_area from e window w as (partition by series_key)")
def present_durations(s, d):
    """A5-A7, W4."""
    return shown(series.with_group(series.present_duration(events(s, d), ["series_key"], "time"), ["series_key"], sum_area=F.sum("area")).select("event_id", "present_for_duration", F.round("sum_area", 4).alias("sum_area")))


@query(f"with {EVENTS} select event_id, coalesce(sum(event_id % 11) over (partition by series_key order by us, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as cumulative_shift from e")
def cumulative_offsets(s, d):
    """W8."""
    return big(series.cumulative(events(s, d).withColumn("shift", F.col("event_id") % 11), ["series_key"], ["us", "event_id"], ["shift"]).select("event_id", "cumulative_shift"))


@query(f"with {EVENTS} select event_id, round(nth_value(area, 2) over (partition by series_key order by us, event_id rows between unbounded preceding and unbounded following), 6) as area_nth from e")
def second_values(s, d):
    """W9."""
    return shown(series.nth(events(s, d), ["series_key"], ["us", "event_id"], "area", 2).select("event_id", "area_nth"))


@query(f"""with {EVENTS}, a as (select series_key, us, event_id, time - lag(time) over (partition by series_key order by us, event_id) as dt from e),
b as (select *, dt < 2.5 * min(dt) over (partition by series_key) as short from a where dt is not null),
c as (select *, case when lag(short) over w is not distinct from short then 0 else 1 end as turn from b window w as (partition by series_key order by us, event_id)),
i as (select *, sum(turn) over (partition by series_key order by us, event_id) as island from c),
r as (select series_key, island, short, count(*) as n from i group by all),
p as (select series_key, n, island, max(island) over (partition by series_key) as last from r where short)
select r.series_key, case when r.short then 0 else 1 end::bigint as start_index, coalesce(x.depth, 1)::bigint as depth from r left join (select series_key, round(avg(n)) + 1 as depth from p where island < last group by series_key) x on x.series_key = r.series_key where r.island = 1""")
def stack_depths(s, d):
    """W10."""
    return big(series.stack_depth(events(s, d), ["series_key"], ["us", "event_id"], "time"))


@query(f"""with {EVENTS} select event_id, area > coalesce(lag(area) over w, '-inf'::double) and area > coalesce(lead(area) over w, '-inf'::double) and area >= 50 as is_peak from e window w as (partition by series_key order by us, event_id)""")
def local_peaks(s, d):
    """W12."""
    return series.local_maxima(events(s, d), ["series_key"], ["us", "event_id"], "area", 50.0).select("event_id", "is_peak")


@query(f"with {EVENTS} select series_key, round(regr_slope(log2(area), time / 3600), 6) as slope from e where area > 0 group by series_key")
def growth_slopes(s, d):
    """A13."""
    return shown(series.slopes(events(s, d).where("area > 0"), ["series_key"], F.log2("area"), F.col("time") / 3600))


@query(f"""with {EVENTS}, g as (select series_key, count(*)::bigint as tracking_count, round(max(time) - min(time), 6) as tracking_time, round(arg_min(area, time), 6) as area_first, round(arg_max(area, time), 6) as area_last, regr_slope(log2(area), time) as r from e where area > 0 group by series_key)
select series_key, tracking_count, tracking_time, area_first, area_last, round(case when tracking_count > 10 then r * 3600 else -1 end, 6) as doublings_per_hour from g""")
def growth_summaries(s, d):
    """A14."""
    g = series.growth_summary(events(s, d), ["series_key"], "time", "area")
    rate = F.when(F.col("tracking_count") > 10, 1 / F.col("doubling_time")).otherwise(-1.0)
    return shown(g.select("series_key", "tracking_count", "tracking_time", "area_first", "area_last", rate.alias("doublings_per_hour")))


@query(f"""with {EVENTS}, q as (select event_type, quantile_cont(area, 0.01) as lo, quantile_cont(area, 0.99) as hi from e group by event_type)
select event_id, round(least(greatest(area, lo), hi), 6) as area_clipped from e join q on q.event_type is not distinct from e.event_type""")
def clipped_values(s, d):
    """A16."""
    return shown(series.normal_range(events(s, d), ["event_type"], "area", 1, 99).select("event_id", "area_clipped"))


@query(f"with {EVENTS} select event_id, event_type, series_key from (select *, row_number() over (partition by event_type, series_key order by us, event_id) as n from e) where n = 1")
def first_of_type(s, d):
    """T9, U5."""
    return series.first_rows(events(s, d), ["event_type", "series_key"], ["us", "event_id"]).select("event_id", "event_type", "series_key")


def _lysis_input(s, d):
    e = events(s, d).withColumn("time_hours", F.col("us") / 3.6e9).withColumn("round_time_hours", F.floor(F.col("us") / 9e8) * 0.25)
    return e.select("label", "series_key", "lineage", "event_id", F.col("us").alias("time_index"), "time_hours", "round_time_hours", F.col("area").alias("colony_area"), (F.col("event_id") % 100).cast("double").alias("ss_area_count"), (F.col("area") / 1000).alias("ss_area_total_growth_rate"), ((F.col("event_id") % 10) / 100).alias("ss_area_count_growth_rate"))


@query(f"""with {EVENTS}, a as (select *, us / 3.6e9 as h, floor(us / 9e8) * 0.25 as rh, (event_id % 100)::double as n from e),
g as (select label, series_key, lineage, max(us) as last_us, max(h) as last_h, min(h) as first_h, max(area) as m, avg(area / 1000) as ra, avg((event_id % 10) / 100) as rc from a group by all),
x as (select g.*, min(us) as iu from g join a on a.series_key = g.series_key and a.area = g.m group by all),
y as (select x.*, a.n, a.rh, (select max(rh) from a b where b.label = x.label) as fin from x join a on a.series_key = x.series_key and a.us = x.iu),
z as (select *, iu <> last_us as lys, last_h >= 4 as pe, first_h < 0.2 as ps from y),
p as (select *, not (lys and pe) as pr from z),
o as (select *, case when pr then ra * (fin - rh) + m else m end as ca from p),
t as (select distinct label, label || lineage as l from o where lys),
k as (select distinct label, label || lineage as l, unnest(string_split(label || lineage, '.')) as tok from o),
st as (select distinct k.label, k.l from k join t on t.label = k.label and t.l = k.tok)
select o.series_key, o.iu as cmax_time_index, o.iu = o.last_us as cmax_at_eop, o.pe as present_at_end, o.ps as present_at_start, round(o.ca, 6) as cmax_colony_area,
  round(case when pr then rc * (fin - rh) + ca else n end, 6) as cmax_cell_count, round(case when pr then fin else rh end, 6) as cmax_time, (o.lys or st.l is not null) as colony_lysis
from o left join st on st.label = o.label and st.l = o.label || o.lineage""")
def lysis_events(s, d):
    """W15, J13, A6, A7."""
    out = lysis.with_lysis(_lysis_input(s, d))
    return shown(out.select("series_key", "cmax_time_index", "cmax_at_eop", "present_at_end", "present_at_start", "cmax_colony_area", "cmax_cell_count", "cmax_time", "colony_lysis").distinct())


_IDS = f"with {EVENTS}, i as (select distinct label, lineage from e)"


@query(_IDS + " select label, lineage from i where not exists (select 1 from i j where j.label = i.label and j.lineage <> i.lineage and starts_with(i.lineage, j.lineage))")
def lineage_roots(s, d):
    """J11."""
    return lineage.roots(events(s, d), "label", "lineage")


@query(_IDS + " select label, lineage from i where not exists (select 1 from i j where j.label = i.label and j.lineage <> i.lineage and starts_with(i.lineage, j.lineage || '.'))")
def lineage_roots_strict(s, d):
    return lineage.roots(events(s, d), "label", "lineage", strict=True)


@query(_IDS + """, r as (select label, lineage from i where not exists (select 1 from i j where j.label = i.label and j.lineage <> i.lineage and starts_with(i.lineage, j.lineage)))
select e.label, r.lineage as root, round(floor(us / 9e8) * 0.25, 6) as round_time_hours, round(sum(area), 6) as area, count(*)::bigint as one, min(us) as us from e join r on r.label = e.label and (e.lineage = r.lineage or starts_with(e.lineage, r.lineage || '.')) group by all""")
def lineage_rollup(s, d):
    """J10, A2."""
    e = events(s, d).withColumn("round_time_hours", F.floor(F.col("us") / 9e8) * 0.25).withColumn("one", F.lit(1.0))
    out = lineage.rolled_up(e, "label", "lineage", "round_time_hours", ["us", "event_id"], ["area", "one"], ["us"])
    return shown(out.withColumn("one", F.col("one").cast("bigint")))


@query(_IDS + ", l as (select label, lineage, max(us) as us from e group by all) select l.label, l.lineage, l.us from l where not exists (select 1 from i j where j.label = l.label and j.lineage <> l.lineage and starts_with(j.lineage, l.lineage))")
def vanished_colonies(s, d):
    """W2, J12."""
    return lineage.vanished(events(s, d), "label", "lineage", "us").select("label", "lineage", "us")


@query(_IDS + " select label, lineage, regexp_replace(lineage, '\\.?[^.]*$', '') as parent from i")
def lineage_parents(s, d):
    """F9."""
    return events(s, d).select("label", "lineage").distinct().withColumn("parent", lineage.parent(F.col("lineage")))


# experiment, condition, repeat of an order: region, segment, nation
def _conditions(s, d):
    o = read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select("o_orderkey", F.col("r_name").alias("experiment"), F.col("c_mktsegment").alias("medium"), F.col("n_name").alias("nation"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("concentration"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("row"), F.month("o_orderdate").alias("col"))


_COND = """c as (select o_orderkey, r_name as experiment, c_mktsegment as medium, n_name as nation, substr(o_orderpriority, 1, 1)::int - 1 as concentration, o_totalprice as price, o_orderstatus as row_, month(o_orderdate) as col_
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query(f"with {_COND} select o_orderkey, dense_rank() over (partition by experiment, medium order by nation)::bigint as repeat from c")
def repeat_ranks(s, d):
    """W5."""
    return conditions.repeats(_conditions(s, d), ["experiment", "medium"], ["concentration"], "nation").select("o_orderkey", "repeat")


@query(f"""with {_COND}, f as (select experiment, medium, nation, min(o_orderkey) as k from c group by all), r as (select *, row_number() over (partition by experiment, medium order by k) as n from f)
select o_orderkey, r.n::bigint as replicate from c join r on r.experiment = c.experiment and r.medium = c.medium and r.nation = c.nation""")
def replicate_numbers(s, d):
    """W6, J14."""
    return conditions.replicates(_conditions(s, d), ["experiment", "medium"], "nation", "o_orderkey").select("o_orderkey", "replicate")


@query(f"""with {_COND}, n as (select experiment, count(distinct row_) as n from c where col_ <> 12 group by experiment), f as (select *, coalesce(sum(n) over (order by experiment rows between unbounded preceding and 1 preceding), 0) as o from n),
x as (select *, dense_rank() over (partition by experiment, col_ = 12 order by row_) as k from c)
select o_orderkey, (case when col_ = 12 then (k - 1) % n else k - 1 end + 1 + o)::bigint as repeat from x join f on f.experiment = x.experiment""")
def repeats_beside_controls(s, d):
    """W7, P9."""
    return conditions.repeats_beside_control(_conditions(s, d), "experiment", "row", "col").select("o_orderkey", "repeat")


@query(f"with {_COND} select o_orderkey, round(price / avg(case when concentration = 0 then price end) over (partition by experiment, medium), 6) as price_normalised from c")
def normalised_to_control(s, d):
    """A3."""
    return shown(conditions.normalised(_conditions(s, d), "price", ["experiment", "medium"], "concentration").select("o_orderkey", "price_normalised"))


@query(f"""with {_COND}, g as (select experiment, col_, avg(price) as m from c group by experiment, col_), m as (select *, row_number() over (partition by experiment order by col_) as n from g)
select o_orderkey, round(price / m, 6) as price_to_self from c left join m on m.experiment = c.experiment and m.n = 2""")
def normalised_to_second_bin(s, d):
    """A4, W9."""
    return shown(conditions.normalised_to_self(_conditions(s, d), "price", ["experiment"], "col").select("o_orderkey", "price_to_self"))


@query("""select l_orderkey, l_linenumber::bigint as l_linenumber, round(greatest(l_tax, l_discount), 6) as concentration, case when l_tax = greatest(l_tax, l_discount) then 'tax' when l_discount = greatest(l_tax, l_discount) then 'discount' end as antibiotic from lineitem""")
def dominant_columns(s, d):
    """P12."""
    li = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax (uM)"), F.col("l_discount").alias("discount (uM)"))
    return shown(conditions.dominant(li, ["tax (uM)", "discount (uM)"]).select("l_orderkey", "l_linenumber", "concentration", "antibiotic"))


@query("select c_custkey, coalesce(c_mktsegment, 'none') as segment from customer where c_nationkey is not distinct from 3 or c_mktsegment is not distinct from 'BUILDING'")
def null_safe_predicate(s, d):
    """P10, P11."""
    c = read(s, d, "customer").where(conditions.matches(c_nationkey=3) | conditions.matches(c_mktsegment="BUILDING"))
    return conditions.replaced_name(c.withColumn("segment", F.lit(None).cast("string")), "c_mktsegment", "segment").select("c_custkey", F.coalesce("segment", F.lit("none")).alias("segment"))


# pixels: line items, labels by supplier and by part
def _pixels(s, d):
    gt = (F.col("l_suppkey") % 50).cast("int")
    return read(s, d, "lineitem").select(F.col("l_returnflag").alias("img"), F.when(F.col("l_partkey") % 10 == 0, (F.col("l_partkey") % 50).cast("int")).otherwise(gt).alias("pred"), gt.alias("gt"))


_PIXELS = """p as (select l_returnflag as img, (case when l_partkey % 10 = 0 then l_partkey % 50 else l_suppkey % 50 end)::bigint as pred, (l_suppkey % 50)::bigint as gt from lineitem),
ct as (select img, pred, gt, count(*) as n from p group by all)"""


@query(f"with {_PIXELS} select * from ct")
def contingency(s, d):
    return big(scoring.contingency(_pixels(s, d)))


@query(f"""with {_PIXELS}, t as (select img, sum(n) filter (where pred <> 0 and gt <> 0) as tp, sum(n) filter (where pred <> 0 and gt = 0) as fp, sum(n) filter (where pred = 0 and gt <> 0) as fn, sum(n) filter (where pred = 0 and gt = 0) as tn,
  sum(n) filter (where pred = gt) as eq, sum(n) as n, count(distinct nullif(pred, 0)) as n_pred, count(distinct nullif(gt, 0)) as n_gt from (select * from ct) group by img)
select img, round(tp / (tp + coalesce(fp, 0) + coalesce(fn, 0)), 6) as iou, round(2 * tp / (2 * tp + coalesce(fp, 0) + coalesce(fn, 0)), 6) as dice, round(tp / (tp + coalesce(fp, 0)), 6) as "precision", round(tp / (tp + coalesce(fn, 0)), 6) as recall,
  round(eq / n, 6) as accuracy, round(coalesce(fp, 0) / (coalesce(fp, 0) + coalesce(tn, 0)), 6) as fpr, round(coalesce(fn, 0) / (coalesce(fn, 0) + tp + coalesce(fn, 0)), 6) as fnr, n_pred, n_gt from t""")
def mask_comparison(s, d):
    """B1-B5, B11."""
    return shown(scoring.compare(scoring.contingency(_pixels(s, d))))


@query("""with t as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality = 1 and toxic = 0) as fp, count(*) filter (where quality = 0 and toxic = 1) as fn, count(*) filter (where quality = toxic) as eq, count(*) as n from labels)
select 'all' as img, round(tp / (tp + fp + fn), 6) as iou, round(2 * tp / (2 * tp + fp + fn), 6) as dice, round(eq / n, 6) as accuracy from t""")
def binary_comparison(s, d):
    """B1-B4 on two flags."""
    x = read(s, d, "labels").select(F.lit("all").alias("img"), F.col("quality").cast("int").alias("pred"), F.col("toxic").cast("int").alias("gt"))
    return shown(scoring.compare(scoring.contingency(x)).select("img", "iou", "dice", "accuracy"))


_AREAS = "pa as (select img, pred, sum(n) as pa from ct where pred <> 0 group by all), ga as (select img, gt, sum(n) as ga from ct where gt <> 0 group by all)"


@query(f"""with {_PIXELS}, {_AREAS}, o as (select ct.img, ct.gt, ct.pred, n / (pa + ga - n) as iou from ct join pa on pa.img = ct.img and pa.pred = ct.pred join ga on ga.img = ct.img and ga.gt = ct.gt),
b as (select *, row_number() over (partition by img, gt order by iou desc, pred) as r from o) select img, round(coalesce(avg(iou) filter (where r = 1 and iou >= 0.5), 0), 6) as matched_iou from b group by img""")
def matched_overlap(s, d):
    """B6."""
    return shown(scoring.matched_iou(scoring.contingency(_pixels(s, d))))


@query(f"""with {_PIXELS}, {_AREAS}, m as (select ct.img, ct.gt, ct.pred from ct join pa on pa.img = ct.img and pa.pred = ct.pred where ct.gt <> 0 and n / pa >= 0.75),
g as (select ga.img, ga.gt, count(m.pred) as k from ga left join m on m.img = ga.img and m.gt = ga.gt group by all), l as (select pa.img, count(*) as lone from pa anti join m on m.img = pa.img and m.pred = pa.pred group by pa.img)
select g.img, (sum(case when k = 0 then 1 else k - 1 end) + coalesce(max(lone), 0))::bigint as errors, coalesce(max(lone), 0)::bigint as unmatched from g left join l on l.img = g.img group by g.img""")
def segmentation_errors(s, d):
    """B7."""
    return big(scoring.errors(scoring.contingency(_pixels(s, d))).select("img", "errors", "unmatched"))


@query(f"with {_PIXELS}, {_AREAS}, k as (select img, unnest(range(1, max(gt) + 1)) as gt from ga group by img) select k.img, k.gt, coalesce(ga, 0)::bigint as area from k left join ga on ga.img = k.img and ga.gt = k.gt")
def label_areas(s, d):
    """A11."""
    return big(scoring.areas(scoring.contingency(_pixels(s, d))))


@query(f"""with {_PIXELS}, {_AREAS} select a.img, a.img as species, g as cell_count, round(p.m, 6) as mean_pred_area, round(a.m, 6) as mean_gt_area, round(p.m / a.m - 1, 6) as area_error from (select img, count(*) as g, sum(ga) / max(gt) as m from ga group by img) a join (select img, sum(pa) / max(pred) as m from pa group by img) p on p.img = a.img""")
def scoring_results(s, d):
    """B9, B10."""
    return shown(scoring.results(scoring.metrics(scoring.contingency(_pixels(s, d)))).drop("mean_errors"))


# points: frames by label, the first two components as places
def _points(s, d):
    x = lambda i: F.col("embedding")[i].cast("double") * 100
    return read(s, d, "embeddings").where("label is not null").select(F.lit("a").alias("label"), F.col("label").cast("bigint").alias("time_index"), F.col("vec_id").alias("id"), x(0).alias("x"), x(1).alias("y"))


_POINTS = "pt as (select 'a' as label, label::bigint as time_index, vec_id as id, embedding[1]::double * 100 as x, embedding[2]::double * 100 as y from embeddings where label is not null)"


@query(f"""with {_POINTS}, c as (select a.time_index, a.id, b.id as o, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist from pt a join pt b on b.time_index = a.time_index - 1)
select pt.id as left_id, coalesce(m.o, -1) as right_id, round(m.dist, 6) as distance from pt left join (select id, arg_min(o, (dist, o)) as o, min(dist) as dist from c where dist < 10 group by id) m on m.id = pt.id""")
def nearest_in_previous(s, d):
    """J5."""
    p = _points(s, d)
    before = p.withColumn("time_index", F.col("time_index") + 1)
    return shown(spatial.nearest_within(p, before, ["time_index"], 10.0).select("left_id", "right_id", "distance"))


@query(f"with {_POINTS} select a.id as left_id, b.id as right_id from pt a join pt b on b.time_index = a.time_index and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4")
def points_within(s, d):
    """J8."""
    p = _points(s, d)
    return spatial.within(p, p, ["time_index"], 2.0).select("left_id", "right_id")


@query(f"""with {_POINTS}, c as (select a.time_index, a.id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d2 from pt a join pt b on b.time_index = (select min(time_index) from pt z where z.time_index > a.time_index) group by all)
select 'a' as label, time_index, round(avg(1 / (0.01 * d2 + 1)), 6) as score from c group by time_index""")
def neighbour_scores(s, d):
    """J6."""
    return shown(spatial.neighbour_scores(_points(s, d)))


@query("select label, time_index, lead as next from (select 'a' as label, label::bigint as time_index, lead(label::bigint) over (order by label) as lead from (select distinct label from embeddings where label is not null)) where lead is not null")
def frame_pairs(s, d):
    """J19."""
    return spatial.pairs_of_frames(_points(s, d), "label", "time_index")


@query()
def tracked_points(s, d):
    """J5 with ids handed on; a fold in time."""
    return spatial.tracked(_points(s, d))


@query("""with o as (select o_orderkey as cell, month(o_orderdate) as r, day(o_orderdate) as c from orders), p as (select month(l_shipdate) as r, day(l_shipdate) as c, max(l_suppkey) as owner from lineitem group by all)
select cell, coalesce(owner, -1) as owner from o left join p on p.r = o.r and p.c = o.c""")
def containment(s, d):
    """J3."""
    cells = read(s, d, "orders").select(F.lit(0).alias("f"), F.col("o_orderkey").alias("cell"), F.month("o_orderdate").alias("r"), F.dayofmonth("o_orderdate").alias("c"))
    px = read(s, d, "lineitem").select(F.lit(0).alias("f"), F.col("l_suppkey").alias("object"), F.month("l_shipdate").alias("r"), F.dayofmonth("l_shipdate").alias("c"))
    return spatial.owners_by_containment(cells, px, ["f"]).select("cell", "owner")


@query("select distinct l_suppkey as id, o_custkey as other from lineitem join orders on l_orderkey = o_orderkey")
def outlines_touching(s, d):
    """J20."""
    a = read(s, d, "lineitem").select(F.lit(0).alias("f"), F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("r"), F.lit(0).alias("c"))
    b = read(s, d, "orders").select(F.lit(0).alias("f"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("r"), F.lit(0).alias("c"))
    return spatial.touching(a, b, ["f"]).select("id", "other")


@query("select d.doc_id, l.doc_id is null as is_debris_ml from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id")
def debris_flags(s, d):
    """J16, S20."""
    return guards.flagged(read(s, d, "documents").select("doc_id"), read(s, d, "labels"), "doc_id", "is_debris_ml")


@query("select count(*) as unmatched from documents d anti join labels l on l.doc_id = d.doc_id")
def unmatched_count(s, d):
    """U6."""
    return guards.unmatched(read(s, d, "documents"), read(s, d, "labels"), "doc_id")


@query("select s_suppkey as k, s_name as name, null::varchar as segment from supplier union all select c_custkey, c_name, c_mktsegment from customer")
def widened_union(s, d):
    """U1, U2."""
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return conditions.union([a, None, read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))])


@query("select distinct l_suppkey % 50 as label from lineitem where l_suppkey % 50 <> 0")
def labels_without_background(s, d):
    """U3, U4."""
    return guards.labels(read(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("label")), "label")


@query("""with x as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) select o_orderkey from x where i >= 10 and i < 500 and (i - 10) % 7 = 0""")
def sliced(s, d):
    """S2."""
    x = series.positioned(read(s, d, "orders").select("o_orderkey"), "o_orderkey", "i")
    return series.projected_steps(x, "i", 10, 500, 7).select("o_orderkey")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_fields(s, d):
    """S14, S15, F23."""
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""select o_orderkey, coalesce(isfinite(try_cast(o_orderpriority as double)), false) as number_like, replace(translate(o_orderpriority, '/%*:<>|"''', ''), ' ', '_') as file, chr((65 + o_orderkey % 26)::int) as letter,
  least(abs(o_orderkey % 10 - o_custkey % 10), 10 - abs(o_orderkey % 10 - o_custkey % 10)) as ring, round(o_totalprice * 0.112, 6) as um, round(o_totalprice * 0.112 * 0.112, 6) as um2,
  printf('%02d:%02d:%02d', floor(o_totalprice / 3600)::bigint, floor(o_totalprice)::bigint % 3600 // 60, floor(o_totalprice)::bigint % 60) as clock, split_part(o_orderpriority, '-', 1) as key from orders""")
def scalar_functions(s, d):
    """F1, F8, F10, F17, F18, F20, F21."""
    o = read(s, d, "orders")
    return shown(o.select("o_orderkey", scalar.is_float(F.col("o_orderpriority")).alias("number_like"), scalar.safe_filename(F.col("o_orderpriority")).alias("file"), scalar.row_letter(F.col("o_orderkey") % 26).alias("letter"), scalar.ring_distance(F.col("o_orderkey") % 10, F.col("o_custkey") % 10, F.lit(10)).alias("ring"), scalar.to_um(F.col("o_totalprice")).alias("um"), scalar.to_um(F.col("o_totalprice"), power=2).alias("um2"), scalar.clock(F.col("o_totalprice")).alias("clock"), F.split("o_orderpriority", "-")[0].alias("key")))


@query("""select p_partkey, chr((65 + r)::int) || (c + 1) as pad, c * 9000.0 - 49500 as x, r * 9000.0 - 31500 as y, chr((65 + r)::int) || (c + 1) as nearest from (select p_partkey, p_partkey // 12 % 8 as r, p_partkey % 12 as c from part)""")
def plate_pads(s, d):
    """F10-F14."""
    p = read(s, d, "part").select("p_partkey", F.concat(F.char(F.floor(F.col("p_partkey") / 12) % 8 + 65), (F.col("p_partkey") % 12 + 1).cast("string")).alias("pad"))
    p = plates.with_pad(p, "pad", plates.PLATES[96])
    x, y = plates.center(F.col("row_index"), F.col("col"), plates.PLATES[96])
    return p.select("p_partkey", "pad", x.alias("x"), y.alias("y")).withColumn("nearest", plates.pad_at(F.col("x"), F.col("y"), plates.PLATES[96]))


@query("""select r * 10 + c as k, (r * 10 + case when r % 2 = 1 then 9 - c else c end + 1)::bigint as position from (select unnest(range(6)) as r) a, (select unnest(range(10)) as c) b""")
def plate_traversal(s, d):
    """T5."""
    k = s.range(60).select(F.col("id").alias("k"), F.floor(F.col("id") / 10).alias("r"), (F.col("id") % 10).alias("c"))
    return plates.traversal(k, "r", "c").select("k", "position")


@query(f"""with {EVENTS}, x as (select series_key, ((row_number() over (partition by series_key order by us, event_id) - 1) * 905.5)::double as t, round(area, 3) as v, (series_key % 12 + 1)::bigint as col from e)
select series_key, t as time, round(t / 86400, 6) as time_days, t as round_time, round(t / 86400, 6) as round_time_days, round(t / 3600, 6) as round_time_hours, v as "OD600", 'A' as "row", col, 'x' as experiment, 'A' || col as pad_name, 'x_A' || col as labelid, true as named from x""")
def plate_reader_table(s, d):
    """A reader's text of each user, parsed again."""
    e = events(s, d).groupBy("series_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", F.round("area", 3).alias("v")))), lambda q: q.v).alias("v"))
    number = lambda c: F.transform(c, lambda v: F.format_string("%.3f", v))
    times = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: (i * 905.5))
    text = F.concat(F.lit("header\nt "), F.array_join(number(times), " "), F.lit(" C 37.0 A"), (F.col("series_key") % 12 + 1).cast("string"), F.lit(" note "), F.array_join(number(F.col("v")), " "), F.lit(";\nend"))
    out = tables.plate_reader(e.select(F.col("series_key").cast("string").alias("path"), text.alias("content")), "x")
    same = F.concat("row", F.col("col").cast("string")) == F.col("pad_name")
    return rounded(out.select(F.col("path").cast("bigint").alias("series_key"), "time", "time_days", "round_time", "round_time_days", "round_time_hours", "OD600", "row", F.col("col").cast("bigint").alias("col"), "experiment", "pad_name", "labelid", same.alias("named")))


@query()
def smoothed_series(s, d):
    """W13, K1."""
    e = events(s, d).where("area > 0").select("series_key", "event_id", "time", "area")
    return growth.smoothed(e, ["series_key"], "time", "area")


@query()
def growth_rates(s, d):
    """W14, K2, K3, K12."""
    e = events(s, d).where("area > 0").select("series_key", "event_id", (F.col("us") / 3.6e9).alias("hours"), "area")
    return growth.growth_rates(e, ["series_key"], "hours", ["area"])


def synthetic_frames(s: SparkSession, labels: int = 4, times: int = 4, size: int = 128) -> DataFrame:
    """Bright discs that grow, a frame for each label and time."""
    import pandas as pd

    def draw(batches):
        import numpy as np

        for b in batches:
            rows = []
            for i in b["id"]:
                label, t = divmod(int(i), times)
                yy, xx = np.mgrid[:size, :size]
                a = np.full((size, size), 30.0)
                for k in range(2):
                    a[(yy - 48 - 30 * k - label) ** 2 + (xx - 45 - 34 * k) ** 2 <= (9 + t) ** 2] = 200
                rows.append((f"f{label}", t, None, 600.0 * t, str(t), segmentation.image_of(a.astype(np.uint8))))
            yield pd.DataFrame(rows, columns=schema.FRAMES.names)

    return s.range(labels * times).mapInPandas(draw, schema.FRAMES)


@query()
def segmented_objects(s, d):
    """I1-I3, I8, I14, P13, P14 on drawn frames."""
    o = segmentation.objects(synthetic_frames(s))
    return o.select("label", "time_index", "kind", "object_index", F.round("area", 6).alias("area"), F.round(scalar.contour_area(F.col("contour")), 6).alias("shoelace"), "on_border")


@query()
def segmented_lineages(s, d):
    """J3, J4, J7, the lineage fold."""
    return segmentation.lineages(segmentation.objects(synthetic_frames(s)))


def synthetic_stacks(s: SparkSession) -> DataFrame:
    """Drawn frames, a label's times as depths."""
    return synthetic_frames(s, 2, 3).withColumn("z_index", F.col("time_index")).withColumn("time_index", F.lit(0))


@query()
def focused_frames(s, d):
    """I18-I20 on drawn stacks: the focused images' digests, for both settings of backlash."""
    z = synthetic_stacks(s)
    small, large = (segmentation.flattened(z, large_backlash=x).select("label", "time_index", "image.h", "image.w", F.sha2("image.px", 256).alias(n)) for x, n in ((False, "digest"), (True, "digest_large_backlash")))
    return small.join(large.select("label", "time_index", "digest_large_backlash"), ["label", "time_index"])


@query()
def sharpest_planes(s, d):
    """T6, I16 on drawn stacks."""
    return segmentation.sharpest(synthetic_stacks(s))


@query("""select l.l_orderkey, l.l_linenumber, l.l_quantity::double as q, o.o_orderpriority as priority from (select *, case when l_linenumber % 5 = 0 then 'NaN'::double when l_linenumber % 7 = 0 then null else l_quantity end as v from lineitem) l
left join (select o_orderkey, o_orderpriority from orders where o_orderkey % 2 = 0) o on o.o_orderkey = l.l_orderkey where l.l_suppkey - 5 >= 0 and l.v is not null and not isnan(l.v)""")
def guarded_rows(s, d):
    """P1, P7, P8."""
    v = F.when(F.col("l_linenumber") % 5 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity").cast("double"))
    cells = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") - 5).alias("id"), v.alias("v"), F.col("l_quantity").cast("double").alias("q"))
    about = read(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return guards.with_metadata(guards.present(guards.identified(cells), "v"), about, "l_orderkey").select("l_orderkey", "l_linenumber", "q", "priority")


@query("select user_id as series_key, event_id from events where user_id in (select user_id from events group by user_id having count(*) > 20)")
def long_tracks(s, d):
    """P17."""
    return guards.tracked(read(s, d, "events").select(F.col("user_id").alias("series_key"), "event_id"), ["series_key"])


@query("select p_partkey, p_size > 5 and p_partkey % 100 > 10 and p_size + 3 < 45 and p_partkey % 100 + 4 < 90 as inside from part")
def boxes_inside(s, d):
    """P15."""
    box = F.col("p_size"), F.col("p_partkey") % 100, F.lit(3), F.lit(4)
    return read(s, d, "part").select("p_partkey", guards.inside(box, (5, 10, 40, 80)).alias("inside"))


@query("select distinct l_suppkey as id from lineitem join (select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_orderkey % 50 = 1) on o_orderkey = l_orderkey")
def objects_annotated(s, d):
    """P19."""
    marked = read(s, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("place"))
    return guards.holding(read(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("place")), marked, ["place"])


@query("""with w as (select l_orderkey as id, count(*) as area, arg_max(l_linenumber, l_quantity * 100 - l_linenumber) as r from lineitem group by all)
select id, area, r, case when area < 3 or r % 3 = 0 then false end as keep from w""")
def colony_rule(s, d):
    """P21."""
    px = read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("double").alias("edt"), F.col("l_linenumber").alias("r"), F.lit(0).alias("c"))
    w = guards.widest_point(px, ["id"], "edt", ("r", "c"))
    return big(w.select("id", "area", "r", guards.keep_rule(F.col("area"), F.col("r") % 3 == 0, 3).alias("keep")))


@query("select l_suppkey as id, round(avg(l_quantity), 6)::double as mean, round(stddev_pop(l_quantity), 6)::double as std from lineitem group by all")
def pixel_statistics(s, d):
    """A12."""
    return shown(guards.pixel_statistics(read(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("double").alias("v")), ["id"], "v"))


@query("select l_orderkey as frame, count(*) as n, list_transform(list(l_linenumber order by l_linenumber), lambda x: x * x)::bigint[] as squares from lineitem group by all")
def frame_counts(s, d):
    """A8."""
    cells = read(s, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("bigint").alias("v"))
    lists = cells.groupBy("frame").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return guards.counted(cells, "frame").join(lists.select("frame", guards.each(F.col("v"), lambda x: x * x).alias("squares")), "frame")


@query("""select o_orderkey, (round(o_totalprice::double / pow(10, floor(log10(o_totalprice::double)) - 1)) * pow(10, floor(log10(o_totalprice::double)) - 1))::bigint::varchar as figures, o_orderpriority as unchanged,
  'Pad ' || o_custkey || ', ' || o_orderkey || '-' || o_orderstatus as pad from orders where o_totalprice >= 100""")
def text_functions(s, d):
    """F2, F6."""
    o = read(s, d, "orders").where("o_totalprice >= 100")
    pad = scalar.pad_label(F.concat_ws("_", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", scalar.two_figures(F.col("o_totalprice").cast("double")).alias("figures"), scalar.two_figures(F.col("o_orderpriority")).alias("unchanged"), pad.alias("pad"))


@query("select o_orderpriority, min(o_totalprice)::double as price_min, max(o_totalprice)::double as price_max from orders group by all")
def ranges_of_groups(s, d):
    """a key that is no column is passed over."""
    o = read(s, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("price"))
    return scalar.group(o, ["o_orderpriority", "no_such_key"]).agg(*scalar.min_max("price"))


# a parallelogram of each part: width, height and slant from its columns
_OUTLINE = "b as (select p_partkey, p_size + 3 as w, p_partkey % 40 + 2 as h, p_partkey % 7 as k, p_partkey % 90 as x, p_size as y from part)"


@query(f"""with {_OUTLINE}, c as (select *, w * h as area, 2 * w + 2 * sqrt(h * h + k * k) as perimeter from b)
select p_partkey, area::double as area, round(perimeter, 6) as perimeter, round(perimeter * perimeter / (4 * pi() * area), 6) as circularity, (x + 5)::bigint as box_x, (y - 4)::bigint as box_y, (w + k + 1)::bigint as box_w, (h + 1)::bigint as box_h,
  not (x + 5 > 15 and y - 4 > 15 and x + 5 + w + k + 1 < 185 and y - 4 + h + 1 < 85) as on_border, round(pi() - atan2(h, k) , 6) as turn, round(2 * pi(), 6) as turns from c""")
def outline_measures(s, d):
    """A21, I14, I24, P14, W11 on drawn outlines, moved by (5, -4)."""
    p = read(s, d, "part").select("p_partkey", (F.col("p_size") + 3).alias("w"), (F.col("p_partkey") % 40 + 2).alias("h"), (F.col("p_partkey") % 7).alias("k"), (F.col("p_partkey") % 90).alias("x"), F.col("p_size").alias("y"))
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x, y, w, h, k = (F.col(c) for c in "xywhk")
    p = p.withColumn("points", scalar.moved(F.array(at(x, y), at(x + w, y), at(x + w + k, y + h), at(x + k, y + h)), F.lit(5), F.lit(-4)))
    p = p.select("p_partkey", scalar.contour_area(F.col("points")).alias("area"), scalar.arc_length(F.col("points")).alias("perimeter"), scalar.bounding_box(F.col("points")).alias("box"), series.turning(F.col("points")).alias("angles"))
    box = [F.col(f"box.{c}").cast("bigint").alias(f"box_{c}") for c in "xywh"]
    turns = F.aggregate("angles", F.lit(0.0), lambda a, v: a + v)
    return shown(p.select("p_partkey", "area", "perimeter", scalar.circularity(F.col("perimeter"), F.col("area")).alias("circularity"), *box, scalar.on_border(F.col("box"), 100, 200).alias("on_border"), F.get("angles", F.lit(0)).alias("turn"), turns.alias("turns")))


@query("""with p as (select l_orderkey, list((l_quantity::double - 25) / 100 order by l_linenumber, l_quantity) as v from lineitem group by all)
select l_orderkey, list_position(v, list_max(v)) < list_position(v, list_min(v)) and list_max(v) > 0.05 and list_max(v) - list_min(v) > 0.1 as ring from p""")
def ring_profiles(s, d):
    """P18."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda q: (q.l_quantity.cast("double") - 25) / 100)
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(v.alias("v")).select("l_orderkey", scalar.ring_profile_peak(F.col("v")).alias("ring"))


_SPECIES = "case c_custkey % 4 when 0 then 'S. AUREUS' when 1 then 'escherichia coli' when 2 then 'Pseudomonas aeruginosa' end"


@query("""select c_custkey, case c_custkey % 4 when 0 then 2.5 when 2 then 1.0 else 1.5 end::double as sigma, case c_custkey % 4 when 0 then -2000 when 2 then -3000 else -1000 end::double as threshold,
  case c_custkey % 4 when 0 then 0.75 when 2 then 0.65 else 0.3 end::double as split_factor, case c_custkey % 4 when 0 then 15 when 2 then 30 else 60 end::bigint as least_mask from customer""")
def species_of_rows(s, d):
    """P20."""
    return schema.with_species(read(s, d, "customer").select("c_custkey", F.expr(_SPECIES).alias("species")), "species").drop("species")


@query("""select l_orderkey, l_linenumber, l_suppkey || '_' || l_linenumber as label_number, l_suppkey || l_returnflag as label_lineage from lineitem""")
def composite_keys(s, d):
    """P3, P6."""
    x = read(s, d, "lineitem").withColumn("label", F.col("l_suppkey").cast("string"))
    return guards.pruned(guards.with_keys(x, "label", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber", "no_such_column", "label_number", "label_lineage"])


@query("select l_returnflag, l_linenumber, avg(l_quantity)::decimal(18, 6)::double as mean, max(l_quantity)::double as greatest from lineitem group by all")
def tile_levels(s, d):
    """A19."""
    return shown(guards.tile_levels(read(s, d, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").cast("double").alias("v")), ["l_returnflag", "l_linenumber"], "v"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def masked_pixels(s, d):
    """J17."""
    mask = read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return spatial.masked(read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), mask, ["l_orderkey"])


@query("""select l_orderkey, l_linenumber, round(o_totalprice::double * 0.112, 6) as distance_to_edge from lineitem left join (select * from orders where o_orderstatus = 'F') on o_orderkey = l_orderkey""")
def edge_distances(s, d):
    """J18."""
    edt = read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("double").alias("edt"))
    return shown(spatial.edge_distance(read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), edt, ["l_orderkey"]))


@query("select l_orderkey as place, arg_max(l_linenumber, (l_quantity, -l_linenumber))::bigint as z, max(l_quantity)::double as v from lineitem group by all")
def depths_of_pixels(s, d):
    """T10."""
    x = read(s, d, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("z"), F.col("l_quantity").cast("double").alias("v"))
    return big(spatial.sharpest_depths(x, ["place"], "z", "v"))


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as choice, max(o_totalprice)::double as score from orders group by all")
def best_candidates(s, d):
    """T2."""
    x = read(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("choice"), F.col("o_totalprice").cast("double").alias("score"))
    return series.best(x, ["o_custkey"], "score", "choice")


@query("""with n as (select o_orderkey, o_orderstatus, o_custkey, row_number() over (partition by o_orderstatus, o_custkey order by o_orderkey) - 1 as child from orders) select o_orderkey, child::bigint as child, o_custkey || '.' || child as path from n""")
def numbered_children(s, d):
    """A18, T4."""
    return big(lineage.numbered_children(read(s, d, "orders"), "o_orderstatus", "o_custkey", "o_orderkey").select("o_orderkey", "child", "path"))


@query(f"""with {EVENTS}, x as (select series_key, row_number() over (partition by series_key order by us, event_id) as n, round(area, 3) as v from e) select series_key, ((n - 1) * 905.5)::double as time, v as "OD600" from x where n <= 4""")
def first_time_points(s, d):
    """T7."""
    e = events(s, d).groupBy("series_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", F.round("area", 3).alias("v")))), lambda q: q.v).alias("v"))
    number = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.3f", v)), " ")
    text = F.concat(F.lit("header\nt "), number(F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: i * 905.5)), F.lit(" B2 "), number(F.col("v")), F.lit(";\nend"))
    out = tables.plate_reader(e.select(F.col("series_key").cast("string").alias("path"), text.alias("content")), "x", limit=4)
    return rounded(out.select(F.col("path").cast("bigint").alias("series_key"), "time", "OD600"))


@query("""with ct as (select distinct l_returnflag as img, l_suppkey % 50 as gt from lineitem where l_suppkey % 50 <> 0), h as (select distinct l_returnflag as img, l_suppkey % 50 as gt from lineitem where l_quantity = 7)
select ct.img, count(h.gt) as with_cells, count(*) - count(h.gt) as without_cells from ct left join h on h.img = ct.img and h.gt = ct.gt group by all""")
def colony_errors(s, d):
    """B8 by intent."""
    px = read(s, d, "lineitem").select(F.col("l_returnflag").alias("img"), (F.col("l_suppkey") % 50).alias("gt"), (F.col("l_partkey") % 50).alias("pred"), "l_quantity")
    return scoring.colony_errors(scoring.contingency(px), px.where("l_quantity = 7").select("img", F.col("gt").alias("colony")))
