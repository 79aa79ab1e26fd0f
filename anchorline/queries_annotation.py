"""Queries of annotator agreement and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions.strings import kappa_band
from anchorline.plans import annotate
from anchorline.registry import query
from anchorline.session import read_table

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LONG = rf"""with e as (select coalesce(nullif(user_id, ''), folder) annotator, exported_at, unnest(map_entries(instance_id_to_label_to_value)) e from user_state),
l0 as (select annotator, e.key instance_id, exported_at ts, e.value[1][1].name as label from e),
l1 as (select annotator, instance_id, arg_max(label, {{'ts': ts, 'label': label}}) as label from l0 where label is not null group by all),
long as (select annotator, instance_id, upper({_TRIM.format("label")}) as label from l1 where {_TRIM.format("label")} <> ''),
cats as (select cast(instance_id as varchar) instance_id, min(nullif(upper({_TRIM.format("k.type")}), '')) category from instances i left join entity_kb k on k.qid = i.answer where instance_id is not null group by 1),
v as (select instance_id, count(*) n_votes, cast(count_if(label = 'YES') as bigint) n_yes, cast(count_if(label = 'NO') as bigint) n_no from long group by 1),
voted as (select *, n_votes >= 2 is_multi, n_yes > 0 and n_no > 0 disagree, case when n_yes > n_no then 'YES' when n_no > n_yes then 'NO' else 'TIE' end majority, not (n_yes > 0 and n_no > 0) unanimous, abs(n_yes - n_no) margin from v)
"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    rows = annotate.labels(read_table(spark, d, "user_state"))
    return rows.withColumn("label", annotate.clean(F.col("label"))).filter("label <> ''")


def _categories(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, category): the type of the answer's entity."""
    kb = read_table(spark, d, "entity_kb").groupBy(F.col("qid").alias("answer")).agg(F.min(F.nullif(annotate.clean(F.col("type")), F.lit(""))).alias("category"))
    rows = read_table(spark, d, "instances").filter("instance_id is not null").select(F.col("instance_id").cast("string").alias("instance_id"), "answer").distinct()
    return rows.join(kb, "answer", "left").groupBy("instance_id").agg(F.min("category").alias("category"))


@query(_LONG + "select annotator, instance_id, label from long")
def labels_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d)


@query(_LONG + "select * from voted")
def vote_master(spark: SparkSession, d: str) -> DataFrame:
    return annotate.votes(_long(spark, d))


@query(_LONG + "select instance_id, n_votes, margin from voted where is_multi and margin <= 1")
def fragile(spark: SparkSession, d: str) -> DataFrame:
    return annotate.fragile(annotate.votes(_long(spark, d)))


@query(_LONG + """select annotator, cast(count_if(label = 'YES') as bigint) yes, cast(count_if(label = 'NO') as bigint) as no, cast(count_if(label not in ('YES', 'NO')) as bigint) other,
(select count(distinct instance_id) from long) - count(*) missing from long group by 1""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return annotate.label_table(_long(spark, d))


_PER = """, per as (select annotator, count(*) n, cast(count_if(label = 'YES') as bigint) yes, cast(count_if(label = 'NO') as bigint) as no from long group by 1), g as (select sum(n) n, sum(yes) yes, sum(no) as no from per)"""


@query(_LONG + _PER + " select annotator, per.n n, per.yes yes, per.no as no, 100 * per.yes / per.n yes_rate, 100 * per.no / per.n no_rate, 100 * per.yes / per.n - 100 * g.yes / g.n bias_yes, 100 * per.no / per.n - 100 * g.no / g.n bias_no from per, g")
def rates_and_bias(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each annotator and their signed gap to the pooled ones, unrounded: engines differ in exact ties."""
    return annotate.rates(_long(spark, d), None)


_KAPPA = """, s as (select x.instance_id instance_id, x.annotator a, y.annotator b, x.label la, y.label lb{extra} from long x join long y on x.instance_id = y.instance_id and x.annotator < y.annotator{join}),
c as (select {by}, la, lb, count(*) n from s group by all), t as (select {by}, sum(n) n_common, sum(case when la = lb then n else 0 end) same from c group by all),
ra as (select {by}, la as label, sum(n) na from c group by all), rb as (select {by}, lb as label, sum(n) nb from c group by all),
ch as (select {by}, sum(na * nb) chance from ra join rb using ({by}, label) group by all), ka as (select {by}, count(*) ka from ra group by all), kb as (select {by}, count(*) kb from rb group by all),
k as (select {by}, cast(n_common as bigint) n_common, case when n_common >= 2 and ka * kb > 1 then (same / n_common - coalesce(chance, 0) / (n_common * n_common)) / nullif(1 - coalesce(chance, 0) / (n_common * n_common), 0) end kappa
  from t join ka using ({by}) join kb using ({by}) left join ch using ({by}))
"""


@query(_LONG + _KAPPA.format(by="a, b", extra="", join="") + """select a, b, n_common, kappa, case when kappa is null then null when kappa >= 0.8 then 'Almost perfect' when kappa >= 0.6 then 'Substantial' when kappa >= 0.4 then 'Moderate'
when kappa >= 0.2 then 'Fair' when kappa >= 0 then 'Slight' else 'Poor' end band from k""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return annotate.kappa(annotate.shared(_long(spark, d)), ["a", "b"]).withColumn("band", kappa_band(F.col("kappa")))


@query(_LONG + _KAPPA.format(by="a, b", extra="", join="") + "select a, b, kappa from k union all select b, a, kappa from k union all select distinct annotator, annotator, 1.0 from long where annotator is not null")
def kappa_matrix(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    return annotate.kappa_matrix(annotate.kappa(annotate.shared(long), ["a", "b"]), long)


@query(_LONG + _KAPPA.format(by="a, b, category", extra=", category", join=" join cats on cats.instance_id = x.instance_id and category is not null") + "select a, b, category, n_common, kappa from k")
def kappa_per_category(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each pair of annotators in each category."""
    long = _long(spark, d).join(_categories(spark, d).filter("category is not null"), "instance_id")
    return annotate.kappa(annotate.shared(long, "category"), ["a", "b", "category"])


@query(_LONG + """select x.annotator a, y.annotator b, x.label label_a, cast(count_if(y.label = 'YES') as bigint) "YES", cast(count_if(y.label = 'NO') as bigint) "NO", cast(count_if(y.label = 'UNCERTAIN') as bigint) "UNCERTAIN"
from long x join long y on x.instance_id = y.instance_id and x.annotator < y.annotator group by all""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return annotate.confusion(annotate.shared(_long(spark, d)))


@query(_LONG + """, x as (select voted.*, category from voted left join cats using (instance_id))
select 'yes_rate' measure, 'all' as value, cast(sum(n_yes) as bigint) n, 100.0 * sum(n_yes) / nullif(sum(n_yes) + sum(n_no), 0) rate from x
union all select 'majority', majority, count(*), null from x group by majority union all select 'category', category, count(*), null from x where category is not null group by category""")
def vote_overview(spark: SparkSession, d: str) -> DataFrame:
    """The global YES rate and the counts of majorities and categories."""
    return annotate.overview(annotate.votes(_long(spark, d)).join(_categories(spark, d), "instance_id", "left"))


@query(_LONG + """, items as (select cast(instance_id as varchar) instance_id, min(mention) mention, min(answer) answer from instances where instance_id is not null group by 1)
select annotator, instance_id, label, mention, answer from long join items using (instance_id)""")
def labels_with_items(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the item they belong to; one of no item would raise."""
    items = read_table(spark, d, "instances").filter("instance_id is not null").groupBy(F.col("instance_id").cast("string").alias("instance_id")).agg(F.min("mention").alias("mention"), F.min("answer").alias("answer"))
    return annotate.to_items(_long(spark, d), items)


@query(_LONG + """select category, count(*) n, cast(count_if(is_multi) as bigint) n_multi, 100.0 * sum(n_yes) / nullif(sum(n_yes) + sum(n_no), 0) yes_rate,
100.0 * count_if(is_multi and unanimous) / nullif(count_if(is_multi), 0) agreement from voted join cats using (instance_id) where category is not null group by 1""")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return annotate.category_summary(annotate.votes(_long(spark, d)).join(_categories(spark, d), "instance_id"))


_TIMES = _LONG + """, b as (select coalesce(nullif(user_id, ''), folder) annotator, unnest(map_entries(instance_id_to_behavioral_data)) e from user_state),
ev as (select annotator, e.key instance_id, e.value.interactions x from b),
t0 as (select annotator, instance_id, x, list_min(list_transform(list_filter(x, lambda i: coalesce(i.event_type = 'navigation' and i.target = 'instance_load', false)), lambda i: i.timestamp)) t0 from ev),
raw as (select distinct annotator, instance_id, list_min(list_filter(list_transform(list_filter(x, lambda i: coalesce(i.event_type = 'annotation_change', false)), lambda i: i.timestamp), lambda t: coalesce(t >= t0, false))) - t0 t_raw from t0),
times as (select raw.*, category from raw left join cats using (instance_id) where t_raw is not null),
q as (select quantile_cont(t_raw, 0.25) q1, quantile_cont(t_raw, 0.75) q3 from times),
capped as (select times.*, least(t_raw, q3 + 1.5 * (q3 - q1)) t from times, q)
"""


def _times(spark: SparkSession, d: str) -> DataFrame:
    return annotate.decision_times(read_table(spark, d, "user_state")).join(_categories(spark, d), "instance_id", "left")


@query(_TIMES + "select annotator, instance_id, t_raw from times")
def decision_time(spark: SparkSession, d: str) -> DataFrame:
    return annotate.decision_times(read_table(spark, d, "user_state"))


@query(_TIMES + "select annotator, instance_id, t, t_raw > q3 + 1.5 * (q3 - q1) is_outlier from capped, q")
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return annotate.cap(_times(spark, d)).select("annotator", "instance_id", "t", "is_outlier")


@query(_TIMES + """select case when grouping(annotator) = 1 then 'ALL' else annotator end annotator, case when grouping(category) = 1 then 'ALL' else category end category,
count(t) n, round(avg(t), 6) mean, round(stddev_samp(t), 6) std, round(quantile_cont(t, 0.5), 6) median from capped group by grouping sets ((annotator, category), (annotator), ())
having grouping(category) = 1 or category is not null""")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.timing_summary(annotate.cap(_times(spark, d)))
    return out.select("annotator", "category", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@query(_TIMES + """, c as (select * from capped where category is not null), m as (select coalesce(annotator, 'ALL') annotator, coalesce(category, 'ALL') category, avg(t) t from c group by cube (annotator, category))
select annotator, round(max(case when category = 'LOC' then t end), 6) "LOC", round(max(case when category = 'ORG' then t end), 6) "ORG", round(max(case when category = 'PERS' then t end), 6) "PERS", round(max(case when category = 'ALL' then t end), 6) "ALL"
from m group by 1""")
def timing_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = annotate.timing_matrix(annotate.cap(_times(spark, d)), ["LOC", "ORG", "PERS"])
    return out.select("annotator", *[F.round(c, 6).alias(c) for c in ("LOC", "ORG", "PERS", "ALL")])


@query("""with f as (select user_id, min(ts) t0 from events where event_type = 'view' group by 1)
select e.user_id user_id, epoch(min(e.ts)) - epoch(any_value(t0)) as seconds from events e join f using (user_id) where e.event_type = 'purchase' and e.ts >= t0 group by e.user_id""")
def first_to_next_event(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each user's first view to the first later purchase."""
    e = read_table(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("us").alias("t0"))
    later = e.filter("event_type = 'purchase'").join(first, "user_id").filter("us >= t0")
    return later.groupBy("user_id").agg(((F.min("us") - F.first("t0")) / 1e6).alias("seconds"))


_BOX = ", ".join(f"quantile_cont(t, {q}) {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))


@query(_TIMES + f""", bx as (select category, annotator, {_BOX} from capped where category is not null and annotator is not null group by all)
select category, annotator, count(*) n, round(avg(t), 6) mean, round(stddev_samp(t), 6) std, round(any_value(q1), 6) q1, round(any_value(median), 6) median, round(any_value(q3), 6) q3,
round(min(case when t >= q1 - 1.5 * (q3 - q1) then t end), 6) whisker_low, round(max(case when t <= q3 + 1.5 * (q3 - q1) then t end), 6) whisker_high, round(max(t), 6) as max
from capped join bx using (category, annotator) group by all""")
def time_box_stats(spark: SparkSession, d: str) -> DataFrame:
    """Box statistics of the capped times per category and annotator."""
    out = annotate.box_stats(annotate.cap(_times(spark, d)), ["category", "annotator"])
    return out.select("category", "annotator", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q1", "median", "q3", "whisker_low", "whisker_high", "max")])


@query(_TIMES + ", p as (select quantile_cont(t_raw, 0.95) b from times) select annotator, instance_id, least(t_raw, b) t from times, p")
def winsorize_p95(spark: SparkSession, d: str) -> DataFrame:
    return annotate.cap(_times(spark, d), "p95").select("annotator", "instance_id", "t")


@query(_LONG + "select category, cast(count_if(not disagree) as bigint) agree, cast(count_if(disagree) as bigint) disagree from voted join cats using (instance_id) where is_multi and category is not null group by 1")
def agreement_by_category(spark: SparkSession, d: str) -> DataFrame:
    v = annotate.votes(_long(spark, d)).filter("is_multi").join(_categories(spark, d).filter("category is not null"), "instance_id")
    return v.groupBy("category").agg(F.count_if(~F.col("disagree")).alias("agree"), F.count_if("disagree").alias("disagree"))


@query(_LONG + "select category, annotator, label, count(*) n from long join cats using (instance_id) where category is not null group by cube (annotator), category, label")
def labels_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Labels per category, overall (null annotator) and for each annotator."""
    rows = _long(spark, d).join(_categories(spark, d).filter("category is not null"), "instance_id")
    return rows.groupingSets([["category", "annotator", "label"], ["category", "label"]], "category", "annotator", "label").agg(F.count(F.lit(1)).alias("n"))


@query(_LONG + "select is_multi, unanimous, majority, count(*) n, min(instance_id) as first from voted group by 1, 2, 3")
def vote_slices(spark: SparkSession, d: str) -> DataFrame:
    """Instances by coverage, unanimity and majority, with the first of each."""
    return annotate.votes(_long(spark, d)).groupBy("is_multi", "unanimous", "majority").agg(F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("first"))


@query(_LONG + "select * from (select category, instance_id, margin, row_number() over (partition by category order by margin desc, instance_id) rn from voted join cats using (instance_id) where category is not null) where rn = 1".replace("select * from", "select category, instance_id, margin from"))
def clearest_per_category(spark: SparkSession, d: str) -> DataFrame:
    """The instance with the largest margin of each category."""
    v = annotate.votes(_long(spark, d)).join(_categories(spark, d).filter("category is not null"), "instance_id")
    best = v.groupBy("category").agg(F.min(F.struct((-F.col("margin")).alias("m"), "instance_id")).alias("b"))
    return best.select("category", F.col("b.instance_id").alias("instance_id"), (-F.col("b.m")).alias("margin"))
