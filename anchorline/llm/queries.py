"""Queries of the training-data operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import consensus, encoding, leakage, mixing, pairs, sampling, splits
from anchorline.session import cut, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name and, if there is one, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TYPED = f"""
with kb as (select qid, min(nullif(upper({_TRIM.format("type")}), '')) as type from entity_kb where qid is not null group by qid),
one as (select instance_id, min(answer) answer from instances where instance_id is not null group by instance_id),
typed as (select instance_id, coalesce(kb.type, 'OTHER') as type from one left join kb on one.answer = kb.qid),
n as (select type as t, count(*) available from typed group by 1),
report as (select sample_id, s.type as type, target_share, target_share * sample_frac * (select count(*) from typed) target_rows, min_rows, coalesce(available, 0) available
           from (select distinct sample_id, type, target_share, sample_frac, min_rows from sample_targets) s left join n on coalesce(nullif(upper({_TRIM.format("s.type")}), ''), 'OTHER') = n.t)
"""


@query(_TYPED + "select sample_id, type from report where available < target_rows or available < min_rows")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Types of a sample that can't be met."""
    return sampling.unmet(read_table(spark, d, "instances"), read_table(spark, d, "entity_kb"), read_table(spark, d, "sample_targets"))


@query(_TYPED + """select sample_id, type, target_rows, cast(available as bigint) available,
cast(least(available, greatest(round(target_rows), min_rows)) as bigint) drawn from report where least(available, greatest(round(target_rows), min_rows)) > 0""")
def p1_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn for each type of each sample."""
    sample, report = sampling.matched_sample(read_table(spark, d, "instances"), read_table(spark, d, "entity_kb"), read_table(spark, d, "sample_targets"))
    drawn = sample.groupBy("sample_id", "type").agg(F.count_distinct("instance_id").alias("drawn"))
    return report.select("sample_id", "type", "target_rows", "available").join(drawn, ["sample_id", "type"])


@query(_TYPED + """, q as (select distinct sample_id, coalesce(nullif(upper(trim(type)), ''), 'OTHER') t, cast(least(available, greatest(round(target_rows), min_rows)) as bigint) quota from report),
d as (select sample_id, instance_id, typed.type as type, quota, row_number() over (partition by sample_id, typed.type order by md5(sample_id || ':' || instance_id || ':20'), instance_id) r from typed join q on t = typed.type)
select sample_id, instance_id, type from d where r <= quota""")
def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The samples themselves."""
    return sampling.matched_sample(read_table(spark, d, "instances"), read_table(spark, d, "entity_kb"), read_table(spark, d, "sample_targets"))[0]


_PAIRS = """
with m as (select distinct 'used_by' field, url record, unnest(used_by) item from image_data where url <> '' and len(used_by) > 0
  union select distinct 'visual_candidates', image.url, unnest(visual_candidates) from instances where image.url is not null),
r as (select 'used_by' field, count(distinct url) n from image_data where url <> '' and len(used_by) > 0
  union all select 'visual_candidates', count(distinct image.url) from instances),
s as (select field, item, count(*) n from m where item is not null group by all),
t as (select a.field, a.item qid_a, b.item qid_b, count(*) n_together from m a join m b on a.field = b.field and a.record = b.record and a.item < b.item group by all),
p as (select t.*, r.n n_records, x.n n_a, y.n n_b from t join r using (field) join s x on x.field = t.field and x.item = qid_a join s y on y.field = t.field and y.item = qid_b
  where n_together >= 6 and n_together * r.n >= 3 * x.n * y.n)
"""


@query(_PAIRS + "select field, qid_a, qid_b from p")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entities that use the same images far more often than chance gives."""
    return pairs.frequent_pairs(read_table(spark, d, "image_data"), read_table(spark, d, "instances")).select("field", "qid_a", "qid_b")


@query(_PAIRS + """select field, qid_a, qid_b, n_records, n_a, n_b, n_together, n_together * n_records / (n_a * n_b) lift,
(n_together + 0.5) * (n_records - n_a - n_b + n_together + 0.5) / ((n_a - n_together + 0.5) * (n_b - n_together + 0.5)) odds_ratio from p""")
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts, lift and odds ratio."""
    return pairs.frequent_pairs(read_table(spark, d, "image_data"), read_table(spark, d, "instances"))


_COUNTED = """select field, qid_a, qid_b, n_records, n_a, n_b, n_together, n_together * n_records / (n_a * n_b) lift,
(n_together + 0.5) * (n_records - n_a - n_b + n_together + 0.5) / ((n_a - n_together + 0.5) * (n_b - n_together + 0.5)) odds_ratio from p"""


@query(_PAIRS.replace("  where n_together >= 6 and n_together * r.n >= 3 * x.n * y.n)", ")") + _COUNTED)
def p2_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs together at all, rare ones and those of hot items included."""
    return pairs.frequent_pairs(read_table(spark, d, "image_data"), read_table(spark, d, "instances"), min_records=1, min_lift=0.0)


_LABELS = rf"""
with e as (select coalesce(nullif(user_id, ''), folder) user_id, exported_at, unnest(map_entries(instance_id_to_label_to_value)) e from user_state),
l0 as (select user_id, try_cast(trim(e.key) as bigint) instance_id, coalesce(exported_at, timestamp '0001-01-01') ts, nullif(upper({_TRIM.format("e.value[1][1].name")}), '') label from e),
l as (select user_id, instance_id, max({{'ts': ts, 'label': label}}).label as label from l0 where label is not null and instance_id is not null group by all),
v as (select instance_id, label, count(*) n from l group by all),
c as (select instance_id, sum(n) n_labels, max(n) m, arg_max(label, n) top from v group by all),
t as (select c.instance_id, case when n_labels >= 3 and (select count(*) from v where v.instance_id = c.instance_id and v.n = c.m) = 1 then top end majority, n_labels from c)
"""


@query(_LABELS + """select user_id from l join t using (instance_id) where majority is not null group by user_id
having 5 * sum(cast(label = majority as int)) < 3 * count(*)""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Annotators who agree with the consensus in less than 60 % of their instances."""
    return consensus.unreliable(consensus.discover(read_table(spark, d, "user_state"))[1])


def _rounds(n: int) -> str:
    """n rounds of truth discovery from the majority; once labels stay the same, further rounds change nothing."""
    low = "least_n * power(greatest(0.05, 1 - 2.0 / (9.0 * least_n) - 1.959963984540054 * sqrt(2.0 / (9.0 * least_n))), 3)".replace("least_n", "count(*)")
    out = """, m as materialized (select c.instance_id, c.n_labels, majority, (select sum(n * (n - 1)) from v where v.instance_id = c.instance_id) / nullif(c.n_labels * (c.n_labels - 1), 0) pair_agreement from c join t using (instance_id)),
s0 as materialized (select instance_id, majority as label from m)"""
    for k in range(1, n + 1):
        out += f""", w{k} as materialized (select user_id, cast(round({low} / (count_if(l.label <> s.label) + 0.5), 6) as decimal(18,6)) w from l join s{k - 1} s using (instance_id) group by user_id),
s{k} as materialized (select instance_id, arg_max(label, {{'w': w, 'label': label}}) as label, cast(max(w) as double) / cast(sum(w) as double) confidence from (select instance_id, label, sum(w) w from l join w{k} using (user_id) group by all) group by 1)"""
    return out


@query(_LABELS + _rounds(12) + "select instance_id, label, cast(n_labels as bigint) n_labels, confidence, pair_agreement, majority from s12 join m using (instance_id)")
def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """The consensus label of each instance with its confidence and agreement."""
    return consensus.discover(read_table(spark, d, "user_state"))[0].drop("settled")


@query(_LABELS + """select user_id, count(*) n_labels, count(majority) n_judged, cast(coalesce(sum(cast(label = majority as int)), 0) as bigint) n_agree
from l join t using (instance_id) group by user_id""")
def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Counts behind each annotator's reliability."""
    return consensus.discover(read_table(spark, d, "user_state"))[1].drop("weight", "errors")


@query(_LABELS + _rounds(12) + "select user_id, cast(w as double) weight from w12")
def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    """Each annotator's reliability weight."""
    return consensus.discover(read_table(spark, d, "user_state"))[1].select("user_id", "weight")


_GROUPS = r"""
with recursive i as (select distinct instance_id, nullif(lower(regexp_replace(regexp_replace(mention, '[\s\x{a0}\x{200b}\x{feff}]*(\([^()]*\)|\[[^\[\]]*\])[\s\x{a0}\x{200b}\x{feff}]*$', ''), '[\s\x{a0}\x{200b}\x{feff}]+', '', 'g')), '') m, answer a
  from instances where instance_id is not null),
k as (select instance_id, 'm' || m as k from i where m is not null union select instance_id, 'a' || a from i where a is not null),
h as (select k, min(instance_id) lo from k group by k),
e as (select distinct instance_id x, lo y from k join h using (k) where lo <> instance_id),
e2 as (select x, y from e union select y, x from e),
r as (select instance_id x, instance_id g from (select distinct instance_id from i) union select e2.x, r.g from r join e2 on e2.y = r.x and r.g < e2.x),
c as (select x instance_id, min(g) group_id from r group by x)
"""


@query(_GROUPS + "select instance_id, group_id from c where group_id in (select group_id from c group by 1 having count(*) > 1)")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Instances that must share their split with another one."""
    return splits.groups(read_table(spark, d, "instances")).filter("group_size > 1").select("instance_id", "group_id")


_SPLITS = """, g as (select c.instance_id, c.group_id, count(*) over (partition by c.group_id) group_size from c),
h as (select g.*, split, -weight / ln((cast('0x' || substr(md5(group_id || ':' || split || ':6'), 1, 13) as bigint) + 0.5) / 4503599627370496.0) score from g, (values ('train', 0.8), ('validation', 0.1), ('test', 0.1)) t(split, weight))
select instance_id, group_id, group_size, arg_max(split, score) as split from h group by all"""


@query(_GROUPS.replace("h as (select k,", "hh as (select k,").replace("join h using", "join hh using") + _SPLITS)
def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of each instance."""
    return splits.assign(splits.groups(read_table(spark, d, "instances")))


def _mix(spark: SparkSession, d: str, sizes: Callable[[DataFrame], DataFrame] = mixing.token_counts) -> tuple[DataFrame, DataFrame]:
    """(places, plan), the sources' sizes being taken from the places."""
    tokens = sizes(read_table(spark, d, "documents"))
    places = cut(mixing.prefix_sums(cut(tokens)))
    return places, cut(mixing.plan_mix(places, read_table(spark, d, "source_targets"), cut(mixing.source_totals(places))))


_MIX = f"""
with t as (select lower({_TRIM.format("source")}) s, sum(len(text)) n from documents where source is not null group by 1),
r as (select distinct mix_id, s.source, target_share * budget_frac * (select sum(n) from t) budget, coalesce(n, 0) * max_repeats have
      from source_targets s left join t on lower({_TRIM.format("s.source")}) = t.s)
"""


@query(_MIX + "select mix_id, source from r where have < budget")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't fill their share of a mix, from the report on the composed corpora. The SQL counts characters: any size measure gives the same rows."""
    return p8_report(spark, d).filter("short").select("mix_id", "source")


@query()
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and shares that each source reached in each mix."""
    places, plan = _mix(spark, d)
    return mixing.mix_report(cut(mixing.compose(places, plan)), plan)


@query()
def p8_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often they are repeated."""
    return mixing.compose(*_mix(spark, d))


_COMPOSED = f"""
with d as (select doc_id, lower({_TRIM.format("source")}) s, coalesce(length(text), 0) n from documents where source is not null),
p as (select *, sum(n) over (partition by s order by md5(doc_id || ':8'), doc_id rows unbounded preceding) upto from d), t as (select s, sum(n) n from d group by s),
r as (select distinct mix_id, source, target_share, target_share * budget_frac * (select sum(n) from t) budget, coalesce(n, 0) have, coalesce(max_repeats, 1) reps from source_targets x left join t on lower({_TRIM.format("x.source")}) = t.s),
k as (select *, have * reps < budget short, case when have = 0 then 0 when have * reps < budget then reps else least(reps, floor(budget / have)) end passes from r),
plan as (select *, case when have = 0 or short or passes >= reps then 0 else floor(budget - passes * have) end rest from k),
corpus as (select mix_id, doc_id, p.s source, p.n n_tokens, cast(passes + (upto <= rest)::int as int) n_repeats from plan join p on p.s = lower({_TRIM.format("plan.source")}) where passes + (upto <= rest)::int > 0)
"""


@query(_COMPOSED + "select mix_id, doc_id, source, n_tokens, n_repeats from corpus")
def p8_corpus_by_characters(spark: SparkSession, d: str) -> DataFrame:
    """The same with sizes in characters, which SQL can count."""
    return mixing.compose(*_mix(spark, d, mixing.char_counts))


@query(_COMPOSED + f"""select mix_id, source, target_share, budget, cast(coalesce(got, 0) as bigint) tokens, coalesce(got / nullif(sum(got) over (partition by mix_id), 0), 0.0) reached_share, short
from plan left join (select mix_id, source cs, sum(n_tokens * n_repeats) got from corpus group by all) g using (mix_id) where cs = lower({_TRIM.format("plan.source")})
union all select mix_id, source, target_share, budget, 0, 0.0, short from plan where (mix_id, lower({_TRIM.format("plan.source")})) not in (select (mix_id, source) from corpus)""")
def p8_report_by_characters(spark: SparkSession, d: str) -> DataFrame:
    places, plan = _mix(spark, d, mixing.char_counts)
    return mixing.mix_report(cut(mixing.compose(places, plan)), plan)


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of a test item."""
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


@query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same with the share of the item that was found."""
    return leakage.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text that went through a wrong decoding."""
    return encoding.garbled_documents(read_table(spark, d, "documents"))


@query()
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Their texts with the originals put back."""
    return encoding.restored_documents(read_table(spark, d, "documents"))
