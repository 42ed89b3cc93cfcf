"""Paired-vector analytics: differences, encoding, lift, categories, examples and training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.config import axis_dim
from postgrain.functions.text import escape_html
from postgrain.operators import lift as lf
from postgrain.operators import pairs as pr
from postgrain.operators import sae as ae
from postgrain.plans import features as plan
from registry import fixtures as fx
from registry import query

SIX = 6


def _diffs(spark, sf) -> DataFrame:
    return plan.pair_diffs(*fx.pair_table(spark, sf))


def _encoded(spark, sf) -> DataFrame:
    return ae.sae_encode(_diffs(spark, sf), fx.fixed_sae())


def _activity(spark, sf) -> DataFrame:
    return lf.axis_activity(_encoded(spark, sf))


def _lift(spark, sf) -> DataFrame:
    return lf.lift_matrix(_activity(spark, sf), fx.AXES)


def _cats(spark, sf) -> DataFrame:
    return lf.feature_categories(_lift(spark, sf))


def _rewrites(spark, sf) -> DataFrame:
    """Original and rewritten text of every pair that has a document."""
    pairs = fx.pair_table(spark, sf)[0].select("post_id", "axis")
    docs = fx.posts(spark, sf).select("post_id", F.col("text").alias("original"), F.concat("text", F.lit("!")).alias("rewrite"))
    return pairs.join(docs, "post_id")


@query(
    "diff_vectors",
    f"""with {fx.PAIRS} select pair_id, axis, direction, round(norm, 6) as norm, cast(i - 1 as int) as dim,
  round(diff[i], 6) as x
from pairs cross join range(1, 65) r(i)""",
)
def diff_vectors(spark, sf):
    long = _diffs(spark, sf).select("pair_id", "axis", "direction", "norm", F.posexplode("diff").alias("dim", "x"))
    return long.withColumns({"norm": F.round("norm", SIX), "x": F.round("x", SIX) + F.lit(0.0)})


@query(
    "sign_then_norm",
    f"""with {fx.PAIRS} select pair_id, round(list_sum(diff), 6) as total from pairs""",
)
def sign_then_norm(spark, sf):
    """The three steps one by one instead of fused."""
    diffs = pr.diff_vectors(pr.join_sides(*fx.pair_table(spark, sf)))
    unit = pr.l2_normalize(pr.sign_normalize(diffs))
    total = F.aggregate("diff", F.lit(0.0), lambda s, x: s + x)
    return unit.select("pair_id", F.round(total, SIX).alias("total"))


@query(
    "pair_stats",
    f"""with {fx.PAIRS} select count(*) as pairs, count(*) filter (direction = 'down') as flipped,
  max(len(diff))::int as dims, round(avg(norm), 6) as mean_norm, round(avg(greatest(norm, 1e-8)), 6) as mean_floored_norm
from pairs""",
)
def pair_stats(spark, sf):
    stats = pr.pair_stats(_diffs(spark, sf))
    means = ("mean_norm", "mean_floored_norm")
    return stats.withColumns({c: F.round(c, SIX) for c in means})


@query(
    "axis_distribution",
    f"""with {fx.PAIRS} select axis, count(*) as n, count(*) filter (direction = 'down') as flipped
from pairs group by axis""",
)
def axis_distribution(spark, sf):
    return pr.axis_distribution(fx.pair_table(spark, sf)[0])


@query(
    "mean_pool",
    """select label as text_id, cast(i - 1 as int) as dim,
  round(sum(case when vec_id % 3 <> 0 then embedding[i]::double else 0 end)
        / greatest(count(*) filter (vec_id % 3 <> 0), 1), 6) as x
from embeddings cross join range(1, 65) r(i) group by label, i""",
)
def mean_pool(spark, sf):
    mask = (F.col("vec_id") % 3 != 0).cast("int")
    tokens = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("text_id"), mask.alias("mask"), F.col("embedding").alias("vec")
    )
    pooled = pr.mean_pool(tokens)
    return pooled.select("text_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", SIX))


@query(
    "sae_encode_fixed",
    f"""with {fx.ACTIVATIONS} select pair_id, axis, cast(feature as int) as feature, round(value, 6) as value from acts""",
)
def sae_encode_fixed(spark, sf):
    long = lf.activations_long(_encoded(spark, sf).select("pair_id", "axis", "activations"))
    return long.withColumn("value", F.round("value", SIX))


@query(
    "sae_losses_fixed",
    f"""with {fx.ACTIVATIONS}, per as (
  select a.pair_id, any_value(list_inner_product(diff, diff)) - sum(diff[feature + 1] ^ 2)
           + sum((value - diff[feature + 1]) ^ 2) as recon,
         sum(value) as sparsity, count(*) filter (value > 0) as active
  from acts a join pairs p on p.pair_id = a.pair_id group by a.pair_id)
select round(avg(recon), 6) as recon, round(avg(sparsity), 6) as sparsity,
  round(avg(recon) + 0.05 * avg(sparsity), 6) as loss, round(sum(active) / ({fx.FIXED_FEATURES}.0 * count(*)), 6) as density from per""",
)
def sae_losses_fixed(spark, sf):
    losses = ae.sae_losses(_encoded(spark, sf), fx.fixed_sae())
    return losses.select(*(F.round(c, SIX).alias(c) for c in losses.columns))


DENSITY_SQL = f"""{fx.ACTIVATIONS}, density as (
  select cast(feature as int) as feature, avg((value > 0)::int) as density, max(value) <= 0 as never_active
  from acts group by feature)"""


@query(
    "feature_density",
    f"with {DENSITY_SQL} select feature, round(density, 6) as density, never_active from density",
)
def feature_density(spark, sf):
    return lf.feature_density(_activity(spark, sf)).withColumn("density", F.round("density", SIX))


@query("overall_density", f"with {fx.ACTIVATIONS} select round(avg((value > 0)::int), 6) as density from acts")
def overall_density(spark, sf):
    return lf.overall_density(_activity(spark, sf)).withColumn("density", F.round("density", SIX))


LIFT_SQL = f"""{DENSITY_SQL}, axes(ord, axis) as (values {fx.AXIS_LIST}), lift as (
  select d.feature, x.axis, x.ord, d.density,
         case when d.density < 0.01 then 0.0 else
           coalesce(avg((value > 0)::int) filter (a.axis = x.axis), 0)
           - coalesce(avg((value > 0)::int) filter (a.axis <> x.axis), 0) end as lift
  from density d cross join axes x join acts a on a.feature = d.feature
  group by d.feature, x.axis, x.ord, d.density),
cats as (
  select feature, round(density, 4) as density,
         case when density < 0.01 then 'dead' when abs(round(lift, 4)) >= 0.3 then 'confirms_axis'
              when abs(round(lift, 4)) >= 0.15 then 'partial_overlap' else 'novel_candidate' end as category,
         case when density >= 0.01 then axis end as best_axis,
         case when density >= 0.01 then round(lift, 4) else 0 end as best_lift
  from lift qualify row_number() over (partition by feature order by abs(round(lift, 4)) desc, ord) = 1)"""


@query(
    "lift_matrix",
    f"with {LIFT_SQL} select feature, axis, ord, round(density, 6) as density, round(lift, 6) + 0.0 as lift from lift",
)
def lift_matrix(spark, sf):
    return _lift(spark, sf).withColumns({"density": F.round("density", SIX), "lift": F.round("lift", SIX) + F.lit(0.0)})


@query("feature_categories", f"with {LIFT_SQL} select * from cats")
def feature_categories(spark, sf):
    return _cats(spark, sf)


@query(
    "category_counts",
    f"""with {LIFT_SQL} select category, count(*) as n,
  round(100.0 * count(*) / (select count(*) from cats), 1) as percent from cats group by category""",
)
def category_counts(spark, sf):
    return lf.category_counts(_cats(spark, sf))


@query(
    "axis_coverage",
    f"""with {LIFT_SQL} select x.ord, x.axis,
  count(*) filter (category = 'confirms_axis') as confirms, count(*) filter (category = 'partial_overlap') as partial,
  coalesce(string_agg('F' || feature, ' ' order by feature), '') as features,
  case when count(feature) > 0 then '✓' else '✗' end as covered
from axes x left join (select * from cats where category in ('confirms_axis', 'partial_overlap')) c
  on c.best_axis = x.axis group by x.ord, x.axis""",
)
def axis_coverage(spark, sf):
    covered = lf.axis_coverage(_cats(spark, sf), axis_dim(spark, fx.CONFIG))
    names = F.transform("features", lambda f: F.concat(F.lit("F"), f["feature"].cast("string")))
    return covered.withColumn("features", F.array_join(names, " "))


@query(
    "axis_best_feature",
    f"""with {LIFT_SQL}, best as (
  select ord, axis, feature, lift from lift where density >= 0.01 and lift <> 0
  qualify row_number() over (partition by axis order by abs(lift) desc, feature) = 1)
select x.ord, x.axis, coalesce(feature, -1) as feature, coalesce(round(lift, 6), 0) as lift,
  case when abs(coalesce(lift, 0)) >= 0.3 then 'confirms_axis' when abs(coalesce(lift, 0)) >= 0.15 then 'partial_overlap'
       else 'novel_candidate' end as category
from axes x left join best b on b.axis = x.axis""",
)
def axis_best_feature(spark, sf):
    return lf.axis_best_feature(_lift(spark, sf)).withColumn("lift", F.round("lift", SIX))


@query(
    "top_features",
    f"with {LIFT_SQL} select * from cats order by abs(best_lift) desc, feature limit 20",
)
def top_features(spark, sf):
    return lf.top_features(_cats(spark, sf), 20)


@query(
    "top_features_nonzero",
    f"with {LIFT_SQL} select * from cats where best_lift <> 0 order by abs(best_lift) desc, feature limit 10",
)
def top_features_nonzero(spark, sf):
    return lf.top_features(_cats(spark, sf), 10, nonzero=True)


@query(
    "heatmap_order",
    f"""with {LIFT_SQL}, m as (select feature, max(abs(lift)) as max_lift from lift group by feature)
select feature, round(max_lift, 6) as max_lift,
  (row_number() over (order by max_lift desc, feature))::int as place,
  round(greatest(max(max_lift) over (), 0.1), 6) as scale from m""",
)
def heatmap_order(spark, sf):
    order = lf.heatmap_order(_lift(spark, sf))
    return order.withColumns({c: F.round(c, SIX) for c in ("max_lift", "scale")})


@query(
    "density_hist",
    f"""with {DENSITY_SQL}, span as (select min(density) as lo, max(density) as hi, avg(density) as mean from density),
s as (select case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi, mean
      from span),
placed as (select least(floor((density - lo) / ((hi - lo) / 15)) + 1, 15)::int as bin from density cross join s)
select b::int as bin, round(lo + (b - 1) * (hi - lo) / 15, 6) as low, round(lo + b * (hi - lo) / 15, 6) as high,
  (select count(*) from placed where bin = b) as n, round(mean, 6) as mean
from range(1, 16) r(b) cross join s""",
)
def density_hist(spark, sf):
    hist = lf.density_hist(lf.feature_density(_activity(spark, sf)))
    return hist.withColumns({c: F.round(c, SIX) for c in ("low", "high", "mean")})


EXAMPLES_SQL = f"""{LIFT_SQL}, {fx.POSTS}, examples as (
  select a.*, row_number() over (partition by feature order by value desc, pair_id) as rn
  from acts a where value > 0 qualify rn <= 10)"""


@query(
    "feature_examples",
    f"""with {EXAMPLES_SQL}
select cast(feature as int) as feature, rn::int as rn, pair_id, e.post_id, axis, direction, round(value, 4) as activation,
  coalesce(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
           '''', '&#39;'), '') as original,
  length(coalesce(text || '!', '')) as n_rewrite
from examples e left join posts p on p.post_id = e.post_id""",
)
def feature_examples(spark, sf):
    top = lf.feature_examples(_encoded(spark, sf), _rewrites(spark, sf))
    return top.select(
        "feature",
        "rn",
        "pair_id",
        "post_id",
        "axis",
        "direction",
        F.round("value", 4).alias("activation"),
        escape_html(F.col("original")).alias("original"),
        F.length("rewrite").cast("bigint").alias("n_rewrite"),
    )


@query(
    "feature_report",
    f"""with {EXAMPLES_SQL}
select c.feature as f, c.density, c.category, c.best_axis, c.best_lift,
  (select count(*) from examples e where e.feature = c.feature and c.category <> 'dead') as n_examples,
  (select string_agg(pair_id, ' ' order by rn) from examples e where e.feature = c.feature and c.category <> 'dead') as pairs,
  (select round(l.lift, 4) + 0.0 from lift l where l.feature = c.feature and l.axis = 'tone') as lift_tone
from cats c""",
)
def feature_report(spark, sf):
    report = plan.report(_encoded(spark, sf), _rewrites(spark, sf), fx.AXES)
    ids = F.array_join(F.transform("examples", lambda e: e["pid"]), " ")
    return report.select(
        "f",
        "density",
        "category",
        "best_axis",
        "best_lift",
        F.size("examples").cast("bigint").alias("n_examples"),
        F.when(F.size("examples") > 0, ids).alias("pairs"),
        (F.element_at("lifts", "tone") + F.lit(0.0)).alias("lift_tone"),
    )


@query("sae_fit_report")
def sae_fit_report(spark, sf):
    """Train on all pairs with the default features and epochs, then report the learned features."""
    _, _, report = plan.fit_and_report(
        _diffs(spark, sf), _rewrites(spark, sf), fx.AXES, local_epochs=100
    )
    return report.select("f", "density", "category", "best_axis", "best_lift", F.size("examples").alias("n_examples"))


@query("sae_history")
def sae_history(spark, sf):
    return ae.sae_fit(_diffs(spark, sf), local_epochs=100)[1]


@query("axis_probe")
def axis_probe(spark, sf):
    return ae.axis_probe(_diffs(spark, sf), fx.AXES)


@query("l1_sweep")
def l1_sweep(spark, sf):
    return ae.l1_sweep(_diffs(spark, sf), [0.05, 0.10], local_epochs=100)
