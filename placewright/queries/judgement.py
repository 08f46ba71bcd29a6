"""Thresholds, bands, catalogue, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers as L
from ..operators import learning, rules, verify
from ..sources import catalog
from . import adapters as A
from .registry import query

_GRID = "grid as (select 0.02 + k * (0.98 - 0.02) / 192 as threshold from (select unnest(range(0, 193)) as k))"
_RATES = f"""{A.SCORED}, {_GRID}, c as (select threshold, cast(count(*) filter (where label = 1 and probability >= threshold - 1e-9 * 0.005) as bigint) as tp, cast(count(*) filter (where label = 0 and probability >= threshold - 1e-9 * 0.005) as bigint) as fp,
   cast(count(*) filter (where label = 1 and probability < threshold - 1e-9 * 0.005) as bigint) as fn, cast(count(*) filter (where label = 0 and probability < threshold - 1e-9 * 0.005) as bigint) as tn from scored cross join grid group by 1),
   r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)"""


@query("threshold_table", f"with {_RATES} select round(threshold, 6) as threshold, tp, fp, fn, tn, round(p, 6) as \"precision\", round(r, 6) as recall from r")
def threshold_table(spark, sf):
    t = learning.threshold_table(A.scored(spark, sf))
    return t.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("threshold_recall", f"with {_RATES} select round(threshold, 6) as threshold, tp, fp from r order by (r >= 0.6) desc, case when r >= 0.6 then p else case when p + r > 0 then 5 * p * r / (4 * p + r) else 0 end end desc, threshold desc limit 1")
def threshold_recall(spark, sf):
    return learning.threshold_for_recall(learning.threshold_table(A.scored(spark, sf)), 0.6).select(F.round("threshold", 6).alias("threshold"), "tp", "fp")


@query(
    "threshold_precision",
    f"with {_RATES} select round(threshold, 6) as threshold, tp, fp from r order by (p >= 0.8) desc, case when p >= 0.8 then r else p end desc, case when p >= 0.8 and p + r > 0 then 2 * p * r / (p + r) else 0 end desc, threshold limit 1",
)
def threshold_precision(spark, sf):
    return learning.threshold_for_precision(learning.threshold_table(A.scored(spark, sf)), 0.8).select(F.round("threshold", 6).alias("threshold"), "tp", "fp")


@query("metrics_at_half", f"with {A.SCORED}, c as (select count(*) filter (where label = 1 and probability >= 0.5) as tp, count(*) filter (where label = 0 and probability >= 0.5) as fp, count(*) filter (where label = 1 and probability < 0.5) as fn, count(*) filter (where label = 0 and probability < 0.5) as tn from scored) select *, round(tp / (tp + fp), 6) as \"precision\", round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def metrics_at_half(spark, sf):
    m = learning.metrics(A.scored(spark, sf), 0.5)
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_BAND = "case when probability >= 0.7 then 'accepted' when probability >= 0.3 then 'manual_review' else 'rejected' end"


@query("decision_bands", f"with {A.SCORED} select {_BAND} as decision, label, count(*) as n, round(sum(length), 3) as length, round(min(probability), 6) as least, round(max(probability), 6) as most from scored group by 1, 2")
def decision_bands(spark, sf):
    d = A.scored(spark, sf).withColumn("decision", learning.band(F.col("probability"), 0.3, 0.7))
    return d.groupBy("decision", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 3).alias("length"), F.round(F.min("probability"), 6).alias("least"), F.round(F.max("probability"), 6).alias("most"))


@query(
    "decision_metrics",
    f"""with {A.SCORED}, d as (select *, {_BAND} in ('accepted', 'manual_review') as hit from scored)
    select count(*) filter (where label=1 and hit) as tp, count(*) filter (where label=0 and hit) as fp, count(*) filter (where label=1 and not hit) as fn,
    round(sum(length) filter (where label=1 and hit) / sum(length) filter (where hit), 6) as length_precision, round(sum(length) filter (where label=1 and hit) / sum(length) filter (where label=1), 6) as length_recall from d""",
)
def decision_metrics(spark, sf):
    d = A.scored(spark, sf).withColumn("decision", learning.band(F.col("probability"), 0.3, 0.7))
    return learning.decision_metrics(d, ["accepted", "manual_review"]).select("tp", "fp", "fn", F.round("length_precision", 6).alias("length_precision"), F.round("length_recall", 6).alias("length_recall"))


@query("label_counts", "select d.source as dataset_id, count(*) filter (where l.quality = 1) as positives, count(*) filter (where l.quality = 0) as negatives, count(*) filter (where l.quality = 1) > 0 and count(*) filter (where l.quality = 0) > 0 as usable from labels l join documents d using (doc_id) group by 1")
def label_counts(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset_id"))
    return learning.label_counts(A.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id"))


# -- catalogue ---------------------------------------------------------------------------------

_PLANT = """plant as (select p_partkey as id, p_name || ' ' || p_partkey as name, case p_size % 3 when 0 then 'tree' when 1 then 'shrub' else 'herbaceous' end as plant_type,
  case when p_size % 4 <> 0 then cast(p_size % 9 as double) end as min_spacing, case when p_size % 5 <> 0 then cast(p_size % 11 as double) end as recommended_spacing, case when p_partkey % 3 <> 0 then 1.5::double end as crown_radius,
  case when p_partkey % 6 <> 0 then cast(p_size % 8 as int) end as zone_min, case p_partkey % 4 when 0 then 'recommended' when 1 then 'conditional' when 2 then 'seasonal_only' end as suitability, cast(p_size % 5 as int) as priority,
  case when p_partkey % 7 = 0 then true when p_partkey % 7 = 1 then null else false end as is_invasive, case when p_partkey % 2 = 0 then true end as is_toxic, case when p_partkey % 5 <> 0 then false end as is_thorny from part)"""


def plants(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    return A.table(spark, sf, "part").select(
        k.alias("id"),
        F.concat_ws(" ", "p_name", k.cast("string")).alias("name"),
        F.when(s % 3 == 0, "tree").when(s % 3 == 1, "shrub").otherwise("herbaceous").alias("plant_type"),
        F.when(s % 4 != 0, (s % 9).cast("double")).alias("min_spacing"),
        F.when(s % 5 != 0, (s % 11).cast("double")).alias("recommended_spacing"),
        F.when(k % 3 != 0, F.lit(1.5)).alias("crown_radius"),
        F.when(k % 6 != 0, (s % 8).cast("int")).alias("zone_min"),
        F.when(k % 4 == 0, "recommended").when(k % 4 == 1, "conditional").when(k % 4 == 2, "seasonal_only").alias("suitability"),
        (s % 5).cast("int").alias("priority"),
        F.when(k % 7 == 0, True).when(k % 7 == 1, F.lit(None)).otherwise(False).alias("is_invasive"),
        F.when(k % 2 == 0, True).alias("is_toxic"),
        F.when(k % 5 != 0, False).alias("is_thorny"),
    )


@query(
    "catalog_order",
    f"with {_PLANT} select plant_type, id, row_number() over (partition by plant_type order by case suitability when 'recommended' then 0 when 'conditional' then 1 else 2 end, priority, zone_min nulls last, name) as place from plant",
)
def catalog_order(spark, sf):
    from pyspark.sql import Window

    rank = F.when(F.col("suitability") == "recommended", 0).when(F.col("suitability") == "conditional", 1).otherwise(2)
    w = Window.partitionBy("plant_type").orderBy(rank, "priority", F.asc_nulls_last("zone_min"), "name")
    return plants(spark, sf).select("plant_type", "id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "catalog_nulls",
    f"with {_PLANT} select plant_type, count(*) as n, count(*) filter (where min_spacing is null) as no_min_spacing, count(*) filter (where recommended_spacing is null) as no_recommended_spacing, count(*) filter (where crown_radius is null) as no_crown_radius, count(*) filter (where is_toxic is null) as no_is_toxic, count(*) filter (where is_thorny is null) as no_is_thorny from plant where not coalesce(is_invasive, false) and coalesce(suitability, 'recommended') <> 'seasonal_only' group by 1",
)
def catalog_nulls(spark, sf):
    return catalog.completeness(plants(spark, sf))


@query("catalog_selectable", f"with {_PLANT} select id, name from plant where not coalesce(is_invasive, false) and coalesce(suitability, 'recommended') <> 'seasonal_only'")
def catalog_selectable(spark, sf):
    return catalog.selectable(plants(spark, sf)).select("id", "name")


@query("rules_with_documents", f"with {A.rules_sql()}, d(doc_id, code, title) as (values (1, 'СП 42.13330', 'Градостроительство')) select r.plant_type, r.rule_code, r.required, d.code from rules r left join d using (doc_id) where r.plant_type in ('tree', 'shrub')")
def rules_with_documents(spark, sf):
    docs = spark.createDataFrame([(1, "СП 42.13330", "Градостроительство", None)], catalog.DOCUMENT)
    return catalog.rules_with_documents(A.rules(spark), docs, ["tree", "shrub"]).select("plant_type", "rule_code", "required", "code")


@query(
    "invalid_rules",
    "with r as (select 'R' || cast(l_suppkey as varchar) as rule_code, case when l_quantity = 13 then null when l_quantity = 14 then -1.0::double else l_quantity end as required, l_orderkey from lineitem where l_linenumber = 1) select rule_code, 'distance' as fault from r where required is null or required < 0 union all select rule_code, 'code' from r group by 1 having count(*) > 1",
)
def invalid_rules(spark, sf):
    q = F.col("l_quantity")
    r = A.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("R"), F.col("l_suppkey").cast("string")).alias("rule_code"), F.when(q == 13, F.lit(None)).when(q == 14, F.lit(-1.0)).otherwise(q).alias("required"), F.lit("min_distance").alias("kind"))
    return catalog.invalid_rules(r)


@query("upserted_catalog", "with o as (select p_partkey as id, p_retailprice as v from part), n as (select p_partkey as id, p_retailprice * 2 as v from part where p_partkey % 3 = 0 union all select p_partkey + 10000000, 1.0::double from part where p_partkey % 50 = 0) select * from n union all select * from o where id not in (select id from n)")
def upserted_catalog(spark, sf):
    p = A.table(spark, sf, "part")
    new = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 2).alias("v")).unionByName(p.filter("p_partkey % 50 = 0").select((F.col("p_partkey") + 10000000).alias("id"), F.lit(1.0).alias("v")))
    return catalog.upserted(p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v")), new, "id")


# -- set operations ------------------------------------------------------------------------------


@query("unchecked_types", f"with {A.SEG}, {A.rules_sql()} select distinct target_type from seg where target_type not in (select target_type from rules where plant_type = 'shrub')")
def unchecked_types(spark, sf):
    return rules.missing(A.lines(spark, sf), A.rules(spark).filter("plant_type = 'shrub'"), "target_type")


@query("missing_types", f"with {A.SEG}, {A.rules_sql()} select distinct target_type from rules where target_type not in (select target_type from seg)")
def missing_types(spark, sf):
    return rules.missing(A.rules(spark), A.lines(spark, sf), "target_type")


_E1 = "select o_orderstatus as handle, o_orderpriority as type, cast(o_orderkey % 40 as varchar) as layer from orders where o_orderkey % 7 <> 0"
_E2 = "select o_orderstatus, o_orderpriority, cast(o_orderkey % 40 as varchar) from orders where o_orderkey % 5 <> 0"


@query("entity_diff", f"select handle, type, layer, 'lost' as change from ({_E1} except all {_E2}) union all select handle, type, layer, 'new' from (select o_orderstatus as handle, o_orderpriority as type, cast(o_orderkey % 40 as varchar) as layer from orders where o_orderkey % 5 <> 0 except all {_E1})")
def entity_diff(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("handle"), F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 40).cast("string").alias("layer"))
    return verify.entity_difference(o.filter("o_orderkey % 7 <> 0"), o.filter("o_orderkey % 5 <> 0"))


@query("id_differences", "select o_custkey, 'missing' as side from (select o_custkey from orders where o_orderkey % 2 = 0 except all select o_custkey from orders where o_orderkey % 2 = 1) union all select o_custkey, 'unexpected' from (select o_custkey from orders where o_orderkey % 2 = 1 except all select o_custkey from orders where o_orderkey % 2 = 0)")
def id_differences(spark, sf):
    o = A.table(spark, sf, "orders")
    return verify.id_differences(o.filter("o_orderkey % 2 = 0").select("o_custkey"), o.filter("o_orderkey % 2 = 1").select("o_custkey"), "o_custkey")


@query(
    "fingerprint_changes",
    "with a as (select p_partkey as handle, p_brand as old from part where p_partkey % 4 <> 0), b as (select p_partkey as handle, case when p_size > 25 then p_brand else p_type end as new from part where p_partkey % 3 <> 0) select handle, old, new from a full join b using (handle) where old is distinct from new",
)
def fingerprint_changes(spark, sf):
    p = A.table(spark, sf, "part")
    a = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("handle"), F.col("p_brand").alias("fingerprint"))
    b = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("handle"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_type")).alias("fingerprint"))
    return verify.fingerprint_changes(a, b)


@query("source_precedence", f"with {A.SEG}, p as (select *, cast(line_id % 3 as int) as priority from seg) select target_type, priority, count(*) as n from p where priority = (select min(priority) from p q where q.target_type = p.target_type) group by 1, 2")
def source_precedence(spark, sf):
    p = A.lines(spark, sf).withColumn("priority", (F.col("line_id") % 3).cast("int"))
    return rules.resolve_sources(p).groupBy("target_type", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("species_summary", "with s as (select distinct p_type as species from part) select replace(lower(trim(species)), 'ё', 'е') as name, count(*) as parts from s join part on replace(lower(trim(p_type)), 'ё', 'е') = replace(lower(trim(species)), 'ё', 'е') group by 1")
def species_summary(spark, sf):
    p = A.table(spark, sf, "part")
    legend = p.select("p_type").distinct().select(L.plain_name(F.col("p_type")).alias("name"))
    return legend.join(p.select(L.plain_name(F.col("p_type")).alias("name")), "name").groupBy("name").agg(F.count(F.lit(1)).alias("parts"))
