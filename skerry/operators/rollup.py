"""Rollups: entity rows by time bucket, imputed silence, cohort metadata and commit markers; trend verdicts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.aggregates import p95

#: Which entities each family is rolled up by.
COHORTS = (("infologger", "host"), ("infologger", "node"), ("central", "host"), ("local", "host"), ("local", "node"))
BUCKET_MS, SETTLE_MS, BACK_FILL, ENTITY_CAP = 600_000, 120_000, 3, 2000
COHORT_KEYS = ["ts", "family", "entity_kind"]


def _bad() -> Column:
    return F.when(F.col("severity_norm").isin("error", "fatal"), 1).otherwise(0)


def roll(events: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """A row for each bucket, family, kind of entity and entity, with the cohort's totals beside it.

    All cohorts come from one scan: a record is exploded to its one or two entities, then aggregated once with partial
    sums before the shuffle. Fleet totals are a window over the entity rows of a cohort's bucket, which the cap of a fleet bounds.
    """
    kinds = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(k).alias("k")) for f, k in COHORTS])
    mine = F.filter(kinds, lambda x: x["f"] == F.col("family"))
    rows = events.select("*", F.explode(mine).alias("cohort")).select(
        (F.floor(F.col("collector_ms") / bucket_ms) * bucket_ms).alias("ts"), "family", F.col("cohort.k").alias("entity_kind"),
        F.when(F.col("cohort.k") == "host", F.col("origin_host")).otherwise(F.col("node")).alias("entity"), "severity_norm", "enter_system_lag_ms", "ingest_lag_ms",
    )
    entities = rows.where(F.col("entity").isNotNull()).groupBy(*COHORT_KEYS, "entity").agg(
        F.count("*").alias("doc_count"), F.sum(_bad()).alias("ef_count"),
        p95("enter_system_lag_ms").alias("p95_entry_lag_ms"), p95("ingest_lag_ms").alias("p95_shipping_lag_ms"),
        F.round(F.avg("enter_system_lag_ms"), 3).alias("avg_entry_lag_ms"), F.round(F.avg("ingest_lag_ms"), 3).alias("avg_shipping_lag_ms"),
    )
    w = Window.partitionBy(*COHORT_KEYS)
    return entities.select("*", F.sum("doc_count").over(w).alias("fleet_count"), F.sum("ef_count").over(w).alias("fleet_ef_count"), F.lit(False).alias("imputed"))


def impute(rollup: DataFrame, bucket_ms: int = BUCKET_MS, back_ms: int = 86_400_000) -> DataFrame:
    """Zero rows for entities that spoke within back_ms before a bucket and not in it, where their cohort did.

    An entity's silence lies between two of its rows, so only gaps are expanded, not every entity by every bucket. Lags of a
    zero row are null, and it never adds to the fleet's totals.
    """
    w = Window.partitionBy("family", "entity_kind", "entity").orderBy("ts")
    spoke = rollup.where("doc_count > 0").select("family", "entity_kind", "entity", "ts", F.lead("ts").over(w).alias("again"))
    last = F.least(F.col("ts") + F.lit(back_ms), F.coalesce(F.col("again") - bucket_ms, F.col("ts") + F.lit(back_ms)))
    gaps = spoke.where(last > F.col("ts")).select("family", "entity_kind", "entity", F.explode(F.sequence(F.col("ts") + bucket_ms, last, F.lit(bucket_ms).cast("long"))).alias("ts"))
    cohorts = rollup.groupBy(*COHORT_KEYS).agg(F.first("fleet_count").alias("fleet_count"), F.first("fleet_ef_count").alias("fleet_ef_count"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("doc_count", "ef_count")]
    none = [F.lit(None).cast("double").alias(c) for c in ("p95_entry_lag_ms", "p95_shipping_lag_ms", "avg_entry_lag_ms", "avg_shipping_lag_ms")]
    return gaps.join(cohorts, COHORT_KEYS).select(*COHORT_KEYS, "entity", *zero, *none, "fleet_count", "fleet_ef_count", F.lit(True).alias("imputed"))


def capped(rollup: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """The first `cap` entities of each cohort's bucket, by name."""
    w = Window.partitionBy(*COHORT_KEYS).orderBy("entity")
    return rollup.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).drop("k")


def meta(rollup: DataFrame, buckets: DataFrame, cap: int = ENTITY_CAP) -> DataFrame:
    """A row for each bucket and cohort, empty ones too: entities, imputed ones, documents, and whether the cap cut any."""
    cohorts = rollup.sparkSession.createDataFrame(list(COHORTS), "family string, entity_kind string")
    every = buckets.select("ts").distinct().join(F.broadcast(cohorts))
    got = rollup.groupBy(*COHORT_KEYS).agg(F.count("*").alias("entities"), F.count_if("imputed").alias("imputed_count"), F.sum("doc_count").alias("doc_count"))
    n = F.coalesce("entities", F.lit(0).cast("long"))
    return every.join(got, COHORT_KEYS, "left").select(
        *COHORT_KEYS, F.least(n, F.lit(cap).cast("long")).alias("entity_count"), F.coalesce("imputed_count", F.lit(0).cast("long")).alias("imputed_count"),
        F.coalesce("doc_count", F.lit(0).cast("long")).alias("doc_count"), (n > cap).alias("truncated"),
    )


def commits(metadata: DataFrame) -> DataFrame:
    """A marker for each bucket, complete unless a cohort was truncated; to be written after all of its rows."""
    name = F.concat("family", F.lit("/"), "entity_kind")
    stats = F.struct(name.alias("cohort"), "entity_count", "doc_count", "truncated")
    return metadata.groupBy("ts").agg(
        (~F.bool_or("truncated")).alias("complete"), F.count("*").alias("observed_cohort_count"),
        F.array_sort(F.collect_list(stats)).alias("commit_cohorts"),
    )


def _slices(rollup: DataFrame, as_of: int, unit: int, long_ms: int, short_ms: int, **measures: Column) -> DataFrame:
    """Measures of each entity over three slices and two baselines, as conditional aggregates of one scan."""
    ts = F.col("ts")
    spans = {f"s{k}": (ts >= as_of - (k + 2) * unit) & (ts < as_of - (k + 1) * unit) for k in range(3)}
    spans |= {"long": (ts >= as_of - long_ms) & (ts < as_of - 4 * unit), "short": (ts >= as_of - short_ms) & (ts < as_of - 4 * unit)}
    aggs = []
    for span, inside in spans.items():
        for name, value in measures.items():
            total = F.avg(F.when(inside, value)) if name == "lag" else F.coalesce(F.sum(F.when(inside, value)), F.lit(0))
            aggs.append(total.alias(f"{name}_{span}"))
        aggs.append(F.count_if(inside).alias(f"rows_{span}"))
    return rollup.where((ts >= as_of - max(long_ms, short_ms)) & (ts < as_of)).groupBy("entity").agg(*aggs)


def _each(test) -> Column:
    return test("s0") & test("s1") & test("s2")


def volume_verdicts(rollup: DataFrame, as_of: int, unit: int = BUCKET_MS, long_ms: int = 604_800_000, short_ms: int = 86_400_000, min_docs: int = 50, min_rows: int = 6, ratio: float = 2.0) -> DataFrame:
    """Each entity's share of its fleet in three slices against its baseline share: hi, lo, and whether it fires."""
    c = F.col
    got = _slices(rollup, as_of, unit, long_ms, short_ms, docs=c("doc_count"), fleet=c("fleet_count"))
    use_long = c("fleet_long") > 0
    docs, fleet, rows = (F.when(use_long, c(f"{x}_long")).otherwise(c(f"{x}_short")) for x in ("docs", "fleet", "rows"))
    base = F.when(fleet > 0, docs / fleet)
    got = got.withColumn("base", base).withColumn("guard", F.coalesce(_each(lambda s: c(f"fleet_{s}") > 0) & (fleet > 0) & (rows >= min_rows) & (base > 0), F.lit(False)))
    for k in range(3):
        got = got.withColumn(f"r{k}", F.when(c("guard"), F.round(c(f"docs_s{k}") / c(f"fleet_s{k}") / c("base"), 6)))
    hi = c("guard") & _each(lambda s: (c(f"docs_{s}") >= min_docs) & (c("r" + s[1]) >= ratio))
    lo = c("guard") & (c("rows_short") > 0) & (c("docs_short") >= min_docs * c("rows_short")) & _each(lambda s: c("r" + s[1]) <= 1 / ratio)
    hi, lo = F.coalesce(hi, F.lit(False)), F.coalesce(lo, F.lit(False))
    return got.select("entity", *[f"docs_s{k}" for k in range(3)], *[f"r{k}" for k in range(3)], F.round("base", 9).alias("base"), hi.alias("hi"), lo.alias("lo"), (hi | lo).alias("fires"))


def ef_verdicts(rollup: DataFrame, as_of: int, unit: int = BUCKET_MS, long_ms: int = 604_800_000, short_ms: int = 86_400_000, min_docs: int = 50, min_ef: int = 10, min_rows: int = 6, ratio: float = 2.0) -> DataFrame:
    """Whether each entity's share of errors is `ratio` times its baseline's in all three slices."""
    c = F.col
    got = _slices(rollup, as_of, unit, long_ms, short_ms, docs=c("doc_count"), ef=c("ef_count"))
    use_long = c("docs_long") > 0
    docs, ef, rows = (F.when(use_long, c(f"{x}_long")).otherwise(c(f"{x}_short")) for x in ("docs", "ef", "rows"))
    base = F.when(docs > 0, F.greatest(ef / docs, F.lit(0.001)))
    fires = (docs > 0) & (rows >= min_rows) & _each(lambda s: (c(f"docs_{s}") >= min_docs) & (c(f"ef_{s}") >= min_ef) & (F.nullif(c(f"ef_{s}") / F.nullif(c(f"docs_{s}"), F.lit(0)), F.lit(-1.0)) / base >= ratio))
    return got.select("entity", *[f"docs_s{k}" for k in range(3)], *[f"ef_s{k}" for k in range(3)], F.round(base, 9).alias("base"), F.coalesce(fires, F.lit(False)).alias("fires"))


def lag_verdicts(rollup: DataFrame, lag: str, as_of: int, unit: int = BUCKET_MS, long_ms: int = 604_800_000, short_ms: int = 86_400_000, min_docs: int = 100, min_lag: float = 250.0, ceiling: float | None = None, min_rows: int = 6, ratio: float = 2.0) -> DataFrame:
    """Whether each entity's tail lag is `ratio` times its baseline's in all three slices."""
    c = F.col
    got = _slices(rollup, as_of, unit, long_ms, short_ms, docs=c("doc_count"), lag=c(lag))
    use_long = F.coalesce(c("lag_long") > 0, F.lit(False))
    base, rows = F.when(use_long, c("lag_long")).otherwise(c("lag_short")), F.when(use_long, c("rows_long")).otherwise(c("rows_short"))
    slice_ok = lambda s: c(f"lag_{s}").isNotNull() & (c(f"docs_{s}") >= min_docs) & (c(f"lag_{s}") >= min_lag) & (F.lit(True) if ceiling is None else c(f"lag_{s}") <= ceiling) & (c(f"lag_{s}") / base >= ratio)
    fires = (base > 0) & (rows >= min_rows) & _each(slice_ok)
    return got.select("entity", *[F.round(f"lag_s{k}", 3).alias(f"lag_s{k}") for k in range(3)], F.round(base, 6).alias("base"), F.coalesce(fires, F.lit(False)).alias("fires"))
