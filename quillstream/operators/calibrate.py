"""Thresholds from labelled scores (sample_id, cls 'human' or 'ai', score): fitting, hold-out, bands, resolution.

All of it is relational: candidates are midpoints of distinct scores and accuracy comes from running sums, in ranges
of scores (``ranks``), so no task holds all of them. A hold-out subtracts each group's own counts from those sums and
asks for the best candidate between its scores, instead of fitting copies of the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranks


def percentile(values: Column, share: float) -> Column:
    """Nearest rank from below: the element at int(share * (n - 1)) of the sorted values. For groups of a task's size;
    of a whole table: ``ranks.nearest_rank``."""
    ordered = F.sort_array(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.get(ordered, F.floor(F.lit(share) * (F.size(ordered) - 1)).cast("int")))


def class_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("cls").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.avg("score").alias("mean"), F.max("score").alias("high"))


def _candidate(cut: Column, right: Column, margin: Column) -> Column:
    """What candidates are compared by: right answers, margin, then the lowest cut."""
    return F.struct(right.cast("long").alias("right"), margin.alias("margin"), (-cut).alias("minus"))


def _ends(low: Column, high: Column, n_human: Column, n_ai: Column) -> tuple[Column, Column]:
    """Candidates below the lowest and above the highest score."""
    bottom, top = low - F.lit(0.01), high + F.lit(0.01)
    return _candidate(bottom, n_human, low - bottom), _candidate(top, n_ai, top - high)


def _between(score: Column, after: Column, right: Column) -> Column:
    middle = (score + after) / 2
    return _candidate(middle, right, F.least(middle - score, after - middle))


def _counts(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by, "score").agg(F.count_if(F.col("cls") == "human").alias("h"), F.count_if(F.col("cls") == "ai").alias("a"))


def pick_threshold(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, threshold, accuracy, margin): scores below the threshold are taken for 'ai'.

    The best accuracy wins, then the widest margin, then the lowest threshold. Groups with one class only have none.
    Without ``by`` the scores are ranked in ranges; with it, each group is one task's.
    """
    by = by or []
    counts = _counts(samples, by)
    if by:
        run = Window.partitionBy(*by).orderBy("score")
        upto, whole = run.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
        t = counts.select(*by, "score", F.sum("h").over(upto).alias("h_upto"), F.sum("a").over(upto).alias("a_upto"), F.sum("h").over(whole).alias("h_all"), F.sum("a").over(whole).alias("a_all"), F.lag("score").over(run).alias("before"), F.lead("score").over(run).alias("after"))
    else:
        totals = counts.agg(F.sum("h").alias("h_all"), F.sum("a").alias("a_all"))
        t = ranks.running(counts, "score", ["h", "a"]).crossJoin(F.broadcast(totals))
    n = F.col("h_all") + F.col("a_all")
    low, high = _ends(F.col("score"), F.col("score"), F.col("h_all"), F.col("a_all"))
    here = F.when(F.col("after").isNotNull(), _between(F.col("score"), F.col("after"), F.col("h_all") - F.col("h_upto") + F.col("a_upto")))
    each = t.where("h_all > 0 and a_all > 0").select(*by, n.alias("n"), F.explode(F.array_compact(F.array(F.when(F.col("before").isNull(), low), here, F.when(F.col("after").isNull(), high)))).alias("x"))
    best = [F.max("x").alias("x"), F.first("n").alias("n")]
    picked = each.groupBy(*by).agg(*best) if by else each.agg(*best)
    return picked.where("x is not null").select(*by, (-F.col("x.minus")).alias("threshold"), (F.col("x.right") / F.col("n")).alias("accuracy"), F.col("x.margin").alias("margin"))


def hold_out_thresholds(samples: DataFrame) -> DataFrame:
    """(fold, threshold) for each group (grp) of samples: the threshold that all other groups' samples give.

    Between two scores of a group its own share of the right answers is constant, so the best candidate there is the
    best one of all samples' (``ranks.largest_within``). Scores that only the group has are no neighbours for others:
    where a run of them goes, the scores on both sides make a candidate of their own.
    """
    own = _counts(samples, ["grp"])
    all_ = ranks.running(own.groupBy("score").agg(F.sum("h").alias("h_all"), F.sum("a").alias("a_all")), "score", ["h_all", "a_all"])
    ends = F.broadcast(all_.agg(F.coalesce(F.sum("h_all"), F.lit(0)).alias("nh"), F.coalesce(F.sum("a_all"), F.lit(0)).alias("na"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.max("idx").alias("last")))
    right = F.col("nh") - F.col("h_all_upto") + F.col("a_all_upto")
    ranked = all_.crossJoin(ends).withColumn("right", right)
    cuts = ranked.where("after is not null").select("idx", _between(F.col("score"), F.col("after"), F.col("right")).alias("x"))

    fold = Window.partitionBy("fold")
    order = fold.orderBy("idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    met = own.withColumnRenamed("grp", "fold").join(ranked.select("score", "h_all", "a_all", "idx", "before", "after", (F.col("right") + F.col("h_all") - F.col("a_all")).alias("right_before"), "nh", "na", "lowest", "highest", "last"), "score")
    placed = met.select(
        "*",
        (F.sum("h").over(fold) - F.sum("h").over(upto) + F.sum("a").over(upto)).alias("mine"),
        (F.col("nh") - F.sum("h").over(fold)).alias("h_left"),
        (F.col("na") - F.sum("a").over(fold)).alias("a_left"),
        ((F.col("h_all") == F.col("h")) & (F.col("a_all") == F.col("a"))).alias("gone"),
        F.lag("idx").over(order).alias("idx_before"),
        F.lead("idx").over(order).alias("idx_after"),
    ).where("h_left > 0 and a_left > 0")
    placed = placed.withColumn("gone_after", F.lead("gone").over(order))
    mine_before = F.col("mine") + F.col("h") - F.col("a")
    # From each own score to the next, and from the bottom to the first.
    after = placed.select("fold", "mine", (F.col("idx") + F.col("gone").cast("long")).alias("low"), F.coalesce(F.col("idx_after") - 1 - F.coalesce("gone_after", F.lit(False)).cast("long"), F.col("last") - 1).alias("high"))
    first = placed.where("idx_before is null").select("fold", mine_before.alias("mine"), F.lit(0).cast("long").alias("low"), (F.col("idx") - 1 - F.col("gone").cast("long")).alias("high"))
    best = ranks.largest_within(after.unionByName(first), cuts, "low", "high", "idx", "x")
    inner = best.select("fold", F.struct((F.col("x.right") - F.col("mine")).alias("right"), F.col("x.margin").alias("margin"), F.col("x.minus").alias("minus")).alias("x"))

    runs = placed.where("gone").withColumn("run", F.col("idx") - F.row_number().over(order))
    lost = runs.groupBy("fold", "run").agg(F.min_by("before", "idx").alias("before"), F.max_by("after", "idx").alias("after"), F.min_by(F.col("right_before") - mine_before, "idx").alias("right"))
    across = lost.where("before is not null and after is not null").select("fold", _between(F.col("before"), F.col("after"), F.col("right")).alias("x"))
    facts = placed.groupBy("fold").agg(*[F.first(c).alias(c) for c in ("h_left", "a_left", "lowest", "highest")])
    edges = lost.groupBy("fold").agg(F.max(F.when(F.col("before").isNull(), F.col("after"))).alias("low"), F.max(F.when(F.col("after").isNull(), F.col("before"))).alias("high"))
    sides = facts.join(edges, "fold", "left").select("fold", F.explode(F.array(*_ends(F.coalesce("low", "lowest"), F.coalesce("high", "highest"), F.col("h_left"), F.col("a_left")))).alias("x"))
    return inner.unionByName(across).unionByName(sides).groupBy("fold").agg(F.max("x").alias("x")).select("fold", (-F.col("x.minus")).alias("threshold"))


def leave_one_group_out(samples: DataFrame) -> DataFrame:
    """One row: correct, predicted, accuracy (null if nothing could be predicted) and n_groups.

    Each group's samples are judged by a threshold fitted without them.
    """
    s = samples.withColumn("grp", T.group_of(F.col("sample_id")))
    own = _counts(s, ["grp"]).withColumnRenamed("grp", "fold")
    judged = own.join(hold_out_thresholds(s), "fold", "left").withColumn("n", F.col("h") + F.col("a"))
    right = F.when(F.col("score") < F.col("threshold"), F.col("a")).otherwise(F.col("h"))
    known = F.col("threshold").isNotNull()
    out = judged.agg(F.coalesce(F.sum(F.when(known, right)), F.lit(0)).alias("correct"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("predicted"), F.count_distinct("fold").alias("n_groups"))
    return out.select("correct", "predicted", F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).alias("accuracy"), "n_groups")


def pair_amber(samples: DataFrame, threshold: DataFrame) -> DataFrame:
    """amber: the 10th percentile of the human scores at or above the threshold (one row), rounded; null without any."""
    above = samples.where("cls = 'human'").crossJoin(F.broadcast(threshold.select("threshold"))).where("score >= threshold")
    return ranks.nearest_rank(above, "score", 0.1).select(F.round("value", 4).alias("amber"))


def band(windows: DataFrame) -> DataFrame:
    """Band record of human windows (sample_id, score): amber is the 90th percentile, 0.5 at most."""
    p90 = F.broadcast(ranks.nearest_rank(windows, "score", 0.9).select(F.col("value").alias("p")))
    facts = windows.agg(F.count("*").alias("n_windows"), F.count_distinct(T.group_of(F.col("sample_id"))).alias("n_essays"))
    return facts.crossJoin(p90).select(F.lit(0.5).alias("threshold"), F.round(F.least("p", F.lit(0.5)), 4).alias("amber"), "n_windows", "n_essays", F.round("p", 4).alias("human_p90"))


def record(samples: DataFrame, pair: tuple[str, str], backend: str) -> DataFrame:
    """Pair record: everything a calibration file says, in one row; no row if a class is missing.

    accuracy is that of the hold-out, null where nothing could be held out. Its parts are a row each and are read one
    after another, now: in one plan each would hold copies of the others'. Persist ``samples`` if scoring is dear.
    """
    spark = samples.sparkSession
    fit = pick_threshold(samples).first()
    raw = "threshold double, amber double, held double, in_sample double, n_human long, n_ai long, n_groups long, human_mean double, ai_mean double"
    rows = []
    if fit is not None:
        held = leave_one_group_out(samples).first()
        of = lambda cls: F.when(F.col("cls") == cls, F.col("score"))
        facts = samples.agg(F.count(of("human")).alias("n_human"), F.count(of("ai")).alias("n_ai"), F.avg(of("human")).alias("human_mean"), F.avg(of("ai")).alias("ai_mean")).first()
        amber = pair_amber(samples, spark.createDataFrame([(fit["threshold"],)], "threshold double")).first()["amber"]
        rows = [(fit["threshold"], amber, held["accuracy"], fit["accuracy"], facts["n_human"], facts["n_ai"], held["n_groups"], facts["human_mean"], facts["ai_mean"])]
    return spark.createDataFrame(rows, raw).select(
        F.array(*[F.lit(p) for p in pair]).alias("pair"),
        F.lit(backend).alias("backend"),
        F.round("threshold", 4).alias("threshold"),
        "amber",
        F.round("held", 4).alias("accuracy"),
        F.lit("leave-one-essay-out").alias("accuracy_kind"),
        F.round("in_sample", 4).alias("accuracy_in_sample"),
        "n_human",
        "n_ai",
        F.col("n_groups").alias("n_essays"),
        F.round("human_mean", 4).alias("human_mean"),
        F.round("ai_mean", 4).alias("ai_mean"),
    )


def record_name(pair: str, backend: str = "", tag: str = "") -> str:
    """``pair[-mlx][-tag]``: the name that a calibration record is kept under."""
    return "-".join(x for x in (pair, "mlx" if backend == "mlx" else "", tag) if x)


def resolve(catalog: DataFrame, name: str) -> DataFrame:
    """The record kept under ``name`` (columns name, source_rank, ...): the lowest rank wins whole; no row if none."""
    first = Window.partitionBy("name").orderBy("source_rank")
    return catalog.where(F.col("name") == name).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def thresholds(spark: SparkSession, catalog: DataFrame, name: str, explicit: float | None = None) -> DataFrame:
    """threshold, amber and calibrated: explicit before saved before the placeholder 0.90; amber is the saved one."""
    saved = resolve(catalog, name).select(F.col("threshold").alias("t"), F.col("amber").alias("a"))
    one = spark.range(1).join(saved, how="left")
    given = F.lit(explicit).cast("double")
    return one.select(F.coalesce(given, "t", F.lit(0.90)).alias("threshold"), F.col("a").alias("amber"), (given.isNotNull() | F.col("t").isNotNull()).alias("calibrated"))


def bands(spark: SparkSession, catalog: DataFrame, name: str) -> DataFrame:
    """threshold, amber, fitted and empty_band of a band record; 0.5 and 0.35 where there is none or a key lacks."""
    saved = resolve(catalog, name).select(F.col("threshold").alias("t"), F.col("amber").alias("a"), F.lit(True).alias("f"))
    one = spark.range(1).join(saved, how="left")
    t, a = F.coalesce("t", F.lit(0.5)), F.coalesce("a", F.lit(0.35))
    return one.select(t.alias("threshold"), a.alias("amber"), F.coalesce("f", F.lit(False)).alias("fitted"), (a >= t).alias("empty_band"))


def verdict(score: Column, threshold: Column, amber: Column) -> Column:
    return F.when(score < threshold, "AI-ish").when(score < amber, "borderline").otherwise("human-ish")
