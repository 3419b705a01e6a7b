"""Registered queries over the driver tables, and the SQL that must give the same rows.

The driver tables hold no review log, so each query first derives the review stream from
``events`` (:func:`tidemark.sources.reviews.reviews_from_events`).  Residuals are summed as
whole thousandths where a query allows it, so sums do not depend on their order and
need no rounding to compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import boost, calibrate, features, joins, metrics, splits, validate
from ..operators import windows as W
from ..session import checkpointed
from ..sources import reviews as source
from ..sources import tables
from ..streaming import scorer
from .ablation import ablation, external
from .nested import evaluate
from .sql import BETA, SQL

KEY = ("user", "review_th")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.reviews_from_events(events(spark, sf_dir)).withColumn("r_milli", (F.col("y") * 1000).cast("long") - F.col("p_milli"))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_calibrated(spine(spark, sf_dir), BETA)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    r = F.col("r_milli")
    return rows.withColumns({"x16": W.shrunk_mean(r, 16) / 1000, "x256": W.shrunk_mean(r, 256) / 1000})


def r6(column: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def _shown(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*KEY, *(c.alias(n) for n, c in columns.items()))


def reviews_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).drop("p_milli", "r_milli")
    return rows.withColumns({"elapsed_seconds": r6("elapsed_seconds"), "fold": F.col("fold").cast("long")})


def cards_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    return joins.with_card_groups(rows, source.cards_from_reviews(rows)).select(*KEY, "card_id", "deck_id", "note_id")


def calibrated_pb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(calibrated(spark, sf_dir), p_b=r6("p_b"), r_b=r6("r_b"))


def spine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spine(spark, sf_dir), x16=F.col("x16"), x256=F.col("x256"))


def surprise_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_surprise(reviews(spark, sf_dir), {"F": "r_milli"})
    return _shown(rows, **{c: F.col(c) / 1000 for c in features.SURPRISE if c.startswith("sF")})


def surprise_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_surprise(calibrated(spark, sf_dir), {"B": "r_b"})
    return _shown(rows, **{c: r6(c) for c in features.SURPRISE if c.startswith("sB")})


def card_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_state(reviews(spark, sf_dir))
    return _shown(rows, st_t=F.col("st_t").cast("long"), st_card_seq=F.col("st_card_seq").cast("long"), st_age_days=F.col("st_age_days"))


def log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_state(reviews(spark, sf_dir))
    return _shown(rows, **{c: r6(c) for c in ("st_log_elapsed", "st_log_i", "st_log_t")})


def deck_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reviews(spark, sf_dir), dk_n_all=W.group_count("deck_id"), dk_acc_all=W.group_accuracy(F.col("r_milli"), "deck_id") / 1000)


def deck_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reviews(spark, sf_dir), dk_n_other=W.other_count("deck_id"), dk_acc_other=W.other_accuracy(F.col("r_milli"), "deck_id") / 1000)


def note_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reviews(spark, sf_dir), nt_n_other=W.other_count("note_id"), nt_acc_other=W.other_accuracy(F.col("r_milli"), "note_id") / 1000)


def deck_since_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_days_since_other(reviews(spark, sf_dir)).select(*KEY, "dk_since_other")


def deck_cards_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_cards_seen(reviews(spark, sf_dir)).select(*KEY, F.col("dk_cards_seen").cast("long").alias("dk_cards_seen"))


def rating_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_stream(reviews(spark, sf_dir))
    return _shown(rows, **{c: r6(c) for c in ("rt_mean8", "rt_mean32", "rt_fail32", "rt_sd32")})


def rating_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_stream(reviews(spark, sf_dir)).select(*KEY, "rt_last")


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_stream(reviews(spark, sf_dir))
    return _shown(rows, **{c: F.col(c).cast("long") for c in ("rt_good_streak", "rt_lapse_streak")})


def session_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_stream(reviews(spark, sf_dir))
    return _shown(rows, sg_log_secs=r6("sg_log_secs"), sg_same_session=F.col("sg_same_session"), sg_prev_dur_log=r6("sg_prev_dur_log"))


def chrono_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_fold(reviews(spark, sf_dir)).select(*KEY, "chrono_fold")


def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    z0, z1 = scalars.logit(F.col("p_fsrs")), scalars.logit(F.col("p_b"))
    logits = [z0, z1, z0 + 1.0986122886681098 * F.col("x16"), 0.9 * z0 + F.col("x256")]
    told = scalars.disagreement(logits, logits[3], z1, z0)
    return _shown(calibrated(spark, sf_dir), **{n: c if n == "dg_n_above" else r6(c) for n, c in told.items()})


def metric_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(reviews(spark, sf_dir), dt=scalars.elapsed_bin(F.col("elapsed_days")), ii=scalars.ordinal_bin(F.col("i")), ll=scalars.lapse_bin(F.col("lapse")))


def user_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both probabilities in one aggregate."""
    rows = calibrated(spark, sf_dir)
    losses = {n: r6(F.avg(metrics.row_loss(F.col("y"), F.col(p)))) for n, p in (("loss_base", "p_fsrs"), ("loss_calibrated", "p_b"))}
    return rows.groupBy("user").agg(*(c.alias(n) for n, c in losses.items()), F.count(F.lit(1)).alias("size"))


def user_rmse_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned_rmse(calibrated(spark, sf_dir), "p_b").select("user", r6("rmse_bins").alias("rmse_bins"))


def user_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(reviews(spark, sf_dir), "p_fsrs").select("user", r6("auc").alias("auc"))


def user_mbe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).withColumns({"p": F.col("p_milli"), "l": (F.col("y") * 1000).cast("long")})
    return metrics.mean_bias(rows, "p", "l").select("user", r6(F.col("mbe") / 1000).alias("mbe"), "size")


def equal_user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = metrics.equal_user(metrics.per_user(calibrated(spark, sf_dir), "p_b"), ["log_loss", "rmse_bins", "auc"])
    return told.select(*((r6(c) if c.startswith("mean") else F.col(c)).alias(c) for c in told.columns))


def equal_user_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.row_weights(reviews(spark, sf_dir)).select(*KEY, r6("weight").alias("weight"))


def _losses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = calibrated(spark, sf_dir)
    return metrics.log_loss(rows, "p_b"), metrics.log_loss(rows, "p_fsrs")


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.paired(*_losses(spark, sf_dir), "log_loss").select("user", r6("delta").alias("delta"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).groupBy("user").agg(F.count(F.lit(1)).alias("size"))


def volume_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.volume_split(_sizes(spark, sf_dir))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shard(_sizes(spark, sf_dir).select("user"), *splits.parse_shard("3/8"))


def semi_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    folds = W.with_fold(rows).where("chrono_fold is not null").select(*KEY, F.col("chrono_fold").alias("fold"))
    return joins.in_folds(rows.drop("fold"), folds).select(*KEY, F.col("fold").alias("test_fold"), r6("elapsed_seconds").alias("elapsed_seconds"))


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = reviews(spark, sf_dir).select("user").distinct().withColumn("identity", F.lit("v1"))
    done = users.where(F.col("user") % 3 == 0)
    return joins.still_to_do(users, done).select("user")


def deferred_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = reviews(spark, sf_dir).select("user").distinct()
    return splits.without_deferred(users, users.where(F.col("user") % 10 == 7))[0]


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(reviews(spark, sf_dir))


def causality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).drop("p_milli", "r_milli")
    return validate.causality(rows, lambda t: features.build(t, BETA), features.FEATURES)


def unmapped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    told = validate.unmapped(joins.with_card_groups(rows, source.cards_from_reviews(rows)))
    return told.withColumn("share", r6("share"))


def row_index_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).withColumn("row_index", W.position().cast("long"))
    return validate.row_index_faults(rows)


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = reviews(spark, sf_dir).select("user").distinct()
    listed = [r.user for r in users.collect()]  # users, whose splits are drawn on the driver
    return splits.split_faults(splits.split_table(spark, splits.nested_splits(listed, 20)), users)


def clip_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).agg(F.count_if(scalars.clipped(F.col("p_fsrs"), 0.1)).alias("hits"), F.count(F.lit(1)).alias("n"))


def card_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.codes(reviews(spark, sf_dir), "card_id", "code").select(*KEY, F.col("code").cast("long").alias("code"))


def hist_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of a first tree level over 16 equal bins of the base probability."""
    rows = reviews(spark, sf_dir)
    p = F.col("p_milli")
    cells = rows.select(F.array(F.floor(F.col("p_fsrs") * 16).cast("short")).alias("bins"), (-F.col("r_milli")).alias("g"), (p * (1000 - p)).alias("h"))
    told = boost.histograms(cells, [0], F.lit(0))
    return told.select("bin", F.col("g").cast("long").alias("g_milli"), F.col("h").cast("long").alias("h_micro"), "n")


def calibration_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = calibrate.objective(calibrate.design(spine(spark, sf_dir)), BETA)
    return told.select(*(r6(c).alias(c) for c in told.columns))


def report_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).agg(F.countDistinct("user").alias("users"), F.count(F.lit(1)).alias("reviews"))


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.head(reviews(spark, sf_dir), 10).select(*KEY)


def spaced_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.spaced_users(_sizes(spark, sf_dir).select("user"), 5)


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings moved and scaled by the rows of users with an even number."""
    rows = reviews(spark, sf_dir)
    told = calibrate.standardized(rows, rows.where(F.col("user") % 2 == 0), ["rating"])
    return told.select(*KEY, r6("rating").alias("rating"))


def size_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh user is expected to have one row more than it has."""
    sizes = _sizes(spark, sf_dir)
    expected = sizes.withColumn("size", F.col("size") + (F.col("user") % 7 == 0).cast("long"))
    return joins.size_mismatches(sizes, expected).select("user", "size", "expected")


def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored probabilities by row number; rows of every fifth place are absent."""
    rows = reviews(spark, sf_dir).withColumn("row_index", W.position().cast("long"))
    stored = rows.where(F.col("row_index") % 5 != 0).select("user", "row_index", F.col("p_milli").alias("stored"))
    return joins.with_stored(rows, stored, ["stored"]).select(*KEY, "stored", "complete")


def misaligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that must agree: one lacks its first rows and differs in every eleventh."""
    rows = reviews(spark, sf_dir).select(*KEY, F.col("p_milli").alias("v"))
    other = rows.where("review_th > 2").withColumn("v", F.when(F.col("review_th") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return joins.misaligned(rows, other, ["v"], KEY)


def group_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients by group of users; users of the last third have none."""
    rows = reviews(spark, sf_dir).select("user").distinct()
    groups = rows.where(F.col("user") % 3 < 2).groupBy((F.col("user") % 3).alias("g")).agg(F.collect_list("user").alias("users"))
    groups = groups.select("users", *((F.col("g") + F.lit(k / 10)).alias(f"b{k}") for k in range(3)))
    return joins.with_group_betas(rows, groups).select("user", *(r6(f"b{k}").alias(f"b{k}") for k in range(3)))


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by rating, with repeats, against the same without everyone's first three rows."""
    rows = reviews(spark, sf_dir)
    return splits.multiset_difference(rows.select("user", "rating"), rows.where("review_th > 3").select("user", "rating"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 42 features of every row."""
    built = features.build(reviews(spark, sf_dir).drop("p_milli", "r_milli"), BETA, narrow=False)
    exact = ("x16", "x256", *(c for c in features.SURPRISE if c.startswith("sF")))  # means of thousandths, which lie halfway between millionths at times
    return _shown(built, **{c: F.round(c, 12) + F.lit(0.0) if c in exact else r6(c) for c in ["p_b", *features.FEATURES]})


def narrow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole thousandths in single precision, as the design matrix has them."""
    return _shown(spine(spark, sf_dir), x16=F.col("x16").cast("float"), x256=F.col("x256").cast("float"), st_i=F.col("i").cast("float"))


def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of the mean loss at the fitted coefficients, which is zero, and whether these beat none."""
    rows = checkpointed(spine(spark, sf_dir))
    found = calibrate.fit(rows)
    at, none = (calibrate.objective(calibrate.design(rows), b) for b in (found.beta, (0.0, 0.0, 0.0)))
    told = at.select(*(r6(f"g{k}").alias(f"g{k}") for k in range(3)), F.col("loss").alias("fitted")).crossJoin(none.select("loss"))  # one row each
    return told.select("g0", "g1", "g2", (F.col("fitted") < F.col("loss")).alias("better"), F.lit(found.users).cast("long").alias("users"), F.lit(found.rows).cast("long").alias("reviews"))


def crossfit_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(spine(spark, sf_dir))
    users = [r.user for r in rows.select("user").distinct().collect()]
    found = [calibrate.cross_fit(rows, split["train"], 20)[0].withColumn("fold", F.lit(k)) for k, split in enumerate(splits.nested_splits(users, 20))]
    return found[0].unionByName(found[1])


def ridge_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalised gradient, which is zero, at the fitted correction on the stream features on top of the calibrated margin."""
    told = features.with_stream(calibrated(spark, sf_dir)).withColumns({"z": scalars.logit(F.col("p_b"))})
    told = checkpointed(metrics.row_weights(told).select("user", "y", "z", "weight", *features.STREAM))
    told = calibrate.standardized(told, told, features.STREAM)
    beta = dict(zip(features.STREAM, map(float, calibrate.offset_regression(told, features.STREAM, "y", "z", "weight")), strict=True))
    z = sum((F.lit(b) * F.col(n) for n, b in beta.items()), F.col("z"))
    slope = F.col("weight") * (scalars.expit(z) - F.col("y"))
    sums = told.agg(*((F.sum(slope * F.col(n)) + 1e-3 * b).alias(n) for n, b in beta.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), r6(n).alias("gradient")) for n in beta))).alias("x")).select("x.*")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000 draws of the users' change of log loss."""
    told = metrics.bootstrap(joins.paired(*_losses(spark, sf_dir), "log_loss"))
    return told.select(*(r6(c).alias(c) for c in ("mean", "ci_low", "ci_high", "se")), "improved", "worsened", "tied", "n")


def fold_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds from one mask each; every ninth row is in two, which is a fault."""
    rows = reviews(spark, sf_dir)
    masks = [f"m{k}" for k in range(5)]
    rows = rows.withColumns({m: (F.col("fold") == k) | ((F.col("review_th") % 9 == 0) & (F.lit(k) == 4)) for k, m in enumerate(masks)})
    faults = validate.mask_faults(rows, masks).select(*KEY, F.lit(True).alias("fault"))
    fold, single = W.fold_from_masks(masks)
    told = rows.select(*KEY, F.when(single, fold).cast("long").alias("mask_fold")).join(faults, list(KEY), "left")
    return told.select(*KEY, "mask_fold", F.coalesce("fault", F.lit(False)).alias("fault"))


def resume_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run does with what it finds: run, skip or refuse, and why."""
    wanted = {"revision": "a", "data": "x"}
    saved = {"identity": validate.identity_digest(wanted), "identity_fields": wanted, "cache_sha256": "s", "status": "ok"}
    cases = {
        "nothing": (wanted, None, None), "data alone": (wanted, None, "s"), "same": (wanted, saved, "s"), "other cache": (wanted, saved, "t"),
        "other data": (wanted | {"data": "y"}, saved, "s"), "excluded": (wanted, saved | {"status": "excluded"}, None),
    }
    told = [(name, decision, ",".join(why)) for name, case in cases.items() for decision, why in [validate.resume_decision(*case)]]
    told += [(text, validate.failure_kind(text, {"no reviews"}), "") for text in ("no reviews", "no reviews, really")]
    return spark.createDataFrame(told, "found string, decision string, why string")


def identity_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of an identity, of all users that a fit depends on, and of an input unit's files."""
    users = reviews(spark, sf_dir).select("user").distinct()
    depends = validate.dependency_digest(users.select("user", F.lit("v1").alias("identity"), F.sha2(F.col("user").cast("string"), 256).alias("sha256")))
    files = users.select(F.concat(F.lit("/in/part-"), F.col("user").cast("string")).alias("path"), F.sha2(F.col("user").cast("string"), 256).alias("sha256"), (F.col("user") * 10).alias("size"))
    own = spark.createDataFrame([("identity", validate.identity_digest({"revision": "a", "data": "x"}))], "what string, sha256 string")
    return own.unionByName(depends.select(F.lit("dependencies").alias("what"), "sha256")).unionByName(validate.unit_digest(files, "/in").select(F.lit("unit").alias("what"), "sha256"))


def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults planted by user number: not scored, wrong fold, stale fit, wrong size, a model missing."""
    sizes = _sizes(spark, sf_dir)
    u = F.col("user")
    held = sizes.select((u % 2).cast("int").alias("fold"), "user", F.lit("held").alias("role"))
    scores = sizes.where(u % 11 != 1).select(
        "user", F.when(u % 11 == 2, 1 - u % 2).otherwise(u % 2).cast("int").alias("fold"), F.explode(F.when(u % 11 == 3, F.array(F.lit("base"))).otherwise(F.array(F.lit("base"), F.lit("boosted")))).alias("model"),
        (F.col("size") + (u % 11 == 4).cast("long")).alias("size"), F.when(u % 11 == 5, F.lit("old")).otherwise(F.concat(F.lit("f"), F.when(u % 11 == 2, 1 - u % 2).otherwise(u % 2).cast("string"))).alias("fit_sha256"),
    )
    fits = spark.createDataFrame([(0, "f0"), (1, "f1")], "fold int, sha256 string")
    return validate.report_faults(scores, held, sizes, ["base", "boosted"], fits)


def reconciled_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reported mean that differs by a millionth is named."""
    told = metrics.per_user(calibrated(spark, sf_dir), "p_b")
    means = told.agg(F.avg("log_loss").alias("log_loss"), F.avg("rmse_bins").alias("rmse_bins")).first().asDict()
    wrong = validate.reconciled(told, means | {"rmse_bins": means["rmse_bins"] + 1e-6})
    return spark.createDataFrame([(name,) for name in wrong], "metric string")


def held_user_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that two folds hold out, and users that no group of coefficients lists."""
    users = reviews(spark, sf_dir).select("user").distinct()
    held = users.select(F.lit(0).alias("fold"), "user", F.lit("held").alias("role")).unionByName(users.where("user % 5 = 0").select(F.lit(1).alias("fold"), "user", F.lit("held").alias("role")))
    groups = users.where("user % 4 > 0").select(F.array("user").alias("users"))
    twice = joins.held_twice(held).select("user", F.lit("held twice").alias("fault"))
    return twice.unionByName(joins.without_betas(users, groups).select("user", F.lit("no coefficients").alias("fault")))


def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that JSON cannot hold become null."""
    odd = F.when(F.col("review_th") % 5 == 0, F.lit(float("nan"))).when(F.col("review_th") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("p_fsrs"))
    return tables.json_safe_columns(reviews(spark, sf_dir).select(*KEY, odd.alias("value")))


def listed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a JSON list as text, and the folds and the schema faults that parsers tell."""
    texts = [str(r.user) for r in reviews(spark, sf_dir).select("user").distinct().collect()]
    rows = [("user", str(u)) for u in tables.user_ids({"user_ids": texts})] + [("fold", str(k)) for k in splits.selected_folds("1,0,1")]
    wrong = reviews(spark, sf_dir).drop("p_milli", "r_milli", "duration").withColumn("y", F.col("y").cast("int"))
    rows += [("schema", x.split(":")[0]) for x in validate.schema_faults(wrong, source.REVIEW_SCHEMA)]
    return spark.createDataFrame(rows, "kind string, value string")


def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in the order of user and review, from sorted ranges."""
    return splits.placed(reviews(spark, sf_dir).select(*KEY), *KEY)


def held_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the held users of both outer folds: each row once."""
    rows = reviews(spark, sf_dir).select(*KEY)
    outer = splits.split_table(spark, splits.nested_splits([r.user for r in rows.select("user").distinct().collect()], 20))
    return splits.members(rows, outer, 0, "held").unionByName(splits.members(rows, outer, 1, "held"))


def inner_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each of three inner groups of all users."""
    groups = splits.inner_groups([r.user for r in reviews(spark, sf_dir).select("user").distinct().collect()], 20)
    return spark.createDataFrame([(k, len(g)) for k, g in enumerate(groups)], "part long, users long")


def external_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of probabilities on a panel that nothing was fitted on."""
    told = external(reviews(spark, sf_dir).drop("p_milli", "r_milli"), {}, BETA)
    return told.select("model", "user", "size", *(r6(m).alias(m) for m in ("log_loss", "rmse_bins", "auc")))


def boost_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outer folds of the nested evaluation with a small booster: held-out metrics of the three probabilities."""
    rows = reviews(spark, sf_dir).drop("p_milli", "r_milli")
    return evaluate(rows, seed=20, settings=boost.Settings(rounds=4, depth=3, bins=32, eta=0.3, min_child_weight=5))


def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature families added one after the other to a penalised correction."""
    return ablation(reviews(spark, sf_dir).drop("p_milli", "r_milli"), BETA)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest gap of every feature between the batch plan and the streaming scorer over the same rows, to a millionth: none."""
    rows = reviews(spark, sf_dir).drop("p_milli", "r_milli")
    online = scorer.replay(rows, BETA)
    batch = features.build(rows, BETA, narrow=False)
    told = metrics.largest_gap(batch, online, ["p_b", *features.FEATURES])
    return told.select(*(r6(c).alias(c) for c in ["p_b", *features.FEATURES]), F.col("unmatched").cast("long").alias("unmatched"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        reviews_base, cards_left_join, calibrated_pb, spine_windows, surprise_base, surprise_calibrated, card_state, log_state, deck_all, deck_other, note_other,
        deck_since_other, deck_cards_seen, rating_windows, rating_lag, streaks, session_timing, chrono_folds, disagreement, metric_bins, user_logloss,
        user_rmse_bins, user_auc, user_mbe, equal_user_summary, equal_user_weights, paired_delta, volume_split, shards, semi_folds, resume_anti,
        deferred_difference, contract_violations, causality_check, unmapped_cards, row_index_contiguity, split_coverage, clip_hits, card_codes,
        hist_split_stats, calibration_objective, report_total, head_rows, spaced_users, standardized, size_mismatches, stored_lookup, misaligned_rows, group_betas,
        multiset_difference, feature_matrix, calibration_fit, crossfit_betas, ridge_correction, bootstrap_ci,
        boost_fit_predict, ablation_deltas, stream_scores, narrow_features, fold_masks, resume_decisions, identity_digests, report_checks, reconciled_means,
        held_user_faults, json_numbers, listed_users, ordered_rows, held_union, inner_group_sizes, external_panel,
    )
}

ORACLE_SQL: dict[str, str] = SQL
