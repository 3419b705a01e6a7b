"""Job driver: ``python -m tidemark STAGE ...``; every stage reads and writes tables.

``derive`` makes the review table, ``check`` tests its contract, ``fit`` boosts the outer folds and
goes on from saved states, ``score`` applies the saved models to their held users, ``report`` checks
everything that a report depends on before it writes one, ``all`` does these four in turn, and
``ablation`` compares feature families.
"""

from __future__ import annotations

import argparse
import json
from argparse import Namespace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boost, splits, validate
from .plans import ablation, nested
from .session import reachable
from .sources import tables
from .sources.reviews import REVIEW_SCHEMA, read_reviews, reviews_from_events, write_reviews

MODELS = {"base": "p_fsrs", "calibrated": "p_b", "boosted": "p_hat"}
SCORES = "model string, user long, size long, log_loss double, rmse_bins double, auc double, fold int, fit_sha256 string"


def _users(spark: SparkSession, rows: DataFrame, path: str | None, deferred: str | None) -> list[int]:
    """Users of the table, or of a list, without the deferred ones; a stranger among those is an error."""
    users = tables.read_user_ids(spark, path) if path else sorted(r.user for r in rows.select("user").distinct().collect())
    later = tables.read_user_ids(spark, deferred) if deferred else []
    if strangers := set(later) - set(users):
        raise SystemExit(f"deferred users that are no users: {sorted(strangers)}")
    return sorted(set(users) - set(later))


def check(rows: DataFrame) -> None:
    """The contract of the review table; any violation ends the job."""
    found = {r.rule: r.violations for r in validate.violations(rows).collect()}
    found["schema"] = len(validate.schema_faults(rows, REVIEW_SCHEMA))
    print(json.dumps(found, sort_keys=True))
    if any(found.values()):
        raise SystemExit(1)


class Job:
    """One review table and what its stages share."""

    def __init__(self, spark: SparkSession, args: Namespace):
        self.spark, self.args = spark, args
        rows = read_reviews(spark, args.reviews)
        self.users = _users(spark, rows, args.users, args.defer_users)
        self.rows = rows.join(spark.createDataFrame([(u,) for u in self.users], "user long"), "user", "left_semi")
        self.outer = splits.nested_splits(self.users, args.seed)
        self.settings = boost.Settings(rounds=args.rounds, seed=args.seed)
        self.folds = splits.selected_folds(args.folds)
        self.source = validate.unit_digest(validate.file_digests(spark, args.reviews), args.reviews).first().sha256

    def store(self, fold: int) -> nested.Store:
        return nested.Store(self.spark, f"{self.args.out}/models/fold={fold}")

    def fit(self) -> None:
        for fold in self.folds:
            nested.fit_fold(self.rows, self.outer[fold], self.args.seed, self.settings, self.store(fold), self.source, self.args.force)

    def score(self) -> None:
        for fold in self.folds:
            held = nested.score_fold(self.rows, self.outer[fold], self.args.seed, self.settings, self.store(fold), self.source)
            if self.args.shard:
                held = held.join(splits.shard(held.select("user").distinct(), *splits.parse_shard(self.args.shard)), "user", "left_semi")
            digest = nested.model_digest(self.store(fold).load())
            scored = nested.score(held, MODELS).withColumns({"fold": F.lit(fold), "fit_sha256": F.lit(digest)})
            part = self.args.shard.replace("/", "of") if self.args.shard else "all"
            tables.write_records(scored, f"{self.args.out}/scores/fold-{fold}-{part}")
            rows = held.withColumn("row_index", F.col("review_th")).select("user", "row_index", *MODELS.values())
            tables.write_predictions(rows, f"{self.args.out}/predictions/fold-{fold}-{part}")

    def report(self) -> None:
        """Faults end the job; else the report and a manifest of all it depends on are written."""
        records = self.spark.read.schema(SCORES).json(f"{self.args.out}/scores/*")
        held = splits.split_table(self.spark, self.outer)
        sizes = self.rows.groupBy("user").agg(F.count(F.lit(1)).alias("size"))
        fits = {fold: nested.model_digest(model) for fold in range(len(self.outer)) if (model := self.store(fold).load())}
        digests = self.spark.createDataFrame(list(fits.items()), "fold int, sha256 string")
        faults = validate.report_faults(records, held, sizes, list(MODELS), digests).groupBy("fault").agg(F.count(F.lit(1)).alias("users")).collect()
        if faults:
            print(json.dumps({r.fault: r.users for r in faults}, sort_keys=True))
            raise SystemExit(1)
        told = nested.report(records)
        means = {(r.model, r.metric): r["mean"] for r in told.collect()}
        wrong = [name for name in MODELS if validate.reconciled(records.where(F.col("model") == name), {m: means[name, m] for m in nested.METRICS if (name, m) in means})]
        if wrong:
            raise SystemExit(f"means that do not agree with the records: {wrong}")
        tables.write_records(told, f"{self.args.out}/report")
        manifest = {
            "source_sha256": self.source, "users": len(self.users), "reviews": self.rows.count(), "seed": self.args.seed, "rounds": self.args.rounds, "fits": fits, "spark": self.spark.version,
            "identity": validate.identity_digest({"source": self.source, "users": self.users, "seed": self.args.seed, "fits": fits}),
        }
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.args.out}/manifest")
        for r in told.collect():
            print(json.dumps(r.asDict(), sort_keys=True))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("stage", choices=["derive", "check", "fit", "score", "report", "all", "ablation"])
    parser.add_argument("--events", help="event table for derive")
    parser.add_argument("--reviews", required=True, help="review table")
    parser.add_argument("--out", help="folder of models, scores and the report; for ablation its table")
    parser.add_argument("--users", help="JSON list of users")
    parser.add_argument("--defer-users", help="JSON list of users to leave out")
    parser.add_argument("--folds", help="outer folds, such as 0,1")
    parser.add_argument("--shard", help="I/N: score every N-th held user from the I-th on")
    parser.add_argument("--seed", type=int, default=20)
    parser.add_argument("--rounds", type=int, default=600)
    parser.add_argument("--force", action="store_true", help="fit anew over saved models")
    args = parser.parse_args(argv)
    spark = reachable(SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if args.stage == "derive":
        write_reviews(reviews_from_events(spark.read.parquet(args.events)).drop("p_milli"), args.reviews)
        return
    if args.stage == "ablation":
        settings = boost.Settings(rounds=args.rounds, seed=args.seed)
        tables.write_records(ablation.ablation(read_reviews(spark, args.reviews), (0.0, 0.0, 0.0), settings), args.out)
        return
    checked = partial(check, read_reviews(spark, args.reviews))
    if args.stage == "check":
        checked()
        return
    job = Job(spark, args)
    stages = {"fit": [job.fit], "score": [job.score], "report": [job.report], "all": [checked, job.fit, job.score, job.report]}
    for stage in stages[args.stage]:
        stage()


if __name__ == "__main__":
    main()
