"""Metrics, splits, joins, learners and checks on small tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tests.test_windows import BETA, table, user_rows
from tidemark.functions import scalars
from tidemark.operators import boost, calibrate, features, joins, metrics, splits, validate
from tidemark.operators import windows as W
from tidemark.plans import nested
from tidemark.sources import tables
from tidemark.sources.reviews import REVIEW_SCHEMA, read_reviews, write_reviews


def test_metrics_against_loops(spark: SparkSession) -> None:
    rows = user_rows(1) + [r | {"user": 2, "y": 1.0} for r in user_rows(1)]
    told = {r.user: r for r in metrics.per_user(table(spark, rows), "p_fsrs").collect()}
    for user in (1, 2):
        own = [r for r in rows if r["user"] == user]
        loss = np.mean([-(math.log(r["p_fsrs"]) if r["y"] else math.log(1 - r["p_fsrs"])) for r in own])
        assert told[user].log_loss == pytest.approx(loss)
        cells: dict[tuple, list] = {}
        for r in own:
            key = tuple(round(s * b ** math.floor(math.log(x) / math.log(b)), d) if x else 0.0 for (s, b, d), x in zip(scalars.BINS.values(), (r["elapsed_days"], r["i"], r["lapse"]), strict=True))
            cells.setdefault(key, []).append(r)
        gap = sum(len(c) * (np.mean([r["y"] for r in c]) - np.mean([r["p_fsrs"] for r in c])) ** 2 for c in cells.values())
        assert told[user].rmse_bins == pytest.approx(math.sqrt(gap / len(own)))
    own = user_rows(1)
    pairs = [(a["p_fsrs"], b["p_fsrs"]) for a, b in itertools.product(own, own) if a["y"] == 1 and b["y"] == 0]
    assert told[1].auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]))
    assert told[2].auc is None
    summary = metrics.equal_user(metrics.per_user(table(spark, rows), "p_fsrs"), ["log_loss", "auc"]).first()
    assert (summary.n_log_loss, summary.n_auc) == (2, 1)
    assert summary.mean_log_loss == pytest.approx((told[1].log_loss + told[2].log_loss) / 2)


def test_bootstraps_agree(spark: SparkSession) -> None:
    deltas = np.random.default_rng(3).normal(-0.01, 0.05, 300)
    here = metrics.paired_bootstrap(deltas, 4000)
    there = metrics.bootstrap(spark.createDataFrame([(k, float(d)) for k, d in enumerate(deltas)], "user long, delta double"), 1500).first()
    assert there.mean == pytest.approx(here["mean"])
    assert there.se == pytest.approx(here["se"], rel=0.1)
    assert there.ci_low == pytest.approx(here["ci_low"], abs=0.002)
    assert (there.improved, there.worsened, there.n) == (here["improved"], here["worsened"], 300)
    half = metrics.bca_half_width(deltas, 0.95, 2000)
    assert half == pytest.approx(1.96 * deltas.std(ddof=1) / math.sqrt(300), rel=0.1)


@pytest.mark.parametrize("users", [list(range(1, 31)), list(range(1, 17))])
def test_splits_cover_and_do_not_meet(spark: SparkSession, users: list[int]) -> None:
    found = splits.nested_splits(users, 20)
    assert found == splits.nested_splits(users[::-1], 20)
    assert sorted(found[0]["held"] + found[1]["held"]) == users
    for split in found:
        parts = [set(split[k]) for k in ("train", "val", "held")]
        assert sum(map(len, parts)) == len(set.union(*parts)) == len(users)
    faults = splits.split_faults(splits.split_table(spark, found), spark.createDataFrame([(u,) for u in users], "user long")).collect()
    assert [(r.doubled, r.missing, r.strange) for r in faults] == [(0, 0, 0)] * 2
    groups = splits.inner_groups(users, 1)
    assert sorted(itertools.chain(*groups)) == users
    assert [len(g) for g in groups] == sorted((len(g) for g in groups), reverse=True)


def test_shards_cover_once_and_parsers_refuse(spark: SparkSession) -> None:
    users = spark.createDataFrame([(u,) for u in range(101)], "user long")
    seen = [r.user for k in range(8) for r in splits.shard(users, k, 8).collect()]
    assert sorted(seen) == list(range(101))
    assert splits.selected_folds("1,0,1") == [0, 1]
    for bad in ("2", "-1"):
        with pytest.raises(ValueError):
            splits.selected_folds(bad)
    for bad in ("8/8", "-1/8"):
        with pytest.raises(ValueError):
            splits.parse_shard(bad)
    assert tables.user_ids({"user_ids": ["3", 1]}) == [1, 3]
    with pytest.raises(ValueError):
        tables.user_ids([1, "1"])


def test_cards_join_keeps_first_and_fills(spark: SparkSession) -> None:
    rows = table(spark, user_rows(1)).where("card_id < 3")
    cards = spark.createDataFrame([(1, 0, 7, 7), (1, 0, 5, 5), (1, 1, None, 4)], "user long, card_id long, deck_id long, note_id long")
    told = {(r.card_id, r.deck_id, r.note_id) for r in joins.with_card_groups(rows, cards).collect()}
    assert told == {(0, 5, 5), (1, -2, -2), (2, -3, -3)}
    assert joins.misaligned(rows, rows.withColumn("y", 1 - F.col("y")), ["y"], ("user", "review_th")).count() == rows.count()


def test_folds_are_the_last_blocks(spark: SparkSession) -> None:
    told = W.with_fold(table(spark, user_rows(1, 20))).orderBy("review_th").collect()
    assert [r.chrono_fold for r in told] == [None] * 5 + [k for k in range(5) for _ in range(3)]


@pytest.mark.parametrize(
    ("rule", "change"),
    [("probability", {"p_fsrs": 1.1}), ("probability", {"p_fsrs": math.nan}), ("label", {"y": 2.0}), ("fold_cover", {"fold": 0}), ("lapse", {"lapse": -1}), ("elapsed", {"elapsed_days": -1.0}), ("day_order", {"day_offset": -5}), ("fold_order", {"fold": 9})],
)
def test_contract_violations(spark: SparkSession, rule: str, change: dict) -> None:
    rows = user_rows(1)
    assert {r.violations for r in validate.violations(table(spark, rows)).collect()} == {0}
    bad = [r | change if rule == "fold_cover" or t == 30 else r for t, r in enumerate(rows)]
    told = {r.rule: r.violations for r in validate.violations(table(spark, bad)).collect()}
    assert told[rule] > 0


def test_schema_and_round_trip(spark: SparkSession, tmp_path) -> None:
    rows = table(spark, user_rows(1), user_rows(2))
    assert validate.schema_faults(rows, REVIEW_SCHEMA) == []
    assert validate.schema_faults(rows.withColumn("y", F.col("y").cast("int")).drop("i"), REVIEW_SCHEMA)
    write_reviews(rows, str(tmp_path / "r"))
    assert splits.multiset_difference(read_reviews(spark, str(tmp_path / "r")).select(rows.columns), rows).isEmpty()
    digests = validate.file_digests(spark, str(tmp_path / "r"))
    first = validate.unit_digest(digests, str(tmp_path / "r")).first().sha256
    assert first == validate.unit_digest(digests.orderBy(F.desc("path")), str(tmp_path / "r")).first().sha256
    records = spark.createDataFrame([(1, math.nan), (2, 0.5)], "user long, auc double")
    tables.write_records(records, str(tmp_path / "m"))
    assert [r.auc for r in spark.read.json(str(tmp_path / "m")).orderBy("user").collect()] == [None, 0.5]


def test_resume_and_identity() -> None:
    wanted = {"revision": "a", "data": "x"}
    saved = {"identity": validate.identity_digest(wanted), "identity_fields": wanted, "cache_sha256": "s", "status": "ok"}
    assert validate.resume_decision(wanted, None, None) == ("run", [])
    assert validate.resume_decision(wanted, None, "s")[0] == "refuse"
    assert validate.resume_decision(wanted, saved, "s") == ("skip", [])
    assert validate.resume_decision(wanted, saved, "other") == ("refuse", ["cache_sha256"])
    assert validate.resume_decision(wanted | {"data": "y"}, saved, "s") == ("refuse", ["data"])
    assert validate.failure_kind("x\nno reviews\n", {"no reviews"}) == "excluded"
    assert validate.failure_kind("no reviews\nboom", {"no reviews"}) == "failed"


def test_report_faults(spark: SparkSession) -> None:
    held = spark.createDataFrame([(0, 1, "held"), (1, 2, "held")], "fold int, user long, role string")
    scores = spark.createDataFrame([(1, 0, "base", 5, "f0"), (2, 1, "base", 5, "f1")], "user long, fold int, model string, size long, fit_sha256 string")
    sizes = spark.createDataFrame([(1, 5), (2, 5)], "user long, size long")
    fits = spark.createDataFrame([(0, "f0"), (1, "f1")], "fold int, sha256 string")
    assert validate.report_faults(scores, held, sizes, ["base"], fits).isEmpty()
    stale = validate.report_faults(scores.withColumn("fit_sha256", F.lit("old")), held, sizes, ["base"], fits)
    assert {r.fault for r in stale.collect()} == {"stale fit"}
    assert {r.fault for r in validate.report_faults(scores.where("user = 1"), held, sizes, ["base"], fits).collect()} == {"not scored"}


def test_calibration_weighs_users_equally(spark: SparkSession) -> None:
    one = [user_rows(1)[0] | {"y": 1.0, "p_fsrs": 1.0}]
    many = [r | {"y": 0.0, "p_fsrs": 0.0} for r in user_rows(2, 120)]
    found = calibrate.fit(features.with_spine(table(spark, one, many)))
    assert np.allclose(found.beta, 0, atol=1e-4)


def test_calibration_beats_base_and_matches_gradient(spark: SparkSession) -> None:
    rows = features.with_spine(table(spark, user_rows(1), user_rows(2), user_rows(3)))
    found = calibrate.fit(rows)
    design = calibrate.design(rows)
    told = calibrate.objective(design, found.beta).first()
    assert max(abs(told.g0), abs(told.g1), abs(told.g2)) < 1e-6
    assert told.loss <= calibrate.objective(design, (0.0, 0.0, 0.0)).first().loss
    beta = calibrate.offset_regression(design, ["x16", "x256"], "y", "z", "weight", l2=1e-3)
    x = np.array(design.select("x16", "x256").collect())
    y, z, w = (np.array([r[0] for r in design.select(c).collect()]) for c in ("y", "z", "weight"))
    slope = x.T @ (w * (1 / (1 + np.exp(-(z + x @ beta))) - y)) + 1e-3 * beta
    assert np.abs(slope).max() < 1e-8


SMALL = boost.Settings(rounds=3, depth=2, bins=8, eta=0.3, min_child_weight=1.0, checkpoint_every=1)


def boost_rows(spark: SparkSession):
    built = features.build(table(spark, user_rows(1), user_rows(2), user_rows(3)), BETA).withColumn("margin", scalars.logit(F.col("p_b")))
    return metrics.row_weights(built)


def test_boosting_learns_resumes_and_ignores_partitioning(spark: SparkSession) -> None:
    rows = boost_rows(spark)
    names = ["x16", "rt_last", "st_card_seq", "sg_log_secs"]
    saved: list[str] = []
    model = boost.fit(rows, rows, names, SMALL, save=lambda m: saved.append(m.dumps()), identity="a")
    again = boost.fit(rows.repartition(3), rows, names, SMALL, start=boost.Model.loads(saved[0]), identity="a")
    assert [[n[:4] for n in t] for t in model.trees] == [[n[:4] for n in t] for t in again.trees] and model.cuts == again.cuts
    with pytest.raises(ValueError, match="other inputs"):
        boost.fit(rows, rows, names, SMALL, start=boost.Model.loads(saved[0]), identity="b")
    told = boost.predict(rows, model)
    before, after = (told.agg(F.sum(F.col("weight") * metrics.row_loss(F.col("y"), F.col(p)))).first()[0] for p in ("p_b", "p_hat"))
    assert after < before


def test_held_users_cannot_change_the_model(spark: SparkSession) -> None:
    users = list(range(1, 17))
    split = splits.nested_splits(users, 20)[0]
    rows = [user_rows(u, 24) for u in users]
    twisted = [[r | {"y": 1 - r["y"], "rating": 1.0} for r in own] if own[0]["user"] in split["held"] else own for own in rows]
    models = [nested.fit_fold(table(spark, *t), split, 1, boost.Settings(rounds=1, depth=1, bins=4, min_child_weight=1.0))[0] for t in (rows, twisted)]
    assert models[0].dumps() == models[1].dumps()


def test_ablation_and_external_panel(spark: SparkSession) -> None:
    from tidemark.plans import ablation

    rows = table(spark, *(user_rows(u) for u in range(1, 9)))
    told = ablation.ablation(rows, BETA, families=["spine", "stream"]).collect()
    assert [(r.step, r.n_features) for r in told] == [("calibrated", 0), ("spine", 2), ("stream", 12)]
    # four evaluation users of a nearly separable toy: ranks improve, confident mistakes cost log loss
    assert told[0].delta is None and told[2].auc > told[0].auc
    model = boost.fit(boost_rows(spark), boost_rows(spark), ["x16", "rt_last"], SMALL)
    found = ablation.external(rows, {"boosted": model}, BETA)
    assert found.groupBy("model").count().where("count = 8").count() == 3


def test_job_driver(spark: SparkSession, tmp_path, capsys, monkeypatch) -> None:
    """All stages; a fit that is there is not made again, one of other inputs is refused, and faults keep a report back."""
    import json

    from tidemark.__main__ import main

    reviews, out = str(tmp_path / "r"), str(tmp_path / "s")
    write_reviews(table(spark, *(user_rows(u, 24) for u in range(1, 17))), reviews)
    main(["check", "--reviews", reviews])
    assert [r.user for r in tables.discovered_users(spark, reviews).orderBy("user").collect()] == list(range(1, 17))
    same = ["--reviews", reviews, "--out", out, "--rounds", "1"]
    with pytest.raises(ValueError, match="no model"):
        main(["score", *same])
    capsys.readouterr()
    main(["all", *same])
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{") and "metric" in x]
    assert {(r["model"], r["metric"]) for r in told if r["n_users"] == 16} >= {("base", "log_loss"), ("boosted", "log_loss"), ("calibrated", "rmse_bins")}
    manifest = json.loads(spark.read.text(f"{out}/manifest").first().value)
    assert manifest["users"] == 16 and manifest["reviews"] == 384 and set(manifest["fits"]) == {"0", "1"}
    grown = []
    monkeypatch.setattr(boost, "grow", lambda *a: grown.append(a))
    main(["fit", *same, "--folds", "0"])
    assert not grown
    with pytest.raises(ValueError, match="other inputs"):
        main(["fit", *same[:-1], "2", "--folds", "0"])
    monkeypatch.undo()
    main(["fit", *same[:-1], "2", "--folds", "0", "--force"])
    with pytest.raises(SystemExit):
        main(["report", *same[:-1], "2"])
    assert "stale fit" in capsys.readouterr().out


def test_fits_that_do_not_converge_are_refused(spark: SparkSession) -> None:
    rows = features.with_spine(table(spark, user_rows(1), user_rows(2), user_rows(3)))
    with pytest.raises(ValueError, match="converge"):
        calibrate.fit(rows, max_iter=1)
    with pytest.raises(ValueError, match="convergence"):
        calibrate.offset_regression(calibrate.design(rows), ["x16", "x256"], "y", "z", "weight", max_iter=1)
    assert calibrate.fit(rows).iterations > 1
    sure = [[r | {"p_fsrs": 0.999999, "y": float(r["review_th"] % 2)} for r in user_rows(u)] for u in (1, 2)]
    sure = features.with_spine(table(spark, *sure))
    design, found = calibrate.design(sure), calibrate.fit(sure)
    assert found.objective <= calibrate.objective(design, (0.0, 0.0, 0.0)).first().loss


def test_places_of_a_total_order(spark: SparkSession) -> None:
    rng = np.random.default_rng(1)
    rows = [(int(a), k) for k, a in enumerate(rng.integers(0, 20, 500))]
    told = splits.placed(spark.createDataFrame(rows, "size long, user long").repartition(7), "size", "user").collect()
    assert [(r.size, r.user) for r in sorted(told, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in told) == list(range(500))
