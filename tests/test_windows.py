"""Features against plain loops, on a synthetic user of 48 rows and one of 400."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, validate
from tidemark.sources.reviews import REVIEW_SCHEMA
from tidemark.streaming import scorer

BETA = (0.05, -0.4, 0.8)


def user_rows(user: int, n: int = 48) -> list[dict]:
    return [
        {
            "user": user, "review_th": t + 1, "rating": float((t + user) % 4 + 1), "y": float((t + user) % 4 + 1 > 1), "p_fsrs": 0.65 + ((t + user) % 7) * 0.04,
            "fold": min(t * 5 // n, 4), "i": t // 5 + 1, "elapsed_days": float(t % 4 + 1), "lapse": t // 13, "nth_today": t % 8, "day_offset": t // 8, "card_id": t % 5,
            "deck_id": (t % 5) // 2, "note_id": t % 5, "elapsed_seconds": float((t % 4 + 1) * 86400), "duration": float((t % 6 + 1) * 900),
        }
        for t in range(n)
    ]


def table(spark: SparkSession, *users: list[dict]):
    rows = [tuple(r[f.name] for f in REVIEW_SCHEMA) for u in users for r in u]
    return spark.createDataFrame(rows, REVIEW_SCHEMA)


def mean(x: list[float]) -> float:
    return sum(x) / len(x) if x else 0.0


def expected(rows: list[dict]) -> list[dict]:
    """The definition of each feature, one row at a time over the rows before."""
    out, r_f, r_b = [], [], []
    for t, row in enumerate(rows):
        past = rows[:t]
        f = {"x16": sum(r_f[-16:]) / (min(t, 16) + 64), "x256": sum(r_f[-256:]) / (min(t, 256) + 64)}
        z = math.log(row["p_fsrs"] / (1 - row["p_fsrs"])) + BETA[0] + BETA[1] * f["x16"] + BETA[2] * f["x256"]
        f["p_b"] = 1 / (1 + math.exp(-z))
        for tag, r in (("F", r_f), ("B", r_b)):
            f |= {f"s{tag}_mean16": mean(r[-16:]), f"s{tag}_mean64": mean(r[-64:]), f"s{tag}_max16": max(r[-16:], default=0.0), f"s{tag}_max64": max(r[-64:], default=0.0)}
            f |= {f"s{tag}_last": r[-1] if r else 0.0, f"s{tag}_all": mean(r)}
        own = [k for k, p in enumerate(past) if p["card_id"] == row["card_id"]]
        f |= {"st_card_seq": len(own), "st_age_days": sum(past[k]["elapsed_days"] for k in own), "st_t": t, "st_log_t": math.log1p(t)}
        for short, key in (("dk", "deck_id"), ("nt", "note_id")):
            group = [k for k, p in enumerate(past) if p[key] == row[key]]
            other = [k for k in group if past[k]["card_id"] != row["card_id"]]
            f |= {f"{short}_n_other": len(other), f"{short}_acc_other": sum(r_b[k] for k in other) / (len(other) + 64)}
            if short == "dk":
                f |= {"dk_n_all": len(group), "dk_acc_all": sum(r_b[k] for k in group) / (len(group) + 64), "dk_cards_seen": len({past[k]["card_id"] for k in group})}
                f["dk_since_other"] = row["day_offset"] - past[other[-1]]["day_offset"] if other else -1
        ratings = [p["rating"] for p in past]
        last = ratings[-32:]
        f |= {"rt_last": ratings[-1] if t else 0.0, "rt_mean8": mean(ratings[-8:]), "rt_mean32": mean(last), "rt_fail32": mean([float(x < 3) for x in last])}
        f["rt_sd32"] = math.sqrt(max(0.0, mean([x * x for x in last]) - mean(last) ** 2))
        for name, holds in (("rt_good_streak", lambda x: x >= 3), ("rt_lapse_streak", lambda x: x == 1)):
            run = 0
            while run < t and holds(ratings[t - 1 - run]):
                run += 1
            f[name] = run
        f |= {"sg_log_secs": math.log1p(max(row["elapsed_seconds"], 0)), "sg_same_session": float(row["elapsed_seconds"] < 600), "sg_prev_dur_log": math.log1p(past[-1]["duration"]) if t else 0.0}
        out.append(f)
        r_f.append(row["y"] - row["p_fsrs"])
        r_b.append(row["y"] - f["p_b"])
    return out


def moved(rows: list[dict]) -> list[dict]:
    """Card 1 leaves its groups for a while and comes back."""
    return [r | ({"deck_id": 20, "note_id": 200} if r["card_id"] == 1 and 15 <= t < 30 else {}) for t, r in enumerate(rows)]


@pytest.mark.parametrize("rows", [user_rows(1), user_rows(2, 400), moved(user_rows(3))], ids=["short", "long", "moved"])
def test_features_follow_their_definitions(spark: SparkSession, rows: list[dict]) -> None:
    built = features.build(table(spark, rows), BETA, narrow=False).orderBy("review_th").toPandas()
    for t, want in enumerate(expected(rows)):
        for name, value in want.items():
            assert built[name][t] == pytest.approx(value, abs=1e-9), (t, name)
    assert features.not_finite(features.build(table(spark, rows), BETA)).isEmpty()


def test_frozen_and_local_groups_agree_when_cards_stay(spark: SparkSession) -> None:
    rows = table(spark, user_rows(1), user_rows(2))
    local, frozen = (features.build(rows, BETA, frozen=x).select("user", "review_th", *features.GROUPS) for x in (False, True))
    assert local.exceptAll(frozen).isEmpty()


def test_frozen_groups_count_a_card_where_the_user_met_it(spark: SparkSession) -> None:
    rows = moved(user_rows(3))
    built = features.build(table(spark, rows), BETA, frozen=True).orderBy("review_th").toPandas()
    met: dict[int, int] = {}
    for t, row in enumerate(rows):
        assert built["dk_cards_seen"][t] == sum(deck == row["deck_id"] for deck in met.values())
        met.setdefault(row["card_id"], row["deck_id"])


def test_leaks_are_found_at_all_places(spark: SparkSession) -> None:
    rows = table(spark, user_rows(1), user_rows(2))
    assert validate.causality(rows, lambda t: features.build(t, BETA), features.FEATURES).first().rows_checked == 2 * sum(n + 1 for n in (48 // 7, 16, 24, 47))
    leaky = validate.causality(rows, lambda t: t.withColumn("f", F.col("y")), ["f"]).first()
    assert leaky.rows_changed == 2 * 4


def test_coefficients_of_each_user(spark: SparkSession) -> None:
    rows = table(spark, user_rows(1), user_rows(2))
    betas = {1: BETA, 2: (0.3, 0.1, -0.2)}
    told = scorer.replay(rows, spark.createDataFrame([(u, *b) for u, b in betas.items()], "user long, b0 double, b1 double, b2 double")).toPandas()
    for user, beta in betas.items():
        want = features.build(rows.where(F.col("user") == user), beta, narrow=False).orderBy("review_th").toPandas()
        assert np.allclose(told[told.user == user].sort_values("review_th")["p_b"], want["p_b"])
    with pytest.raises(Exception, match="neither"):
        scorer.replay(rows, spark.createDataFrame([(1, *BETA)], "user long, b0 double, b1 double, b2 double")).collect()


def test_later_outcomes_change_no_earlier_feature(spark: SparkSession) -> None:
    rows = table(spark, user_rows(1), user_rows(2))
    for after in (0, 20, 47):
        told = validate.causality(rows, lambda t: features.build(t, BETA), features.FEATURES, [F.lit(after)]).first()
        assert told.rows_checked == 2 * (after + 1)
        assert told.rows_changed == 0


@pytest.mark.parametrize("rows", [user_rows(1), user_rows(2, 400), moved(user_rows(3))], ids=["short", "long", "moved"])
def test_online_scorer_equals_the_plan(spark: SparkSession, rows: list[dict]) -> None:
    built = features.build(table(spark, rows), BETA, narrow=False).orderBy("review_th").toPandas()
    session = scorer.Session(BETA)
    for t, row in enumerate(rows):
        if t == 20:  # state survives being saved
            session = scorer.Session(BETA).loads(session.dumps())
        told = session.observe(row)
        for name in ["p_b", *features.FEATURES]:
            assert told[name] == pytest.approx(built[name][t], abs=1e-9), (t, name)


def test_online_scorer_refuses_bad_reviews() -> None:
    session = scorer.Session(BETA)
    row = user_rows(1)[0]
    with pytest.raises(ValueError, match="missing"):
        session.observe(row | {"rating": None})
    with pytest.raises(ValueError, match="outside"):
        session.observe(row | {"p_fsrs": 1.1})
    with pytest.raises(ValueError, match="neither"):
        scorer.Session(None).observe(row)
    session.observe(row)
    with pytest.raises(ValueError, match="order"):
        session.observe(row)


def test_stream_carries_state_across_batches(spark: SparkSession, tmp_path) -> None:
    rows = user_rows(1) + user_rows(2)
    source = tmp_path / "in"
    first = [r for r in rows if r["review_th"] <= 20]
    second = [r for r in rows if r["review_th"] > 20]
    table(spark, first).coalesce(1).write.parquet(str(source / "a"))
    stream = spark.readStream.schema(REVIEW_SCHEMA).parquet(str(source / "*"))

    def run() -> None:
        query = scorer.score_stream(stream, BETA).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    table(spark, second).coalesce(1).write.parquet(str(source / "b"))
    run()
    told = spark.read.parquet(str(tmp_path / "out")).orderBy("user", "review_th").toPandas()
    want = features.build(table(spark, rows), BETA, narrow=False).orderBy("user", "review_th").toPandas()
    assert len(told) == 96
    for name in ["p_b", *features.FEATURES]:
        pd.testing.assert_series_equal(told[name], want[name].astype(float), atol=1e-9, rtol=0, check_dtype=False)
