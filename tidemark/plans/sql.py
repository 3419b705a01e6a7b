"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from functools import partial

from ..operators.features import FEATURES, STREAM
from ..operators.metrics import POISSON

BETA = (0.05, -0.4, 0.8)
B0, B1, B2 = BETA

BASE = f"""
ev AS (
  SELECT user_id AS "user", event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END AS rating
  FROM events),
eb AS (
  SELECT *, k % 12 AS card_id, k % 4 AS deck_id, k % 6 AS note_id, CASE WHEN rating > 1 THEN 1 ELSE 0 END AS y,
         50 + (event_id * 7919) % 900 AS p_milli,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_offset,
         row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS review_th
  FROM ev),
rv AS (
  SELECT "user", review_th, CAST(y AS DOUBLE) AS y, p_milli / 1000.0::DOUBLE AS p_fsrs,
         CAST(ntile(5) OVER u - 1 AS BIGINT) AS fold, row_number() OVER c AS i,
         CAST(coalesce(day_offset - lag(day_offset) OVER c, 0) AS DOUBLE) AS elapsed_days,
         CAST(coalesce(sum(CASE WHEN rating = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY "user", card_id ORDER BY review_th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lapse,
         row_number() OVER (PARTITION BY "user", day_offset ORDER BY review_th) AS nth_today, CAST(day_offset AS BIGINT) AS day_offset,
         CAST(card_id AS BIGINT) AS card_id, CAST(deck_id AS BIGINT) AS deck_id, CAST(note_id AS BIGINT) AS note_id, CAST(rating AS DOUBLE) AS rating,
         coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER c, 0) / 1e6::DOUBLE AS elapsed_seconds,
         CAST(CAST(trunc(value * 100) AS BIGINT) AS DOUBLE) AS duration, CAST(p_milli AS BIGINT) AS p_milli,
         CAST(1000 * y - p_milli AS BIGINT) AS r_milli, row_number() OVER u - 1 AS t
  FROM eb WINDOW c AS (PARTITION BY "user", card_id ORDER BY review_th), u AS (PARTITION BY "user" ORDER BY review_th)),
sp AS (
  SELECT *, coalesce(sum(r_milli) OVER (PARTITION BY "user" ORDER BY review_th ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (least(t, 16) + 64) / 1000 AS x16,
         coalesce(sum(r_milli) OVER (PARTITION BY "user" ORDER BY review_th ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (least(t, 256) + 64) / 1000 AS x256
  FROM rv),
pb AS (
  SELECT *, y - p_b AS r_b FROM (SELECT *, 1 / (1 + exp(-(ln(p_fsrs / (1 - p_fsrs)) + {B0} + {B1} * x16 + {B2} * x256))) AS p_b FROM sp))
"""

_USER = 'PARTITION BY "user" ORDER BY review_th'
_PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _w(keys: str = "", frame: str = _PAST) -> str:
    return f'(PARTITION BY "user"{keys} ORDER BY review_th {frame})'


def _prev(n: int) -> str:
    return _w(frame=f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")


def query(body: str) -> str:
    return f"WITH {BASE}{body}"


def _round(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


r6 = _round


KEY = '"user", review_th'
DECK, NOTE, CARD = ", deck_id", ", note_id", ", card_id"
LOSS = "-(y * ln({0}) + (1 - y) * ln(1 - {0}))"
DT = "CASE WHEN elapsed_days = 0 THEN round_even(2.48::DOUBLE * pow(3.62::DOUBLE, floor(ln(1e-6::DOUBLE) / ln(3.62::DOUBLE))), 2) ELSE round_even(2.48::DOUBLE * pow(3.62::DOUBLE, floor(ln(elapsed_days) / ln(3.62::DOUBLE))), 2) END"
II = "round_even(1.99::DOUBLE * pow(1.89::DOUBLE, floor(ln(i::DOUBLE) / ln(1.89::DOUBLE))), 0)"
LL = "CASE WHEN lapse = 0 THEN 0.0::DOUBLE ELSE round_even(1.65::DOUBLE * pow(1.73::DOUBLE, floor(ln(greatest(lapse, 1)::DOUBLE) / ln(1.73::DOUBLE))), 0) END"
RMSE = (
    ', cell AS (SELECT "user", dt, ii, ll, avg(y) AS my, avg({p}) AS mp, count(*) AS n FROM (SELECT *, ' + DT + " AS dt, " + II + " AS ii, " + LL + ' AS ll FROM pb) GROUP BY "user", dt, ii, ll)'
)
AUC = (
    ', ranked AS (SELECT "user", y, rank() OVER (PARTITION BY "user" ORDER BY {p}) + (count(*) OVER (PARTITION BY "user", {p}) - 1) / 2.0::DOUBLE AS r FROM pb),'
    ' au AS (SELECT "user", CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM ranked GROUP BY "user")'
)
CARDS = ', cards AS (SELECT DISTINCT "user", card_id, deck_id, note_id FROM rv WHERE card_id <> 11)'


def streak(flag: str) -> str:
    return f"CAST(t - 1 - coalesce(max(CASE WHEN NOT ({flag}) THEN t END) OVER {_w()}, -1) AS BIGINT)"


def surprise(tag: str, r: str, scale: str, digits: int = 6) -> str:
    r6 = str if scale else partial(_round, digits=digits)  # whole thousandths need no rounding
    parts = [
        f"{r6(f'coalesce(avg({r}) OVER {_prev(16)}, 0){scale}')} AS s{tag}_mean16", f"{r6(f'coalesce(avg({r}) OVER {_prev(64)}, 0){scale}')} AS s{tag}_mean64",
        f"{r6(f'coalesce(max({r}) OVER {_prev(16)}, 0){scale}')} AS s{tag}_max16", f"{r6(f'coalesce(max({r}) OVER {_prev(64)}, 0){scale}')} AS s{tag}_max64",
        f"{r6(f'coalesce(lag({r}) OVER ({_USER}), 0){scale}')} AS s{tag}_last", f"{r6(f'coalesce(avg({r}) OVER {_w()}, 0){scale}')} AS s{tag}_all",
    ]
    return ", ".join(parts)


def _group(key: str, short: str) -> str:
    own = f"{key}, card_id"
    return (
        f"CAST(count(*) OVER {_w(key)} - count(*) OVER {_w(own)} AS BIGINT) AS {short}_n_other, "
        f"(coalesce(sum(r_milli) OVER {_w(key)}, 0) - coalesce(sum(r_milli) OVER {_w(own)}, 0))::DOUBLE / (count(*) OVER {_w(key)} - count(*) OVER {_w(own)} + 64) / 1000"
        f" AS {short}_acc_other"
    )


def _others(key: str, short: str) -> str:
    own = f"{key}, card_id"
    n = f"count(*) OVER {_w(key)} - count(*) OVER {_w(own)}"
    return f"CAST({n} AS DOUBLE) AS {short}_n_other, {r6(f'(coalesce(sum(r_b) OVER {_w(key)}, 0) - coalesce(sum(r_b) OVER {_w(own)}, 0)) / ({n} + 64)')} AS {short}_acc_other"


def mixed(x: str) -> str:
    """The 32-bit mix of the bootstrap."""
    first = f"(xor({x}, {x} >> 16) * 2146121005 % 4294967296)"
    second = f"(xor({first}, {first} >> 15) * 2221713035 % 4294967296)"
    return f"xor({second}, {second} >> 16)"


SQL: dict[str, str] = {
    "reviews_base": query(f" SELECT {KEY}, y, p_fsrs, fold, i, elapsed_days, lapse, nth_today, day_offset, card_id, deck_id, note_id, rating, {r6('elapsed_seconds')} AS elapsed_seconds, duration FROM rv"),
    "cards_left_join": query(CARDS + f' SELECT rv."user", rv.review_th, rv.card_id, coalesce(c.deck_id, -(rv.card_id + 1)) AS deck_id, coalesce(c.note_id, -(rv.card_id + 1)) AS note_id FROM rv LEFT JOIN cards c ON c."user" = rv."user" AND c.card_id = rv.card_id'),
    "calibrated_pb": query(f" SELECT {KEY}, {r6('p_b')} AS p_b, {r6('r_b')} AS r_b FROM pb"),
    "spine_windows": query(f" SELECT {KEY}, x16, x256 FROM sp"),
    "surprise_base": query(f" SELECT {KEY}, {surprise('F', 'r_milli', ' / 1000')} FROM rv"),
    "surprise_calibrated": query(f" SELECT {KEY}, {surprise('B', 'r_b', '')} FROM pb"),
    "card_state": query(f" SELECT {KEY}, CAST(t AS BIGINT) AS st_t, CAST(count(*) OVER {_w(CARD)} AS BIGINT) AS st_card_seq, coalesce(sum(elapsed_days) OVER {_w(CARD)}, 0) AS st_age_days FROM rv"),
    "deck_all": query(f" SELECT {KEY}, CAST(count(*) OVER {_w(DECK)} AS BIGINT) AS dk_n_all, coalesce(sum(r_milli) OVER {_w(DECK)}, 0)::DOUBLE / (count(*) OVER {_w(DECK)} + 64) / 1000 AS dk_acc_all FROM rv"),
    "deck_other": query(f" SELECT {KEY}, {_group(DECK, 'dk')} FROM rv"),
    "note_other": query(f" SELECT {KEY}, {_group(NOTE, 'nt')} FROM rv"),
    "deck_since_other": query(
        f", ch AS (SELECT *, CASE WHEN lag(card_id) OVER (PARTITION BY \"user\", deck_id ORDER BY review_th) <> card_id THEN lag(day_offset) OVER (PARTITION BY \"user\", deck_id ORDER BY review_th) END AS ended FROM rv)"
        f" SELECT {KEY}, CAST(coalesce(day_offset - last_value(ended IGNORE NULLS) OVER (PARTITION BY \"user\", deck_id ORDER BY review_th ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS DOUBLE) AS dk_since_other FROM ch"
    ),
    "deck_cards_seen": query(
        f", fi AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY \"user\", deck_id, card_id ORDER BY review_th) = 1 THEN 1 ELSE 0 END AS first FROM rv)"
        f" SELECT {KEY}, CAST(coalesce(sum(first) OVER {_w(DECK)}, 0) AS BIGINT) AS dk_cards_seen FROM fi"
    ),
    "rating_windows": query(
        f" SELECT {KEY}, {r6(f'coalesce(avg(rating) OVER {_prev(8)}, 0)')} AS rt_mean8, {r6(f'coalesce(avg(rating) OVER {_prev(32)}, 0)')} AS rt_mean32,"
        f" {r6(f'coalesce(avg(CASE WHEN rating < 3 THEN 1.0::DOUBLE ELSE 0 END) OVER {_prev(32)}, 0)')} AS rt_fail32, {r6(f'coalesce(stddev_pop(rating) OVER {_prev(32)}, 0)')} AS rt_sd32 FROM rv"
    ),
    "rating_lag": query(f" SELECT {KEY}, coalesce(lag(rating) OVER ({_USER}), 0) AS rt_last FROM rv"),
    "streaks": query(f" SELECT {KEY}, {streak('rating >= 3')} AS rt_good_streak, {streak('rating = 1')} AS rt_lapse_streak FROM rv"),
    "session_timing": query(
        f" SELECT {KEY}, {r6('ln(1 + greatest(elapsed_seconds, 0))')} AS sg_log_secs, CASE WHEN elapsed_seconds < 600 THEN 1.0::DOUBLE ELSE 0.0 END AS sg_same_session,"
        f" {r6(f'ln(1 + coalesce(lag(duration) OVER ({_USER}), 0))')} AS sg_prev_dur_log FROM rv"
    ),
    "log_state": query(f" SELECT {KEY}, {r6('ln(1 + elapsed_days)')} AS st_log_elapsed, {r6('ln(1 + i::DOUBLE)')} AS st_log_i, {r6('ln(1 + t::DOUBLE)')} AS st_log_t FROM rv"),
    "chrono_folds": query(
        ", z AS (SELECT *, count(*) OVER (PARTITION BY \"user\") AS n, count(*) OVER (PARTITION BY \"user\") // 6 AS b FROM rv)"
        f" SELECT {KEY}, CAST(CASE WHEN b > 0 AND t >= n - 5 * b THEN (t - (n - 5 * b)) // b END AS BIGINT) AS chrono_fold FROM z"
    ),
    "disagreement": query(
        ", z AS (SELECT *, ln(p_fsrs / (1 - p_fsrs)) AS z0, ln(p_b / (1 - p_b)) AS z1, ln(p_fsrs / (1 - p_fsrs)) + 1.0986122886681098::DOUBLE * x16 AS z2, 0.9::DOUBLE * ln(p_fsrs / (1 - p_fsrs)) + x256 AS z3 FROM pb),"
        " m AS (SELECT *, (z0 + z1 + z2 + z3) / 4 AS mean FROM z)"
        f" SELECT {KEY}, {r6('z3 - z1')} AS dg_z_gap_b, {r6('z3 - z0')} AS dg_z_gap_fsrs,"
        f" {r6('sqrt(((z0 - mean) * (z0 - mean) + (z1 - mean) * (z1 - mean) + (z2 - mean) * (z2 - mean) + (z3 - mean) * (z3 - mean)) / 4)')} AS dg_var_std,"
        f" {r6('greatest(z0, z1, z2, z3) - least(z0, z1, z2, z3)')} AS dg_var_range, CAST((z0 > 0)::INT + (z1 > 0)::INT + (z2 > 0)::INT + (z3 > 0)::INT AS DOUBLE) AS dg_n_above,"
        f" {r6('mean - z3')} AS dg_var_mean_minus_all FROM m"
    ),
    "metric_bins": query(f" SELECT {KEY}, {DT} AS dt, {II} AS ii, {LL} AS ll FROM rv"),
    "user_logloss": query(f" SELECT \"user\", {r6('avg(' + LOSS.format('p_fsrs') + ')')} AS loss_base, {r6('avg(' + LOSS.format('p_b') + ')')} AS loss_calibrated, count(*) AS size FROM pb GROUP BY \"user\""),
    "user_rmse_bins": query(RMSE.format(p="p_b") + f" SELECT \"user\", {r6('sqrt(sum(n * (my - mp) * (my - mp)) / sum(n))')} AS rmse_bins FROM cell GROUP BY \"user\""),
    "user_auc": query(AUC.format(p="p_fsrs") + f" SELECT \"user\", {r6('auc')} AS auc FROM au"),
    "user_mbe": query(f" SELECT \"user\", {r6('avg(-r_milli) / 1000')} AS mbe, count(*) AS size FROM rv GROUP BY \"user\""),
    "equal_user_summary": query(
        AUC.format(p="p_b") + RMSE.format(p="p_b")
        + ", one AS (SELECT \"user\", avg(" + LOSS.format("p_b") + ") AS l FROM pb GROUP BY \"user\"), two AS (SELECT \"user\", sqrt(sum(n * (my - mp) * (my - mp)) / sum(n)) AS r FROM cell GROUP BY \"user\")"
        + f" SELECT {r6('avg(l)')} AS mean_log_loss, count(l) AS n_log_loss, {r6('avg(r)')} AS mean_rmse_bins, count(r) AS n_rmse_bins, {r6('avg(auc)')} AS mean_auc, count(auc) AS n_auc FROM one JOIN two USING (\"user\") JOIN au USING (\"user\")"
    ),
    "equal_user_weights": query(f" SELECT {KEY}, {r6('(SELECT count(*)::DOUBLE / count(DISTINCT \"user\") FROM rv) / count(*) OVER (PARTITION BY \"user\")')} AS weight FROM rv"),
    "paired_delta": query(
        ", d AS (SELECT \"user\", avg(" + LOSS.format("p_b") + ") - avg(" + LOSS.format("p_fsrs") + ") AS delta FROM pb GROUP BY \"user\")"
        f" SELECT \"user\", {r6('delta')} AS delta FROM d"
    ),
    "volume_split": query(
        ", s AS (SELECT \"user\", count(*) AS size FROM rv GROUP BY \"user\"), k AS (SELECT *, row_number() OVER (ORDER BY size, \"user\") - 1 AS k FROM s)"
        " SELECT \"user\", size, CASE WHEN k % 2 = 1 THEN 'eval' WHEN (k // 2) % 4 = 3 THEN 'val' ELSE 'fit' END AS role FROM k"
    ),
    "shards": query(", s AS (SELECT DISTINCT \"user\" FROM rv), k AS (SELECT \"user\", row_number() OVER (ORDER BY \"user\") - 1 AS k FROM s) SELECT \"user\" FROM k WHERE k % 8 = 3"),
    "semi_folds": query(
        ", z AS (SELECT *, count(*) OVER (PARTITION BY \"user\") AS n, count(*) OVER (PARTITION BY \"user\") // 6 AS b FROM rv)"
        f" SELECT {KEY}, CAST((t - (n - 5 * b)) // b AS BIGINT) AS test_fold, {r6('elapsed_seconds')} AS elapsed_seconds FROM z WHERE b > 0 AND t >= n - 5 * b"
    ),
    "resume_anti": query(" SELECT DISTINCT \"user\" FROM rv WHERE \"user\" % 3 <> 0"),
    "deferred_difference": query(" SELECT DISTINCT \"user\" FROM rv EXCEPT SELECT DISTINCT \"user\" FROM rv WHERE \"user\" % 10 = 7"),
    "contract_violations": query(" SELECT n AS rule, CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['probability', 'label', 'order', 'fold_order', 'fold_cover', 'day_order', 'lapse', 'elapsed']) AS n)"),
    "causality_check": query(", z AS (SELECT t, count(*) OVER (PARTITION BY \"user\") AS n FROM rv) SELECT CAST(sum((t <= n // 7)::INT + (t <= n // 3)::INT + (t <= n // 2)::INT + (t <= n - 1)::INT) AS BIGINT) AS rows_checked, CAST(0 AS BIGINT) AS rows_changed FROM z"),
    "unmapped_cards": query(
        CARDS + ", j AS (SELECT rv.*, c.deck_id AS known FROM rv LEFT JOIN cards c ON c.\"user\" = rv.\"user\" AND c.card_id = rv.card_id)"
        f" SELECT count(*) FILTER (WHERE known IS NULL) AS unmapped_rows, count(DISTINCT CASE WHEN known IS NULL THEN \"user\" * 1000 + card_id END) AS unmapped_cards, {r6('count(*) FILTER (WHERE known IS NULL)::DOUBLE / count(*)')} AS share FROM j"
    ),
    "row_index_contiguity": query(" SELECT \"user\", CAST(min(t) AS BIGINT) AS low, CAST(max(t) AS BIGINT) AS high, count(DISTINCT t) AS n, TRUE AS contiguous FROM rv GROUP BY \"user\""),
    "split_coverage": query(" SELECT f AS fold, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS strange FROM (SELECT unnest([0, 1])::INTEGER AS f)"),
    "clip_hits": query(" SELECT count(*) FILTER (WHERE p_fsrs <= 0.1 OR p_fsrs >= 0.9) AS hits, count(*) AS n FROM rv"),
    "card_codes": query(", f AS (SELECT *, min(review_th) OVER (PARTITION BY \"user\", card_id) AS first FROM rv) SELECT " + KEY + ", CAST(dense_rank() OVER (PARTITION BY \"user\" ORDER BY first) - 1 AS BIGINT) AS code FROM f"),
    "hist_split_stats": query(
        f", h AS (SELECT floor(p_fsrs * 16)::INTEGER AS bin, CAST(y AS BIGINT) AS y, r_milli, p_milli FROM rv)"
        " SELECT bin, CAST(sum(-r_milli) AS BIGINT) AS g_milli, CAST(sum(p_milli * (1000 - p_milli)) AS BIGINT) AS h_micro, count(*) AS n FROM h GROUP BY bin"
    ),
    "calibration_objective": query(
        ", d AS (SELECT *, ln(p_fsrs / (1 - p_fsrs)) + 0.05 - 0.4 * x16 + 0.8 * x256 AS z, 1.0::DOUBLE / count(*) OVER (PARTITION BY \"user\") AS w FROM sp)"
        f" SELECT {r6('sum(w * (greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z)) / sum(w)')} AS loss, {r6('sum(w * (1 / (1 + exp(-z)) - y)) / sum(w)')} AS g0,"
        f" {r6('sum(w * (1 / (1 + exp(-z)) - y) * x16) / sum(w)')} AS g1, {r6('sum(w * (1 / (1 + exp(-z)) - y) * x256) / sum(w)')} AS g2 FROM d"
    ),
    "report_total": query(" SELECT count(DISTINCT \"user\") AS users, count(*) AS reviews FROM rv"),
    "head_rows": query(f" SELECT {KEY} FROM rv WHERE t < 10"),
    "spaced_users": query(", s AS (SELECT \"user\", row_number() OVER (ORDER BY \"user\") - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT \"user\" FROM rv)) SELECT \"user\" FROM s WHERE k % greatest(n // 5, 1) = 0 AND k // greatest(n // 5, 1) < 5"),
    "standardized": query(
        ", m AS (SELECT avg(rating) AS a, stddev_pop(rating) AS d FROM rv WHERE \"user\" % 2 = 0)"
        f" SELECT {KEY}, {r6('(rating - a) / (d + 1e-9::DOUBLE)')} AS rating FROM rv, m"
    ),
    "size_mismatches": query(", s AS (SELECT \"user\", count(*) AS size FROM rv GROUP BY \"user\") SELECT \"user\", size, size + 1 AS expected FROM s WHERE \"user\" % 7 = 0"),
    "stored_lookup": query(f" SELECT {KEY}, CASE WHEN t % 5 <> 0 THEN p_milli END AS stored, t % 5 <> 0 AS complete FROM rv"),
    "misaligned_rows": query(f" SELECT {KEY}, p_milli AS v_left, CASE WHEN review_th > 2 THEN p_milli + 1 END AS v_right FROM rv WHERE review_th <= 2 OR review_th % 11 = 0"),
    "group_betas": query(
        ", s AS (SELECT DISTINCT \"user\", (\"user\" % 3)::DOUBLE AS g FROM rv)"
        f" SELECT \"user\", {r6('CASE WHEN g < 2 THEN g END')} AS b0, {r6('CASE WHEN g < 2 THEN g + 0.1::DOUBLE END')} AS b1, {r6('CASE WHEN g < 2 THEN g + 0.2::DOUBLE END')} AS b2 FROM s"
    ),
    "multiset_difference": query(" SELECT \"user\", rating, 'left' AS side FROM (SELECT \"user\", rating FROM rv EXCEPT ALL SELECT \"user\", rating FROM rv WHERE review_th > 3)"),
    "narrow_features": query(f" SELECT {KEY}, CAST(x16 AS FLOAT) AS x16, CAST(x256 AS FLOAT) AS x256, CAST(i AS FLOAT) AS st_i FROM sp"),
    "calibration_fit": query(" SELECT 0.0::DOUBLE AS g0, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2, TRUE AS better, count(DISTINCT \"user\") AS users, count(*) AS reviews FROM rv"),
    "fold_masks": query(f" SELECT {KEY}, CASE WHEN fold = 4 OR review_th % 9 <> 0 THEN fold END AS mask_fold, fold <> 4 AND review_th % 9 = 0 AS fault FROM rv"),
    "resume_decisions": (
        "SELECT * FROM (VALUES ('nothing', 'run', ''), ('data alone', 'refuse', 'data without a sidecar'), ('same', 'skip', ''), ('other cache', 'refuse', 'cache_sha256'),"
        " ('other data', 'refuse', 'data'), ('excluded', 'skip', ''), ('no reviews', 'excluded', ''), ('no reviews, really', 'failed', '')) t(found, decision, why)"
    ),
    "identity_digests": query(
        ", u AS (SELECT DISTINCT \"user\" AS u FROM rv), d AS (SELECT u, sha256(u::VARCHAR) AS s FROM u)"
        " SELECT 'identity' AS what, sha256('{\"data\":\"x\",\"revision\":\"a\"}') AS sha256"
        " UNION ALL SELECT 'dependencies', sha256(string_agg(u::VARCHAR || chr(0) || 'v1' || chr(0) || s, chr(10) ORDER BY u)) FROM d"
        " UNION ALL SELECT 'unit', sha256(string_agg(l, chr(10) ORDER BY l)) FROM (SELECT 'part-' || u::VARCHAR || chr(0) || s || chr(0) || (u * 10)::VARCHAR AS l FROM d)"
    ),
    "report_checks": query(
        ", u AS (SELECT DISTINCT \"user\" FROM rv)"
        " SELECT CASE \"user\" % 11 WHEN 1 THEN 'not scored' WHEN 2 THEN 'wrong fold' WHEN 3 THEN 'models' WHEN 4 THEN 'wrong size' ELSE 'stale fit' END AS fault, \"user\" FROM u WHERE \"user\" % 11 BETWEEN 1 AND 5"
    ),
    "reconciled_means": "SELECT 'rmse_bins' AS metric",
    "held_user_faults": query(
        ", u AS (SELECT DISTINCT \"user\" FROM rv) SELECT \"user\", 'held twice' AS fault FROM u WHERE \"user\" % 5 = 0 UNION ALL SELECT \"user\", 'no coefficients' FROM u WHERE \"user\" % 4 = 0"
    ),
    "json_numbers": query(f" SELECT {KEY}, CASE WHEN review_th % 5 <> 0 AND review_th % 7 <> 0 THEN p_fsrs END AS value FROM rv"),
    "listed_users": query(
        " SELECT 'user' AS kind, u::VARCHAR AS value FROM (SELECT DISTINCT \"user\" AS u FROM rv)"
        " UNION ALL SELECT * FROM (VALUES ('fold', '0'), ('fold', '1'), ('schema', 'y'), ('schema', 'duration')) t"
    ),
    "ordered_rows": query(f" SELECT {KEY}, row_number() OVER (ORDER BY {KEY}) - 1 AS place FROM rv"),
    "held_union": query(f" SELECT {KEY} FROM rv"),
    "inner_group_sizes": query(", n AS (SELECT count(DISTINCT \"user\") AS n FROM rv) SELECT CAST(k AS BIGINT) AS part, n // 3 + CASE WHEN k < n % 3 THEN 1 ELSE 0 END AS users FROM n, (SELECT unnest([0, 1, 2]) AS k)"),
    "ridge_correction": f"SELECT unnest({STREAM}) AS feature, 0.0::DOUBLE AS gradient",
    "stream_scores": "SELECT " + ", ".join(f"0.0::DOUBLE AS {f}" for f in ("p_b", *FEATURES)) + ", CAST(0 AS BIGINT) AS unmatched",
    "bootstrap_ci": query(
        ", d AS (SELECT \"user\" AS u, avg(" + LOSS.format("p_b") + ") - avg(" + LOSS.format("p_fsrs") + ") AS delta FROM pb GROUP BY \"user\"),"
        f" k AS (SELECT u, delta, {mixed('CAST(u AS UBIGINT)')} AS k1 FROM d), kk AS (SELECT u, delta, {mixed('k1')} AS key FROM k),"
        " g AS (SELECT u, delta, CAST((key + CAST(range AS UBIGINT) * 2654435761) % 4294967296 AS UBIGINT) AS x, range AS draw FROM kk, range(20000)),"
        f" c AS (SELECT draw, delta, {mixed('x')} AS x FROM g),"
        f" t AS (SELECT draw, delta, {' + '.join(f'(x >= {int(p)})::INT' for p in POISSON)} AS times FROM c),"
        " m AS (SELECT draw, sum(delta * times) / sum(times) AS mean FROM t GROUP BY draw)"
        f" SELECT {r6('avg(delta)')} AS mean, {r6('(SELECT quantile_cont(mean, 0.025) FROM m)')} AS ci_low, {r6('(SELECT quantile_cont(mean, 0.975) FROM m)')} AS ci_high,"
        f" {r6('(SELECT stddev_samp(mean) FROM m)')} AS se, count(*) FILTER (WHERE delta < 0) AS improved, count(*) FILTER (WHERE delta > 0) AS worsened,"
        " count(*) FILTER (WHERE delta = 0) AS tied, count(*) AS n FROM d"
    ),
    "external_panel": query(
        ", both_p AS (SELECT *, 'p_fsrs' AS model, p_fsrs AS p FROM pb UNION ALL SELECT *, 'p_b' AS model, p_b AS p FROM pb),"
        " bins AS (SELECT *, " + DT + " AS dt, " + II + " AS ii, " + LL + " AS ll FROM both_p),"
        " cell AS (SELECT model, \"user\", dt, ii, ll, avg(y) AS my, avg(p) AS mp, count(*) AS n FROM bins GROUP BY ALL),"
        " rm AS (SELECT model, \"user\", sqrt(sum(n * (my - mp) * (my - mp)) / sum(n)) AS rmse FROM cell GROUP BY ALL),"
        " rk AS (SELECT model, \"user\", y, rank() OVER (PARTITION BY model, \"user\" ORDER BY p) + (count(*) OVER (PARTITION BY model, \"user\", p) - 1) / 2.0::DOUBLE AS r FROM both_p),"
        " au AS (SELECT model, \"user\", CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM rk GROUP BY ALL),"
        " ls AS (SELECT model, \"user\", avg(" + LOSS.format("p") + ") AS loss, count(*) AS size FROM both_p GROUP BY ALL)"
        f" SELECT model, \"user\", size, {r6('loss')} AS log_loss, {r6('rmse')} AS rmse_bins, {r6('auc')} AS auc FROM ls JOIN rm USING (model, \"user\") JOIN au USING (model, \"user\")"
    ),
    "feature_matrix": query(
        ", f AS (SELECT *, CASE WHEN lag(card_id) OVER d <> card_id THEN lag(day_offset) OVER d END AS ended, CASE WHEN row_number() OVER (PARTITION BY \"user\", deck_id, card_id ORDER BY review_th) = 1 THEN 1 ELSE 0 END AS first"
        " FROM pb WINDOW d AS (PARTITION BY \"user\", deck_id ORDER BY review_th))"
        f" SELECT {KEY}, {r6('p_b')} AS p_b, round(x16, 12) + 0.0 AS x16, round(x256, 12) + 0.0 AS x256, {surprise('F', '(y - p_fsrs)', '', 12)}, {surprise('B', 'r_b', '')},"
        f" CAST(i AS DOUBLE) AS st_i, elapsed_days AS st_elapsed_days, CAST(lapse AS DOUBLE) AS st_lapse, CAST(t AS DOUBLE) AS st_t, CAST(nth_today AS DOUBLE) AS st_nth_today,"
        f" {r6('ln(1 + elapsed_days)')} AS st_log_elapsed, {r6('ln(1 + i::DOUBLE)')} AS st_log_i, {r6('ln(1 + t::DOUBLE)')} AS st_log_t,"
        f" CAST(count(*) OVER {_w(CARD)} AS DOUBLE) AS st_card_seq, coalesce(sum(elapsed_days) OVER {_w(CARD)}, 0) AS st_age_days,"
        f" {_others(DECK, 'dk')}, {_others(NOTE, 'nt')}, CAST(count(*) OVER {_w(DECK)} AS DOUBLE) AS dk_n_all, {r6(f'coalesce(sum(r_b) OVER {_w(DECK)}, 0) / (count(*) OVER {_w(DECK)} + 64)')} AS dk_acc_all,"
        f" CAST(coalesce(sum(first) OVER {_w(DECK)}, 0) AS DOUBLE) AS dk_cards_seen,"
        f" CAST(coalesce(day_offset - last_value(ended IGNORE NULLS) OVER (PARTITION BY \"user\", deck_id ORDER BY review_th ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS DOUBLE) AS dk_since_other,"
        f" {r6(f'coalesce(avg(rating) OVER {_prev(8)}, 0)')} AS rt_mean8, {r6(f'coalesce(avg(rating) OVER {_prev(32)}, 0)')} AS rt_mean32, coalesce(lag(rating) OVER ({_USER}), 0) AS rt_last,"
        f" {r6(f'coalesce(avg(CASE WHEN rating < 3 THEN 1.0::DOUBLE ELSE 0 END) OVER {_prev(32)}, 0)')} AS rt_fail32, {r6(f'coalesce(stddev_pop(rating) OVER {_prev(32)}, 0)')} AS rt_sd32,"
        f" CAST({streak('rating >= 3')} AS DOUBLE) AS rt_good_streak, CAST({streak('rating = 1')} AS DOUBLE) AS rt_lapse_streak,"
        f" {r6('ln(1 + greatest(elapsed_seconds, 0))')} AS sg_log_secs, CASE WHEN elapsed_seconds < 600 THEN 1.0::DOUBLE ELSE 0.0 END AS sg_same_session,"
        f" {r6(f'ln(1 + coalesce(lag(duration) OVER ({_USER}), 0))')} AS sg_prev_dur_log FROM f"
    ),
}
