"""The online twin of the feature plan: predict from state, then fold the outcome in.

:class:`Session` holds one user's state and is shared by the streaming processor, by the
replay of stored rows, and by callers that score one review at a time.  Group state is
local to (group, card), so a card that moves between groups stays consistent.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import CLIP, SESSION_SECONDS, SHRINK
from ..operators.boost import Model, _leaf_values
from ..operators.features import FEATURES

REQUIRED = ("review_th", "y", "p_fsrs", "i", "elapsed_days", "lapse", "nth_today", "day_offset", "card_id", "deck_id", "note_id", "rating", "elapsed_seconds", "duration")
OUTPUT = T.StructType(
    [T.StructField("user", T.LongType()), T.StructField("review_th", T.LongType()), T.StructField("p_b", T.DoubleType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("p_hat", T.DoubleType())]
)


def _logit(p: float) -> float:
    p = min(max(p, CLIP), 1 - CLIP)
    return math.log(p / (1 - p))


def _expit(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0


class Session:
    """State of one user; a new session knows nothing.

    Without coefficients of its own a session takes those of its first review (b0, b1, b2), and keeps them.
    ``groups``, ``cards`` and ``recent`` may be any mappings, such as keyed state.
    """

    def __init__(self, beta: tuple[float, float, float] | None, model: Model | None = None):
        if model is not None and (unknown := set(model.features) - set(FEATURES)):
            raise ValueError(f"features that the scorer cannot build: {sorted(unknown)}")
        self.beta, self.model = beta, model
        self.t, self.last = 0, None
        self.r_f: list[float] = []  # up to 256
        self.r_b: list[float] = []  # up to 64
        self.sum_f = self.sum_b = 0.0
        self.ratings: list[float] = []  # up to 32
        self.good = self.lapses = 0
        self.duration: float | None = None
        self.groups: dict[str, list[float]] = {}  # rows and residual sum by deck, note, and each with a card
        self.cards: dict[str, list[float]] = {}  # rows and days by card
        self.recent: dict[str, list[float]] = {}  # by deck: cards seen, last card and day, last day of another card

    def dumps(self, keyed: bool = True) -> str:
        """The state as text; without the keyed part it is windows, sums and counters, of bounded size."""
        return json.dumps({k: v for k, v in vars(self).items() if k != "model" and (keyed or k not in KEYED)})

    def loads(self, text: str) -> Session:
        vars(self).update(json.loads(text))
        self.beta = tuple(self.beta) if self.beta is not None else None
        return self

    def _others(self, kind: str, group: int, card: int) -> tuple[float, float]:
        n, total = self.groups.get(f"{kind}{group}", (0, 0.0))
        own_n, own_total = self.groups.get(f"{kind}{group}/{card}", (0, 0.0))
        if n < own_n:
            raise ValueError("a card has more history in a group than the group")
        return n - own_n, (total - own_total) / (n - own_n + SHRINK)

    def features(self, row: dict[str, Any]) -> dict[str, float]:
        """All features but those of the calibrated residual's own row; state is not changed."""
        missing = [name for name in REQUIRED if row.get(name) is None]
        if missing:
            raise ValueError(f"missing: {missing}")
        t, f, b = self.t, self.r_f, self.r_b
        deck, note, card = int(row["deck_id"]), int(row["note_id"]), int(row["card_id"])
        out = {"x16": sum(f[-16:]) / (min(t, 16) + SHRINK), "x256": sum(f) / (min(t, 256) + SHRINK)}
        for tag, values, total in (("F", f, self.sum_f), ("B", b, self.sum_b)):
            out |= {
                f"s{tag}_mean16": _mean(values[-16:]), f"s{tag}_mean64": _mean(values[-64:]), f"s{tag}_max16": max(values[-16:], default=0.0),
                f"s{tag}_max64": max(values[-64:], default=0.0), f"s{tag}_last": values[-1] if values else 0.0, f"s{tag}_all": total / t if t else 0.0,
            }
        seen, age = self.cards.get(str(card), (0, 0.0))
        out |= {
            "st_i": float(row["i"]), "st_elapsed_days": float(row["elapsed_days"]), "st_lapse": float(row["lapse"]), "st_t": float(t), "st_nth_today": float(row["nth_today"]),
            "st_log_elapsed": math.log1p(row["elapsed_days"]), "st_log_i": math.log1p(row["i"]), "st_log_t": math.log1p(t), "st_card_seq": float(seen), "st_age_days": age,
        }
        n, total = self.groups.get(f"d{deck}", (0, 0.0))
        dk_other, note_other = self._others("d", deck, card), self._others("n", note, card)
        cards, last_card, last_day, other_day = self.recent.get(str(deck), (0, None, None, None))
        since = last_day if last_card is not None and last_card != card else other_day
        out |= {
            "dk_n_all": float(n), "dk_acc_all": total / (n + SHRINK), "dk_n_other": float(dk_other[0]), "dk_acc_other": dk_other[1],
            "dk_since_other": float(row["day_offset"] - since) if since is not None else -1.0, "dk_cards_seen": float(cards),
            "nt_n_other": float(note_other[0]), "nt_acc_other": note_other[1],
        }
        ratings = self.ratings
        spread = _mean([r * r for r in ratings]) - _mean(ratings) ** 2
        out |= {
            "rt_last": ratings[-1] if ratings else 0.0, "rt_mean8": _mean(ratings[-8:]), "rt_mean32": _mean(ratings), "rt_fail32": _mean([float(r < 3) for r in ratings]),
            "rt_sd32": math.sqrt(max(spread, 0.0)), "rt_good_streak": float(self.good), "rt_lapse_streak": float(self.lapses),
            "sg_log_secs": math.log1p(max(row["elapsed_seconds"], 0.0)), "sg_same_session": float(row["elapsed_seconds"] < SESSION_SECONDS),
            "sg_prev_dur_log": math.log1p(self.duration) if self.duration is not None and not math.isnan(self.duration) else 0.0,
        }
        return out

    def observe(self, row: dict[str, Any]) -> dict[str, float]:
        """Features and probabilities of a review, after which its outcome joins the state."""
        if self.last is not None and row["review_th"] <= self.last:
            raise ValueError("reviews must arrive in order")
        if self.beta is None and row.get("b0") is not None and not math.isnan(row["b0"]):
            self.beta = (row["b0"], row["b1"], row["b2"])
        out = self.features(row)
        if not 0 <= row["p_fsrs"] <= 1:
            raise ValueError("a probability outside [0, 1]")
        if self.beta is not None:
            z = _logit(row["p_fsrs"]) + self.beta[0] + self.beta[1] * out["x16"] + self.beta[2] * out["x256"]
            out["p_b"] = _expit(z)
        elif row.get("p_b") is not None:
            out["p_b"] = float(row["p_b"])
        else:
            raise ValueError("neither coefficients nor a calibrated probability")
        out["p_hat"] = self._predict(out)
        self._advance(row, out)
        return out

    def _predict(self, out: dict[str, float]) -> float:
        if self.model is None:
            return out["p_b"]
        x = np.array([[out[f] for f in self.model.features]])
        trees = self.model.trees[: self.model.best_round + 1]
        return _expit(_logit(out["p_b"]) + sum(float(_leaf_values(tree, None, None, x)[0]) for tree in trees))

    def _advance(self, row: dict[str, Any], out: dict[str, float]) -> None:
        r_f, r_b = row["y"] - row["p_fsrs"], row["y"] - out["p_b"]
        self.r_f = [*self.r_f[-255:], r_f]
        self.r_b = [*self.r_b[-63:], r_b]
        self.sum_f, self.sum_b = self.sum_f + r_f, self.sum_b + r_b
        deck, note, card = int(row["deck_id"]), int(row["note_id"]), int(row["card_id"])
        new = f"d{deck}/{card}" not in self.groups
        for key in (f"d{deck}", f"d{deck}/{card}", f"n{note}", f"n{note}/{card}"):
            n, total = self.groups.get(key, (0, 0.0))
            self.groups[key] = [n + 1, total + r_b]
        seen, age = self.cards.get(str(card), (0, 0.0))
        self.cards[str(card)] = [seen + 1, age + float(row["elapsed_days"])]
        cards, last_card, last_day, other_day = self.recent.get(str(deck), (0, None, None, None))
        if last_card is not None and last_card != card:
            other_day = last_day
        self.recent[str(deck)] = [cards + new, card, int(row["day_offset"]), other_day]
        rating = float(row["rating"])
        self.ratings = [*self.ratings[-31:], rating]
        self.good = self.good + 1 if rating >= 3 else 0
        self.lapses = self.lapses + 1 if rating == 1 else 0
        self.duration = float(row["duration"])
        self.t, self.last = self.t + 1, int(row["review_th"])


def _observed(session: Session, user: int, rows: pd.DataFrame) -> pd.DataFrame:
    told = []
    for row in rows.sort_values("review_th").to_dict("records"):
        told.append({"user": user, "review_th": row["review_th"], **session.observe(row)})
    return pd.DataFrame(told, columns=[f.name for f in OUTPUT])


class Keyed(dict):
    """A mapping over a map state: reads what is asked for, and writes back what was set."""

    def __init__(self, state: Any):
        super().__init__()
        self.state, self.dirty = state, set()

    def __contains__(self, key: str) -> bool:
        return super().__contains__(key) or self.state.containsKey((key,))

    def get(self, key: str, default: Any = None) -> Any:
        if not super().__contains__(key):
            if not self.state.containsKey((key,)):
                return default
            super().__setitem__(key, list(self.state.getValue((key,))))
        return super().__getitem__(key)

    def __setitem__(self, key: str, value: list) -> None:
        super().__setitem__(key, value)
        self.dirty.add(key)

    def flush(self) -> None:
        for key in self.dirty:
            self.state.updateValue((key,), tuple(super(Keyed, self).__getitem__(key)))
        self.dirty.clear()


#: Map states and the types of their values; they grow with a user's cards and groups, one entry each.
KEYED = {"groups": "n long, total double", "cards": "n long, days double", "recent": "cards long, last_card long, last_day long, other_day long"}


class Processor(StatefulProcessor):
    """One user's session as keyed state; reviews older than the state are refused.

    Windows and counters are one value of bounded size; groups, cards and decks are map
    states, of which a batch reads and writes only the entries that its reviews touch.
    """

    def __init__(self, beta: tuple[float, float, float] | None, model: Model | None = None):
        self.beta, self.model = beta, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", T.StructType([T.StructField("session", T.StringType())]))
        key = T.StructType([T.StructField("key", T.StringType())])
        self.maps = {name: handle.getMapState(name, key, kind) for name, kind in KEYED.items()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session = Session(self.beta, self.model)
        if self.state.exists():
            session.loads(self.state.get()[0])
        for name, state in self.maps.items():
            setattr(session, name, Keyed(state))
        yield _observed(session, int(key[0]), pd.concat(list(rows)))
        for name in KEYED:
            getattr(session, name).flush()
        self.state.update((session.dumps(keyed=False),))

    def close(self) -> None:
        pass


Betas = tuple[float, float, float] | DataFrame


def _with_betas(rows: DataFrame, beta: Betas) -> tuple[DataFrame, tuple[float, float, float] | None]:
    """Rows with the coefficients of their user (user, b0, b1, b2), or the coefficients of all."""
    if isinstance(beta, DataFrame):
        return rows.join(beta.select("user", "b0", "b1", "b2"), "user", "left"), None
    return rows, beta


def score_stream(stream: DataFrame, beta: Betas, model: Model | None = None) -> DataFrame:
    """Features and probabilities of a stream of reviews; needs the RocksDB state store.  A user without coefficients is an error."""
    rows, own = _with_betas(stream, beta)
    return rows.groupBy("user").transformWithStateInPandas(statefulProcessor=Processor(own, model), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def replay(rows: DataFrame, beta: Betas, model: Model | None = None) -> DataFrame:
    """Stored rows through the online path, user by user in order."""
    rows, own = _with_betas(rows, beta)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _observed(Session(own, model), int(key[0]), part)

    return rows.groupBy("user").applyInPandas(one, OUTPUT)
