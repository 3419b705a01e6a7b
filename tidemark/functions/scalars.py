"""Scalar expressions over probabilities, gaps and labels; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-6
SHRINK = 64
#: Scale, base and rounding digits of the three bin keys.
BINS = {"elapsed": (2.48, 3.62, 2), "ordinal": (1.99, 1.89, 0), "lapse": (1.65, 1.73, 0)}
SESSION_SECONDS = 600


def clip(p: Column, edge: float = CLIP) -> Column:
    return F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))


def logit(p: Column) -> Column:
    inside = clip(p)
    return F.log(inside / (1 - inside))


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def calibrated(p: Column, x16: Column, x256: Column, beta: tuple[float, float, float] | tuple[Column, Column, Column]) -> Column:
    """Probability after the three-coefficient shift of the logit."""
    b0, b1, b2 = (b if isinstance(b, Column) else F.lit(float(b)) for b in beta)
    return expit(logit(p) + b0 + b1 * x16 + b2 * x256)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def log_seconds(seconds: Column) -> Column:
    return F.log1p(F.greatest(seconds, F.lit(0.0)))


def same_session(seconds: Column) -> Column:
    return (seconds < SESSION_SECONDS).cast("double")


def clipped(p: Column, edge: float = CLIP) -> Column:
    """Does a probability touch the clip?"""
    return (p <= edge) | (p >= 1 - edge)


def in_domain(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)


def _power_bin(x: Column, kind: str) -> Column:
    scale, base, digits = BINS[kind]
    level = F.floor(F.log(x) / F.log(F.lit(base)))
    return F.bround(F.lit(scale) * F.pow(F.lit(base), level), digits)


def elapsed_bin(days: Column) -> Column:
    return _power_bin(F.greatest(days.cast("double"), F.lit(CLIP)), "elapsed")


def ordinal_bin(i: Column) -> Column:
    return _power_bin(F.greatest(i.cast("double"), F.lit(1.0)), "ordinal")


def lapse_bin(lapse: Column) -> Column:
    return F.when(lapse == 0, F.lit(0.0)).otherwise(_power_bin(F.greatest(lapse.cast("double"), F.lit(1.0)), "lapse"))


def disagreement(logits: list[Column], z_all: Column, z_b: Column, z_base: Column) -> dict[str, Column]:
    """How a family of model logits disagrees with its main one and among itself."""
    n = len(logits)
    mean = sum(logits[1:], logits[0]) / n
    spread = sum(((z - mean) * (z - mean) for z in logits[1:]), (logits[0] - mean) * (logits[0] - mean)) / n
    return {
        "dg_z_gap_b": z_all - z_b,
        "dg_z_gap_fsrs": z_all - z_base,
        "dg_var_std": F.sqrt(spread),
        "dg_var_range": F.greatest(*logits) - F.least(*logits),
        "dg_n_above": sum(((z > 0).cast("double") for z in logits[1:]), (logits[0] > 0).cast("double")),
        "dg_var_mean_minus_all": mean - z_all,
    }
