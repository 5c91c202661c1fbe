"""Bands, actions, tiers and trust as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringwatch import constants as K
from ringwatch.functions.numbers import ladder


def band(score: Column) -> Column:
    return ladder(score, K.BANDS[:-1], "LOW")


def band_action(band_col: Column) -> Column:
    out = F.lit(K.BAND_ACTIONS["LOW"])
    for name in ("MEDIUM", "HIGH", "CRITICAL"):
        out = F.when(band_col == name, K.BAND_ACTIONS[name]).otherwise(out)
    return out


def containment(suspicion: Column) -> Column:
    return ladder(suspicion, K.CONTAINMENT, K.CONTAINMENT_DEFAULT)


def confidence_tier(p: Column, t_lo: float = K.DEFAULT_T_LO, t_hi: float = K.DEFAULT_T_HI) -> Column:
    sure, clear, unsure = K.TIERS
    return F.when(p >= t_hi, sure).when(p <= t_lo, clear).otherwise(unsure)


def model_trust(p: Column, completeness: Column) -> Column:
    decisive = F.abs(p - 0.5) * 2.0
    return F.bround(100.0 * (0.6 * decisive + 0.4 * completeness), 0).cast("int")


def ground_truth(label: Column) -> Column:
    return F.when(label == 1, "MULE").when(label.isNotNull(), "legit")


def verdict(band_col: Column, p: Column) -> Column:
    """One plain sentence on the call for an account."""
    share = F.concat(F.bround(100.0 * p, 0).cast("int").cast("string"), F.lit("%"))
    strength = F.when(p >= 0.9, "High").otherwise("Elevated")
    step = F.when(band_col == "CRITICAL", "escalate to L2").otherwise("same-day analyst review")
    strong = F.concat(
        strength, F.lit(" confidence ("), share, F.lit(") this account behaves like a mule; recommend "), step
    )
    mixed = F.concat(F.lit("Mixed signals ("), share, F.lit("); add to enhanced monitoring"))
    low = F.concat(F.lit("Low risk ("), share, F.lit("); routine monitoring"))
    return F.when(band_col.isin("CRITICAL", "HIGH"), strong).when(band_col == "MEDIUM", mixed).otherwise(low)
