"""Decision chains as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cycles for which a type is quiet after it fires. Fixed values.
COOLDOWN_CYCLES = {"IMPERSONATION": 100, "GHOST_VOICE": 100, "EXTRA_SPEAKER": 150, "VOICE_MISMATCH": 80}


def z_confidence(z: Column) -> Column:
    """Under 4: up to 0.49; from 4 on: 0.5 and more, 1 at 7."""
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return F.when(z < 4, clip(z / 8, 0.0, 0.49)).otherwise(clip(0.5 + (z - 4) / 6, 0.5, 1.0))


def plain_z_confidence(z: float) -> float:
    """z_confidence of one number."""
    return min(max(z / 8, 0.0), 0.49) if z < 4 else min(max(0.5 + (z - 4) / 6, 0.5), 1.0)


def voice_checks(band_ratio: Column, hnr_db: Column, flatness: Column, temporal: Column) -> Column:
    """How many of four checks a frame passes: share of the voice's band, harmonicity, tonality, modulation; two make a voice."""
    passed = (band_ratio > 0.45, hnr_db >= 6.0, flatness <= 0.35, temporal)
    return sum(F.coalesce(c, F.lit(False)).cast("int") for c in passed)


def routed(voice: Column, value: Column, otherwise: float = 0.0) -> Column:
    """A detector's value for frames that go to it; others, and those that it has nothing for, have a fixed one."""
    return F.when(F.coalesce(voice, F.lit(False)), F.coalesce(value, F.lit(otherwise))).otherwise(otherwise)


def comb_confidence(combs: Column, ratio: float = 0.45) -> Column:
    """Of two voices at once, from harmonic combs (strongest first): 0 for fewer than two, 0.1 if no other is ratio as strong as the first, else by the strongest such one."""
    first = F.get(combs, F.lit(0))["score"]
    strong = F.filter(F.slice(combs, 2, F.greatest(F.size(combs), F.lit(1))), lambda c: c["score"] >= first * ratio)
    share = F.get(strong, F.lit(0))["score"] / (first + F.lit(1e-10))
    scored = F.when(F.size(strong) == 0, 0.1).otherwise(F.least(F.greatest((share - 0.30) / 0.20, F.lit(0.0)), F.lit(1.0)))
    return F.when(F.coalesce(F.size(combs), F.lit(0)) < 2, 0.0).otherwise(scored)


def verdict_confidence(fused: Column, match: float = 0.72, likely: float = 0.55, uncertain: float = 0.35) -> Column:
    """How sure a verdict is, within its band of the fused score, to three digits (half to even)."""
    one = F.lit(1.0)
    found = (
        F.when(fused >= match, F.least(one, 0.75 + (fused - match) / (1 - match)))
        .when(fused >= likely, 0.50 + 0.25 * (fused - likely) / (match - likely))
        .when(fused >= uncertain, 0.25 * (fused - uncertain) / (likely - uncertain))
        .otherwise(F.least(one, (uncertain - fused) / 0.20))
    )
    return F.bround(found, 3)


def verdict_note(fused: Column, f0: Column, variance: Column, likely: float = 0.55, uncertain: float = 0.35) -> Column:
    """A remark for those who read an uncertain or failed verdict; else empty."""
    return (
        F.when(fused >= likely, "")
        .when(fused >= uncertain, "close in pitch, to be reviewed")
        .when((f0 < 0.30) & (variance > 0.70), "another pitch: another speaker, or whispering")
        .otherwise("unknown speaker")
    )


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "HIGH").otherwise("MEDIUM")


def fusion_decision(speech: Column, lips: Column, score: Column, speakers: Column, available: float = 0.05, uncertain: float = 0.40, match: float = 0.72) -> Column:
    """The first that holds, or null: while lips rest, another voice or the enrolled one; several speakers; another voice."""
    scored = score >= available
    return (
        F.when(speech & ~lips & scored & (score < uncertain), "IMPERSONATION")
        .when(speech & ~lips & scored & (score >= match), "GHOST_VOICE")
        .when(speech & (speakers >= 2), "EXTRA_SPEAKER")
        .when(speech & scored & (score < uncertain), "VOICE_MISMATCH")
    )


def event_confidence(kind: Column, lips: Column, score: Column, speakers: Column, uncertain: float = 0.40) -> Column:
    strange, one = (uncertain - score) / uncertain, F.lit(1.0)
    return (
        F.when(kind == "IMPERSONATION", F.least(one, strange + F.when(lips, 0.0).otherwise(0.3)))
        .when(kind == "GHOST_VOICE", F.least(one, score))
        .when(kind == "EXTRA_SPEAKER", F.least(one, 0.5 + 0.2 * (speakers - 1)))
        .when(kind == "VOICE_MISMATCH", F.least(one, strange))
    )
