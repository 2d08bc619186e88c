"""Expressions over attention masses, span widths and hidden vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def head_ratio(m_qp: Column, m_qi: Column, w_p: Column, w_i: Column, eps: float = 1e-6) -> Column:
    """Attention per token on the inserted span over that on the rest of the passage: widths cancel out."""
    wi, wp = F.greatest(F.lit(1), w_i.cast("int")), F.greatest(F.lit(1), w_p.cast("int"))
    rest = F.greatest(F.lit(0.0), m_qp - m_qi) / F.greatest(F.lit(1), wp - wi)
    return (m_qi / wi) / (rest + F.lit(eps))


def standardized(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.greatest(sd, F.lit(TINY))


def safe_sd(sd: Column) -> Column:
    """The deviation, 1 where there is none."""
    return F.when(sd < TINY, F.lit(1.0)).otherwise(sd)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(TINY))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def probe_score(vec: Column, coef: Column, bias: Column, mean: Column | None = None, sd: Column | None = None) -> Column:
    """Probability by a linear probe on the standardized vector."""
    x = vec if mean is None else F.zip_with(F.zip_with(vec, mean, lambda v, m: v - m), sd, lambda v, s: v / s)
    return sigmoid(bias + dot(x, coef))


def fused(alpha: Column, zr: Column, zp: Column) -> Column:
    return alpha * zr + (F.lit(1.0) - alpha) * zp
