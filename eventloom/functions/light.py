"""Colour and light as column arithmetic, and the cue confidences built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.rotation import clip

# fixed values: luminance weights, grey weights
LUMA = (0.2126, 0.7152, 0.0722)
GREY = (0.299, 0.587, 0.114)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def log_lum(r, g, b, eps: float = 1e-5) -> Column:
    return F.log(luminance(r, g, b) + eps)


def gray_log(r, g, b) -> Column:
    return F.log1p(F.rint(GREY[0] * r + GREY[1] * g + GREY[2] * b))


def chroma(r, g, b) -> list[Column]:
    total = r + g + b + 3.0
    return [(c + 1.0) / total for c in (r, g, b)]


def distance(a: list[Column], b: list[Column]) -> Column:
    d = [(x - y) * (x - y) for x, y in zip(a, b)]
    s = d[0]
    for e in d[1:]:
        s = s + e
    return F.sqrt(s)


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-clip(v, -20, 20)))


# fixed values: threshold floors and softness rules (minimum, factor)
FLOORS = {"flow": 0.35, "relative": 0.18, "depth": 0.015, "photo": 0.04, "chroma": 0.015}
RELATIVE_CAP = 0.40
SOFTNESS = {"flow": (0.12, 0.25), "relative": (0.04, 0.25), "depth": (0.006, 0.35), "photo": (0.02, 0.35), "chroma": (0.008, 0.35)}


# fixed values: how much light evidence weakens motion, and how much persistence supports it
LIGHT_WEAKENS, PERSISTENT_SUPPORTS = 0.85, 0.25


def cue(kind: str, value: Column, threshold: Column) -> Column:
    """Soft evidence that a residual exceeds its threshold."""
    least, factor = SOFTNESS[kind]
    return sigmoid((value - threshold) / F.greatest(F.lit(least), factor * threshold))


def fuse(flow: Column, depth: Column, photo: Column, chroma_: Column, persistent: Column, valid: Column) -> dict[str, Column]:
    """Split motion evidence into static, dynamic, illumination and unknown."""
    ok = valid.cast("double")
    support = F.greatest(depth, chroma_, PERSISTENT_SUPPORTS * persistent)
    light = photo * (1.0 - support) * ok
    dynamic = flow * (1.0 - LIGHT_WEAKENS * light)
    static = (1.0 - flow) * (1.0 - light) * ok
    return {"q_static": static, "q_dynamic": dynamic, "q_illumination": light,
            "q_unknown": F.greatest(light, 1.0 - F.greatest(dynamic, static))}


def log_blend(a: list[Column], b: list[Column], f: Column) -> list[Column]:
    """Blend two colours with linear chroma and geometric luminance."""
    eps = 1e-5
    a = [F.greatest(c, F.lit(0.0)) for c in a]
    b = [F.greatest(c, F.lit(0.0)) for c in b]
    want = F.exp((1.0 - f) * F.log(luminance(*a) + eps) + f * F.log(luminance(*b) + eps)) - eps
    mix = [(1.0 - f) * x + f * y for x, y in zip(a, b)]
    return [m * (want / (luminance(*mix) + eps)) for m in mix]
