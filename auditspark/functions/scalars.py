"""Column functions: safe division, severity bands, intervals, keyed hashes, text folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The severities, from worst to best.
SEVERITIES = ("CRITICAL", "HIGH", "MODERATE", "LOW")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def severity(di: Column, threshold: float = 0.8) -> Column:
    """Band of a disparate impact: its cuts are 0.9 * threshold, threshold and 0.95, in floating point."""
    return (
        F.when(di.isNull(), "UNKNOWN").when(di < threshold * 0.9, "CRITICAL").when(di < threshold, "HIGH").when(di < 0.95, "MODERATE (borderline)").otherwise("LOW (fair)")
    )


def band(di: Column) -> Column:
    """Band with the fixed cuts .72, .80, .95."""
    return F.when(di.isNull(), "UNKNOWN").when(di < 0.72, "CRITICAL").when(di < 0.80, "HIGH").when(di < 0.95, "MODERATE").otherwise("LOW")


def severity_label(text: Column) -> Column:
    """The first severity that a free text contains; the text itself in upper case if none, UNKNOWN if empty."""
    up = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for s in reversed(SEVERITIES):
        out = F.when(up.contains(s), s).otherwise(out)
    return F.coalesce(out, F.when(F.trim(up) != "", F.trim(up)), F.lit("UNKNOWN"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clipped to 0..1; null where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    below = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / below
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    clip = lambda x: F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(x, 12))))
    return clip(centre - half), clip(centre + half)


def key_hash(key: Column, seed: int | str) -> Column:
    """Hex digest of (key, seed): the order of all seeded choices, whatever the partitioning."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def key_uniform(key: Column, seed: int | str) -> Column:
    """The digest's first 32 bits as a number in [0, 1)."""
    return F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal_category(c: Column) -> Column:
    """Trimmed, lower case, hyphens and spaces as underscores; empty, nan, none and null as null."""
    t = F.translate(F.lower(F.trim(c)), "- ", "__")
    return F.when(~t.isin("", "nan", "none", "null"), t)


def number(c: Column) -> Column:
    """A text as a double; null for text that is no number, and for NaN."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def percent(c: Column) -> Column:
    """A percent text (13.5%) as a double."""
    return number(F.replace(c, F.lit("%"), F.lit("")))


def bins(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the interval that holds a value: closed on the left, or on the right; null outside and for null."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        hit = ((c > low) & (c <= high)) if right else ((c >= low) & (c < high))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def recoded(c: Column, pairs: dict) -> Column:
    """A value's entry in a small dictionary, null without one."""
    out = None
    for k, v in pairs.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def any_contained(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def folded(text: Column) -> Column:
    """Lower case with runs of white space and hyphens as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s-]+", " "))


def shortened(text: Column, most: int = 220) -> Column:
    """White space collapsed; longer texts cut and ended by three dots."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def title_tokens(text: Column) -> Column:
    """Distinct lower-case letter and digit runs of a title, braces removed."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[{}]", "")), "[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(t), " "), lambda w: w != ""))
