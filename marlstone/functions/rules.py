"""Rule expressions: classifiers, reason lists, bands, signs, intervals and grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """A condition whose missing inputs count as false."""
    return F.coalesce(condition, F.lit(False))


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The label of the first rule that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(holds(condition), label if isinstance(label, Column) else F.lit(label)).otherwise(out)
    return out


def reasons(flags: Sequence[tuple[str, Column]]) -> Column:
    """The names of all flags that hold, in order, as an array."""
    return F.array_compact(F.array(*(F.when(holds(c), F.lit(name)) for name, c in flags)))


def reason_text(flags: Sequence[tuple[str, Column]], none: str = "NONE", several: str | None = None) -> Column:
    """reasons() joined by ';', or `none`; with `several`, that word stands for more than one."""
    found = reasons(flags)
    text = F.when(F.size(found) == 0, none)
    if several is not None:
        text = text.when(F.size(found) > 1, several)
    return text.otherwise(F.concat_ws(";", found))


def band(value: Column, bands: Sequence[tuple[float, object]], beyond: object = None) -> Column:
    """The label of the first (upper bound, label) with value <= bound; null stays null."""
    return F.when(value.isNotNull(), first_match([(value <= top, label) for top, label in bands], beyond))


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True, lowest: bool = False) -> Column:
    """The label of the bin between two edges, right- or left-closed; outside is null."""
    rules = []
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        inside = ((value > low) & (value <= high)) if right else ((value >= low) & (value < high))
        rules.append((inside | (value == low) if lowest and right and i == 0 else inside, label))
    return first_match(rules)


def sign(value: Column, dead: float = 0.0) -> Column:
    """1, 0 or -1, with a dead band around zero; null stays null."""
    return F.when(value > dead, 1).when(value < -dead, -1).when(value.isNotNull(), 0)


def interval_status(point: Column, low: Column, high: Column, dead: float = 3.0) -> Column:
    """STRONG_UNDER, POTENTIAL_UNDER, WITHIN, POTENTIAL_OVER or STRONG_OVER of a gap and its interval.

    WITHIN is closer to zero than the dead band; a missing value is INSUFFICIENT.
    """
    missing = point.isNull() | low.isNull() | high.isNull()
    return first_match([(missing, "INSUFFICIENT"), (low > 0, "STRONG_UNDER"), (high < 0, "STRONG_OVER"), (F.abs(point) < dead, "WITHIN"), (point > 0, "POTENTIAL_UNDER")], "POTENTIAL_OVER")


def sign_pattern(values: Sequence[Column], dead: float = 0.0) -> Column:
    """Signs as text, such as '++-'; a missing one is 'NA'."""
    return F.concat(*(first_match([(v.isNull(), "NA"), (v > dead, "+"), (v < -dead, "-")], "0") for v in values))


def sign_stability(values: Sequence[Column], dead: float = 0.0) -> Column:
    """STABLE_POSITIVE, STABLE_NEGATIVE or MIXED of the values there are, INSUFFICIENT with fewer than two."""
    there = F.filter(F.array(*values), lambda v: v.isNotNull())
    return first_match(
        [
            (F.size(there) < 2, "INSUFFICIENT"),
            (F.forall(there, lambda v: v > dead), "STABLE_POSITIVE"),
            (F.forall(there, lambda v: v < -dead), "STABLE_NEGATIVE"),
        ],
        "MIXED",
    )


def agreement(residual: Column, comparable: Column, dead: float = 0.5) -> Column:
    """How two methods agree in sign: either inside the dead band is neutral, and MIXED names the one that is positive."""
    return first_match(
        [
            (residual.isNull() | comparable.isNull(), "INSUFFICIENT"),
            ((F.abs(residual) <= dead) | (F.abs(comparable) <= dead), "NEUTRAL_OR_ZERO"),
            ((residual > 0) & (comparable > 0), "STRONG_POSITIVE"),
            ((residual < 0) & (comparable < 0), "STRONG_NEGATIVE"),
            (residual > 0, "MIXED_POSITIVE_RESIDUAL"),
        ],
        "MIXED_POSITIVE_COMPARABLE",
    )


#: Shares of positive draws from which, and up to which, a sign counts as stable.
STABLE_SHARES = (0.90, 0.75, 0.25, 0.10)


def probability_class(p: Column, cuts: Sequence[float] = STABLE_SHARES) -> Column:
    """The stability of a sign by the share of draws in which it is positive; a missing share is INSUFFICIENT."""
    very_high, high, low, very_low = cuts
    return first_match(
        [
            (p.isNull() | F.isnan(p), "INSUFFICIENT"),
            (p >= very_high, "VERY_STABLE_POSITIVE"),
            (p >= high, "STABLE_POSITIVE"),
            (p <= very_low, "VERY_STABLE_NEGATIVE"),
            (p <= low, "STABLE_NEGATIVE"),
        ],
        "MIXED",
    )


def quadrant(one: Column, two: Column, dead: float = 0.0) -> Column:
    """The combination of two signals, HIGH or LOW each, NEUTRAL inside the dead band."""
    part = lambda v: first_match([(v.isNull(), "NA"), (v > dead, "HIGH"), (v < -dead, "LOW")], "NEUTRAL")
    return F.concat_ws("_", part(one), part(two))


def persistent(values: Sequence[Column], limit: float, least: int = 2) -> Column:
    """UP or DOWN if at least `least` values lie beyond the limit on that side, else NONE."""
    count = lambda test: F.size(F.filter(F.array(*values), test))
    return first_match([(count(lambda v: v > limit) >= least, "UP"), (count(lambda v: v < -limit) >= least, "DOWN")], "NONE")


def severity(major: Sequence[Column], minor: Sequence[Column]) -> Column:
    """MAJOR if a major flag holds, MINOR if a minor one does, else NONE."""
    some = lambda flags: F.greatest(*(holds(f).cast("int") for f in (*flags, F.lit(False)))) == 1
    return first_match([(some(major), "MAJOR"), (some(minor), "MINOR")], "NONE")


def gate(checks: Sequence[tuple[Column, str, str]], passed: str = "VERIFIED") -> Column:
    """(status, reason, action) of the first check that fails; its condition states success, and a missing one fails."""
    shape = lambda s, r, a: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"), F.lit(a).cast("string").alias("action"))
    out = shape(passed, None, None)
    for condition, reason, action in reversed(checks):
        out = F.when(holds(condition), out).otherwise(shape("PENDING", reason, action))
    return out


def keyword_class(text: Column, exclude: Sequence[str], include: Sequence[str]) -> Column:
    """EXCLUDED if an excluding word stands in the text, else INCLUDED if an including one does, else OTHER."""
    any_of = lambda words: text.rlike("|".join(words))
    return first_match([(any_of(exclude), "EXCLUDED"), (any_of(include), "INCLUDED")], "OTHER")


#: Shortfalls that are numbers of rental households of known complexes.
RENTAL_SHORTFALLS = (15, 32, 46, 48, 64, 71, 75, 80)


def difference_cause(listed: Column, registered: Column, minor: int = 3, rental: Sequence[int] = RENTAL_SHORTFALLS, split: int = 100) -> Column:
    """Why a listed count differs from the registered one: EXACT, MINOR_DIFFERENCE (up to `minor`), RENTAL_DIFFERENCE (a
    listed shortfall), SPLIT_OR_UNREGISTERED (a shortfall of `split` or more), DATA_DIFFERENCE, or MISSING."""
    apart = listed - registered
    return first_match(
        [
            (apart.isNull(), "MISSING"),
            (apart == 0, "EXACT"),
            (F.abs(apart) <= minor, "MINOR_DIFFERENCE"),
            ((-apart).isin(*rental), "RENTAL_DIFFERENCE"),
            (apart <= -split, "SPLIT_OR_UNREGISTERED"),
        ],
        "DATA_DIFFERENCE",
    )


def shrunk(value: Column, n: Column, neutral: Column, k: float) -> Column:
    """(n * value + k * neutral) / (n + k)."""
    return (n * value + F.lit(k) * neutral) / (n + F.lit(k))


def weighted_score(parts: Sequence[tuple[float, Column]]) -> Column:
    """Weighted mean of the parts that are there, with their weights renormalised; null if none is."""
    total = sum((F.coalesce(F.lit(w) * c, F.lit(0.0)) for w, c in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def sum_with_least(columns: Sequence[Column], least: int) -> Column:
    """Sum across columns, null with fewer than `least` values."""
    there = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(there >= least, sum((F.coalesce(c, F.lit(0)) for c in columns), F.lit(0)))


def ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is null for a zero or missing divisor."""
    return top / F.nullif(bottom, F.lit(0))


def percent_gap(value: Column, base: Column) -> Column:
    return (ratio(value, base) - 1) * 100


def log_to_percent(effect: Column) -> Column:
    return (F.exp(effect) - 1) * 100


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is missing."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a local plane: 111 km a degree, longitudes shortened by the cosine of the mean latitude."""
    return 111.0 * F.hypot(lat2 - lat1, (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)))
