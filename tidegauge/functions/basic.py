"""Small column helpers shared by every operator family."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Col = Column | str


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Col) -> Column:
    """NULL for null, empty and whitespace-only strings, else the trimmed string."""
    return F.nullif(F.trim(c(x)), F.lit(""))


def first_filled(*xs: Col) -> Column:
    return F.coalesce(*[blank_to_null(x) for x in xs])


def clamp(x: Col, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c(x)))


def round_half_up(x: Col, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity (also for negatives)."""
    scale = float(10 ** digits)
    return F.floor(F.round(c(x) * scale, 9) + 0.5) / F.lit(scale)  # nine digits: summation order must not decide ties


def round1(x: Col) -> Column:
    return round_half_up(x, 1)


def safe_div(a: Col, b: Col, default: float = 0.0) -> Column:
    return F.when(c(b) != 0, c(a) / c(b)).otherwise(F.lit(default))


def pct_change(current: Col, previous: Col) -> Column:
    """Change in percent against a base of at least one."""
    return (c(current) - c(previous)) / F.greatest(c(previous), F.lit(1.0)) * 100


def delta_pct(current: Col, previous: Col) -> Column:
    """Change in percent; a base of zero or less gives 100 when something arrived, else 0."""
    return F.when(c(previous) <= 0, F.when(c(current) > 0, 100.0).otherwise(0.0)).otherwise(
        (c(current) - c(previous)) / c(previous) * 100
    )


def log_score(x: Col, ceiling: float) -> Column:
    """0..100 on a log10 scale that reaches 100 at ``ceiling``."""
    return clamp(F.log10(F.greatest(c(x), F.lit(0.0)) + 1) / F.log10(F.lit(ceiling + 1)) * 100, 0.0, 100.0)


def linear_score(x: Col, low: float, high: float) -> Column:
    return clamp((c(x) - low) / F.lit(high - low) * 100, 0.0, 100.0)


def words(items) -> list[str]:
    return sorted(set(items))


def one_of(token: Col, items) -> Column:
    """Token is in a fixed word list (a hash set in the plan, also inside lambdas)."""
    return c(token).isin(*words(items))


def count_in(tokens: Col, items) -> Column:
    """How many tokens are in a fixed word list."""
    return F.size(F.filter(c(tokens), lambda t: one_of(t, items)))


def count_true(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def minutes_between(later: Col, earlier: Col) -> Column:
    return F.expr("1.0D") * (epoch(later) - epoch(earlier)) / 60.0


def epoch(ts: Col) -> Column:
    """Whole seconds since 1970; works for timestamps with and without time zone (session zone UTC)."""
    return F.unix_timestamp(F.date_trunc("second", c(ts)))


def floor_minutes(ts: Col, step: int) -> Column:
    """Start of the ``step``-minute bucket, aligned to the epoch."""
    secs = step * 60
    return F.timestamp_seconds(F.floor(epoch(ts) / secs) * secs)


def age_hours(as_of: Col, ts: Col) -> Column:
    return F.greatest(F.lit(0.0), (epoch(as_of) - epoch(ts)) / 3600.0)


def day_list(start: Col, end: Col) -> Column:
    """Every calendar day touched by [start, end]."""
    return F.sequence(F.to_date(c(start)), F.to_date(c(end)))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside nested lambdas (a plain column would be inlined there)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def barrier(df):
    """Keep later filters and projections from being merged into (and multiplying) the expressions below.

    A one-element inline: a narrow operator, no shuffle, no extra pass."""
    return df.select(F.inline(F.array(F.struct(*[F.col(x) for x in df.columns]))))
