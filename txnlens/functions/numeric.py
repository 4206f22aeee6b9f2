"""Column expressions for numbers: coercion, guarded ratios, rounding, money sums.

Every helper returns a ``Column`` built from Spark built-ins, so it stays inside
whole-stage code generation and behaves the same whether ANSI mode is on or off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnlens.schemas import FLOAT_TEXT_PATTERN, NUM_PATTERN

INF = float("inf")
NAN = float("nan")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(predicate: Column) -> Column:
    """0/1 integer of a predicate; unknown (null) counts as 0 like a pandas mask."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def to_number(c, currency_symbol: str | None = None) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null.

    Non-finite results (``1e400``) also become null: missing is null, not inf.
    ``currency_symbol`` optionally strips a literal prefix such as ``$`` first.
    """
    s = _c(c)
    if currency_symbol:
        s = F.replace(s, F.lit(currency_symbol), F.lit(""))
    # the pattern is tested once per row; only the cheap cast repeats
    v = F.trim(s).try_cast("double")
    return F.when(s.rlike(NUM_PATTERN), F.when(F.abs(v) != F.lit(INF), v))


def strip_currency(c, symbol: str = "$") -> Column:
    """Remove every literal ``symbol`` and cast to double; malformed text raises.

    Like ``astype(float)``: numbers parse (digits may be grouped by single
    underscores, as Python's ``float`` allows), ``inf``/``infinity`` (any case,
    signed) give +-inf, ``nan`` is missing (null here), and anything else fails
    the job, also when ANSI mode is off. Null stays null.
    """
    s = F.replace(_c(c), F.lit(symbol), F.lit(""))
    infinite = s.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$")
    return (
        F.when(s.isNull(), F.lit(None).cast("double"))
        .when(s.rlike(FLOAT_TEXT_PATTERN), F.replace(F.trim(s), F.lit("_"), F.lit("")).cast("double"))
        .when(s.rlike(r"(?i)^\s*[+-]?nan\s*$"), F.lit(None).cast("double"))
        .when(infinite & F.trim(s).startswith("-"), F.lit(-INF))
        .when(infinite, F.lit(INF))
        .otherwise(F.raise_error(F.concat(F.lit("not a number: "), s)))
    )


def safe_ratio(x, y) -> Column:
    """x / y with float semantics: x/0 is +-inf, 0/0 is NaN, null stays null.

    Spark under ANSI raises on division by zero, so zero is handled before the
    division is reached.
    """
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return (
        F.when(x.isNull() | y.isNull(), F.lit(None).cast("double"))
        .when(y == 0, F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF)).otherwise(F.lit(NAN)))
        .otherwise(x / y)
    )


def rate(numerator, denominator) -> Column:
    """Share ``numerator / denominator`` as double; null when the denominator is 0."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def round_half_even(c, digits: int = 2) -> Column:
    """Round like numpy: scale, round half to even, scale back."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


#: Amounts from here on (in magnitude) are summed as doubles.
LARGE = 1e10


def money_state(c) -> Column:
    """Aggregate: what the sum of a money column needs, a struct that merges by adding its fields.

    An ordinary value (below 1e10) is split, without rounding, into a multiple of
    1e4 and a rest, and the rest into whole cents and a sub-cent remainder in
    micro-units (1e-6). The three parts are summed as BIGINT: exact, independent of
    partitioning, far cheaper than a wide decimal, and without overflow below 9e12
    rows a group, whatever the values. Values of 1e10 and more (and NaN) are summed
    as doubles, as a float sum does; ``large`` is null when there are none.
    """
    c = _c(c).cast("double")
    small = F.when(F.abs(c) < F.lit(LARGE), c)  # NaN is above every number here
    rest = small % F.lit(1e4)
    cents = F.rint(rest * F.lit(100.0))
    micro = F.rint((rest * F.lit(100.0) - cents) * F.lit(10000.0))
    return F.struct(
        F.sum(((small - rest) / F.lit(1e4)).cast("bigint")).alias("blocks"),
        F.sum(cents.cast("bigint")).alias("cents"),
        F.sum(micro.cast("bigint")).alias("micro"),
        F.sum(F.when(F.abs(c) >= F.lit(LARGE), c)).alias("large"))


def merge_money(state: str) -> Column:
    """Aggregate: the ``money_state`` of several groups together."""
    return F.struct(*[F.sum(f"{state}.{f}").alias(f) for f in ("blocks", "cents", "micro", "large")])


def money_value(state: Column) -> Column:
    """The sum a ``money_state`` stands for, as the nearest double; null when it holds no value."""
    wide = lambda f: state[f].cast("decimal(38,0)")
    units = (wide("blocks") * F.lit(10**10).cast("decimal(11,0)") + wide("cents") * F.lit(10**4) + wide("micro")).cast("decimal(38,0)")
    exact = F.concat(units.cast("string"), F.lit("E-6")).cast("double")
    return F.when(state["large"].isNull(), exact).otherwise(state["large"] + F.coalesce(exact, F.lit(0.0)))


def money_sum(c) -> Column:
    """Sum of a money column (see ``money_state``); 0 when all null."""
    return F.coalesce(money_value(money_state(c)), F.lit(0.0))


def money_avg(c) -> Column:
    """Mean of a money column from that sum; null when there is no value."""
    return money_value(money_state(c)) / F.nullif(F.count(_c(c)), F.lit(0))


def float_mean(c) -> Column:
    """Mean with pandas float semantics: NaN skipped, infinities propagate.

    A plain float mean of the finite values, at full relative precision; its last
    bits can depend on the order in which partial sums are merged.
    """
    c = _c(c).cast("double")
    v = F.when(~F.isnan(c), c)
    finite = F.when(F.abs(v) != F.lit(INF), v)
    has_pos = F.max(flag(v == F.lit(INF)))
    has_neg = F.max(flag(v == F.lit(-INF)))
    return (
        F.when((has_pos == 1) & (has_neg == 1), F.lit(NAN))
        .when(has_pos == 1, F.lit(INF))
        .when(has_neg == 1, F.lit(-INF))
        .otherwise(F.avg(finite))
    )


def round_significant(c, digits: int = 11) -> Column:
    """Round to ``digits`` significant digits, for statistics whose last bits depend on
    the order in which partial results are merged; 0, NaN and infinities stay."""
    c = _c(c).cast("double")
    plain = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF)) & (c != 0)
    text = F.format_string(f"%.{digits - 1}e", c)
    return F.when(plain, text.cast("double")).otherwise(c)
