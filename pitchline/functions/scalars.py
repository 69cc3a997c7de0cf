"""Scalar rules shared by the batch, feed and live paths (ANSI-safe: bad input becomes NULL, not an error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finished statuses, sending-off details and the own-goal detail of the fixture feed.
FINISHED_STATUSES = ["FT", "AET", "PEN"]
RED_CARD_DETAILS = ["Red Card", "Yellow Red Card"]
OWN_GOAL = "Own Goal"

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"^\s*[+-]?(inf|infinity|nan)\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_int(c: Column | str) -> Column:
    """Whole number or NULL: text with a fraction or junk is NULL, numeric input is truncated."""
    return col(c).try_cast("bigint")


def safe_float(c: Column | str) -> Column:
    """Float or NULL; the text check keeps JVM-only spellings such as ``1.5d`` out."""
    text = col(c).cast("string")
    return F.when(text.rlike(_NUMBER) | F.lower(text).rlike(_SPECIAL), F.trim(text).try_cast("double"))


def rate(num: Column | str, den: Column | str) -> Column:
    """Ratio that is NULL where the denominator is 0."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def per_90(total: Column | str, minutes: Column | str) -> Column:
    return F.coalesce(rate(total, col(minutes) / 90.0), F.lit(0.0))


def season_key(label: Column | str, calendar_years: bool = True) -> Column:
    """Sortable year of a season label.

    ``2023_2024`` -> 2023, ``2324`` -> 2023, other digits -> that number, anything else -> 0. With
    ``calendar_years`` a four-digit label is short only when its second half follows its first (``2324``), so
    ``2023`` stays 2023; without it every four-digit label is read as short.
    """
    text = col(label).cast("string")
    head, tail = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 3, 2).try_cast("int")
    short = text.rlike(r"^\d{4}$")
    if calendar_years:
        short = short & ((head + 1) % 100 == tail)
    return F.coalesce(
        F.when(text.contains("_"), F.trim(F.split_part(text, F.lit("_"), F.lit(1))).try_cast("int"))
        .when(short, head + 2000)
        .when(text.rlike(r"^\d+$"), text.try_cast("int")),
        F.lit(0),
    )


def event_minute(elapsed: Column | str, extra: Column | str) -> Column:
    return (F.coalesce(safe_int(elapsed), F.lit(0)) + F.coalesce(safe_int(extra), F.lit(0))).cast("int")


def period_label(minute: Column | str) -> Column:
    m = col(minute)
    return (
        F.when(m <= 15, "0-15").when(m <= 30, "15-30").when(m <= 45, "30-45")
        .when(m <= 60, "45-60").when(m <= 75, "60-75").otherwise("75-90+")
    )


def shooter_goal_diff(h_a: Column | str, h_goals: Column | str, a_goals: Column | str) -> Column:
    """Score of the shooting side minus the other side's at the time of the shot."""
    diff = col(h_goals) - col(a_goals)
    return F.when(col(h_a) == "h", diff).when(col(h_a) == "a", -diff).otherwise(F.lit(0)).cast("int")


def game_state(diff: Column | str) -> Column:
    d = col(diff)
    return F.when(d > 0, "leading").when(d < 0, "trailing").otherwise("tie")


def goal_diff_label(diff: Column | str) -> Column:
    d = col(diff)
    return F.when(d <= -4, "-4-").when(d >= 4, "4+").otherwise(d.cast("string"))


def is_goal_result(result: Column | str, any_case: bool = False) -> Column:
    return F.lower(col(result)) == "goal" if any_case else col(result) == "Goal"


def is_finished(status: Column | str) -> Column:
    return F.coalesce(col(status).isin(FINISHED_STATUSES), F.lit(False))


def feed_event_kind(kind: Column | str, detail: Column | str) -> Column:
    """``goal`` / ``red`` / ``sub`` for the events that change a match, NULL for the rest."""
    k = F.lower(col(kind))
    return (
        F.when(k == "goal", "goal")
        .when((k == "card") & col(detail).isin(RED_CARD_DETAILS), "red")
        .when(k == "subst", "sub")
    )


def odds(p: Column | str) -> Column:
    return rate(col(p), 1.0 - col(p))


def from_odds(o: Column | str) -> Column:
    return rate(col(o), 1.0 + col(o))


def shrink(x: Column, k: float) -> Column:
    """Logarithmic compression of a tail excess."""
    return F.log1p(x * F.lit(k)) / F.lit(k)


def mean_log_loss(p: Column | str, y: Column | str, eps: float = 2.220446049250313e-16) -> Column:
    """Mean binary log loss with probabilities clipped away from 0 and 1."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(p)))
    return F.avg(-(F.when(col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))))


def log_gamma(z: Column, shift: int = 10) -> Column:
    """Logarithm of the gamma function of positive values: Stirling's series at ``z + shift``, stepped back by the recurrence."""
    far = z + F.lit(float(shift))
    steps = z
    for k in range(1, shift):
        steps = steps * (z + F.lit(float(k)))
    series = 1 / (12 * far) - 1 / (360 * F.pow(far, F.lit(3))) + 1 / (1260 * F.pow(far, F.lit(5))) - 1 / (1680 * F.pow(far, F.lit(7)))
    return (far - 0.5) * F.ln(far) - far + F.lit(0.9189385332046727) + series - F.ln(steps)


def beta_share(x: Column, a: Column, b: Column, terms: int = 400) -> Column:
    """Regularised incomplete beta function of ``x`` in [0, 1], by its continued fraction taken from the far end.

    The fraction converges fast up to the mean of the distribution; beyond it the other tail is taken.
    """
    def part(x: Column, a: Column, b: Column) -> Column:
        def fraction(held: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + k - 1) * (a + k))
            odd = -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / held

        whole = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), fraction)
        return F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / (a * whole)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), part(x, a, b)).otherwise(1 - part(1 - x, b, a))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation (and of the slope of its regression) of ``n`` pairs; null for fewer than three."""
    return F.when(n > 2, beta_share(F.greatest(F.lit(0.0), 1 - r * r), (n.cast("double") - 2) / 2, F.lit(0.5)))


def utc_now_second() -> Column:
    return F.date_trunc("second", F.current_timestamp())


# Club words that do not identify a club.
CLUB_WORDS = (
    "fc", "afc", "united", "town", "wanderers", "albion", "rovers", "palace", "spurs", "north-end", "stanley",
    "dons", "hotspur", "forest", "logo", "badge", "club", "hove", "and",
)


def match_name(name: Column | str) -> Column:
    """Club name reduced to its identifying words, joined by single hyphens."""
    text = F.translate(F.lower(col(name)), " _", "--")
    text = F.regexp_replace(text, r"\b(" + "|".join(CLUB_WORDS) + r")\b", "")
    return F.btrim(F.regexp_replace(text, "-+", "-"), F.lit("-"))


def current_season(seasons: Column | str) -> Column:
    """Year of the first season flagged current, else of the last one listed."""
    flagged = F.filter(col(seasons), lambda s: F.coalesce(s["current"], F.lit(False)))
    return F.coalesce(F.get(flagged, F.lit(0)), F.try_element_at(col(seasons), F.lit(-1)))["year"].cast("int")
