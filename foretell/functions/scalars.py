"""Column expressions that the match operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is above zero."""
    return F.when(denominator > 0, numerator / denominator)


def elo_expectation(lead: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -lead / 400))


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def clean_count(x: Column) -> Column:
    """A count as double; null where it is no finite whole number from zero up."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < float("inf")) & (v % 1 == 0), v)


def price(x: Column) -> Column:
    """A price as finite double above 1, else null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (v > 1) & (v < float("inf")), v)


def devig(odds: list[Column]) -> list[Column]:
    """Implied probabilities with the bookmaker's margin divided out in proportion; null if any price is unusable."""
    inverse = [1 / price(o) for o in odds]
    total = inverse[0] + inverse[1] + inverse[2]
    return [x / total for x in inverse]


def expected_value(probability: Column, odds: Column) -> Column:
    return probability * odds - 1


def season_start(date: Column, first_month: int) -> Column:
    """Start year of a date's season, as text."""
    return (F.year(date) - (F.month(date) < first_month).cast("int")).cast("string")


def season_label(start_year: Column) -> Column:
    """2025 -> 2025/26."""
    return F.concat(start_year.cast("string"), F.lit("/"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def season_code(start_year: Column) -> Column:
    """2025 -> 2526."""
    return F.concat(F.lpad((start_year % 100).cast("string"), 2, "0"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def match_id(league: str = "League", date: str = "MatchDate", home: str = "HomeTeam", away: str = "AwayTeam") -> Column:
    """League_yyyyMMdd_Home_Away; null if any part is."""
    return F.concat(F.col(league), F.lit("_"), F.date_format(F.col(date), "yyyyMMdd"), F.lit("_"), F.col(home), F.lit("_"), F.col(away))


def result_of(home_goals: Column, away_goals: Column) -> Column:
    """H, D or A; null unless both counts are there."""
    return F.when(home_goals > away_goals, "H").when(home_goals == away_goals, "D").when(home_goals < away_goals, "A")


def probability_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def first_largest(values: list[Column]) -> Column:
    """Place of the largest value, the first of equal ones."""
    held = F.array(*values)
    return (F.array_position(held, F.array_max(held)) - 1).cast("int")


#: Day-first forms of a date, each with the shape of texts that have it.
DATE_FORMS = {
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMM yy": r"^\d{1,2} [A-Za-z]{3} \d{2}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,} \d{4}$",
    "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]{4,} \d{1,2} \d{4}$",
}


def mixed_date(text: Column) -> Column:
    """Dates of mixed forms, day first: numbers set apart by ``/``, ``-``, ``.`` or blanks, names of months, years of four or two digits, ISO dates; a time behind the date is left out."""
    day = F.regexp_replace(F.trim(text), r"[T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?Z?$", "")
    worded = F.initcap(F.regexp_replace(day, r"[\s,./-]+", " "))
    plain = F.regexp_replace(F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1/$2/$3"), r"[\s./-]+", "/")

    def read(t: Column) -> Column:
        found = None
        for form, shape in DATE_FORMS.items():
            date = F.try_to_date(t, form)
            if form.endswith(" yy") or form.endswith("/yy"):
                # Two digits mean the year within fifty years of today's.
                date = F.when(F.year(date) >= F.year(F.current_date()) + 50, F.add_months(date, -1200)).otherwise(date)
            found = F.when(t.rlike(shape), date) if found is None else found.when(t.rlike(shape), date)
        return found

    # The text is brought into shape once: a lambda's argument isn't copied into each case.
    return F.get(F.transform(F.array(F.when(day.rlike("[A-Za-z]"), worded).otherwise(plain)), read), 0)
