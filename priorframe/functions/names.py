"""Names and context: normalization, tags, local dates, geometry, air, calendar scores."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorframe.functions.rates import col



def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose canonical decomposition without marks is one other character, those characters, and longer decompositions.

    Hangul syllables, which decompose to letters without marks, stay as they are.
    """
    accented, plain, longer = [], [], {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            accented.append(c)
            plain.append(base)
        elif len(base) > 1:
            longer[c] = base
    return "".join(accented), "".join(plain), longer


ACCENTED, PLAIN, LONGER = _decompositions()


#: Fixed order of the suffixes that are taken off.
SUFFIXES = (" jr.", " jr", " sr.", " sr", " ii", " iii", " iv")


def without_marks(text) -> Column:
    """text with its letters as they are without accents and other marks: composed ones are taken apart, combining ones dropped."""
    n = F.translate(col(text), ACCENTED, PLAIN)
    apart = n
    for c, base in LONGER.items():
        apart = F.replace(apart, F.lit(c), F.lit(base))
    # The few letters that come apart into several are of scripts that most texts don't have.
    n = F.when(n.rlike(f"[{''.join(LONGER)}]"), apart).otherwise(n)
    return F.regexp_replace(n, r"\p{Mn}+", "")


def normalize_name(name) -> Column:
    """Lower case, without marks on letters, parentheses, suffixes and double blanks."""
    n = F.trim(F.lower(F.regexp_replace(without_marks(name), r"\s*\([^)]*\)", " ")))
    for s in SUFFIXES:
        n = F.trim(F.regexp_replace(n, s.replace(".", r"\.") + "$", ""))
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def team_tag(name) -> Column:
    """The 2 to 4 letters in closing parentheses, upper case, or null."""
    return F.nullif(F.upper(F.regexp_extract(col(name), r"\(\s*([A-Za-z]{2,4})\s*\)\s*$", 1)), F.lit(""))


def last_token(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def local_date(instant, zone: str = "America/New_York") -> Column:
    """Calendar date of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(col(instant).cast("timestamp"), zone))


def role_bucket(days) -> Column:
    """Bucket of days since the last appearance, with a level for unknown."""
    # The bounds and names of the buckets.
    d = col(days)
    return F.when(d.isNull(), "unknown").when(d <= 2, "<=2").when(d <= 7, d.cast("int").cast("string")).when(d <= 10, "8-10").when(d <= 20, "11-20").otherwise("21+")


def zone_distance(x, z, top, bottom, half: float) -> Column:
    """Signed distance to the edge of a zone, negative inside; unknown sides are passed over."""
    clean = lambda c: F.nanvl(col(c), F.lit(None).cast("double"))
    return F.greatest(F.abs(clean(x)) - half, clean(bottom) - clean(z), clean(z) - clean(top))


def shadow_bin(distance, bins: int = 6, band: float = 0.25) -> Column:
    """Bin of a distance within the band at the edge, null outside of it."""
    d = col(distance)
    at = F.floor((d + band) / (2 * band) * bins)
    return F.when(F.abs(d) <= band, F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0))).cast("int")


def air_density(altitude_ft, temp_f, humidity_pct, pressure_hpa=None) -> Column:
    """Density of moist air in kg per cubic metre; pressure from altitude where it is not given."""
    # Barometric formula, Magnus formula, gas constants of dry air and vapour.
    metres = col(altitude_ft) * 0.3048
    celsius = (col(temp_f) - 32) * 5 / 9
    kelvin = celsius + 273.15
    standard = 1013.25 * F.pow(1 - 2.25577e-5 * metres, F.lit(5.25588))
    pascal = 100 * (standard if pressure_hpa is None else F.coalesce(col(pressure_hpa), standard))
    vapour = 611.2 * F.exp(17.67 * celsius / (celsius + 243.5)) * col(humidity_pct) / 100
    return (pascal - vapour) / (287.058 * kelvin) + vapour / (461.495 * kelvin)


def altitude_penalty(altitude_ft, breaking_share) -> Column:
    return col(breaking_share) * (col(altitude_ft) / 5280.0) * -0.02


def repeat_penalty(fast_share, breadth) -> Column:
    """Expected loss at later meetings: greatest for one-sided mixes, least for wide ones."""
    # The penalties and their bounds.
    return F.when(col(fast_share) > 0.60, -0.04).when(col(breadth) >= 4, -0.02).otherwise(-0.03)


def long_absence(days, least: int = 18) -> Column:
    """Return after more than least days (18 at single points, 25 in bulk)."""
    return F.coalesce(col(days) > least, F.lit(False))


def age_years(born, day) -> Column:
    return F.datediff(col(day), col(born)) / 365.25


def parse_reconstructed(flag) -> Column:
    """Whether a row was reconstructed: all but known words for no count as yes."""
    word = F.lower(F.trim(F.coalesce(col(flag), F.lit(""))))
    return ~word.isin("0", "0.0", "false", "f", "no", "n", "")


def lunar_phase(day, epoch: str = "2000-01-06") -> Column:
    """Negative control: days into the lunar month."""
    return F.datediff(col(day), F.lit(epoch).cast("date")) % 29.53059


def seeded_noise(key, seed: int) -> Column:
    """Negative control in [0, 1) that a rerun repeats."""
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
