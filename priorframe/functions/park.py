"""Park and weather: what a venue and the air do to an episode, as columns of the venue, the forecast and the mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorframe.functions.names import air_density, altitude_penalty
from priorframe.functions.rates import col

#: Temperature, humidity and pressure where none is known, rate of misses of fast balls, shares and heights at which bending balls suffer, losses of two kinds in the cold and its bounds.
TEMPERATURE, HUMIDITY, SEA_LEVEL = 72.0, 50.0, 1013.25
FAST_MISSES = 0.205
BENDING, HIGH = 0.35, 3000
SLIDING_LOSS, SPLITTING_LOSS, COLD, COLD_RANGE = 0.013, 0.010, 60.0, 30.0


def cold_penalty(temperature, sliding, splitting) -> Column:
    """Loss of sliding and splitting balls below 60 degrees; none if the temperature or the mix is unknown."""
    cold = (COLD - col(temperature)) / COLD_RANGE
    loss = -(col(sliding) * SLIDING_LOSS + col(splitting) * SPLITTING_LOSS) * cold
    return F.coalesce(F.when(col(temperature) < COLD, loss), F.lit(0.0))


def park_weather(df: DataFrame, altitude: str, temperature: str, humidity: str, pressure: str, roof: str, factor: str, fast_misses: str, bending: str, sliding: str, splitting: str) -> DataFrame:
    """df with the group of park and weather features; unknown venues have factor 1, no height and an open roof, unknown mixes no penalty."""
    height = F.coalesce(col(altitude).cast("double"), F.lit(0.0))
    rho = air_density(height, F.coalesce(col(temperature).cast("double"), F.lit(TEMPERATURE)), F.coalesce(col(humidity).cast("double"), F.lit(HUMIDITY)), col(pressure))
    sea = air_density(F.lit(0.0), F.lit(TEMPERATURE), F.lit(HUMIDITY), F.lit(SEA_LEVEL))
    ratio, k = rho / sea, F.coalesce(col(factor).cast("double"), F.lit(1.0))
    misses, covered = F.coalesce(col(fast_misses).cast("double"), F.lit(FAST_MISSES)), F.coalesce(col(roof), F.lit("open"))
    return df.withColumns({
        "park_factor": k, "park_residual": k - ratio, "fast_misses_here": misses, "fast_misses_delta": misses - FAST_MISSES, "height": height,
        "bending_penalty": F.coalesce(altitude_penalty(height, col(bending)), F.lit(0.0)), "bending_high": F.coalesce((col(bending) > BENDING) & (height > HIGH), F.lit(False)),
        "is_dome": covered == "dome", "is_retractable": covered == "retractable", "is_open": covered == "open", "cold_penalty": cold_penalty(temperature, sliding, splitting), "density": rho, "density_ratio": ratio,
    })
