"""Techno-economic column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def annuity(rate: Column, years: Column) -> Column:
    growth = F.pow(rate + 1.0, years.cast("double"))
    return rate * growth / (growth - 1.0)


def conversion_cost(capex, opex, rate, years, hours, inputs: list[tuple[Column, Column]]) -> Column:
    """Capital and operation for each unit, plus amount times price of every input; missing prices make it impossible."""
    fixed = capex * (annuity(rate, years) + opex) / hours
    for amount, price in inputs:
        fixed = fixed + amount * price
    return F.coalesce(F.nanvl(fixed, F.lit(INF)), F.lit(INF))


def convert(cost: Column, conversion: Column, efficiency: Column) -> Column:
    return F.try_divide(cost + conversion, efficiency)


def line_haul(distance_m: Column, eur_per_mwh_km: Column) -> Column:
    return distance_m / 1000.0 * eur_per_mwh_km


def detour(distance_m: Column, tolerance_m: float, factor: float = 1.5) -> Column:
    return F.when(distance_m <= tolerance_m, F.lit(0.0)).otherwise(distance_m * factor)


def ship_loss(distance_m: Column, speed_kmh: Column, boil_off_per_day: Column, self_per_km: Column, fuel: Column) -> Column:
    boiled = distance_m / 1000.0 / speed_kmh / 24.0 * boil_off_per_day
    return F.when(fuel, F.greatest(boiled, distance_m / 1000.0 * self_per_km)).otherwise(boiled)


def ship_cost(cost: Column, loss: Column, distance_m: Column, rate: Column, fuel: Column) -> Column:
    """Null (infeasible) where nothing arrives; ships that burn their cargo pay by losses only."""
    freight = F.when(fuel, F.lit(0.0)).otherwise(line_haul(distance_m, rate))
    return F.when(loss < 1, cost / (1.0 - loss) + freight)


def cost_category(cost: Column) -> Column:
    """Classes of 50 above 50; at most 50 has none."""
    low = (F.ceil(cost / 50.0) * 50 - 50).cast("int")
    return F.when(cost > 300, F.lit(">300")).when(cost > 50, F.concat(F.lit("("), low.cast("string"), F.lit(","), (low + 50).cast("string"), F.lit("]")))


def delivered_twh(mwh: Column, efficiency_percent: Column) -> Column:
    return mwh * efficiency_percent / 100.0 / 1e6


def strike_adjusted(cost: Column, price: Column) -> Column:
    return cost - F.coalesce(price, F.lit(0.0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def finite_or_inf(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(INF)), F.lit(INF))


def as_bool(text: Column) -> Column:
    """Text or numbers of configurations as booleans."""
    return F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "y", "on")


def unit_scale(kwh: Column) -> Column:
    power = F.least(F.greatest(F.floor(F.log10(F.greatest(kwh, F.lit(1.0))) / 3), F.lit(0)), F.lit(4)).cast("int")
    return F.element_at(F.array(*map(F.lit, ("kWh", "MWh", "GWh", "TWh", "PWh"))), power + 1)
