"""Ownership-register expressions: stakes, bands, vehicles."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ownerlens import vocab as V
from ownerlens.functions import text as T

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def to_percent(value: Column) -> Column:
    """"28.5%" or 28.5 as DOUBLE; NULL when nothing finite was disclosed."""
    t = F.trim(F.replace(value.cast("string"), F.lit("%"), F.lit("")))
    return F.when(F.rlike(t, F.lit(_NUMBER)), t.try_cast("double"))


def share_band(value: Column) -> Column:
    """Disclosure band, '' when no figure was disclosed."""
    pct = to_percent(value)
    out = F.when(pct.isNotNull(), V.BELOW_THRESHOLD).otherwise("")
    for floor, name in reversed(V.SHARE_BANDS):
        out = F.when(pct >= floor, name).otherwise(out)
    return out


def band_for(stored: Column, value: Column) -> Column:
    """A valid stored band wins; NULL when undisclosed."""
    return F.when(stored.isin(V.BAND_IDS), stored).otherwise(T.non_empty(share_band(value)))


def is_direct_holding(vehicle: Column) -> Column:
    return F.lower(F.trim(F.coalesce(vehicle, F.lit("")))).isin(V.DIRECT_HOLDING_LABELS)


def party_key(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def control_chain(person: Column, role: Column, vehicle: Column, company: Column) -> Column:
    """Two steps for a direct holding, three when a vehicle stands between."""

    def step(kind, title, subtitle):
        return F.struct(
            F.lit(kind).alias("kind"), title.alias("title"), subtitle.alias("subtitle")
        )

    return F.filter(
        F.array(
            step("person", F.coalesce(T.non_empty(person), F.lit("Undisclosed holder")),
                 F.coalesce(T.non_empty(role), F.lit("Natural person"))),
            step("vehicle", F.when(~is_direct_holding(vehicle), vehicle), F.lit("Intermediate vehicle")),
            step("company", F.coalesce(T.non_empty(company), F.lit("Undisclosed company")),
                 F.lit("Operating company")),
        ),
        lambda s: s["title"].isNotNull(),
    )
