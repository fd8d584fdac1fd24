"""Address parsing as one struct of native expressions over the normalised address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from erlink.functions.constants import LANDMARK_WORDS, STATE_NAMES, STREET_SUFFIXES, US_STATES
from erlink.functions.text import country_key, tokens

TWO_WORD_STATES = [s for s in STATE_NAMES if s.count(" ") == 1]
ONE_WORD_STATES = [s for s in STATE_NAMES if " " not in s]


def missing(raw: Column) -> Column:
    return F.coalesce(F.trim(raw) == "", F.lit(True))


def house_number(t: Column) -> Column:
    first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
    return F.when(first.rlike(r"^\p{Nd}"), first).otherwise("")


def postal_code(norm: Column, country: Column) -> Column:
    """First match of the country's pattern in the normalised text; '' without one."""
    key = F.coalesce(country_key(country), F.lit(""))
    us, india, other = (F.regexp_extract(norm, p, 0) for p in (r"\b\d{5}(?:-\d{4})?\b", r"\b\d{6}\b", r"\b\d{5}\b"))
    return F.when(key == "us", us).when(key == "india", india).otherwise(other)


def state_key(t: Column) -> Column:
    """First two-word state among adjacent tokens, else first one-word state or US abbreviation (as its full name)."""
    pairs = F.when(F.size(t) >= 2, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.concat(F.get(t, i), F.lit(" "), F.get(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    two = F.get(F.filter(pairs, lambda p: p.isin(TWO_WORD_STATES)), F.lit(0))
    one = F.get(F.filter(t, lambda x: x.isin(ONE_WORD_STATES + list(US_STATES))), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in US_STATES.items() for x in kv])
    return F.coalesce(two, F.try_element_at(names, one), one, F.lit(""))


def street_tokens(t: Column, house: Column) -> Column:
    return F.slice(F.filter(t, lambda x: ~x.isin(STREET_SUFFIXES) & (x != house)), 1, 12)


def city_tokens(t: Column) -> Column:
    return F.when(F.size(t) > 6, F.slice(t, -6, 6)).otherwise(t)


def parse_address(raw: Column, norm: Column, country: Column) -> Column:
    """Struct of the parts of an address; all empty where the raw text is missing."""
    t = F.when(missing(raw), F.array().cast("array<string>")).otherwise(tokens(norm))
    house = house_number(t)
    return F.struct(
        house.alias("house_no"),
        street_tokens(t, house).alias("street_tokens"),
        F.when(missing(raw), "").otherwise(postal_code(norm, country)).alias("postal"),
        state_key(t).alias("state_key"),
        city_tokens(t).alias("city_tokens"),
        F.exists(t, lambda x: x.isin(LANDMARK_WORDS)).alias("landmark_flag"),
        missing(raw).alias("addr_missing"),
    )
