"""Functions that mappings may call by name. An unknown name raises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraweave.functions import geometry, text
from terraweave.plans.config import Config

Function = Callable[..., Column]


def _uuid(*keys: Column) -> Column:
    return text.uuid_v3(F.concat(*[F.coalesce(k, F.lit("")) for k in keys]))


def _join(*values: Column) -> Column:
    return text.concatenate(*values) if len(values) == 2 else F.trim(F.concat_ws(" ", *values))


def _date(v: Column, pattern: Column | str) -> Column:
    return text.standard_date(v, pattern if isinstance(pattern, str) else "yyyyMMdd")


FUNCTIONS: dict[str, Function] = {
    "getUUID": _uuid,
    "getRandomUUID": F.uuid,
    "getNextSerial": lambda: (F.monotonically_increasing_id() + 1).cast("string"),
    "keepOriginalID": lambda v: v,
    "getResourceType": lambda v: v,
    "concatenate": _join,
    "getTransliteration": text.transliterate,
    "standardizePhoneNumber": text.phone,
    "standardizeDate": _date,
    "encodeUTF": lambda v, *_: F.decode(F.encode(v, "UTF-8"), "UTF-8"),
}
#: Arguments that stay plain strings, by function and place.
LITERAL_ARGS = {("standardizeDate", 1)}


def register(name: str, function: Function) -> None:
    """Adds a function of Columns that mappings can name."""
    FUNCTIONS[name] = function


def call(name: str, args: list[str], attribute: Callable[[str], Column | None], config: Config) -> Column:
    """An argument is an attribute (missing values are empty) or else a literal, quotes dropped."""
    if name == "getDataSource":
        return F.lit(config.source)
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name}")
    values = []
    for i, a in enumerate(args):
        if (name, i) in LITERAL_ARGS:
            values.append(a.replace('"', ""))
        elif a == "DATA_SOURCE":
            values.append(F.lit(config.source))
        else:
            found = attribute(a)
            values.append(F.lit(a.replace('"', "")) if found is None else F.coalesce(found, F.lit("")))
    return FUNCTIONS[name](*values)


def call_geometry(name: str, args: list[str], wgs84: Column, flat: Column) -> Column:
    """``wgs84`` and ``flat`` are the parsed geometry in degrees and in metres."""
    c = geometry.centroid(wgs84)
    if name == "getGeoHash":
        return geometry.geohash(c["x"], c["y"], int(args[0]) if args else 8)
    if name == "getArea":
        return F.when(geometry.is_areal(wgs84), geometry.area(flat).cast("string"))
    if name == "getLength":
        return F.when(geometry.is_areal(wgs84) | geometry.is_linear(wgs84), geometry.length(flat).cast("string"))
    if name in ("getLongitude", "getLatitude"):
        return c["x" if name == "getLongitude" else "y"].cast("string")
    raise KeyError(f"no geometric function {name}")
