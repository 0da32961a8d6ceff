"""Scalar functions: units, element classes, names, paths and metadata values."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length units in nanometres (fixed values).
UNITS_NM = {
    "yoctometer": 1e-15, "zeptometer": 1e-12, "attometer": 1e-9, "femtometer": 1e-6, "picometer": 1e-3, "nanometer": 1.0,
    "micrometer": 1e3, "millimeter": 1e6, "centimeter": 1e7, "decimeter": 1e8, "meter": 1e9, "hectometer": 1e11, "kilometer": 1e12,
    "megameter": 1e15, "gigameter": 1e18, "terameter": 1e21, "petameter": 1e24, "exameter": 1e27, "zettameter": 1e30,
    "yottameter": 1e33, "angstrom": 0.1, "inch": 25400000.0, "foot": 304800000.0, "yard": 914400000.0, "mile": 1609344000000.0,
    "parsec": 3.085677581e25,
}
#: Short names (fixed values).
UNIT_NAMES = {
    "ym": "yoctometer", "zm": "zeptometer", "am": "attometer", "fm": "femtometer", "pm": "picometer", "nm": "nanometer",
    "µm": "micrometer", "um": "micrometer", "mm": "millimeter", "cm": "centimeter", "dm": "decimeter", "m": "meter",
    "hm": "hectometer", "km": "kilometer", "Mm": "megameter", "Gm": "gigameter", "Tm": "terameter", "Pm": "petameter",
    "Em": "exameter", "Zm": "zettameter", "Ym": "yottameter", "Å": "angstrom", "in": "inch", "ft": "foot", "yd": "yard",
    "mi": "mile", "pc": "parsec",
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def unit_name(unit: Column) -> Column:
    """The long name of a unit given by its long or short name; others are an error."""
    known = F.when(F.array_contains(F.array(*map(F.lit, UNITS_NM)), unit), unit).otherwise(F.try_element_at(_map(UNIT_NAMES), unit))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown length unit: "), unit)).cast("string"))


def to_nanometer(value: Column, unit: Column) -> Column:
    return value * F.element_at(_map(UNITS_NM), unit_name(unit))


def convert_length(value: Column, unit: Column, target: str) -> Column:
    return to_nanometer(value, unit) / F.lit(UNITS_NM[UNIT_NAMES.get(target, target)])


#: Spark types wide enough for each element type (unsigned ones go one step up).
SPARK_TYPES = {
    "uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int",
    "uint64": "decimal(20,0)", "int64": "bigint", "float32": "float", "float64": "double",
}


def channel_dtype(element_class: Column, channels: Column) -> Column:
    """The type of one channel: float and double by name, else the bits shared out."""
    kind = F.regexp_extract(element_class, r"^([a-z]+)", 1)
    bits = F.nullif(F.regexp_extract(element_class, r"(\d+)$", 1), F.lit("")).cast("int")
    plain = F.concat(kind, (bits / channels).cast("int").cast("string"))
    return F.when(kind == "double", F.lit("float64")).when(bits.isNull() & (kind == "float"), F.lit("float32")).otherwise(plain)


def element_class(dtype: Column, channels: Column) -> Column:
    kind, bits = F.regexp_extract(dtype, r"^([a-z]+)", 1), F.regexp_extract(dtype, r"(\d+)$", 1).cast("int")
    total = F.concat(kind, (bits * channels).cast("string"))
    one = F.when(dtype == "float64", F.lit("double")).when(dtype == "float32", F.lit("float"))
    return F.when((channels == 1) & one.isNotNull(), one).otherwise(total)


def snake_to_camel(name: Column) -> Column:
    joined = F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30))


def normal_path(path: Column) -> Column:
    """Path without empty and '.' parts; '..' takes the part before it away."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done, p):
        last = F.element_at(done, -1)
        up = (F.size(done) > 0) & (F.coalesce(last, F.lit("")) != "..")
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        root = path.startswith("/")
        return F.when(p != "..", F.array_append(done, p)).when(up, shorter).when(root, done).otherwise(F.array_append(done, p))

    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: step(F.coalesce(a, F.array().cast("array<string>")), p))
    joined = F.array_join(kept, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", F.lit(".")).otherwise(joined))


def relative_path(path: Column, root: Column) -> Column:
    """Relative when inside root, else unchanged."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(base), F.concat(F.lit("./"), F.substring(path, F.length(base) + 1, F.length(path)))).otherwise(path)


def metadata_kind(value: Column) -> Column:
    """'number', 'string[]' or 'string' of a JSON value given as text."""
    return (
        F.when(value.rlike(r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), F.lit("number"))
        .when(value.rlike(r"^\s*\["), F.lit("string[]"))
        .otherwise("string")
    )


def byte_ranges(size: Column, chunk: int) -> Column:
    """(start, end) of each chunk of a file; end is exclusive."""
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(chunk).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + chunk, size).alias("end")))


def epoch_ms() -> Column:
    """Now, in milliseconds."""
    return F.unix_millis(F.current_timestamp())


def random_color(seed: int | None = None) -> Column:
    """A random colour (r, g, b, a) of strong saturation and middle lightness."""
    draw = lambda k: F.rand(None if seed is None else seed + k)
    hsl = F.struct(draw(0).alias("h"), (0.5 + draw(1) / 2).alias("s"), (0.4 + draw(2) / 5).alias("l"))

    def channel(c, turn):
        # The share of the full tone at this angle of the wheel.
        angle = (c["h"] + F.lit(turn / 3 + 1)) % 1 * 6
        tone = F.least(F.greatest(F.abs(angle - 3) - 1, F.lit(0.0)), F.lit(1.0))
        return c["l"] + (tone - 0.5) * c["s"] * (1 - F.abs(2 * c["l"] - 1))

    # One draw for all channels: the struct passes through a one-element array.
    mixed = F.transform(F.array(hsl), lambda c: F.array(channel(c, 0), channel(c, -1), channel(c, 1), F.lit(1.0)))
    return F.element_at(mixed, 1)


def job_resources(text: str) -> dict:
    """Settings out of JSON, or of 'key=value,key=value' with dashes as underscores and numbers as numbers."""
    text = text.strip()
    if text.startswith("{"):
        return json.loads(text)
    out = {}
    for pair in text.split(","):
        key, equals, value = pair.partition("=")
        if not equals:
            raise ValueError(f"not a key=value pair: {pair}")
        value = value.strip()
        out[key.strip().replace("-", "_")] = int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value) if re.fullmatch(r"[+-]?\d*\.\d+", value) else value
    return out


def key_values(text: Column) -> Column:
    """A map out of JSON or of 'k=v,k=v' text."""
    return F.when(text.startswith("{"), F.from_json(text, "map<string,string>")).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))
