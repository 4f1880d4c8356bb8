"""Column functions: locations, capability sets, property literals, durations, vectors, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "@"


# Locations: levels from the finest to the coarsest, '@' between them.
def levels(location: Column) -> Column:
    """Array of levels; '' has none, and empty levels at the end are dropped."""
    trimmed = F.regexp_replace(location, f"{SEPARATOR}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR))


def render(parts: Column) -> Column:
    return F.array_join(parts, SEPARATOR)


def parent(parts: Column) -> Column:
    """Without the finest level; one level or none has the empty parent."""
    return F.when(F.size(parts) <= 1, F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))))


def matching_levels(a: Column, b: Column) -> Column:
    """Number of levels, from the coarsest, in which two locations agree."""
    equal = F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("long")


# Capability sets: lower-case, distinct, sorted.
def capabilities(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(names, F.lower)))


def has_capability(caps: Column, name: str) -> Column:
    return F.array_contains(caps, name.lower())


def matches(wanted: Column, offered: Column) -> Column:
    return F.size(F.array_except(wanted, offered)) == 0


def with_prefix(caps: Column, prefix: str) -> Column:
    return F.filter(caps, lambda c: c.startswith(prefix))


# Property literals.
def size_literal(text: Column) -> Column:
    """Bytes of '12', '3k', '1M', '2G'; null for anything else."""
    number = F.regexp_extract(text, "^([0-9]+)([kKmMgG]?)$", 1)
    unit = F.lower(F.regexp_extract(text, "^([0-9]+)([kKmMgG]?)$", 2))
    scale = F.when(unit == "k", 1024).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(number != "", number.try_cast("long") * scale.cast("long"))


def boolean_literal(text: Column, default: bool) -> Column:
    return F.coalesce(text.isin("1", "on", "", "true", "yes"), F.lit(default))


def duration(micros: Column) -> Column:
    """A time in microseconds with three decimals of its unit."""
    shown = lambda x, unit: F.concat(F.format_string("%.3f", x), F.lit(unit))
    return F.when(micros < 1, shown(micros * 1e3, " ns")).when(micros < 1e3, shown(micros, " us")).when(micros < 1e6, shown(micros / 1e3, " ms")).otherwise(shown(micros / 1e6, " s"))


def common_prefix(a: Column, b: Column) -> Column:
    """Index of the first character in which two strings differ."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)).cast("long")


# Coordinates: arrays of doubles.
def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return magnitude(subtract(a, b))


def coordinate_step(own: Column, own_error: Column, other: Column, other_error: Column, rtt: Column) -> tuple[Column, Column]:
    """New coordinates and error after one measured round trip: moved along the line between the two, by trust and misfit.

    Points closer than 0.01 have no direction and stay; a caller that wants them parted passes a random other point.
    """
    gap, weight = distance(own, other), own_error / (own_error + other_error)
    misfit = F.abs(gap - rtt) / rtt
    error = F.least(F.lit(1.0), misfit * 0.1 * weight + own_error * (F.lit(1.0) - weight * 0.1))
    move = F.when(gap < 0.01, F.lit(0.0)).otherwise(0.1 * weight * (rtt - gap) / gap)
    return F.zip_with(own, other, lambda x, y: x + (x - y) * move), error


def align(x: Column, to: int) -> Column:
    """x rounded up to a multiple of a power of two."""
    return (x + (to - 1)).bitwiseAND(F.lit(~(to - 1)))


def drawn(seed: str, *columns: str) -> Column:
    """A random order that a seed fixes: sorting by it and taking the first n draws n rows without replacement."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def address_score(address: Column) -> Column:
    """Preference of an IPv4 address: global 2, site-local 4, link-local 6, loopback 8; less is better."""
    return F.when(address.startswith("127."), 8).when(address.startswith("169.254."), 6).when(address.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), 4).otherwise(2).cast("long")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


# Property lists and templates.
def string_list(text: Column, delimiter: str = r"\s*,\s*") -> Column:
    """Parts between delimiters; empty parts at the end are dropped, and no text gives no part. The empty text is one empty part."""
    parts = F.split(text, delimiter, -1)
    kept = F.size(parts) - F.aggregate(F.reverse(parts), F.struct(F.lit(True).alias("end"), F.lit(0).alias("n")), lambda s, x: F.struct((s["end"] & (x == "")).alias("end"), (s["n"] + (s["end"] & (x == "")).cast("int")).alias("n")))["n"]
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text == "", F.array(F.lit(""))).otherwise(F.slice(parts, F.lit(1), kept))


def equals(text: Column, match: str) -> Column:
    """Whether a property is set and equals match."""
    return F.coalesce(text == match, F.lit(False))


def implementations(text: Column) -> tuple[Column, Column]:
    """The first of a list of stacked implementations, ',' or ';' between them, and the rest (null without one)."""
    parts = F.split(text, "[,;]", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def filled(template: Column, host: Column, process: Column) -> Column:
    """A location template: %HOSTNAME%, %DOMAIN% (levels of the host's name after the first, '@' between them), %FLAT_DOMAIN% (':'), %PID%; %% is one
    per cent sign, and any other name or lone sign stays as it is."""
    labels = F.split(host, r"\.")
    domain = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    known = {"%HOSTNAME%": F.get(labels, F.lit(0)), "%DOMAIN%": F.array_join(domain, SEPARATOR), "%FLAT_DOMAIN%": F.array_join(domain, ":"), "%PID%": process.cast("string"), "%%": F.lit("%")}
    value = F.create_map(*[x for key, column in known.items() for x in (F.lit(key), column)])
    tokens = F.regexp_extract_all(template, F.lit("%%|%[^%]+%|[^%]+|%"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(value, t), t)), "")


def expanded(text: Column, variables: dict[str, str]) -> Column:
    """${NAME} replaced where NAME is known. Values may name others in turn; a chain of names is followed to its end."""
    value = F.create_map(*[F.lit(x) for name, known in variables.items() for x in ("${" + name + "}", known)]) if variables else F.create_map().cast("map<string,string>")
    for _ in variables:
        tokens = F.regexp_extract_all(text, F.lit(r"\$\{\w+\}|[^$]+|\$"), F.lit(0))
        text = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(value, t), t)), "")
    return text


# Bytes on the wire.
def big_endian(number: Column, size: int = 8) -> Column:
    """Two's complement of a whole number in size bytes, as hex, the highest byte first."""
    return F.substring(F.lpad(F.hex(number.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)


def little_endian(number: Column, size: int = 8) -> Column:
    digits = big_endian(number, size)
    return F.array_join(F.transform(F.sequence(F.lit(size - 1), F.lit(0)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2))), "")


def from_big_endian(digits: Column) -> Column:
    """The number of 16 hex digits."""
    return F.when(F.substring(digits, 1, 1) < "8", F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 16, -10).cast("long"))


def wire_length(text: Column) -> Column:
    """Bytes of a text whose zero characters take two bytes and whose characters beyond the basic plane take six, as pairs of surrogates."""
    zeros, beyond = F.regexp_count(text, F.lit("\\x00")), F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return (F.octet_length(text) + zeros + 2 * beyond).cast("long")


# Port types.
def port_fault(caps: Column, wants_upcalls: Column) -> Column:
    """Why a set of capabilities makes no port type; null if it makes one."""
    has = lambda name: F.array_contains(caps, name)
    connections = F.size(F.filter(caps, lambda c: c.isin("connection.onetoone", "connection.onetomany", "connection.manytoone", "connection.manytomany")))
    light = has("connection.light")
    return (
        F.when(connections != 1, "CONNECTION_TYPES")
        .when(~F.exists(caps, lambda c: c.startswith("serialization")), "NO_SERIALIZATION")
        .when(light & has("connection.upcalls"), "LIGHT_UPCALLS")
        .when(light & has("communication.reliable"), "LIGHT_RELIABLE")
        .when(light & has("communication.fifo"), "LIGHT_FIFO")
        .when(wants_upcalls & ~has("connection.upcalls"), "UPCALLS_NOT_REQUESTED")
    )
