"""Scalar functions of the match and map domain, as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wool colours by their damage value.
COLOURS = ["white", "orange", "magenta", "light_blue", "yellow", "lime", "pink", "gray", "silver", "cyan", "purple", "blue", "brown", "green", "red", "black"]
#: Colours under other names.
ALIASES = {"light gray": "silver", "light grey": "silver", "light_gray": "silver", "light_grey": "silver", "grey": "gray", "light blue": "light_blue"}
#: Least players of a team for each size tier, the largest first.
TIERS = {80: "giga", 64: "mega", 48: "hecto", 32: "centi", 22: "milli", 14: "micro", 6: "nano", 1: "pico"}
#: Names that are turned into Arrow rows at a time.
CHUNK = 256


def ascii_of(names: pa.Array) -> pa.Array:
    """Texts without accents and without what has no ASCII letter."""
    parts = [pa.array([unicodedata.normalize("NFKD", x.as_py()).encode("ascii", "ignore").decode("ascii") if x.is_valid else None for x in names.slice(at, CHUNK)], pa.string()) for at in range(0, len(names), CHUNK)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normal_name(name: Column) -> Column:
    """A map's slug: accents off, lower case, spaces to ``_``, only ``a-z0-9_``, no doubled or outer ``_``.

    Names of ASCII alone stay on the JVM; others are decomposed (NFKD) in Arrow batches,
    one after the other, so that of a batch of long texts only its two ends are held.
    """
    @F.arrow_udf("string")
    def decomposed(names: pa.Array) -> pa.Array:
        return ascii_of(names)

    plain = F.when(name.rlike(r"[^\x00-\x7F]"), decomposed(F.when(name.rlike(r"[^\x00-\x7F]"), name))).otherwise(name)
    kept = F.regexp_replace(F.regexp_replace(F.lower(plain), " ", "_"), "[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")


def message_name(text: Column) -> Column:
    """Map name of a message ``**#12 - Name - 3m**``: markdown off, what stands between the first two dashes."""
    return F.trim(F.regexp_extract(F.regexp_replace(text, r"[*_`~]", ""), r"^[^-]*-\s*(.*?)\s*(?:-|$)", 1))


def colour_of(damage: Column) -> Column:
    """Wool colour of a damage value; null outside 0 to 15."""
    return F.when(damage.between(0, 15), F.element_at(F.array(*(F.lit(c) for c in COLOURS)), damage.cast("int") + 1))


def damage_of(colour: Column) -> Column:
    """Damage value of a colour under any of its names; null for unknown ones."""
    plain = F.lower(F.trim(colour))
    for name, real in ALIASES.items():
        plain = F.when(plain == name, real).otherwise(plain)
    at = F.array_position(F.array(*(F.lit(c) for c in COLOURS)), F.regexp_replace(plain, " ", "_"))
    return F.when(at > 0, at - 1).cast("int")


def size_tier(players: Column) -> Column:
    """Size tier of a map by its players per team; null below 1."""
    out = None
    for least, name in TIERS.items():
        out = F.when(players >= least, name) if out is None else out.when(players >= least, name)
    return out


def adaptive_grid(blocks: Column) -> Column:
    """Grid size of a map by its blocks: the root of a 300th, rounded half to even, 2 at least."""
    return F.greatest(F.lit(2), F.bround(F.sqrt(F.greatest(blocks, F.lit(1)) / 300.0)).cast("int"))


def signed_angle(ux: Column, uz: Column, vx: Column, vz: Column) -> Column:
    """Degrees from one vector to another; positive ones are left-handed (z points down)."""
    return F.degrees(F.atan2(uz * vx - ux * vz, ux * vx + uz * vz))


def between_angle(ux: Column, uz: Column, vx: Column, vz: Column) -> Column:
    """Degrees between two vectors, 0 to 180; null for a null vector."""
    length = F.hypot(ux, uz) * F.hypot(vx, vz)
    return F.when(length > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uz * vz) / length)))))


def offset_from_line(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Distance of a point from the line through two others; null if those are one."""
    length = F.hypot(bx - ax, bz - az)
    return F.when(length > 0, F.abs((bx - ax) * (az - pz) - (ax - px) * (bz - az)) / length)


def mirrored(low: Column, high: Column, axis: Column) -> tuple[Column, Column]:
    """Ends of an interval mirrored at an axis, in order."""
    a, b = 2 * axis - low, 2 * axis - high
    return F.least(a, b), F.greatest(a, b)


def short_duration(seconds: Column) -> Column:
    """``1h20m`` from an hour on, else ``47m36s``."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(seconds >= 3600, F.format_string("%dh%02dm", hours, minutes)).otherwise(F.format_string("%dm%02ds", minutes, (seconds % 60).cast("long")))


def week_monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def item_category(item: Column) -> Column:
    """Kind of a held item by its name: bow, melee, block, tool or other."""
    low = F.lower(item)
    return F.when(F.contains(low, F.lit("bow")), "bow").when(F.contains(low, F.lit("sword")), "melee").when(F.contains(low, F.lit("block")), "block").when(low.rlike("axe|shovel|spade|hoe"), "tool").otherwise("other")


def structure_class(gradient: Column, ratio: Column, width: Column, length: Column, room: Column) -> Column:
    """A stair climbs along itself, a wall is level, long and near a room; else null.

    ``gradient`` is the slope along the long axis, ``ratio`` that over the slope across.
    """
    stair = (ratio >= 2.5) & (gradient >= 0.45) & (width <= 14)
    wall = (room <= 25) & (gradient <= 0.35) & (ratio < 2) & (width <= 12) & (length >= 8)
    return F.when(stair, "stair").when(wall, "wall")


def respawn_label(has_spawner: Column, has_mob_spawner: Column, has_renewable: Column, has_chest: Column) -> Column:
    """How a wool comes back: the first of its mechanisms."""
    return F.when(has_spawner, "pgm_spawner").when(has_mob_spawner, "mob_spawner").when(has_renewable, "renewable").when(has_chest, "chest").otherwise("unknown")


def base_name(path: Column) -> Column:
    """Last part of a path of either kind of slash."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def start_of(file_name: Column) -> Column:
    """Start of a match from ``2026-01-24_10-00-00`` in its file's name; null without one."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(file_name, r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss"))


def plain_team(team: Column) -> Column:
    """A team's name without its ``-team`` suffix."""
    return F.regexp_replace(team, "-team$", "")


def death_region(location: Column, island: Column, home: Column) -> Column:
    """Where a life ended: bridge (a build region), home or enemy island, else void."""
    return F.when(location == "build_region", "bridge").when((location == "island") & island.isNotNull(), F.when(island == home, "home_island").otherwise("enemy_island")).otherwise("void")


def binomial_tails(top: Column, trials: Column) -> Column:
    """Twice the odds of ``top`` or more heads among ``trials`` tosses of a fair coin; not cut at 1.

    Terms are summed from the first one by its logarithm, so none overflows.
    """
    one = lambda c: c.cast("double")
    steps = F.when(top > 0, F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    first = F.aggregate(steps, -one(trials) * F.log(F.lit(2.0)), lambda s, i: s + F.log(one(trials - i + 1) / one(i)))
    ahead = F.sequence(top, F.greatest(trials, top))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    last = F.aggregate(ahead, start, lambda s, k: F.struct((s["term"] + F.log(F.greatest(one(trials - k), F.lit(1e-300)) / one(k + 1))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")))
    return F.when(top > trials, 0.0).otherwise(2 * last["sum"])
