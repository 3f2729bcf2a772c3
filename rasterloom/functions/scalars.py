"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The measured hand and the tables below must equal the published ones.
HAND = {"line_pitch": 6180.0, "letter_advance": 1860.0, "letter_height": 3000.0, "stroke_width": 346.0}
INK_LAYER_UM = 15.0
SCALE_STEPS = [10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000]
SCRIBES = {
    "PHercParis4": (3000, 6180),
    "PHerc0139": (1610, 4320),
    "PHerc0500P2": (1920, 2820),
    "PHerc0343P": (1670, 3460),
    "PHerc1667": (1630, 3260),
    "PHerc0814": (1280, 3300),
}
CHUNK_BYTES = 2097152


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def round_half_up(v: Column) -> Column:
    """Browser rounding: halves go towards plus infinity."""
    return F.floor(v + 0.5)


def span_chunks(start: Column, size: Column, factor: Column, limit: Column, chunk: Column) -> Column:
    """How many chunks one axis of a read touches at a pyramid level."""
    a = clamp(round_half_up(start / factor), 0, limit - 1)
    b = clamp(a + round_half_up(size / factor), a + 1, limit)
    return F.floor((b - 1) / chunk) - F.floor(a / chunk) + 1


def snap_z(z: Column, z_factor: Column, depth: Column) -> Column:
    return clamp(round_half_up(z / z_factor), 0, depth - 1)


def format_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(F.format_string("%.1f", n / kb), F.lit(" KB")))
        .when(n < gb, F.concat(F.format_string("%.1f", n / mb), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", n / gb), F.lit(" GB")))
    )


def scale_bar(view: Column, um: Column) -> tuple[Column, Column]:
    """First round length at or above a quarter of the view, with its label."""
    target = view * um / 4
    steps = F.array(*[F.lit(s) for s in SCALE_STEPS])
    chosen = F.coalesce(F.array_min(F.filter(steps, lambda s: s >= target)), F.lit(SCALE_STEPS[-1]))
    label = F.when(
        chosen >= 1000, F.concat((chosen / 1000).cast("int").cast("string"), F.lit(" mm"))
    ).otherwise(F.concat(chosen.cast("string"), F.lit(" µm")))
    return chosen, label


def resolvability(um: Column) -> Column:
    v = INK_LAYER_UM / um
    return F.when(v >= 3, "resolved").when(v >= 1.5, "marginal").otherwise("unresolved")


def model_name(base: Column, volume: Column) -> Column:
    """Tail of a map file name after the volume it was computed on."""
    cut = F.concat(volume, F.lit("-"))
    pos = F.position(cut, base)
    tail = F.when(pos > 0, F.substr(base, pos + F.length(cut))).otherwise(base)
    tail = F.regexp_replace(tail, r"\.(jpg|tif)$", "")
    tail = F.regexp_replace(tail, r"-ds\d+$", "")
    tail = F.regexp_replace(tail, r"-tile\d+-stride\d+$", "")
    return F.coalesce(F.nullif(tail, F.lit("")), F.lit("unnamed"))


def protocol(name: Column) -> tuple[Column, Column, Column]:
    """Voxel size, propagation distance and energy from a volume name; nulls if absent."""
    three, two = r"^([\d.]+)um-([\d.]+)m-(\d+)keV", r"^([\d.]+)um-(\d+)keV"
    full = F.regexp_extract(name, three, 1) != ""
    um = F.when(full, F.regexp_extract(name, three, 1)).otherwise(F.regexp_extract(name, two, 1))
    prop = F.regexp_extract(name, three, 2)
    kev = F.when(full, F.regexp_extract(name, three, 3)).otherwise(F.regexp_extract(name, two, 2))
    num = lambda c, t: F.nullif(c, F.lit("")).try_cast(t)
    return num(um, "double"), num(prop, "double"), num(kev, "int")


def lut_index(v: Column, lo: Column, hi: Column) -> Column:
    """Display-window position 0..255, truncated."""
    span = F.coalesce(F.nullif(hi - lo, F.lit(0)), F.lit(1))
    return clamp((v - lo) / span * 255, 0.0, 255.0).cast("int")


def voxels_through_ink(um: Column) -> Column:
    return INK_LAYER_UM / um
