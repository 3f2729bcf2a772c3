"""File payloads built in the JVM: TIFF planes, tracks, assembled parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _le(value: Column, size: int) -> Column:
    """Little-endian hex of a non-negative integer."""
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * (size - i) - 1, 2) for i in range(size)])


def byte_hex(value: Column) -> Column:
    """Two hex digits of a byte; a value outside 0..255 is an error, not cut."""
    fault = F.raise_error(F.concat(F.lit("not a byte: "), value.cast("string"))).cast("string")
    return F.when(value.between(0, 255), F.lpad(F.hex(value.cast("long")), 2, "0")).otherwise(fault)


def gray_tiff(pixels: Column, width: Column, height: Column) -> Column:
    """Single-strip 8-bit grey TIFF of an array of byte values in row order."""
    n = F.size(pixels)
    body = F.array_join(F.transform(pixels, byte_hex), "")
    # Tag numbers, field types and the header of the file format.
    short, long = 3, 4
    tags = [
        (256, long, width), (257, long, height), (258, short, F.lit(8)), (259, short, F.lit(1)), (262, short, F.lit(1)),
        (273, long, F.lit(8)), (277, short, F.lit(1)), (278, long, height), (279, long, n),
    ]
    entries = [
        F.concat(_le(F.lit(t), 2), _le(F.lit(k), 2), _le(F.lit(1), 4), _le(v, 2 if k == short else 4), F.lit("0000" if k == short else ""))
        for t, k, v in tags
    ]
    return F.unhex(
        F.concat(F.lit("49492A00"), _le(n + 8, 4), body, _le(F.lit(len(tags)), 2), *entries, F.lit("00000000"))
    )


def label_layers(df: DataFrame, keys: list[str], layer: str, value: str) -> DataFrame:
    """One TIFF and its manifest entry per painted layer of a bounded crop."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    g = df.groupBy(*keys, layer).agg(
        F.transform(cells, lambda c: c["v"]).alias("px"), F.count_if(F.col(value) > 0).alias("painted"),
        (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
    )
    g = g.where("painted > 0")
    digits = F.col(layer).cast("string")
    numbered = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))
    name = F.concat_ws("-", *keys, F.concat(F.lit("layer"), numbered, F.lit("-ink.tif")))
    return g.select(*keys, layer, name.alias("file"), "painted", gray_tiff(F.col("px"), F.col("w"), F.col("h")).alias("tiff"))


def manifest(layers: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """JSON list of the painted layers in layer order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(layer).alias("layer"), F.col("file"), F.col("painted"))))
    return layers.groupBy(*keys).agg(F.to_json(items).alias("manifest"))


def track_lines(tracks: DataFrame, scale: float) -> DataFrame:
    """CSV lines of track points in millimetres."""
    mm = lambda c: F.format_string("%.4f", F.col(c) * scale)
    return tracks.withColumn("line", F.concat_ws(",", F.col("track").cast("string"), mm("z"), mm("y"), mm("x")))


def assemble(parts: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """Parts joined in order, with their total size and checksum.

    A file's parts are few and meet in one row because the file itself is one
    row; sizes are summed before the bytes are touched.
    """
    piece = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    whole = F.array_join(F.transform(piece, lambda p: p["d"]), "")
    return parts.groupBy(key).agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.length(data)).alias("bytes"), F.md5(whole).alias("md5")
    )
