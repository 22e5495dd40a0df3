"""Scalar functions on columns: parsing, geometry and interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA_PER_FWHM = 2.354820045
#: File type aliases.
FILE_TYPES = {
    "tif": "TIFF", "tiff": "TIFF", "ome-tif": "TIFF", "ome-tiff": "TIFF", "h5": "H5", "hdf5": "H5", "n5": "N5",
    "zarr": "ZARR", "ome-zarr": "ZARR",
}
#: Axis aliases.
AXIS_ALIASES = {
    "t": "t", "time": "t", "p": "p", "position": "p", "s": "p", "series": "p", "c": "c", "ch": "c", "channel": "c",
    "z": "z", "y": "y", "x": "x",
}


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")


def _first_number(text: Column, pattern: str) -> Column:
    """The first match's number, null where there is none."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def tiff_indices(path: Column) -> dict[str, Column]:
    """t, p, c of an acquisition file; absent numbers are 0.

    The position is that of the last whole path part ``Position<n>``; every
    other mark is looked for in the stem of the file, the first one counts.
    Single letters must stand between hyphens, underscores or ends.
    """
    folders = F.filter(F.split(path, "/"), lambda x: x.rlike(r"(?i)^Position\d+$"))
    folder = F.try_element_at(folders, F.lit(-1))
    name = stem(path)
    letter = lambda x: _first_number(name, rf"(?i)(?:^|[_-]){x}(\d+)(?:[_-]|$)")
    return {
        "t": F.coalesce(_first_number(name, r"(?i)CH\d+_(\d+)"), letter("T"), F.lit(0)),
        "p": F.coalesce(_first_number(folder, r"(\d+)$"), letter("P"), F.lit(0)),
        "c": F.coalesce(_first_number(name, r"(?i)CH(\d+)"), letter("C"), F.lit(0)),
    }


def h5_sort_keys(name: Column) -> list[Column]:
    """(c, t, name) of CH<c>_<t>; other names sort last."""
    matched = name.rlike(r"(?i)CH\d+_\d+")
    c = F.when(matched, F.regexp_extract(name, r"(?i)CH(\d+)_(\d+)", 1).cast("int")).otherwise(9999)
    t = F.when(matched, F.regexp_extract(name, r"(?i)CH(\d+)_(\d+)", 2).cast("int")).otherwise(9999)
    return [c, t, name]


def axis_token(token: Column) -> Column:
    """Canonical axis letter; unknown words fall back to their first letter."""
    low = F.lower(F.trim(token))
    names = F.create_map(*[F.lit(x) for kv in AXIS_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.substring(low, 1, 1)))


def file_type(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.ltrim(F.trim(name), F.lit(".")))), F.lit("UNKNOWN"))


def chunk_sizes(text: Column) -> Column:
    """Positive integers of "256" or "1,256,256"."""
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda x: x.cast("int"))


def calibration(text: Column) -> Column:
    """Map of world axis to binding from "z=+x,y=none,x=+y"."""
    return F.str_to_map(F.regexp_replace(F.lower(text), r"\s+", ""), F.lit(","), F.lit("="))


def zoom_factor(text: Column) -> Column:
    """The first positive number in a text."""
    found = F.try_element_at(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double")), lambda v: v > 0), F.lit(1))
    return found


def binning(text: Column) -> dict[str, Column]:
    """x and y of "2x2", "2,2" or "2"; otherwise 1."""
    x = F.regexp_extract(text, r"^\s*(\d+)", 1)
    y = F.regexp_extract(text, r"^\s*\d+\s*[xX,]\s*(\d+)", 1)
    bx = F.when(x == "", 1).otherwise(F.greatest(F.lit(1), x.try_cast("int")))
    return {"x": bx, "y": F.when(y == "", bx).otherwise(F.greatest(F.lit(1), y.try_cast("int")))}


def fwhm_to_sigma(fwhm: Column) -> Column:
    return fwhm / SIGMA_PER_FWHM


def gaussian(x: Column, amplitude: Column, center: Column, sigma: Column, offset: Column) -> Column:
    return amplitude * F.exp(-((x - center) ** 2) / (2 * sigma * sigma)) + offset


def ease(alpha: Column, smooth: bool = True) -> Column:
    """Fraction clipped to 0..1, linear or a^2 (3 - 2 a)."""
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), alpha))
    return a * a * (3 - 2 * a) if smooth else a


def interpolate(start: Column, end: Column, alpha: Column) -> Column:
    return start + (end - start) * alpha


def interpolate_vector(start: Column, end: Column, alpha: Column) -> Column:
    return F.zip_with(start, end, lambda a, b: a + (b - a) * alpha)


def clip_to_dtype(value: Column, low: int, high: int) -> Column:
    """Half-even rounding and clipping, as integer types are stored."""
    return F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), F.rint(value).cast("long")))


def truncate_uint16(value: Column, low: Column, high: Column) -> Column:
    """NaN, infinity and negatives to 0, scaled to low..high, truncated."""
    v = F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), value))
    return F.floor(F.least(F.lit(65535.0), low + (high - low) * v)).cast("int")


def pixel_size_um(fov: Column, pixels: Column, fov_y: Column, pixels_y: Column, pixel: Column, zoom: Column, bins: Column) -> Column:
    """First usable of fov/pixels in x, in y, scaled pixel, bare pixel."""
    scaled = F.when((zoom > 0) & (pixel > 0), pixel / zoom * bins)
    return F.coalesce(
        F.when((fov > 0) & (pixels > 0), fov / pixels), F.when((fov_y > 0) & (pixels_y > 0), fov_y / pixels_y), scaled, F.when(pixel > 0, pixel)
    )


def broadcast_channel(values: Column, channel: Column) -> Column:
    """A list of one serves all channels; otherwise the channel's entry."""
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.try_element_at(values, channel + 1))


def first_present(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, name of the source) of the first candidate that is not null."""
    value = F.coalesce(*[c for _, c in candidates])
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in candidates])
    return value, name
