"""Column functions over colours, names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file types that are read, their MIME types, and the leading bytes that tell them apart.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".avif", ".svg")
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "avif": "image/avif", "svg": "image/svg+xml"}
HEAD = 1024


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(path: Column | str) -> Column:
    """Lower-cased ending with its dot, or empty."""
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./\\]*)$", 1))


def supported(path: Column | str) -> Column:
    return extension(path).isin(*EXTENSIONS)


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/", -1)


def relative_to(path: Column | str, root: Column | str) -> Column:
    """The path below root, or the path itself if it isn't there."""
    path, root = (F.replace(_c(x), F.lit("\\"), F.lit("/")) for x in (path, root))
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def hidden(path: Column | str) -> Column:
    """Below a folder whose name starts with a dot (files with such names are not hidden)."""
    return _c(path).rlike(r"/\.[^/]*/")


def sniff(head: Column | str) -> Column:
    """webp, avif, svg, bmp or empty, from a text or binary head; white space and byte order marks before it don't count,
    nor does case."""
    text = F.decode(F.substring(_c(head).cast("binary"), 1, HEAD), "ISO-8859-1")
    text = F.lower(F.regexp_replace(text, "^(?:[ \t\r\n]|\u00ef\u00bb\u00bf)+", ""))
    return (
        F.when(F.startswith(text, F.lit("riff")) & (F.substring(text, 9, 4) == "webp") & (F.length(text) > 12), "webp")
        .when((F.substring(text, 5, 4) == "ftyp") & F.substring(text, 9, 4).isin("avif", "avis"), "avif")
        .when(F.contains(text, F.lit("<svg")) | F.contains(text, F.lit("<!doctype svg")), "svg")
        .when(F.startswith(text, F.lit("bm")), "bmp")
        .otherwise("")
    )


def mime(name: Column | str) -> Column:
    found = F.lit("application/octet-stream")
    for kind, value in MIME.items():
        found = F.when(F.ltrim(extension(name), F.lit(".")) == kind, value).otherwise(found)
    return found


def data_uri(name: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("data:"), mime(name), F.lit(";base64,"), F.base64(_c(content)))


def from_data_uri(uri: Column | str) -> Column:
    """Bytes of a data URI or of plain base64; null if it is neither."""
    return F.try_to_binary(F.regexp_replace(_c(uri), r"^data:[^,]*,", ""), F.lit("base64"))


def rgb_distance(a: tuple, b: tuple) -> Column:
    """Euclid's distance of two (r, g, b) over 255."""
    return F.sqrt(sum(((_c(x) - _c(y)) * (_c(x) - _c(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0))) / 255


def luminance(r, g, b, alpha=None) -> Column:
    """Rec. 601 luma; where alpha is 0, white."""
    y = 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)
    return y if alpha is None else F.when(_c(alpha) == 0, 255.0).otherwise(y)


def hsv(r, g, b) -> Column:
    """(h in degrees, s, v) of 8-bit channels."""
    r, g, b = (_c(x) / 255 for x in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    h = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    return F.struct(F.when(h < 0, h + 360).otherwise(h).alias("h"), F.when(top == 0, 0.0).otherwise(span / top).alias("s"), top.alias("v"))


def hex_colour(r, g, b) -> Column:
    return F.format_string("#%02x%02x%02x", *(_c(x).cast("int") for x in (r, g, b)))


def int_or(text: Column | str, default: int) -> Column:
    return F.coalesce(F.expr("1") * _c(text).try_cast("int"), F.lit(default))


def round4(x: Column | str) -> Column:
    """Four places; halves and what is below zero go the way of truncation."""
    return (_c(x) * 10000 + 0.5).cast("long") / 10000


def eta(done, total, elapsed) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.when(_c(done) > 0, (_c(total) - _c(done)) * _c(elapsed) / _c(done))


def bin_of(x: Column, bins: int) -> Column:
    """Bin of a value from 0 to 1; 1 itself goes to the last."""
    return F.least(F.lit(bins - 1), F.floor(x * bins)).cast("int")
