"""Names: extension classes, signatures, path parts, sanitizing, and folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelf.options import UNNAMED

#: Extensions of each kind, device names, and the bound on a component's bytes.
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "tif", "tiff", "webp", "heic", "heif", "avif"),
    "raw": ("nef", "arw", "dng", "orf", "raf", "cr2"),
    "video": ("mov", "mp4", "m4v", "avi", "mts", "3gp", "mpg"),
    "sidecar": ("xmp", "aae"),
}
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)))
MAX_BYTES, MAX_EXTENSION = 100, 16
_ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UP, _LOW)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """Path without its last component; empty for a bare name."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """Name without its last extension; a name such as ``.jpg`` is all stem."""
    cut = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(cut == "", name).otherwise(cut)


def extension(name: Column) -> Column:
    """Text after the last dot of a name that does not begin there; null if there is none."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)\.([^.]*)$", 1))


def classify(ext: Column) -> Column:
    """Kind of a file by its extension, in any ASCII case; null for other files."""
    low = ascii_lower(ext)
    return F.coalesce(*[F.when(low.isin(*exts), F.lit(kind)) for kind, exts in EXTENSIONS.items()])


def path_order(path: Column) -> Column:
    """Sort key of paths: by component, so ``a/b`` comes before ``a-b``."""
    return F.split(path, "/")


#: Container signatures in hex.
_STILL = ("ffd8ff", "89504e470d0a1a0a", "49492a00", "4d4d002a", "49492b00", "4d4d002b", "46554a4946494c4d434344")
_RIFF, _WEBP, _FTYP, _MPEG = "52494646", "57454250", "66747970", "000001"


def signature_matches(kind: Column, head: Column) -> Column:
    """Whether the first bytes fit the kind; fewer than 12 never do, sidecars always."""
    h = F.lower(F.hex(head))
    boxed, riff = F.substring(h, 9, 8) == _FTYP, h.startswith(_RIFF)
    still = boxed | (riff & (F.substring(h, 17, 8) == _WEBP))
    for mark in _STILL:
        still = still | h.startswith(mark)
    moving = boxed | riff | h.startswith(_MPEG)
    tested = F.when(kind == "video", moving).otherwise(still)
    return F.when(kind == "sidecar", F.lit(True)).when(F.octet_length(head) < 12, F.lit(False)).otherwise(tested)


def is_reserved(name: Column) -> Column:
    """Device name before the first dot, in any ASCII case."""
    return F.translate(F.split(name, r"\.", 2)[0], _LOW, _UP).isin(*DEVICES)


def sanitize_ascii(text: Column) -> Column:
    """``component`` for text known to be ASCII, where characters are bytes; stays in the JVM."""
    s = F.left(F.regexp_replace(text, _ILLEGAL, "-"), F.lit(MAX_BYTES))
    s = F.regexp_replace(F.regexp_replace(s, r"[. ]+$", ""), r"^[. ]+", "")
    return F.when(s == "", F.lit(UNNAMED)).when(is_reserved(s), F.concat(F.lit("_"), s)).otherwise(s)


_BAD = re.compile(_ILLEGAL)
_DEVICES = frozenset(DEVICES)


def cut(text: str, most: int) -> str:
    """Longest prefix of whole characters within ``most`` bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def component(text: str) -> str:
    """One path component fit for any file system.

    In order: NFC, illegal characters to hyphens, at most 100 bytes of whole characters,
    final dots and spaces off, then leading ones, a placeholder for nothing, an underscore
    before a device name.
    """
    s = cut(_BAD.sub("-", unicodedata.normalize("NFC", text)), MAX_BYTES).rstrip(". ").lstrip(". ")
    if not s:
        return UNNAMED
    return "_" + s if s.split(".", 1)[0].translate(_CAPITALS) in _DEVICES else s


_CAPITALS = str.maketrans(_LOW, _UP)


def file_name(text: str) -> str:
    """A file name whose extension survives truncation.

    The part after the last dot counts as an extension if it has at most 16 bytes and no
    space and something stands before the dot; both parts are sanitized, and the stem gets
    what the extension leaves of 100 bytes.
    """
    before, _, ext = text.rpartition(".")
    if not before or len(ext.encode("utf-8", "surrogatepass")) > MAX_EXTENSION or " " in ext:
        return component(text)
    ext = component(ext)
    room = max(1, MAX_BYTES - len(ext.encode()) - 1)
    return f"{cut(component(before), room).rstrip('. ') or UNNAMED}.{ext}"


@F.pandas_udf(StringType())
def sanitize_component(text: pd.Series) -> pd.Series:
    """``component`` over a column; null stays null. Composing has no Spark function."""
    return text.map(lambda s: None if s is None else component(s))


@F.pandas_udf(StringType())
def sanitize_file_name(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else file_name(s))


def fold(path: str) -> str:
    """Case-folded form under which two destinations collide; capitals fold one by one."""
    return "".join(c.lower() if c.isupper() else c for c in path.replace("\\", "/"))


_TAIL = re.compile(r"(_[0-9]+)+\Z")


def family(path: str) -> str:
    """Name family: folded folder, stem without trailing ``_n``, and extension.

    Every name that suffixing can make of a path is in the path's own family.
    """
    head, _, name = fold(path).rpartition("/")
    cut = name.rfind(".")
    front, ext = (name[:cut], name[cut:]) if cut > 0 else (name, "")
    return f"{head}/{_TAIL.sub('', front)}\0{ext}"


@F.pandas_udf(StringType())
def family_of(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else family(p))


@F.pandas_udf(StringType())
def fold_of(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else fold(p))
