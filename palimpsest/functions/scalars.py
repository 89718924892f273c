"""Scalar functions of the catalog as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File type bits (fixed values of POSIX).
S_IFMT, S_IFSOCK, S_IFLNK, S_IFREG, S_IFBLK, S_IFDIR, S_IFCHR, S_IFIFO = 0o170000, 0o140000, 0o120000, 0o100000, 0o060000, 0o040000, 0o020000, 0o010000
_TYPES = ((S_IFLNK, "l"), (S_IFSOCK, "s"), (S_IFREG, "-"), (S_IFBLK, "b"), (S_IFDIR, "d"), (S_IFCHR, "c"), (S_IFIFO, "p"))


def _bits(mode: Column, mask: int) -> Column:
    return mode.bitwiseAND(F.lit(mask).cast("bigint")) == mask


def file_type(mode: Column) -> Column:
    """One letter for the kind of file; ? if the mode names none."""
    kind = mode.bitwiseAND(F.lit(S_IFMT).cast("bigint"))
    out = F.lit("?")
    for bits, letter in _TYPES:
        out = F.when(kind == bits, letter).otherwise(out)
    return out


def mode_string(mode: Column) -> Column:
    """ls-style ten characters of a mode."""
    parts = [file_type(mode)]
    for r, w, x, s, low, high in ((0o400, 0o200, 0o100, 0o4000, "s", "S"), (0o040, 0o020, 0o010, 0o2000, "s", "S"), (0o004, 0o002, 0o001, 0o1000, "t", "T")):
        parts.append(F.when(_bits(mode, r), "r").otherwise("-"))
        parts.append(F.when(_bits(mode, w), "w").otherwise("-"))
        parts.append(F.when(_bits(mode, s | x), low).when(_bits(mode, s), high).when(_bits(mode, x), "x").otherwise("-"))
    return F.concat(*parts)


def is_dir(mode: Column) -> Column:
    return file_type(mode) == "d"


def is_regular(mode: Column) -> Column:
    return file_type(mode) == "-"


def is_symlink(mode: Column) -> Column:
    return file_type(mode) == "l"


def is_device(mode: Column) -> Column:
    return file_type(mode).isin("b", "c")


def is_fifo(mode: Column) -> Column:
    return file_type(mode) == "p"


def item_size(mode: Column, content: Column, target: Column) -> Column:
    """Content size of a file, byte length of a link's target, else 0."""
    return F.when(is_regular(mode), content).when(is_symlink(mode), F.octet_length(F.coalesce(target, F.lit("")))).otherwise(0)


def kind_name(mode: Column, size: Column) -> Column:
    """What an added or removed item is called in a comparison."""
    kind = file_type(mode)
    return (
        F.when(kind == "d", "directory").when(kind == "l", "link").when(kind == "p", "fifo").when(kind == "b", "blkdev").when(kind == "c", "chrdev")
        .when(kind == "-", F.concat(size.cast("string"), F.lit(" B"))).otherwise("entry")
    )


def name_or_id(name: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), number.cast("string"), F.lit("None"))


def owner_changed(a: tuple[Column, Column], b: tuple[Column, Column], numeric: bool) -> Column:
    """Whether (user, group) differ, as ids (null is -1) or names (null is empty)."""
    none = F.lit(-1) if numeric else F.lit("")
    return (F.coalesce(a[0], none) != F.coalesce(b[0], none)) | (F.coalesce(a[1], none) != F.coalesce(b[1], none))


def device_major(rdev: Column) -> Column:
    """Major number of a Linux device number."""
    low = F.shiftright(rdev, 8).bitwiseAND(F.lit(0xFFF).cast("bigint"))
    return low.bitwiseOR(F.shiftright(rdev, 32).bitwiseAND(F.lit(0xFFFFF000).cast("bigint")))


def device_minor(rdev: Column) -> Column:
    low = rdev.bitwiseAND(F.lit(0xFF).cast("bigint"))
    return low.bitwiseOR(F.shiftright(rdev, 12).bitwiseAND(F.lit(0xFFFFFF00).cast("bigint")))


def device_number(major: Column, minor: Column) -> Column:
    b = lambda c, m: c.bitwiseAND(F.lit(m).cast("bigint"))
    return F.shiftleft(b(major, 0xFFF), 8).bitwiseOR(b(minor, 0xFF)).bitwiseOR(F.shiftleft(b(minor, 0xFFFFFF00), 12)).bitwiseOR(F.shiftleft(b(major, 0xFFFFF000), 32))


# Paths


def dirname(path: Column) -> Column:
    """Directory part; "." for a bare name, "/" for a file at the root."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(F.instr(path, "/") == 0, ".").when(cut == "", "/").otherwise(cut)


def strip_components(path: Column, n: int) -> Column:
    """Path without its first n parts; null if nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.nullif(F.array_join(F.slice(parts, n + 1, 100000), "/"), F.lit(""))


def safe_path(path: Column) -> Column:
    """Relative path without empty and "." parts; an error where a part is ".."."""
    parts = F.split(path, "/")
    unsafe = F.exists(F.split(path, r"[/\\]"), lambda x: x == "..")
    clean = F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")
    return F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe path: "), path))).otherwise(F.when(clean == "", ".").otherwise(clean))


def archived_path(path: Column) -> Column:
    """Stored form of a path: what follows a /./ marker, without leading / and ../."""
    cut = F.when(F.instr(path, "/./") > 0, F.regexp_replace(path, r"^.*?/\./", "")).otherwise(path)
    return F.regexp_replace(cut, r"^(\.{0,2}/)+", "")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def reverse_fqdn(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


# Sizes


def _human(units: str, precision: int, sign: bool, largest: str | None):
    power = 1024.0 if units == "iec" else 1000.0
    names = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"] if units == "iec" else ["", "k", "M", "G", "T", "P", "E", "Z", "Y"]
    if largest is not None:
        names = names[: names.index(largest) + 1]

    def one(n) -> str | None:
        if pd.isna(n):
            return None
        n = int(n)
        if units == "raw":
            return f"{'+' if sign and n > 0 else ''}{n} B"
        v, prec, unit, shift = float(n), precision if len(names) > 1 else 0, names[-1], 10.0**precision
        for i, name in enumerate(names[:-1]):
            rounded = float(int(abs(v) * shift + 0.5)) / shift
            if rounded < power:
                unit, prec = name, precision if i else 0
                break
            v /= power
        return f"{'+' if sign and v > 0 else ''}{v:.{prec}f} {unit}B"

    return one


def human_bytes(n: Column, units: str = "si", precision: int = 2, sign: bool = False, largest: str | None = None) -> Column:
    """Size in SI, IEC or raw units, up to the prefix ``largest`` if one is given; bytes have no decimals.

    A vectorised Python function: format_string rounds the decimal form of a
    double, this rounds its exact value.
    """
    one = _human(units, precision, sign, largest)

    @F.pandas_udf("string")
    def render(values: pd.Series) -> pd.Series:
        return values.map(one)

    return render(n)


#: Factors of size suffixes (fixed values).
_FACTORS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15}


def parse_size(text: Column) -> Column:
    """Bytes of a number with an optional K, M, G, T or P; null if it is none."""
    number = F.regexp_extract(F.upper(text), r"^([0-9]+(?:\.[0-9]+)?)[KMGTP]?$", 1)
    suffix = F.regexp_extract(F.upper(text), r"([KMGTP])$", 1)
    factor = F.lit(1).cast("decimal(20,0)")
    for letter, value in _FACTORS.items():
        if letter:
            factor = F.when(suffix == letter, F.lit(value).cast("decimal(20,0)")).otherwise(factor)
    return (F.nullif(number, F.lit("")).try_cast("decimal(18,3)") * factor).cast("bigint")


def padme(n: Column) -> Column:
    """Bytes of padding so that a size leaks only O(log log n) bits."""
    e = F.floor(F.log2(n.cast("double"))).cast("int")
    s = F.floor(F.log2(e.cast("double"))).cast("int") + 1
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), e - s) - 1
    padded = (n + mask).bitwiseAND(F.bitwise_not(mask))
    return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(padded - n)


# Times


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def display_time(t: Column) -> Column:
    return F.date_format(t, "EEE, yyyy-MM-dd HH:mm:ss Z")


def parse_timestamp(text: Column) -> Column:
    """The first of nine ISO layouts that fits, in the session's zone; null if none does."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-MM")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])


def offset(t: Column, span: str, back: bool = False) -> Column:
    """t plus (or minus) a span such as 3m: y and m by the calendar, w, d, H, M, S exactly."""
    number, unit = span[:-1], span[-1:]
    if not number.isdigit() or unit not in "ymwdHMS":
        raise ValueError(f"{span!r} is no time span")
    n = int(number) * (-1 if back else 1)
    if unit in "ym":
        return t + F.make_ym_interval(F.lit(n if unit == "y" else 0), F.lit(n if unit == "m" else 0))
    seconds = {"w": 604800, "d": 86400, "H": 3600, "M": 60, "S": 1}[unit] * n
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def iso_week(t: Column) -> Column:
    return F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), t), F.extract(F.lit("WEEK"), t))


#: strftime directives (fixed values) as date_format patterns.
_STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}


def strftime(t: Column, template: str) -> Column:
    """Time by a strftime template; directives that depend on a locale are refused."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c != "%":
            out.append(F.lit(c))
            i += 1
            continue
        d = template[i + 1 : i + 2]
        i += 2
        yday = F.dayofyear(t)
        sunday, monday = F.dayofweek(t) - 1, F.weekday(t)
        special = {
            "%": lambda: F.lit("%"),
            "G": lambda: F.format_string("%04d", F.extract(F.lit("YEAROFWEEK"), t)),
            "V": lambda: F.format_string("%02d", F.extract(F.lit("WEEK"), t)),
            "u": lambda: (monday + 1).cast("string"),
            "w": lambda: sunday.cast("string"),
            "U": lambda: F.format_string("%02d", F.floor((yday + 6 - sunday) / 7)),
            "W": lambda: F.format_string("%02d", F.floor((yday + 6 - monday) / 7)),
            "s": lambda: F.unix_timestamp(t).cast("string"),
            "C": lambda: F.format_string("%02d", F.floor(F.year(t) / 100)),
            "e": lambda: F.format_string("%2d", F.dayofmonth(t)),
            "n": lambda: F.lit("\n"),
            "t": lambda: F.lit("\t"),
        }
        if d in special:
            out.append(special[d]())
        elif d in _STRFTIME:
            out.append(F.date_format(t, _STRFTIME[d]))
        else:
            raise ValueError(f"directive %{d} is not supported")
    return F.concat(*out) if out else F.lit("")


def timedelta_string(seconds: Column) -> Column:
    """Whole seconds as ``N days, H:MM:SS``."""
    days = F.floor(seconds / 86400).cast("bigint")
    rest = seconds - days * 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    word = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), word, clock))


# Ids and text


def short_id(binary_id: Column) -> Column:
    return F.left(F.lower(F.hex(binary_id)), F.lit(8))


def content_id(data: Column) -> Column:
    return F.sha2(data, 256)


def keyed_id(data: Column, key: bytes, algorithm: str = "hmac-sha256") -> Column:
    """HMAC-SHA-256 or keyed BLAKE2b-256 of binary data, in hex."""
    import hashlib
    import hmac

    def one(x: bytes | None) -> str | None:
        if x is None:
            return None
        if algorithm == "hmac-sha256":
            return hmac.new(key, bytes(x), hashlib.sha256).hexdigest()
        if algorithm == "blake2b-256":
            return hashlib.blake2b(bytes(x), key=key[:64], digest_size=32).hexdigest()
        raise ValueError(f"unknown algorithm {algorithm!r}")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(data)


def approximate_text(data: Column) -> Column:
    """Bytes as text, invalid UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("string"))


def valid_name(name: Column) -> Column:
    """Whether an archive may have the name: 1 to 300 characters, none of them forbidden, no outer blanks."""
    return (F.length(name) >= 1) & (F.length(name) <= 300) & ~name.rlike(r'[\\"<|>?*\x00-\x1f\x7f/:]') & ~name.rlike(r"^\s|\s$")


def valid_tag(tag: Column) -> Column:
    return tag.rlike(r"^@?[A-Za-z0-9_.\-]{1,100}$")


def sorted_xattrs(xattrs: Column) -> Column:
    """Extended attributes as a list of (key, value), keys in byte order, null values empty."""
    entries = F.transform(F.map_entries(xattrs), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit(b"")).alias("value")))
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
