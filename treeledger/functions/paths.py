"""Column builders for relative paths ("/" separated, "" is the root)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All proper ancestors, "" first. Prefix relations are equi-joins on the exploded array."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))


def self_and_ancestors(path: Column) -> Column:
    return F.array_append(ancestors(path), path)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(parts(path)))


def under(path: Column, folder: str) -> Column:
    """The folder itself or anything below it; a literal prefix, so scans can use it."""
    return F.lit(True) if folder == "" else (path == folder) | path.startswith(folder + "/")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name start no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def hidden(path: Column) -> Column:
    return F.exists(parts(path), lambda p: p.startswith("."))


def has_part(path: Column, names: list[str]) -> Column:
    """A folder above the item has one of the names."""
    p = parts(path)
    return F.arrays_overlap(F.slice(p, 1, F.size(p) - 1), F.array(*[F.lit(n) for n in names]))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers of any length: their number of digits without leading zeros, then the digits."""
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 9, "0"), number(x))).otherwise(x)), "")


def glob_regex(pattern: str) -> str:
    """A shell pattern whose * crosses "/", as a regular expression; [ab], [a-z] and [!ab] are sets, an open [ is itself."""
    plain = lambda c: c if c.isalnum() or c in "_/ " else "\\" + c
    out, i = "", 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 3 if pattern[i + 1 : i + 2] == "!" else i + 2)
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end]
            no = inside.startswith("!")
            out += "[" + "^" * no + "".join("-" if x == "-" else plain(x) for x in inside[no:]) + "]"
            i = end + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else plain(c)
        i += 1
    return f"(?s)^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern matches the whole path or, without a "/", the name."""
    out = F.lit(False)
    for p in patterns:
        rx = glob_regex(p)
        out = out | path.rlike(rx) | (F.lit("/" not in p) & basename(path).rlike(rx))
    return out
