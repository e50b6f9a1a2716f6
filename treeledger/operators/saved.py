"""Searches as strings: conditions on names, places, dates, sizes, contents, tags and attributes, parsed into columns and semi joins."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta, tzinfo
from urllib.parse import parse_qs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from . import browse as B
from . import search as S

_CONDITION = re.compile(r"^(.+?)(>=|<=|=|>|<)(.*)$")
MOST = 5000


@dataclass(frozen=True)
class Search:
    """What a search asks for; see ``parse`` for the fields' names in a string."""

    words: str = ""
    text: str = ""
    kind: str = ""
    under: str = ""
    after_ns: int | None = None
    before_ns: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    any_tag: bool = False
    untagged: bool = False
    direct: bool = False
    attributes: tuple[tuple[str, str, str], ...] = field(default=())
    gone: bool = False
    collapse: bool = False
    folders: bool = False
    limit: int = 500


def condition(raw: str) -> tuple[str, str, str]:
    """``name``, ``name=value``, ``name>=value`` and so on as (name, operator, value)."""
    found = _CONDITION.match(raw.strip())
    if found is None:
        return " ".join(raw.split()), "exists", ""
    return " ".join(found[1].split()), found[2], found[3].strip()


def _day(text: str, zone: tzinfo, more: int = 0) -> int | None:
    if not text.strip():
        return None
    day = datetime.strptime(text.strip(), "%Y-%m-%d").replace(tzinfo=zone) + timedelta(days=more)
    return int(day.timestamp()) * 1_000_000_000


def parse(query: str, zone: tzinfo = UTC) -> Search:
    """A search from its string: q, text, kind, under, after, before (days, inclusive), min_size, max_size, tag, not (both repeatable), mode (or), untagged, direct, attr (repeatable), gone, collapse, folders, limit.

    Unknown kinds, numbers and days that can't be read, and a string without
    any condition are refused; ``limit`` is kept between 1 and 5000.
    """
    fields = parse_qs(query, keep_blank_values=True)
    one = lambda key: (fields.get(key) or [""])[-1]
    flag = lambda key: one(key) == "1"
    every = lambda key: tuple(x for x in fields.get(key, ()) if x.strip())

    def number(key: str) -> int | None:
        raw = one(key).strip()
        return int(float(raw)) if raw else None

    if one("kind") and one("kind") not in N.KINDS:
        raise ValueError(f"unknown kind: {one('kind')}")
    limit = number("limit")
    made = Search(
        words=one("q"), text=one("text").strip(), kind=one("kind"), under=one("under").strip("/"), after_ns=_day(one("after"), zone), before_ns=_day(one("before"), zone, 1), min_size=number("min_size"), max_size=number("max_size"),
        include=every("tag"), exclude=every("not"), any_tag=one("mode") == "or", untagged=flag("untagged"), direct=flag("direct"), attributes=tuple(condition(x) for x in every("attr")),
        gone=flag("gone"), collapse=flag("collapse"), folders=flag("folders"), limit=max(1, min(500 if limit is None else limit, MOST)),
    )
    if not (made.words.split() or made.text or made.kind or made.under or made.include or made.exclude or made.attributes or made.untagged or any(x is not None for x in (made.after_ns, made.before_ns, made.min_size, made.max_size))):
        raise ValueError("a search needs at least one condition")
    return made


def tag_filter(entries: DataFrame, tags: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), any_tag: bool = False, direct: bool = False, untagged: bool = False) -> DataFrame:
    """``entries`` by their tags (root, path, tag; what tags imply included): all of ``include`` (or any), none of ``exclude``, or no tag at all.

    A folder's tags hold for everything below it, unless ``direct``; a root's
    tags have the path ''.
    """
    key = ["root", "relpath"]
    wanted = tags if untagged else tags.filter(F.col("tag").isin(*include, *exclude))
    p = F.col("relpath")
    up = entries.select(*key, F.explode(F.array(p) if direct else F.when(p == "", F.array(p)).otherwise(P.self_and_ancestors(p))).alias("path"))
    hits = up.join(wanted, ["root", "path"]).select(*key, "tag").distinct()
    out = entries
    if untagged:
        out = out.join(hits, key, "left_anti")
    if include:
        n = hits.filter(F.col("tag").isin(*include)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(n.filter(F.col("n") >= (1 if any_tag else len(set(include)))), key, "left_semi")
    if exclude:
        out = out.join(hits.filter(F.col("tag").isin(*exclude)), key, "left_anti")
    return out


def attribute_filter(entries: DataFrame, values: DataFrame, kinds: dict[str, str], conditions: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """``entries`` whose attributes meet all conditions; an item's own value counts, else that of the nearest folder above.

    values: root, path, name, value; kinds: the attributes' types. A condition
    on an attribute without a type only holds as ``exists``.
    """
    key, p, out = ["root", "relpath"], F.col("relpath"), entries
    for name, op, want in conditions:
        mine = values.filter(F.col("name") == name).select("root", "path", "value")
        up = out.select(*key, F.posexplode(F.when(p == "", F.array(p)).otherwise(P.self_and_ancestors(p))).alias("d", "path"))
        near = up.join(mine, ["root", "path"]).groupBy(*key).agg(F.max_by("value", "d").alias("value"))
        met = N.match_attr(F.lit(kinds.get(name)), F.col("value"), op, want) if op == "exists" or name in kinds else F.lit(False)
        out = out.join(near.filter(met), key, "left_semi")
    return out


def search(
    asked: Search | str,
    entries: DataFrame,
    tags: DataFrame | None = None,
    attributes: DataFrame | None = None,
    kinds: dict[str, str] | None = None,
    names: DataFrame | None = None,
    extracts: DataFrame | None = None,
) -> DataFrame:
    """The entries (root, relpath, is_dir, size, mtime_ns, sha256, gone_at) that a search finds, the first ``limit`` by root and path.

    tags: direct ones and what they imply; names: see
    ``dictionary.canonical_names``, by which tags that are asked for under an
    alias are found; extracts: sha256, text. With ``collapse`` files of one
    content are one row, its first path, with ``copies``.
    """
    a = parse(asked) if isinstance(asked, str) else asked
    found = entries if a.gone else entries.filter("gone_at IS NULL")
    words = any([a.words.split(), a.kind, a.under, a.after_ns is not None, a.before_ns is not None, a.min_size is not None, a.max_size is not None])
    if words:
        found = S.find(found, words=a.words, kind=a.kind, under=a.under, after_ns=a.after_ns, before_ns=a.before_ns, min_size=a.min_size, max_size=a.max_size)
    if not a.folders or a.text:
        found = found.filter("NOT is_dir")
    if a.text:
        found = found.join(S.text_matches(extracts, a.text.split()).select("sha256"), "sha256", "left_semi").select(*entries.columns)
    if a.gone:
        found = B.newest_state(found)
    if a.include or a.exclude or a.untagged:
        asked_for = [*a.include, *a.exclude]
        said = {r.alias: r.tag for r in names.filter(F.col("alias").isin(asked_for)).collect()} if names is not None and asked_for else {}  # a row a tag of the search
        proper = lambda xs: tuple(dict.fromkeys(said.get(x, x) for x in xs))
        found = tag_filter(found, tags, proper(a.include), proper(a.exclude), a.any_tag, a.direct, a.untagged)
    if a.attributes:
        found = attribute_filter(found, attributes, kinds or {}, a.attributes)
    if a.collapse:
        one = S.collapse(found.filter("gone_at IS NULL"))
        found = found.join(one.select("root", "relpath", "copies"), ["root", "relpath"], "left").filter("copies IS NOT NULL OR gone_at IS NOT NULL")
    return found.orderBy("root", "relpath", "gone_at").limit(a.limit)
