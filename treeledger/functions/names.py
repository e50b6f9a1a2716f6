"""Column builders that judge file and folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfc

from .paths import basename, extension, parts, stem
from .text import fold, nfc, nfkc_casefold

# Names, extensions and patterns of each category.
REGENERABLE = [
    "node_modules", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    ".tox", ".gradle", ".next", ".nuxt", "bower_components", ".parcel-cache", ".terraform",
]
APP_DATA = ["DMMGames", "My Games", "StreamFab", "Steam", "SteamLibrary", "steamapps", "Epic Games", "Rockstar Games", "Battle.net"]
CACHES = ["cache", "caches", "code cache", "gpucache", "shadercache", "inetcache"]
OS_JUNK = ["thumbs.db", "ehthumbs.db", ".ds_store", "desktop.ini"]
TEMP = [".tmp", ".temp", ".crdownload", ".part", ".partial", ".download", ".bak", ".dmp"]
VM_IMAGES = [".vdi", ".vmdk", ".vhd", ".vhdx", ".qcow2"]
INSTALLERS = [".iso", ".msi", ".dmg", ".pkg", ".deb", ".rpm", ".appimage"]
DOWNLOADS = ["downloads", "ダウンロード"]
VCS = [".git", ".svn", ".hg"]
APP_MARKERS = [".obsidian", "zotero.sqlite", "metadata.db"]
OFFICE_LOCK = r"^(~\$|\.~lock\..*#$)"
CONFLICTS = [
    r"-safeBackup-\d+$",
    r"(?i)\[conflicted\]|\.conflicted$",
    r"\.conflict\d+$",
    r"(?i)_conflict( \(\d+\))?$",
    r" \(\d+\)$",
    r"(?i)(のコピー| - コピー| - copy| copy)( \(\d+\))?$",
]
ARCHIVES = [".zip", ".7z", ".rar", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".lzh"]
CATEGORIES = [
    "app-data", "regenerable", "vm-image", "installer", "conflict", "office-lock", "os-junk",
    "temp", "empty-file", "empty-dir", "extracted-archive", "old-version", "stale-large",
]
KINDS = {
    "pdf": [".pdf"],
    "office": [".docx", ".docm", ".doc", ".xlsx", ".xlsm", ".xls", ".pptx", ".pptm", ".ppt", ".odt", ".ods", ".odp", ".rtf"],
    "text": [".txt", ".md", ".csv", ".tsv", ".json", ".xml", ".html", ".htm", ".log", ".ini", ".yaml", ".yml", ".toml", ".rdp", ".set", ".py", ".mq4", ".mq5"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".svg"],
    "video": [".mp4", ".m4v", ".webm", ".mov", ".ogv", ".flv", ".f4v", ".mkv", ".avi", ".wmv", ".asf", ".mpg", ".mpeg", ".ts", ".m2ts", ".mts", ".3gp", ".vob", ".divx"],
    "audio": [".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".opus", ".wma"],
    "archive": [".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".lzh"],
}
KINDS["document"] = KINDS["pdf"] + KINDS["office"] + KINDS["text"]
DATE_FORMATS = [
    ("YYYY-MM-DD", r"^(19|20)\d{2}-\d{2}-\d{2}"),
    ("YYYY_MM_DD", r"^(19|20)\d{2}_\d{2}_\d{2}"),
    ("YYYYMMDD", r"^(19|20)\d{6}(\D|$)"),
    ("YYYY-MM", r"^(19|20)\d{2}-\d{2}(\D|$)"),
    ("YYYY_MM", r"^(19|20)\d{2}_\d{2}(\D|$)"),
    ("YYYY.MM", r"^(19|20)\d{2}\.\d{2}(\D|$)"),
    ("YYYYMM", r"^(19|20)\d{4}(\D|$)"),
    ("YYYY年MM月", r"^(19|20)\d{2}年\d{1,2}月"),
    ("YYYY年", r"^(19|20)\d{2}年"),
    ("YYYY", r"^(19|20)\d{2}(\D|$)"),
]
DATED = r"^(19|20)\d{2}([-_.]?(0[1-9]|1[0-2])([-_.]?\d{2})?|年(\d{1,2}月)?)?(\D.*)?$"
NUMBERED = r"^(\d{1,3})[_ .\-)]"
SUFFIXES = ["類", "一覧", "関係", "関連", "等", "など"]
CLOUD_BAD = r'["*:<>?/\\|\x00-\x1f]'
CLOUD_RESERVED = r"(?i)^(con|prn|aux|nul|com\d|lpt\d|\.lock|desktop\.ini|_vti_.*)(\..*)?$"
CLOUD_MAX = 400


def kind(path: Column) -> Column:
    """The first matching kind of a file's extension, or null."""
    ext = extension(path)
    return F.coalesce(*[F.when(ext.isin(KINDS[k]), k) for k in ("pdf", "office", "text", "image", "video", "audio", "archive")])


def classify_file(path: Column, size: Column, devices: list[str] = ()) -> Column:
    """The first hygiene category that fits a file's name and size, or null."""
    name, ext, base = basename(path), extension(path), stem(path)
    folders = F.transform(F.slice(parts(path), 1, F.size(parts(path)) - 1), F.lower)
    conflict = F.lit(False)
    for rx in CONFLICTS:
        conflict = conflict | base.rlike(rx) | name.rlike(rx)
    for d in devices:
        conflict = conflict | F.lower(base).endswith("-" + d.lower())
    return (
        F.when(name.rlike(OFFICE_LOCK), "office-lock")
        .when(F.lower(name).isin(OS_JUNK), "os-junk")
        .when(ext.isin(VM_IMAGES), "vm-image")
        .when(ext.isin(INSTALLERS), "installer")
        .when((ext == ".exe") & (base.rlike("(?i)setup|install") | F.arrays_overlap(folders, F.array(*[F.lit(x) for x in DOWNLOADS]))), "installer")
        .when(ext.isin(TEMP), "temp")
        .when(conflict, "conflict")
        .when(size == 0, "empty-file")
    )


def conflict_original(path: Column, devices: list[str] = ()) -> Column:
    """The name that a conflict copy's original should have, or null."""
    name, base = basename(path), stem(path)
    ext = F.substring(name, F.length(base) + 1, F.length(name))
    tries = []
    for rx in CONFLICTS:
        cut = F.rtrim(F.regexp_replace(name, rx, ""))
        cut_ext = F.regexp_extract(cut, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)
        after = F.struct(F.substring(cut, F.lit(1), F.length(cut) - F.length(cut_ext)).alias("b"), cut_ext.alias("e"))
        tries.append(F.when(base.rlike(rx), F.struct(F.rtrim(F.regexp_replace(base, rx, "")).alias("b"), ext.alias("e"))).when(name.rlike(rx), after))
    found = F.get(F.filter(F.array(*tries), lambda x: x.isNotNull()), F.lit(0))

    def whole(x: Column) -> Column:
        b, e, out = F.coalesce(x["b"], base), F.coalesce(x["e"], ext), x["b"]
        for d in reversed(list(devices)):
            out = F.when(F.lower(b).endswith("-" + d.lower()) & (F.length(b) > len(d) + 1), F.substring(b, F.lit(1), F.length(b) - (len(d) + 1))).otherwise(out)
        return F.when(out != "", F.concat(out, e))

    return F.get(F.transform(F.array(found), whole), F.lit(0))


def cloud_name_problem(path: Column) -> Column:
    """Why a path can't be stored in the cloud: the first part's first problem, or null."""

    def problem(p: Column) -> Column:
        return (
            F.when(p.isin("", ".", ".."), "empty or dots")
            .when(p.rlike(CLOUD_BAD), "bad character")
            .when((p != F.trim(p)) | p.endswith("."), "edge space or dot")
            .when(p.rlike(CLOUD_RESERVED), "reserved name")
            .when(p.startswith("~$"), "lock prefix")
        )

    return F.when(F.length(path) > CLOUD_MAX, "too long").otherwise(F.get(F.filter(F.transform(parts(path), problem), lambda x: x.isNotNull()), F.lit(0)))


def date_format(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(rx), label) for label, rx in DATE_FORMATS])


def number_prefix(name: Column) -> Column:
    """The digits of a name's number prefix, as text; "" if it has none."""
    return F.regexp_extract(name, NUMBERED, 1)


def skeleton(folded: Column) -> Column:
    """What similar siblings have in common; ``folded`` is the NFKC, case-folded name."""
    bare = F.regexp_replace(folded, r"(?U)[\d\W_]+", "")
    # aggregate and transform name what they go on with: each step uses the one before several times
    cut = F.aggregate(F.array(*[F.lit(x) for x in SUFFIXES]), bare, lambda t, x: F.when(t.endswith(x) & (F.length(t) > F.length(x) + 1), F.substring(t, F.lit(1), F.length(t) - F.length(x))).otherwise(t))
    singular = lambda t: F.when(t.rlike("^[a-z]+$") & (F.length(t) > 3), F.regexp_replace(F.regexp_replace(t, "ies$", "y"), "s$", "")).otherwise(t)
    return F.get(F.transform(F.array(cut), singular), F.lit(0))


def human_size(n: Column) -> Column:
    """Bytes as text, one digit after the point from KB on, halves to the even digit."""
    unit = lambda power, name: F.format_string(f"%.1f{name}", F.bround(n / float(1024**power), 1))
    return F.when(n < 1024, F.format_string("%dB", n)).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).when(n < 1024**4, unit(3, "GB")).otherwise(unit(4, "TB"))


def parse_size(text: Column) -> Column:
    """Bytes of "5MB" or "1.5G"; null if it isn't a size."""
    rx = r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)I?B?\s*$"
    up = F.upper(text)
    unit = F.create_map(*[F.lit(x) for kv in (("", 1.0), ("K", 1024.0), ("M", 1024.0**2), ("G", 1024.0**3), ("T", 1024.0**4)) for x in kv])
    number = F.expr("1").cast("double") * F.regexp_extract(up, rx, 1).try_cast("double")
    return F.floor(number * F.try_element_at(unit, F.regexp_extract(up, rx, 2))).cast("long")


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, cached: Column, written: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price per million tokens (in, out); cached reads cost a tenth and cache writes 1.25 of the input price; null for unknown models."""
    if not prices:
        return F.lit(None).cast("double")
    table = F.create_map(*[x for m, (i, o) in prices.items() for x in (F.lit(m), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")))])
    p = F.try_element_at(table, model)
    return (tokens_in * p["i"] + cached * p["i"] * 0.1 + written * p["i"] * 1.25 + tokens_out * p["o"]) / 1e6


def model_parts(model: Column) -> Column:
    """``id[:effort]@endpoint`` as a struct."""
    left = F.substring_index(model, "@", 1)
    return F.struct(F.substring_index(left, ":", 1).alias("id"), F.nullif(F.regexp_extract(left, ":(.*)$", 1), F.lit("")).alias("effort"), F.nullif(F.regexp_extract(model, "@(.*)$", 1), F.lit("")).alias("endpoint"))


#: White space by which names are split.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def normalize_tag(tag: Column) -> Column:
    """NFC, white space squeezed, spaces around ":" trimmed; null if the tag is empty, too long, begins or ends with ":", or holds control, format or unassigned characters."""
    t = F.regexp_replace(F.regexp_replace(nfc(tag), _SPACE + "+", " "), "^ | $", "")
    t = F.regexp_replace(t, " ?: ?", ":")
    bad = (t == "") | (F.length(t) > 100) | t.startswith(":") | t.endswith(":") | t.rlike(r"\p{C}")
    return F.when(~bad, t)


def parse_attr(kind: Column, value: Column, choices: Column) -> Column:
    """A typed attribute's stored text, or null if the value isn't valid for its type."""
    v = F.trim(value)
    number = F.regexp_replace(v, ",", "").try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    return (
        F.when(kind == "flag", F.when(v.isin("true", "1", "on"), "true"))
        .when(v == "", None)
        .when(kind == "choice", F.when(F.array_contains(choices, v), v))
        .when(kind == "date", F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull(), v))
        .when(kind == "number", F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), whole))
        .otherwise(F.when(F.length(v) <= 200, F.regexp_replace(v, r"\s+", " ")))
    )


def match_attr(kind: Column, value: Column, op: str, want: str) -> Column:
    """Whether a stored value meets a condition; numbers and dates are ordered, text matches parts, the rest is equal or not."""
    if op == "exists":
        return value.isNotNull()
    compare = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}[op]
    number = compare(value.try_cast("double"), F.lit(want.replace(",", "")).try_cast("double"))
    out = F.when(kind == "number", number).when(kind == "date", compare(value, F.lit(want.strip())))
    if op != "=":
        return F.coalesce(out, F.lit(False))
    return F.coalesce(out.when(kind == "text", F.contains(nfkc_casefold(value), F.lit(fold(want.strip())))).otherwise(value == want.strip()), F.lit(False))


# What a file name can't hold, and its longest stem in characters and bytes.
NAME_BAD = r'[\\/:*?"<>|\x00-\x1f\x7f\u202a-\u202e\u2066-\u2069]'
NAME_CHARS, NAME_BYTES = 150, 200


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of ``text`` of at most ``most`` UTF-8 bytes; no character is cut."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most)
    return F.substring(text, F.lit(1), F.array_max(fits))


def clean_name(new: Column, original: Column) -> Column:
    """A proposed name as a file name with the original's extension; without anything usable the original's stem."""
    ext = extension(original)
    bare = F.trim(nfc(new))
    bare = F.when((ext != "") & F.lower(bare).endswith(ext), F.substring(bare, F.lit(1), F.length(bare) - F.length(ext))).otherwise(bare)
    edges = lambda c: F.regexp_replace(c, r"^[ .]+|[ .]+$", "")
    bare = F.regexp_replace(edges(F.regexp_replace(bare, NAME_BAD, "_")), r"\s+", " ")
    held = F.get(F.transform(F.array(F.substring(F.when(bare == "", stem(original)).otherwise(bare), 1, NAME_CHARS)), lambda b: F.regexp_replace(cut_bytes(b, NAME_BYTES), r"[ .]+$", "")), F.lit(0))
    return F.concat(F.when(held == "", stem(original)).otherwise(held), ext)


def slug(name: Column) -> Column:
    """What plan ids hold of a name: runs of anything but letters, digits, "_", "." and "-" as "_", the last 40 characters."""
    s = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w.\-]+", "_"), "^_+|_+$", "")
    s = F.when(F.length(s) > 40, F.substring(s, -40, 40)).otherwise(s)
    return F.when(s == "", "root").otherwise(s)


def time_label(seconds: Column) -> Column:
    """h:mm:ss"""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def json_answer(text: Column) -> Column:
    """The JSON object of a model's answer: the whole text, a fenced block, or what stands between the outermost braces; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = F.array(F.trim(text), fenced, braces)
    return F.get(F.filter(tries, lambda t: F.get_json_object(t, "$").isNotNull() & F.trim(t).startswith("{")), F.lit(0))
