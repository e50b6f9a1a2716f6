"""Metadata that is taken off what a plan puts aside, and put back when the plan is undone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

RECORD = ["root", "base", "fact", "path", "other", "key", "value"]


def detached(state: dict[str, DataFrame], bases: DataFrame) -> DataFrame:
    """What stands at or below the ``bases`` (root, base), as rows to keep (``RECORD``), one for each base.

    state: items, attrs, relations (either end counts), types and cards of
    ``fold.fold``, and ``sources`` of items if they have any.
    """
    empty = F.lit(None).cast("string")
    rows = {
        "items": ("item", "path", empty, F.col("tag"), F.col("source") if "source" in state["items"].columns else empty),
        "attrs": ("attr", "path", empty, F.col("name"), F.col("value")),
        "relations": ("relation", "src", F.col("dst"), F.col("kind"), empty),
        "types": ("type", "path", empty, empty, F.col("type")),
        "cards": ("card", "path", empty, F.col("description"), F.col("naming")),
    }
    held = None
    for table, (fact, path, other, key, value) in rows.items():
        if table in state:
            part = state[table].select("root", F.lit(fact).alias("fact"), F.col(path).alias("path"), other.alias("other"), key.alias("key"), value.alias("value"))
            held = part if held is None else held.unionByName(part)
    places = F.array_distinct(F.concat(P.self_and_ancestors(F.col("path")), F.when(F.col("other").isNotNull(), P.self_and_ancestors(F.col("other"))).otherwise(F.array().cast("array<string>"))))
    return held.withColumn("base", F.explode(places)).join(bases.select("root", "base").distinct(), ["root", "base"], "left_semi").select(*RECORD)


def detach_events(record: DataFrame) -> DataFrame:
    """The events that take the recorded facts off; each fact once."""
    r = record.select("root", "fact", "path", "other", "key", "value").distinct()
    fact = F.col("fact")
    op = F.create_map(*[F.lit(x) for pair in (("item", "remove"), ("attr", "attr-unset"), ("relation", "unrelate"), ("type", "dir-type"), ("card", "dir-card")) for x in pair])
    return _events(r, F.element_at(op, fact), F.lit(""), F.lit(""))


def attach_events(record: DataFrame, state: dict[str, DataFrame], names: DataFrame, kinds: DataFrame) -> DataFrame:
    """The events that put the recorded facts back.

    A tag that became an alias meanwhile comes back under its name; what is
    there (again) is left as it is, as are attributes whose definition is gone
    (kinds: name of each that is left). Types and cards are set again unless
    they are the same.
    """
    r = record.select("root", "fact", "path", "other", "key", "value").distinct()
    said = names.select(F.col("alias").alias("key"), F.col("tag").alias("__name"))
    items = r.filter("fact = 'item'").join(said, "key", "left").withColumn("key", F.coalesce("__name", "key")).drop("__name")
    items = items.groupBy("root", "fact", "path", "other", "key").agg(F.min("value").alias("value")).join(state["items"].select("root", "path", F.col("tag").alias("key")), ["root", "path", "key"], "left_anti")
    attrs = r.filter("fact = 'attr'").join(kinds.select(F.col("name").alias("key")), "key", "left_semi").join(state["attrs"].select("root", "path", F.col("name").alias("key")), ["root", "path", "key"], "left_anti")
    relations = r.filter("fact = 'relation'").join(state["relations"].select("root", F.col("src").alias("path"), F.col("dst").alias("other"), F.col("kind").alias("key")), ["root", "path", "other", "key"], "left_anti")
    types = r.filter("fact = 'type'").join(state["types"].select("root", "path", F.col("type").alias("value")), ["root", "path", "value"], "left_anti")
    cards = r.filter("fact = 'card'").join(state["cards"].select("root", "path", F.col("description").alias("key"), F.col("naming").alias("value")), ["root", "path", "key", "value"], "left_anti")
    columns = ["root", "fact", "path", "other", "key", "value"]
    back = items.select(*columns)
    for part in (attrs, relations, types, cards):
        back = back.unionByName(part.select(*columns))
    op = F.create_map(*[F.lit(x) for pair in (("item", "add"), ("attr", "attr-set"), ("relation", "relate"), ("type", "dir-type"), ("card", "dir-card")) for x in pair])
    return _events(back, F.element_at(op, F.col("fact")), F.col("key"), F.col("value"))


def _events(r: DataFrame, op, description, text) -> DataFrame:
    """Facts as events; ``description`` and ``text``: what types and cards are set to."""
    is_ = lambda *f: F.col("fact").isin(*f)
    return r.select(
        op.alias("op"), "root", F.when(~is_("relation"), F.col("path")).alias("path"), F.when(is_("item"), F.col("key")).alias("tag"), F.when(is_("relation"), F.col("path")).alias("src"), F.when(is_("relation"), F.col("other")).alias("dst"),
        F.when(is_("relation"), F.col("key")).alias("kind"), F.when(is_("attr"), F.col("key")).alias("name"), F.when(is_("attr"), F.col("value")).alias("value"), F.when(is_("item"), F.col("value")).alias("source"),
        F.when(is_("type"), text).alias("type"), F.when(is_("card"), description).alias("description"), F.when(is_("card"), text).alias("naming"),
    )
