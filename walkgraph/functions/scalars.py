"""Column functions on walks, follow lists and numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TAGS = 100_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_walk(path: str | Column) -> Column:
    """'0,1,2'; an empty walk gives an empty string."""
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ",")


def parse_walk(text: str | Column) -> Column:
    """The ids of '0,1,2'; null for an empty string; an error for what isn't whole numbers."""
    return F.when(_col(text) != "", F.transform(F.split(text, ","), lambda x: x.cast("long")))


def parse_ids(text: str | Column) -> Column:
    """As parse_walk(), but null where anything isn't a whole number."""
    ids = F.transform(F.split(text, ","), lambda x: x.try_cast("long"))
    return F.when((_col(text) != "") & ~F.exists(ids, lambda x: x.isNull()), ids)


def unique_sorted(values: str | Column) -> Column:
    """Sorted, each once; null if there are none."""
    out = F.array_sort(F.array_distinct(values))
    return F.when(F.size(out) > 0, out)


def difference(a: str | Column, b: str | Column) -> Column:
    """Sorted a - b."""
    return F.array_sort(F.array_except(a, b))


def partition(old: str | Column, new: str | Column) -> Column:
    """struct(removed, common, added), each sorted."""
    return F.struct(
        difference(old, new).alias("removed"),
        F.array_sort(F.array_intersect(old, new)).alias("common"),
        difference(new, old).alias("added"),
    )


def crop_walk(path: str | Column, node: str | Column) -> Column:
    """What follows the node; null where the walk doesn't visit it."""
    p = F.array_position(path, node)
    return F.when(p > 0, F.slice(path, p + 1, F.size(path)))


def trim_cycles(old: str | Column, new: str | Column) -> Column:
    """The beginning of new, up to its first element that old has too."""
    hit = F.array_min(F.filter(F.transform(_col(old), lambda x: F.array_position(new, x)), lambda p: p > 0))
    return F.when(hit.isNull(), _col(new)).otherwise(F.slice(new, 1, (hit - 1).cast("int")))


def invalid_step(path: str | Column, node: str | Column, removed: str | Column) -> Column:
    """Where to cut a walk that goes from the node to one of the removed: the nodes kept; else null."""
    p = F.array_position(path, node).cast("int")
    after = F.try_element_at(_col(path), p + 1)
    return F.when((p > 0) & F.array_contains(removed, after), p)


def prune_graft(path: str | Column, cut: str | Column, segment: str | Column) -> Column:
    return F.concat(F.slice(path, 1, cut), segment)


def starts_with(path: str | Column, node: str | Column) -> Column:
    return F.coalesce(F.try_element_at(_col(path), F.lit(1)) == node, F.lit(False))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def walks_to_update(added: Column, current: Column, visits: Column) -> Column:
    """The share added / current of the visits, each step in single precision, rounded half up."""
    # Spark divides in double precision, and takes a cast to single that one to double follows away; a zero between them keeps it.
    single = lambda c: c.cast("float") + F.lit(0).cast("float")
    share = (single(added) / single(current)).cast("float") * visits.cast("float")
    return F.when(current > 0, F.floor(share + F.lit(0.5).cast("float")).cast("long")).otherwise(F.lit(0).cast("long"))


def follow_tags(tags: str | Column, author: str | Column) -> Column:
    """Keys that an event follows: second parts of 'p' tags, without the author, sorted, each once.

    No keys at all if there are more than MAX_TAGS tags."""
    keys = F.transform(F.filter(tags, lambda t: (F.size(t) >= 2) & (t[0] == "p") & (t[1] != author)), lambda t: t[1])
    none = F.array().cast("array<string>")
    return F.when(_col(tags).isNull() | (F.size(tags) > MAX_TAGS), none).otherwise(F.array_sort(F.array_distinct(keys)))


#: The curve's field, and y^2 = x^3 + 7 on it.
FIELD = 2**256 - 2**32 - 977


def on_curve(key: str | None) -> bool:
    """64 lower-case hex digits that are a point's x coordinate."""
    if key is None or len(key) != 64 or not set(key) <= set("0123456789abcdef"):
        return False
    x = int(key, 16)
    return x < FIELD and pow((pow(x, 3, FIELD) + 7) % FIELD, (FIELD - 1) // 2, FIELD) == 1


@F.pandas_udf(T.BooleanType())
def is_valid_pubkey(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for k in keys:
        yield k.map(on_curve).astype(bool)
