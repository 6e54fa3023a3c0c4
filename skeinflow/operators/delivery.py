"""Exactly one row for each message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.runtime import Scratch


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(field: T.StructField) -> Column:
    """A column that can be hashed: types that hold maps as JSON."""
    return F.to_json(_quoted(field.name)) if "map<" in field.dataType.simpleString() else _quoted(field.name)


#: Identities delivered more than once are broadcast up to this many bytes; beyond it rows are shuffled once instead.
BROADCAST_BYTES = 32 << 20


def _complete(identity: dict[str, Column]) -> Column:
    known = F.lit(True)
    for expr in identity.values():
        known = known & expr.isNotNull()
    return known


def _row_hash(rows: DataFrame) -> Column:
    return F.xxhash64(*[_hashable(f) for f in rows.schema.fields])


def _rank(rows: DataFrame, delivered: Column, ties: Sequence[Column]) -> Column:
    return F.struct(delivered.isNull().alias("late"), delivered.alias("at"), *[t.alias(f"t{i}") for i, t in enumerate(ties)], _row_hash(rows).alias("h"))


def delivery_counts(rows: DataFrame, identity: dict[str, Column], delivered: Column, ties: Sequence[Column]) -> DataFrame:
    """The identity columns, ``kept`` and ``copies``: how often each identity was delivered, and the hash of its row to keep.

    ``kept`` is ``min_by`` over the struct (``delivered`` is null, ``delivered``, ``ties``..., hash of the
    row), combined within tasks before the shuffle: of a message delivered millions of times each task
    passes on one hash, a rank and a count, never a row's content. The result is written to the
    shared folder, as it is read more than once. Identities with a null have no row here.
    """
    by = [e.alias(k) for k, e in identity.items()]
    found = rows.where(_complete(identity)).groupBy(*by).agg(F.min_by(_row_hash(rows), _rank(rows, delivered, ties)).alias("kept"), F.count(F.lit(1)).alias("copies"))
    return Scratch(rows.sparkSession, "deliveries").save(found)


def first_delivery(rows: DataFrame, identity: dict[str, Column], delivered: Column, ties: Sequence[Column], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Keep the earliest delivered row of each identity, and the number of its deliveries.

    ``identity`` maps output names to expressions that together identify a message. The row to keep
    is the one of the smallest rank (see ``delivery_counts``), so it doesn't depend on the order in
    which rows arrive, and equal rows are interchangeable. Content is only shuffled for identities
    delivered more than once: these are found first, and as long as they are few (their size is
    measured) rows meet them in a broadcast join and all others pass straight through. When they
    are many, all rows are reduced in one shuffle by the same rank. Both ways give the same rows.

    Returns the identity columns (in place of columns of the same name), all other columns of
    ``rows``, and ``copies``. A row with a null in its identity can't be told to be a copy of another
    one: it is kept as it is with ``copies`` 1. An empty table gives no rows.
    """
    payload = [c for c in rows.columns if c not in identity and c != "copies"]
    keys = list(identity)
    by = [e.alias(k) for k, e in identity.items()]
    complete = _complete(identity)
    unknown = rows.where(~complete).select(*by, *[_quoted(c) for c in payload], F.lit(1).cast("long").alias("copies"))
    counts = delivery_counts(rows, identity, delivered, ties)
    repeated = counts.where("copies > 1")
    size = F.lit(32)
    for k in keys:
        size = size + F.length(_quoted(k).cast("string"))
    weight = repeated.agg(F.coalesce(F.sum(size), F.lit(0))).collect()[0][0]  # one number
    own = [f"__id{i}" for i in range(len(keys))]
    content = F.struct(F.lit(0).alias("__none"), *[_quoted(c) for c in payload])
    keyed = rows.where(complete).select(*[e.alias(o) for e, o in zip(identity.values(), own)], content.alias("__row"), _row_hash(rows).alias("__h"), _rank(rows, delivered, ties).alias("__rank"))
    out = [*[F.col(o).alias(k) for o, k in zip(own, keys)], *[F.col("__row").getField(c).alias(c) for c in payload]]
    if weight > broadcast_bytes:
        best = keyed.groupBy(*own).agg(F.min_by("__row", "__rank").alias("__row"), F.count(F.lit(1)).alias("copies"))
        return best.select(*out, "copies").unionByName(unknown)
    known = F.broadcast(repeated.select(*[_quoted(k).alias(o) for o, k in zip(own, keys)], F.col("kept").alias("__kept"), "copies"))
    single = keyed.join(known.select(*own), own, "left_anti").select(*out, F.lit(1).cast("long").alias("copies"))
    many = keyed.join(known, own).where("__h = __kept").groupBy(*own, "copies").agg(F.first("__row").alias("__row"))
    return single.unionByName(many.select(*out, "copies")).unionByName(unknown)
