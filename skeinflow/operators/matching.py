"""Joins of texts with names, of references with entities, and of intervals."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.columns import name_key
from skeinflow.operators.sequences import last_before
from skeinflow.operators.skew import hot_keys, lookup_join
from skeinflow.runtime import ship


def _slot(text: str, mask: int) -> int:
    return zlib.crc32(text.encode()) & mask


def name_filter(names: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
    """Two bit sets, of hashes of all names and of their first words; their mask; and the numbers of words that names have.

    Each task sets the bits of its names, and the sets are united: their size is chosen from the
    number of names, at most 2 ** 27 bits (16 MB), whatever the names are. Beyond some ten million
    names they let more through, which the join that follows sorts out.
    """
    bits = min(27, max(16, (16 * names.count() + 1).bit_length()))
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, heads, sizes = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool), set()
        for b in batches:
            for n in b.column(0).to_pylist():
                words = n.split(" ")
                whole[_slot(n, mask)] = heads[_slot(words[0], mask)] = True
                sizes.add(len(words))
        yield pa.record_batch([pa.array([np.packbits(whole).tobytes()], pa.binary()), pa.array([np.packbits(heads).tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["whole", "heads", "sizes"])

    found = [np.zeros((1 << bits) // 8, np.uint8), np.zeros((1 << bits) // 8, np.uint8)]
    sizes: set[int] = set()
    for r in names.select(name).coalesce(16).mapInArrow(run, "whole binary, heads binary, sizes array<int>").toLocalIterator():
        found[0] |= np.frombuffer(r["whole"], np.uint8)
        found[1] |= np.frombuffer(r["heads"], np.uint8)
        sizes |= set(r["sizes"])
    return found[0], found[1], mask, sorted(sizes)


def _found_names(texts: DataFrame, doc: str, text: str, keyed: DataFrame) -> DataFrame:
    """``_doc, _name, _at``: word sequences of the texts that may be names, with the numbers of their first words.

    A bit set of the names' hashes keeps back all others before anything is shuffled; the few that
    pass by chance fall out in the join with the names.
    """
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(name_filter(keyed.select("_name").distinct(), "_name"))
    kind = texts.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, packed_heads, mask, sizes = shared.value
        whole, heads = np.unpackbits(packed).tobytes(), np.unpackbits(packed_heads).tobytes()
        known: dict[str, bool] = {}
        for b in batches:
            rows, found, places = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = re.findall("[a-z0-9]+", t.lower()) if t else []
                here: dict[str, list[int]] = {}
                for at, w in enumerate(words):
                    head = known.get(w)
                    if head is None:
                        if len(known) > 500_000:
                            known.clear()
                        head = known[w] = bool(heads[_slot(w, mask)])
                    if head:
                        for n in sizes:
                            if at + n > len(words):
                                break
                            key = " ".join(words[at : at + n])
                            if whole[_slot(key, mask)]:
                                here.setdefault(key, []).append(at)
                rows += [i] * len(here)
                found += here
                places += here.values()
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["_doc", "_name", "_at"])

    return texts.select(F.col(doc).alias("_doc"), text).mapInArrow(run, f"_doc {kind}, _name string, _at array<int>")


def mentions(texts: DataFrame, doc: str, text: str, names: DataFrame, entity: str, name: str) -> DataFrame:
    """``doc, entity, mentions``: how often each name stands in each text as whole words.

    Texts and names are compared in key form (lower case a-z, 0-9). Instead of testing every name
    against every text, texts are cut into the word sequences of the lengths that names have, which
    meet the names in an equi-join, repeats in a text as one row. Null or empty names and texts give
    no rows. A name of several entities counts for each.
    """
    keyed = names.select(F.col(entity).alias("_entity"), name_key(F.col(name)).alias("_name")).where("_name <> ''").distinct()
    counted = _found_names(texts, doc, text, keyed).select("_doc", "_name", F.size("_at").cast("long").alias("_n"))
    return lookup_join(counted, keyed, "_name", unique=False).groupBy("_doc", "_entity").agg(F.sum("_n").alias("mentions")).select(F.col("_doc").alias(doc), F.col("_entity").alias(entity), "mentions")


def named(texts: DataFrame, doc: str, text: str, names: DataFrame, entity: str, name: str) -> DataFrame:
    """``doc, entity, name``: each name (in key form) that stands in a text as whole words, once; null and empty ones give no rows."""
    keyed = names.select(F.col(entity).alias("_entity"), name_key(F.col(name)).alias("_name")).where("_name <> ''").distinct()
    found = lookup_join(_found_names(texts, doc, text, keyed).select("_doc", "_name"), keyed, "_name", unique=False).distinct()
    return found.select(F.col("_doc").alias(doc), F.col("_entity").alias(entity), F.col("_name").alias("name"))


def pairs_around(texts: DataFrame, doc: str, text: str, names: DataFrame, entity: str, name: str, triggers: Mapping[str, bool]) -> DataFrame:
    """``doc, trigger, source, target``: the nearest names before and after the first of each trigger phrase in a text.

    Before is what ends at the trigger or earlier, the last one to end (then the shorter); after is
    what begins behind it, the first to begin (then the shorter). A trigger that maps to true names the
    later state first: its source is behind it. A name of several entities means the smallest. Texts
    without either, or with one entity on both sides, give no row. What is gathered is one text's mentions.
    """
    own = names.select(F.col(entity).cast("string").alias("_entity"), name_key(F.col(name)).alias("_name")).where("_name <> ''").groupBy("_name").agg(F.min("_entity").alias("_entity"))
    phrases = names.sparkSession.createDataFrame([(t,) for t in triggers], "_name string")
    marked = own.withColumn("_trigger", F.lit(False)).unionByName(phrases.select(F.lit(None).cast("string").alias("_entity"), "_name", F.lit(True).alias("_trigger")))
    found = lookup_join(_found_names(texts, doc, text, marked), marked, "_name", unique=False).select("_doc", "_name", "_entity", "_trigger", F.size(F.split("_name", " ")).alias("_size"), F.explode("_at").alias("_i"))
    first = found.where("_trigger").groupBy("_doc", F.col("_name").alias("trigger")).agg(F.min(F.struct("_i", "_size")).alias("f")).select("_doc", "trigger", F.col("f._i").alias("_from"), (F.col("f._i") + F.col("f._size")).alias("_to"))
    spots = found.where("NOT _trigger").select("_doc", "_entity", F.col("_i").alias("_s"), (F.col("_i") + F.col("_size")).alias("_e"))
    near = first.join(spots, "_doc").groupBy("_doc", "trigger").agg(
        F.max(F.when(F.col("_e") <= F.col("_from"), F.struct("_e", "_s", "_entity")))["_entity"].alias("before"),
        F.min(F.when(F.col("_s") >= F.col("_to"), F.struct("_s", "_e", "_entity")))["_entity"].alias("after"),
    )
    back = F.col("trigger").isin([t for t, turned in triggers.items() if turned])
    rows = near.where("before <> after").select(F.col("_doc").alias(doc), "trigger", F.when(back, F.col("after")).otherwise(F.col("before")).alias("source"), F.when(back, F.col("before")).otherwise(F.col("after")).alias("target"))
    return rows


def first_links(texts: DataFrame, doc: str, text: str, names: DataFrame, entity: str, name: str) -> DataFrame:
    """``doc, entity, word_no, words``: where a text would link to each entity.

    From left to right the longest name at each place is taken, nothing inside it; each entity
    is linked at its first taken mention. A name of several entities means the smallest. ``word_no``
    counts from 0 in key form. What is gathered for the fold is one text's mentions.
    """
    keyed = names.select(F.col(entity).alias("_entity"), name_key(F.col(name)).alias("_name")).where("_name <> ''").groupBy("_name").agg(F.min("_entity").alias("_entity"))
    found = lookup_join(_found_names(texts, doc, text, keyed), keyed, "_name").select("_doc", "_entity", F.size(F.split("_name", " ")).alias("_n"), F.explode("_at").alias("_p"))
    spans = found.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("p"), (-F.col("_n")).alias("m"), F.col("_entity").alias("e")))).alias("_spans"))
    start = F.struct(F.lit(0).alias("upto"), F.filter("_spans", lambda s: F.lit(False)).alias("kept"))
    fold = F.aggregate("_spans", start, lambda acc, s: F.when(s["p"] < acc["upto"], acc).otherwise(F.struct((s["p"] - s["m"]).alias("upto"), F.array_append(acc["kept"], s).alias("kept"))))
    taken = spans.select("_doc", F.explode(fold["kept"]).alias("s"))
    first = taken.groupBy("_doc", F.col("s.e").alias("_entity")).agg(F.min(F.struct("s.p", "s.m")).alias("f"))
    return first.select(F.col("_doc").alias(doc), F.col("_entity").alias(entity), F.col("f.p").cast("long").alias("word_no"), (-F.col("f.m")).cast("long").alias("words"))


def resolve(rows: DataFrame, keys: Sequence[tuple[str, Column]], lookups: Sequence[DataFrame], out: str) -> DataFrame:
    """References resolved by the first of several ways that works.

    Each way is an expression over ``rows`` and a lookup table ``(key, value)`` with one value for a
    key. Adds ``out`` and ``out_by``, the name of the way; both null where none works.
    """
    values: list[Column] = []
    # Hot keys are looked for before the first join, where they cost a scan of one column.
    hot = [hot_keys(rows.select(expr.alias("_k")), "_k") for _, expr in keys]
    for i, ((_, expr), lookup) in enumerate(zip(keys, lookups)):
        table = lookup.where("key IS NOT NULL").select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}"))
        rows = lookup_join(rows.withColumn(f"_k{i}", expr), table, f"_k{i}", "left", hot=hot[i])
        values.append(F.col(f"_v{i}"))
    by = None
    for (label, _), v in zip(keys, values):
        by = F.when(v.isNotNull(), F.lit(label)) if by is None else by.when(v.isNotNull(), F.lit(label))
    rows = rows.withColumn(out, F.coalesce(*values)).withColumn(f"{out}_by", by)
    return rows.drop(*[f"_k{i}" for i in range(len(values))], *[f"_v{i}" for i in range(len(values))])


def unique_prefix(refs: DataFrame, ref: str, known: DataFrame, key: str, least: int = 6) -> DataFrame:
    """``ref, key``: references that are an identifier, or else the beginning of exactly one.

    Prefixes meet identifiers in an equi-join on the lengths that occur, not in a comparison of all pairs.
    """
    asked = refs.select(F.col(ref)).where(F.col(ref).isNotNull()).distinct()
    ids = known.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    exact = asked.join(ids, F.col(ref) == F.col(key))
    rest = asked.join(exact.select(ref), ref, "left_anti").where(F.length(ref) >= least)
    lengths = [r[0] for r in rest.select(F.length(ref)).distinct().collect()]
    if not lengths:
        return exact.select(ref, key)
    cut = ids.withColumn("_p", F.explode(F.array(*[F.substring(F.col(key), 1, n) for n in sorted(lengths)])))
    found = rest.join(cut, F.col(ref) == F.col("_p")).groupBy(ref).agg(F.min(key).alias(key), F.countDistinct(key).alias("_n")).where("_n = 1")
    return exact.select(ref, key).unionByName(found.select(ref, key))


def nearest_interval(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, reach: int) -> DataFrame:
    """Each point with the distance to the nearest span of its key, 0 inside one, null beyond ``reach``.

    Two as-of joins: the largest end of all spans that began by then tells whether the point is
    inside one and how far the last one is behind; the next start tells how far the next one is
    ahead. So it doesn't matter how long a span is or how many overlap. Points with a null key or
    time have a null distance; spans with a null key or bound, or an end before their start, are left out.
    """
    valid = spans.where((F.col(end) >= F.col(start)) & F.col(key).isNotNull())
    begun = valid.select(F.col(key).alias("_key"), F.col(start).alias("_when"), F.col(end).alias("_top"))
    ahead = valid.select(F.col(key).alias("_key"), (-F.col(start)).alias("_when"), F.col(start).alias("_next"))
    rows = points.withColumn("_key", F.col(key)).withColumn("_when", F.col(at))
    rows = last_before(rows, begun, "_key", "_when", "_top", "_top", largest=True)
    rows = last_before(rows.withColumn("_when", -F.col(at)), ahead, "_key", "_when", "_next", "_next")
    distance = F.when(F.col("_top") >= F.col(at), F.lit(0)).otherwise(F.least(F.col(at) - F.col("_top"), F.col("_next") - F.col(at)))
    return rows.select(*points.columns, F.when(distance <= reach, distance).alias("distance"))
