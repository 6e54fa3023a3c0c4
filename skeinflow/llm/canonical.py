"""Records that are equal but for their dress: white space, case, punctuation, field order."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.skew import lookup_join
from skeinflow.runtime import Scratch, table

_NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
_FIELD = re.compile(r"[\W_]*([^\W_]+)[\W_]*?[:=](.*)", re.S)
_PAIR = re.compile(r'\s*"([^"]*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,{}"\[\]]*)\s*(?:,|$)', re.S)
_QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "​": None, "﻿": None, "⁠": None, "\xad": None})
_SPLITS = [re.compile(p) for p in (";", r"\|", r"[\r\n]+", r"[;|\r\n]+", ",")]


def squeeze(text: str) -> bytes:
    """The letters and digits of ``text`` in order, case folded."""
    if text.isascii():
        return text.lower().encode().translate(None, _NOT_ALNUM)
    return "".join(c for c in unicodedata.normalize("NFC", text).casefold() if c.isalnum()).encode()


def _json_fields(text: str) -> list[tuple[str, str]] | None:
    body = text.translate(_QUOTES).strip()
    if not (body.startswith("{") and body.endswith("}")):
        return None
    try:
        pairs = json.loads(body, object_pairs_hook=list)
        if all(not isinstance(v, (list, dict)) for _, v in pairs):
            return [(n, v if isinstance(v, str) else json.dumps(v)) for n, v in pairs]
    except (ValueError, TypeError, RecursionError):
        pass
    inner, at, out = body[1:-1], 0, []
    while at < len(inner.rstrip()):
        m = _PAIR.match(inner, at)
        if m is None:
            return None
        out.append((m[1], m[2]))
        at = m.end()
    return out


def fields(text: str) -> list[tuple[bytes, bytes]] | None:
    """The fields of a text that is nothing but two or more ``name: value`` or ``name=value``; else None."""
    if ":" not in text and "=" not in text:
        return None
    pairs = _json_fields(text)
    if pairs is None:
        for split in _SPLITS:
            parts = [p for p in split.split(text) if any(map(str.isalnum, p))]
            if len(parts) < 2:
                continue
            found = [_FIELD.fullmatch(p) for p in parts]
            if all(found):
                pairs = [(m[1], m[2]) for m in found]
                break
    if pairs is None or len(pairs) < 2 or any(len(n.split()) != 1 for n, _ in pairs):
        return None
    return sorted((squeeze(n), squeeze(v)) for n, v in pairs)


def canonical(text: str | None) -> bytes | None:
    """Bytes that are equal for equal records; None without letter or digit."""
    if not text:
        return None
    found = fields(text)
    if found is not None:
        return b"f" + b"\x1e".join(n + b"\x1f" + v for n, v in found)
    plain = squeeze(text)
    return b"p" + plain if plain else None


#: Bytes that a text counts beside its own, for the nodes it takes.
OVERHEAD = 200
#: Bytes of texts that a task holds while it counts, before and after the shuffle.
HELD_BYTES = 64 << 20


class CountingTrie:
    """Byte strings in steps of ``STEP`` bytes; the node where one ends has its counter and smallest id."""

    STEP = 8

    def __init__(self) -> None:
        self.root: dict = {}
        self.keys = self.bytes = 0

    def add(self, key: bytes, n: int, low: str) -> None:
        node = self.root
        for i in range(0, len(key), self.STEP):
            step = key[i : i + self.STEP]
            child = node.get(step)
            if child is None:
                child = node[step] = {}
            node = child
        end = node.get(None)
        if end is None:
            node[None] = [n, low]
            self.keys += 1
            self.bytes += len(key) + OVERHEAD
        else:
            end[0] += n
            if low < end[1]:
                end[1] = low

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for step, child in node.items():
                if step is None:
                    yield prefix, child[0], child[1]
                else:
                    stack.append((prefix + step, child))


_COUNTED = pa.schema([("canon", pa.binary()), ("n", pa.int64()), ("low", pa.string())])


def _emit(trie: CountingTrie, rows: int = 20_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple[bytes, int, str]] = []
    held = 0
    for end in trie.terminals():
        chunk.append(end)
        held += len(end[0])
        if len(chunk) == rows or held >= size:
            held = 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*chunk), _COUNTED.types)], schema=_COUNTED)
            chunk = []
    if chunk:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*chunk), _COUNTED.types)], schema=_COUNTED)


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "canon"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts within a task before anything is shuffled; emptied when it holds ``HELD_BYTES``."""
    trie = CountingTrie()
    for b in batches:
        for key, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(key, 1, low)
            if trie.bytes >= HELD_BYTES:
                yield from _emit(trie)
                trie = CountingTrie()
    yield from _emit(trie)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie for each bucket; buckets come one after another."""
    trie, now = CountingTrie(), None
    for b in batches:
        for bucket, key, n, low in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now:
                yield from _emit(trie)
                trie, now = CountingTrie(), bucket
            trie.add(key, n, low)
    yield from _emit(trie)


#: Oversized prefixes of one length that are broadcast; more of them meet the texts in a join.
MAX_PREFIXES = 20_000


def _marked(rows: DataFrame, big: DataFrame, many: int, depth: int, flag: str) -> DataFrame:
    """``rows`` with ``flag`` true where their first ``depth`` bytes are one of the ``big`` prefixes and aren't all of them."""
    prefixed = rows.withColumn("_prefix", F.when(F.length("canon") > depth, F.substring("canon", 1, depth)))
    table_ = big.select(F.col("prefix").alias("_prefix"), F.lit(True).alias(flag))
    joined = prefixed.join(F.broadcast(table_), "_prefix", "left") if many <= MAX_PREFIXES else lookup_join(prefixed, table_, "_prefix", "left")
    return joined.drop("_prefix")


def radix_counts(keyed: DataFrame, limit: int = HELD_BYTES // 4) -> DataFrame:
    """``canon, n, low``: each distinct ``canon`` of ``keyed(id, canon)`` with its number of rows and its smallest id.

    Counts are combined within tasks first, so a text with a third of all rows leaves each task as
    one row. The rest is partitioned by radix on the canonical bytes: buckets are the prefixes of
    2 bytes; a bucket of more than ``limit`` bytes is split by 4 bytes, then 8, and so on, until each
    fits or is a single text. Each bucket is counted in a trie of its own, in one task, which holds
    one bucket at a time. Oversized prefixes are broadcast while they are few (they are counted),
    else they meet the texts in a join whose hot keys are split off.
    """
    spark = keyed.sparkSession
    scratch = Scratch(spark, "radix")
    parts = scratch.save(keyed.where("canon IS NOT NULL").select("canon", F.col("id").cast("string").alias("low")).mapInArrow(_combine, "canon binary, n bigint, low string"))
    depth, open_rows = 2, parts
    over: list[tuple[int, DataFrame, int]] = []
    while True:
        sizes = open_rows.where(F.length("canon") > depth).groupBy(F.substring("canon", 1, depth).alias("prefix")).agg(F.sum(F.length("canon") + OVERHEAD).alias("bytes"))
        big = scratch.save(sizes.where(F.col("bytes") > limit).select("prefix"))
        many = big.count()
        if not many:
            break
        over.append((depth, big, many))
        open_rows = _marked(open_rows, big, many, depth, "_o").where("_o").drop("_o")
        depth *= 2
    placed = parts
    bucket = F.substring("canon", 1, depth)
    for i, (d, big, many) in enumerate(over):
        placed = _marked(placed, big, many, d, f"_o{i}")
    for i, (d, _, _) in reversed(list(enumerate(over))):
        bucket = F.when(F.col(f"_o{i}"), bucket).otherwise(F.substring("canon", 1, d))
    # Prefixes of different lengths never collide: a shorter one is a bucket only where it isn't split.
    placed = placed.select(bucket.alias("bucket"), "canon", "n", "low").repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_count_buckets, "canon binary, n bigint, low string")


def claim_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``claim_id, group_claim_id, copies`` for every claim whose text has a letter or digit.

    Claims without (null, empty, only punctuation) are no case and have no row. ``group_claim_id`` is
    the smallest id of the equal claims. Members find their group through a join on the canonical
    bytes, from which texts with more than 1 % of the copies (at most 100) are split off.
    """
    scratch = Scratch(spark, "canonical")
    claims = table(spark, sf_dir, "claims").where(F.col("claim_id").isNotNull()).select(F.col("claim_id").alias("id"), F.col("claim_text").alias("text"))
    keyed = scratch.save(claims.mapInArrow(_canonical_rows, "id string, canon binary").where("canon IS NOT NULL"))
    groups = scratch.save(radix_counts(keyed))
    total = keyed.count()
    hot = [r[0] for r in groups.where(F.col("n") > max(total / 100, 1000)).select("canon").collect()]
    single = groups.where("n = 1").select(F.col("low").alias("claim_id"), F.col("low").alias("group_claim_id"), F.col("n").alias("copies"))
    members = lookup_join(keyed, groups.where("n > 1"), "canon", hot=hot).select(F.col("id").alias("claim_id"), F.col("low").alias("group_claim_id"), F.col("n").alias("copies"))
    return members.unionByName(single)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_copies(spark, sf_dir).where("copies > 1").select("group_claim_id", "claim_id")


def p3_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct claim once, with its number of copies."""
    return claim_copies(spark, sf_dir).where("claim_id = group_claim_id").select("claim_id", "copies")
