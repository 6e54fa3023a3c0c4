"""Filling containers of fixed capacity with items of varying size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.tokens import TOKENIZER, token_counts
from skeinflow.runtime import Scratch, table


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each item: largest first, each into the fullest bin that takes it.

    Bins are kept by their free space in a bit set, so finding the fullest fitting one is a shift.
    """
    where = np.empty(len(sizes), np.int64)
    by_free: dict[int, list[int]] = {}
    free_set, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = free_set >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                free_set ^= 1 << free
        else:
            free, b = capacity, bins
            bins += 1
        where[i] = b
        left = free - size
        if left:
            stack = by_free.setdefault(left, [])
            if not stack:
                free_set |= 1 << left
            stack.append(b)
    return where


def bin_bound(sizes: np.ndarray, capacity: int) -> int:
    """``histogram_bound`` of items given one by one."""
    return histogram_bound(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def histogram_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins below which no packing goes, by dual feasible functions.

    Two families: U(e) counts items above ``capacity - e`` as whole bins and forgets those below
    ``e``; u(k) rounds sizes to multiples of 1 / k. Both are tried at every useful parameter, U for
    all e up to half the capacity, u for k up to 20, also one after the other.
    """
    if not counts.any():
        return 0
    count = counts[: capacity + 1].astype(np.float64)
    x = np.arange(capacity + 1)
    best = 0.0
    for k in range(0, 21):
        if k:
            exact = (x * (k + 1)) % capacity == 0
            value = np.where(exact, x / capacity, np.floor(x * (k + 1) / capacity) / k)
        else:
            value = x / capacity
        many, mass = np.cumsum(count), np.cumsum(count * value)
        e = np.arange(1, capacity // 2 + 1)
        # Items above capacity - e are whole; those from e to capacity - e keep their value.
        whole = many[-1] - many[capacity - e]
        middle = mass[capacity - e] - mass[e - 1]
        best = max(best, float(mass[-1]), float((whole + middle).max()) if len(e) else 0.0)
    return int(np.ceil(best - 1e-6))


_PACKED = "kind string, capacity int, cell long, bin long, doc_id long, part_no long, token_start long, tokens long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs each (kind, cell); rows come sorted by them. The bound rides on every row of a cell."""

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        sizes = t["tokens"].to_numpy()
        capacity = t["capacity"][0].as_py()
        where = best_fit_decreasing(sizes, capacity)
        bins = int(where.max()) + 1
        bound = bin_bound(sizes, capacity)
        n = len(sizes)
        t = t.set_column(t.column_names.index("bin"), "bin", pa.array(where))
        t = t.append_column("bins", pa.array(np.full(n, bins))).append_column("bound", pa.array(np.full(n, bound)))
        return t.combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        kinds, cells = b.column("kind").to_pylist(), b.column("cell").to_pylist()
        start = 0
        for i, key in enumerate(zip(kinds, cells)):
            if key != now:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held and now is not None:
                    yield finish(held)
                held, now, start = [], key, i
        held.append(b.slice(start))
    if held:
        yield finish(held)


def _packed(items: DataFrame) -> DataFrame:
    return items.repartition("kind", "cell").sortWithinPartitions("kind", "cell").mapInArrow(_pack, f"{_PACKED}, bins long, bound long")


#: Rounds without gain after which the exchange stops, certified or not.
PATIENCE = 2


def pack(sized: DataFrame, specs: list[tuple[str, int]], cell_items: int = 20_000, patience: int = PATIENCE) -> DataFrame:
    """The containers of ``pack_certified``, without its report."""
    return pack_certified(sized, specs, cell_items, patience)[0]


def pack_certified(sized: DataFrame, specs: list[tuple[str, int]], cell_items: int = 20_000, patience: int = PATIENCE) -> tuple[DataFrame, DataFrame]:
    """Assign the documents of ``sized(doc_id, tokens)`` to containers of each ``(kind, capacity)``.

    Returns two tables. ``container_kind, container_id, doc_id, part_no, token_start, tokens``: a document
    that alone exceeds the capacity is cut into full containers and a rest; the rest and all other
    documents are items that stay whole. Documents of no tokens, or with a null id or size, need no
    place and have no row; a repeated ``doc_id`` counts once. Other columns are ignored. And
    ``container_kind, cell, bins, bound, certified`` for each cell in which items were packed.

    Items are spread by hash over cells of about ``cell_items`` items (so no source or size makes a
    cell hot), and each cell is packed by best-fit decreasing and certified by a lower bound from
    dual feasible functions. Cells that use more bins than their bound exchange items: their bins
    that have room are opened, the items spread anew over fewer cells, and packed again. The new packing of
    a kind is taken only if it uses fewer bins. This goes on until every cell is certified, or
    ``patience`` rounds have gained nothing; the report says which cells aren't. Sizes and ids move,
    never texts.
    """
    spark = sized.sparkSession
    scratch = Scratch(spark, "packing")
    if not specs or len({k for k, _ in specs}) < len(specs) or any(c < 1 for _, c in specs):
        raise ValueError("container kinds must be distinct and have a capacity of at least 1")
    dims = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in specs])
    sized = sized.where("doc_id IS NOT NULL AND tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    n_docs = sized.count()
    cells = max(1, round(n_docs / cell_items))
    each = sized.withColumn("s", F.explode(dims)).select(F.col("s.kind").alias("kind"), F.col("s.capacity").alias("capacity"), "doc_id", "tokens")
    parts = F.expr("CAST(tokens div capacity AS BIGINT)")
    full = (
        each.where("tokens >= capacity")
        .withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select(
            F.col("kind").alias("container_kind"),
            F.concat_ws("-", "kind", F.lit("full"), "doc_id", "part_no").alias("container_id"),
            "doc_id",
            "part_no",
            (F.col("part_no") * F.col("capacity")).alias("token_start"),
            F.col("capacity").cast("long").alias("tokens"),
        )
    )
    rest = each.where("tokens % capacity > 0").select(
        "kind",
        "capacity",
        F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(cells)).alias("cell"),
        F.lit(0).cast("long").alias("bin"),
        F.col("doc_id").cast("long").alias("doc_id"),
        parts.alias("part_no"),
        (parts * F.col("capacity")).alias("token_start"),
        F.expr("tokens % capacity").alias("tokens"),
    )
    state = scratch.save(_packed(rest))
    settled = state.where(F.lit(False))
    turn, idle = 0, dict.fromkeys((k for k, _ in specs), 0)
    while True:
        turn += 1
        gapped = state.groupBy("kind", "cell").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound")).where("bins > bound")
        gapped = gapped.where(F.col("kind").isin([k for k, n in idle.items() if n < patience]))
        loose = state.groupBy("kind", "cell", "bin").agg(F.sum("tokens").alias("fill"), F.max("capacity").alias("cap")).where("fill < cap").select("kind", "cell", "bin")
        loose = scratch.save(loose.join(gapped.select("kind", "cell"), ["kind", "cell"], "left_semi"))
        opened = {r["kind"]: r["n"] for r in loose.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each kind
        if not opened:
            break
        joined = state.join(loose.withColumn("_open", F.lit(True)), ["kind", "cell", "bin"], "left")
        pool = joined.where("_open").select(*[c.split()[0] for c in _PACKED.split(", ")])
        items = {r["kind"]: r["count"] for r in pool.groupBy("kind").count().collect()}
        spread = F.lit(1)
        for kind, n in items.items():
            # Fewer cells each time: wider exchange, and fewer bins that are last in their cell.
            spread = F.when(F.col("kind") == kind, F.lit(max(1, round(n / (cell_items * min(1 + turn, 4)))))).otherwise(spread)
        again = scratch.save(_packed(pool.withColumn("cell", F.lit(turn * 10**9) + F.pmod(F.xxhash64("doc_id", F.lit(turn)), spread))))
        used = {r["kind"]: r["n"] for r in again.groupBy("kind", "cell").agg(F.max("bins").alias("b")).groupBy("kind").agg(F.sum("b").alias("n")).collect()}
        better = [k for k, n in opened.items() if used[k] < n]
        idle |= {k: 0 if k in better else idle[k] + 1 for k in opened}
        if better:
            taken = F.col("kind").isin(better)
            # What wasn't opened is a certified cell, or a bin without room: nothing better can be done with it.
            settled = settled.unionByName(joined.where(taken & F.col("_open").isNull()).select(state.columns))
            state = state.where(~taken).unionByName(again.where(taken))
    cells_of = state.groupBy("kind", "cell").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    closed = settled.groupBy("kind", "cell").agg(F.countDistinct("bin").alias("bins")).withColumn("bound", F.col("bins"))
    report = cells_of.unionByName(closed).select(F.col("kind").alias("container_kind"), "cell", "bins", "bound", (F.col("bins") <= F.col("bound")).alias("certified"))
    state = state.unionByName(settled)
    packed = state.select(
        F.col("kind").alias("container_kind"),
        F.concat_ws("-", "kind", "cell", "bin").alias("container_id"),
        "doc_id",
        "part_no",
        "token_start",
        "tokens",
    )
    return packed.unionByName(full), report


def containers(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The container kinds: a table of fixed size."""
    return [(r[0], r[1]) for r in table(spark, sf_dir, "container_specs").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind").collect()]


def _sized(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return Scratch(spark, "sizes").save(token_counts(docs, "text", tokenizer=tokenizer))


def p7_containers(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(_sized(spark, sf_dir, tokenizer), containers(spark, sf_dir))


def least_containers(packed: DataFrame, specs: list[tuple[str, int]]) -> dict[str, int]:
    """For each kind the number of containers below which no packing of all its items goes, by dual feasible functions.

    The items' sizes are counted first: at most as many rows as the capacities of the kinds add up to.
    """
    counts = {k: np.zeros(c + 1, np.int64) for k, c in specs}
    for r in packed.groupBy("container_kind", "tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["container_kind"]][r["tokens"]] = r["n"]
    return {k: histogram_bound(counts[k], c) for k, c in specs}


def p7_report(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each kind: containers, the fewest that could do, whether that is reached, the share of space filled, and how many cells are certified."""
    specs = containers(spark, sf_dir)
    packed, cells = pack_certified(_sized(spark, sf_dir, tokenizer), specs)
    packed = Scratch(spark, "packed").save(packed)
    least = spark.createDataFrame([(k, c, n) for (k, c), n in zip(specs, least_containers(packed, specs).values())], "container_kind string, capacity int, least bigint")
    per = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    checked = cells.groupBy("container_kind").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("certified").cast("long")).alias("certified_cells"))
    joined = least.join(per, "container_kind", "left").join(checked, "container_kind", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    filled = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return joined.select("container_kind", none("containers"), "least", (F.coalesce("containers", F.lit(0)) <= F.col("least")).alias("certified"), filled.alias("filled"), none("cells"), none("certified_cells"))


def p7_invariants(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each kind: documents placed, and how many containers overflow, parts repeat, documents have gaps or are cut without need (all none)."""
    specs = containers(spark, sf_dir)
    packed = Scratch(spark, "packed").save(pack(_sized(spark, sf_dir, tokenizer), specs))
    kinds = spark.createDataFrame(specs, "container_kind string, capacity int")
    fills = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("fill")).join(F.broadcast(kinds), "container_kind")
    over = fills.groupBy("container_kind").agg(F.sum((F.col("fill") > F.col("capacity")).cast("long")).alias("overfull"))
    parts = packed.groupBy("container_kind", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part_no").alias("distinct"), F.max("part_no").alias("last"), F.sum("tokens").alias("size"), F.max(F.col("token_start") + F.col("tokens")).alias("reach")).join(F.broadcast(kinds), "container_kind")
    bad = lambda c, n: F.sum(c.cast("long")).alias(n)
    per = parts.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("documents"),
        bad(F.col("n") > F.col("distinct"), "repeated"),
        bad((F.col("last") + 1 != F.col("n")) | (F.col("reach") != F.col("size")), "with_gaps"),
        bad((F.col("n") > 1) & (F.col("size") <= F.col("capacity")), "cut"),
    )
    return kinds.join(per, "container_kind", "left").join(over, "container_kind", "left").select("container_kind", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overfull", "repeated", "with_gaps", "cut")])
