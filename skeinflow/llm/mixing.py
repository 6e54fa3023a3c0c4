"""Mixtures of sources with target shares of the total size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.tokens import TOKENIZER, token_counts
from skeinflow.runtime import Scratch, table


def capped_rate(lam: float, cap: int) -> float:
    """The mean of min(N, cap) for a Poisson N of mean ``lam``."""
    return sum(1 - c for c in poisson_steps(lam, cap))


def poisson_steps(lam: float, cap: int) -> list[float]:
    """P(N <= j) for j from 0 to ``cap`` - 1: a document of hash u is used once for each step below u."""
    p = math.exp(-lam)
    out, total = [], 0.0
    for j in range(cap):
        total += p
        out.append(min(total, 1.0))
        p *= lam / (j + 1)
    return out


def solve_rate(rate: float, cap: int) -> float:
    """The Poisson mean whose capped mean is ``rate``, by bisection."""
    lo, hi = 0.0, 1.0
    while capped_rate(hi, cap) < rate and hi < 700:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_rate(mid, cap) < rate else (lo, mid)
    return (lo + hi) / 2


def _uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from a hash of the columns: the same for the same row in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))


def _by_source(values: dict[str, list[float]]) -> Column:
    """A literal map from source to an array; one entry for each target row."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(float(t)) for t in v]))])


def _times(steps: Column, u: Column) -> Column:
    return F.size(F.filter(steps, lambda s: u > s)).cast("long")


def plan_rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[str, float]]:
    """The total size of the mixture and each source's mean number of uses.

    Shares are scaled to 1 over the sources that have documents. Without ``total`` it is the
    largest at which no source needs more than its cap. With a larger one the sources that would
    exceed their caps are used to the cap and the shares fall short, which the report shows.
    """
    have = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in have.values())
    if not have:
        return 0.0, {}
    most = min(t[1] * sizes[s] * whole / t[0] for s, t in have.items())
    total = most if total is None else total
    return total, {s: min(total * t[0] / whole / sizes[s], float(t[1])) for s, t in have.items()}


#: Drawn and wanted tokens of a source may differ by this share; tuning goes on until they do or no mean comes nearer.
TOLERANCE = 0.001


def tuned_steps(sized: DataFrame, rates: dict[str, float], sizes: dict[str, int], caps: dict[str, int], u: Column, documents: dict[str, int], grid: int = 12, tolerance: float = TOLERANCE) -> dict[str, list[float]]:
    """For each source the steps of the Poisson mean whose drawn tokens come nearest to ``rates * sizes``.

    What is drawn is monotone in the mean. Every pass is one aggregation over ids and sizes that
    tries ``grid`` means for each source still open and keeps the interval around its goal. A source
    is done within ``tolerance``, or when its interval is a thousandth of the mean distance of its
    documents' hashes, so that no mean inside it draws anything else; intervals shrink ``grid``-fold.
    """
    best: dict[str, float] = {}
    low, high, error = {}, {}, {}
    for s, r in rates.items():
        if r >= caps[s] * (1 - 1e-9):
            best[s] = 60.0 + caps[s]  # every document as often as it may be
        else:
            low[s], high[s], error[s] = 0.0, 2 * solve_rate(r, caps[s]) + 1e-9, math.inf
    open_sources = set(low)
    while open_sources:
        tries = {s: [low[s] + (high[s] - low[s]) * (i + 1) / grid for i in range(grid)] for s in open_sources}
        sums = []
        for i in range(grid):
            steps = _by_source({s: poisson_steps(tries[s][i], caps[s]) for s in open_sources})[F.col("source")]
            sums.append(F.sum(F.col("tokens") * _times(steps, u)).alias(f"t{i}"))
        drawn = {r["source"]: [r[f"t{i}"] or 0 for i in range(grid)] for r in sized.where(F.col("source").isin(sorted(open_sources))).groupBy("source").agg(*sums).collect()}
        for s in sorted(open_sources):
            goal = rates[s] * sizes[s]
            near = min(range(grid), key=lambda i: abs(drawn[s][i] - goal))
            if abs(drawn[s][near] - goal) < error[s]:
                best[s], error[s] = tries[s][near], abs(drawn[s][near] - goal)
            below = [i for i in range(grid) if drawn[s][i] <= goal]
            k = below[-1] if below else -1
            low[s], high[s] = (tries[s][k] if k >= 0 else low[s]), tries[s][min(k + 1, grid - 1)]
            if error[s] <= tolerance * goal or high[s] - low[s] <= max(1e-3 / documents[s], 1e-13) * high[s]:
                open_sources.discard(s)
    return {s: poisson_steps(best[s], caps[s]) for s in rates}


def mixture(sized: DataFrame, targets: dict[str, tuple[float, int]], seed: int = 17, total: float | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, source, copy_no, tokens, shuffle_key`` in a global random order.

    ``sized`` has ``doc_id, source, tokens`` (other columns stay out); ``targets`` maps a source to
    its share of all tokens and the most uses of one document. ``total`` is the size wanted, in
    tokens; without it the mixture is the largest whose shares can be met. A document is used as
    often as the inverse of a Poisson distribution function at its hashed number says, capped. That
    is monotone in the Poisson mean, so each source's mean, first solved from its target rate, is
    then tuned until the tokens really drawn meet the target (``tuned_steps``). Sources without
    target, with a null source or of no share are left out, as are documents of no tokens; a
    repeated ``doc_id`` counts once; sources without documents can't contribute. Copies are shuffled
    by a hash of document and copy. Nothing is collected but a few numbers for each target source.
    """
    sized = sized.where("tokens > 0 AND doc_id IS NOT NULL").where(F.col("source").isin(list(targets)))
    sized = Scratch(sized.sparkSession, "mixture").save(sized.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")))
    found = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # a row for each target
    sizes, documents = {r["source"]: int(r["t"]) for r in found}, {r["source"]: r["n"] for r in found}
    total, rates = plan_rates(sizes, targets, total)
    u = _uniform(seed, "doc_id")
    if not rates:
        chosen = sized.where(F.lit(False)).withColumn("times", F.lit(0).cast("long"))
    else:
        steps = _by_source(tuned_steps(sized, rates, sizes, {s: targets[s][1] for s in rates}, u, documents, tolerance=tolerance))[F.col("source")]
        chosen = sized.where(F.col("source").isin(list(rates))).withColumn("times", _times(steps, u)).where("times > 0")
    copies = chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy_no"))
    return copies.withColumn("shuffle_key", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))).orderBy("shuffle_key", "doc_id", "copy_no")


def mix_targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    """The targets: a table of fixed size. Rows without source or share count nothing."""
    rows = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").collect()
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows}


def _sized(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return Scratch(spark, "mix").save(token_counts(docs, "text", tokenizer=tokenizer))


def p8_mixture(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER, total: float | None = None) -> DataFrame:
    """The mixture of ``total`` tokens; without it the largest in which every source has its share."""
    return mixture(_sized(spark, sf_dir, tokenizer), mix_targets(spark, sf_dir), total=total)


def _shares(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float | None) -> DataFrame:
    spark = sized.sparkSession
    mixed = mixture(sized, targets, total=total).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("copy_no").alias("most_uses"))
    stock = sized.where("tokens > 0 AND doc_id IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("stock"))
    wanted = spark.createDataFrame([(s, t[0], t[1]) for s, t in targets.items()], "source string, target_share double, max_repeats int")
    joined = Scratch(spark, "shares").save(wanted.join(mixed, "source", "left").join(stock, "source", "left"))
    whole = joined.agg(F.sum("tokens"), F.sum(F.when(F.col("stock") > 0, F.col("target_share")))).collect()[0]  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reached, share = zero("tokens") / F.lit(whole[0] or 1), F.when(zero("stock") > 0, F.col("target_share") / F.lit(whole[1] or 1.0)).otherwise(F.lit(0.0))
    return joined.select(
        "source", "target_share", share.alias("possible_share"), reached.alias("reached_share"), zero("tokens").cast("long").alias("tokens"), zero("stock").cast("long").alias("stock"), "max_repeats", zero("most_uses").cast("long").alias("most_uses"),
        (zero("tokens") >= zero("stock") * F.col("max_repeats")).alias("used_up"), (F.abs(reached - share) <= 0.01 * share).alias("met"),
    )


def p8_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER, total: float | None = None) -> DataFrame:
    """Target and reached share of every target source; the share possible among sources that have documents; whether a source is used up and whether its share is met within 1 %."""
    return _shares(_sized(spark, sf_dir, tokenizer), mix_targets(spark, sf_dir), total)


def p8_corpus_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The same for a mixture as large as the corpus: small sources are used up to their caps and fall short, which shows."""
    sized = _sized(spark, sf_dir, tokenizer)
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).collect()[0][0]  # one number
    return _shares(sized, mix_targets(spark, sf_dir), float(total))


def p8_invariants(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each target source: its largest allowed use, and how many documents are used too often, counted twice or of another source (all none)."""
    mixed = Scratch(spark, "mixed").save(p8_mixture(spark, sf_dir, tokenizer))
    targets = mix_targets(spark, sf_dir)
    wanted = spark.createDataFrame([(s, t[1]) for s, t in targets.items()], "source string, max_repeats int")
    uses = mixed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("copy_no").alias("copies"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own")).distinct()
    seen = uses.join(own, "doc_id", "left").join(F.broadcast(wanted), "source", "left")
    bad = lambda c, n: F.sum(F.coalesce(c, F.lit(True)).cast("long")).alias(n)
    per = seen.groupBy("source").agg(bad(F.col("uses") > F.col("max_repeats"), "too_often"), bad(F.col("uses") > F.col("copies"), "counted_twice"), bad(F.col("own") != F.col("source"), "of_another"))
    return wanted.join(per, "source", "left").select("source", "max_repeats", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("too_often", "counted_twice", "of_another")])
