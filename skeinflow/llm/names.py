"""Variant spellings of one name, by noisy-channel attribution."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.groups import seed_tree_components
from skeinflow.operators.skew import lookup_join
from skeinflow.runtime import Scratch, table

# Forms of address, and words that carry no name.
TITLES = frozenset("captain capt cpt doctor dr professor prof sergeant sgt lieutenant lt commander cmdr lady ldy lord ld sir dame brother br sister sr father fr mother mr mrs ms miss master".split())
FILLERS = frozenset("the of and de von van".split())
PLACEHOLDERS = frozenset("unknown none null nil na n/a tbd tba anonymous unnamed noname test todo missing nobody someone".split())

#: A word is context (a given name, a kind of organisation or place) if at least LEAST + CONTEXT_SHARE * entities have it.
CONTEXT_SHARE, LEAST = 0.001, 2.8
#: A variant of a context word is learned if it is seen twice and in this share of the word's aliases: at most 1 / LEARNED_SHARE a word.
LEARNED_SHARE = 0.002
#: A word that stands in aliases for this many different context words, none of them with more than this share, is a title.
TITLE_MEANINGS, TITLE_TOP = 6, 0.3
#: Log-likelihood of one edit, of a nickname or abbreviation, of an initial, and of leaving the context out.
EDIT, SHORT, INITIAL, BARE = -4.0, -0.7, -1.5, -2.0
#: A variant is attached where its best canonical form has at least this posterior.
SURE = 0.6
#: Times a record of the curated table counts in a spelling's frequency.
CURATED = 3


class Parsed(NamedTuple):
    """``words`` in order, ``dotted``: those written with a full stop, ``letters``: single letters."""

    words: tuple[str, ...]
    dotted: frozenset
    letters: tuple[str, ...]


def parse(name: str | None) -> Parsed:
    """The words of a name: case, accents, quotes and joining signs away, parts after a comma first, titles and fillers out."""
    text = unicodedata.normalize("NFKC", name or "").replace("\u200b", "")
    text = re.sub(r"\([^()]*\)", " ", text)
    if " " not in text.strip():
        text = re.sub(r"([^\W\d_A-Z])([A-ZÀ-Þ])", r"\1 \2", text)
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = re.sub(r"['’`´]", "", text)
    if text.count(",") == 1:
        last, first = text.split(",")
        text = f"{first} {last}"
    words, dotted, letters = [], set(), []
    for m in re.finditer(r"([^\W_]+)(\.?)", text):
        w = m[1]
        if w in TITLES or (w in FILLERS and not m[2]) or w in PLACEHOLDERS:
            continue
        if len(w) == 1:
            letters.append(w)
        else:
            words.append(w)
            if m[2]:
                dotted.add(w)
    return Parsed(tuple(words), frozenset(dotted), tuple(letters))


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between ``a`` and ``b``; ``most`` + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(size: int) -> int:
    """Edits allowed in a word of ``size`` letters."""
    return 0 if size < 4 else 1 if size < 7 else 2


def abbreviates(short: str, word: str) -> bool:
    """``short`` has the first letter of ``word`` and others of it in order."""
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


class Context:
    """What the context words of all names are, and how people vary them: the channel's dictionary.

    ``words`` maps a context word to the number of entities with it; ``learned`` maps a variant to the
    context words it stood for in aliases of the same family or place name, with counts; ``titles``
    are words that stand for any context word, so that they say nothing. A word meets the context
    words through shared deletions or its first letter, not one by one.
    """

    MEMO = 200_000

    def __init__(self, words: dict[str, int], learned: dict[str, dict[str, int]], titles: frozenset = frozenset()) -> None:
        self.words, self.learned, self.titles = words, learned, titles
        self.memo: dict[tuple[str, bool], dict[str, float] | None] = {}
        self.initial: dict[str, list[str]] = {}
        self.parts: dict[str, list[str]] = {}
        for w in words:
            self.initial.setdefault(w[0], []).append(w)
            if len(w) >= 4:
                for part in deletions(w):
                    self.parts.setdefault(part, []).append(w)

    def meanings(self, word: str, dotted: bool) -> dict[str, float] | None:
        """The context words ``word`` may stand for, with log-likelihoods; None if it is none of them."""
        key = (word, dotted)
        if key not in self.memo:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[key] = self._meanings(word, dotted)
        return self.memo[key]

    def _meanings(self, word: str, dotted: bool) -> dict[str, float] | None:
        if word in self.words:
            return {word: 0.0}
        known = self.learned.get(word)
        if known:
            total = sum(known.values())
            out = {w: SHORT + math.log(n / total) for w, n in known.items() if n / total >= 0.1}
            if out:
                return out
        if dotted or len(word) <= 5:
            out = {w: SHORT * 2 for w in self.initial.get(word[0], ()) if abbreviates(word, w) and (len(word) <= 4 or word == w[: len(word)])}
            if out:
                return out
        most = allowed(len(word)) if len(word) < 8 else 2
        best: dict[str, float] = {}
        # Words of seven letters have two deletions in the index but may take one: look as far as the other side may.
        for w in {w for part in deletions(word, most) for w in self.parts.get(part, ())}:
            d = edits(word, w, most)
            if d <= min(most, allowed(len(w))):
                best[w] = EDIT / 2 * d
        if best:
            top = max(best.values())
            return {w: v for w, v in best.items() if v == top}
        return None


class Form(NamedTuple):
    """A spelling's parts: ``root`` (what is left of context words), and what its context may mean.

    ``context`` has one entry for each context word: ``word=log-likelihood`` joined by ``|``, ``*``
    in front of a single letter.
    """

    root: str
    context: str
    full: str | None


def form(name: str | None, ctx: Context) -> Form | None:
    """The form of a name, or None if it is missing, a placeholder or nothing but context words.

    A rest of less than four letters is a root only beside context words ("Anna Lee"); such roots allow no edits.
    """
    p = parse(name)
    words = [w for w in p.words if w not in ctx.titles] if len(p.words) > 1 else list(p.words)
    if len(words) == 1 and words[0] not in ctx.words:
        # Two parts written as one, without capitals.
        w = words[0]
        for v in ctx.words:
            if len(v) >= 4 and len(w) - len(v) >= 5 and (w.startswith(v) or w.endswith(v)):
                words = [v, w[len(v) :]] if w.startswith(v) else [w[: -len(v)], v]
                break
    means = [ctx.meanings(w, w in p.dotted) for w in words]
    rest = [w for w, m in zip(words, means) if m is None]
    if not rest:
        return None
    if len(rest) == 1 and len(rest[0]) < 4 and len(words) == 1:
        return None
    if len(rest) > 1:
        # Not a name of the usual build (an epithet, say): compared as a whole.
        return Form(" ".join(words), "", "")
    found = [m for m in means if m is not None]
    letters = [] if found else list(p.letters[:1])
    sure = all(len(m) == 1 for m in found) and not letters
    parts = sorted({"|".join(f"{w}={v:.2f}" for w, v in sorted(m.items())) for m in found} | {f"*{c}" for c in letters})
    if sure and found:
        # One meaning only: all spellings of it are one form.
        words = sorted({next(iter(m)) for m in found})
        return Form(rest[0], ";".join(f"{w}=0" for w in words), " ".join(words))
    return Form(rest[0], ";".join(parts), None)


def fits(context: str, full: str) -> float | None:
    """The log-likelihood of writing ``full``'s context words as ``context``; None if they contradict."""
    words = full.split(" ") if full else []
    if not context:
        return BARE if words else 0.0
    total, used = 0.0, set()
    for part in context.split(";"):
        if part[0] == "*":
            if not any(w[0] == part[1] for w in words):
                return None
            total += INITIAL
            continue
        options = dict(o.split("=") for o in part.split("|"))
        hits = [(float(options[w]), w) for w in words if w in options]
        if not hits:
            return None
        value, w = max(hits)
        total += value
        used.add(w)
    # Context words left out, as "X Trading" for "X Trading Company".
    return total + 0.5 * BARE * (len(words) - len(used)) * (part[0] != "*")


def deletions(root: str, most: int | None = None) -> set[str]:
    """What is left of ``root`` without up to ``most`` letters (as many as edits are allowed in it): near words share one of these."""
    out = {root}
    layer = {root}
    for _ in range(allowed(len(root)) if most is None else most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def word_deletions(root: str) -> set[str]:
    """``deletions`` of a root, within its words: a part that loses a whole word or a blank says nothing about spelling."""
    words = root.split(" ")
    if len(words) == 1:
        return deletions(root)
    cut = [[deletions(w, 0), deletions(w, min(1, len(w) - 1)) - {w}, (deletions(w, min(2, len(w) - 1)) - deletions(w, 1)) - {w}] for w in words]
    out = {root}
    for i, w in enumerate(words):
        for c in cut[i][1] | cut[i][2]:
            out.add(" ".join([*words[:i], c, *words[i + 1 :]]))
        for k in range(i + 1, len(words)):
            for c in cut[i][1]:
                for d in cut[k][1]:
                    out.add(" ".join([*words[:i], c, *words[i + 1 : k], d, *words[k + 1 :]]))
    return out


#: Log-likelihood that a spelling near another one is a name of its own.
ALONE = -9.0


def likelihood(x: dict, y: dict) -> float | None:
    """The log of prior times likelihood that form ``x`` was written for the canonical form ``y``; None where it can't have been.

    Both have ``key, root, context, full, freq, records``. A full form (one context) competes with
    being a name of its own; every one of its records would have to be the same typo. It is only
    attached to a more frequent form of the same context.
    """
    d = edits(x["root"], y["root"]) if x["root"] != y["root"] else 0
    if d > min(allowed(len(x["root"])), allowed(len(y["root"]))):
        return None
    if x["full"] is not None:
        if (d == 0 and " " not in x["root"]) or (x["full"] == "") != (y["full"] == "") or (y["freq"], y["key"]) < (x["freq"], x["key"]):
            return None
    value = fits(x["context"], y["full"]) if x["full"] != "" else 0.0
    return None if value is None else max(x["records"], 1) * EDIT * d + value + math.log(y["freq"])


def decided(key: Column, full: Column, freq: Column, best: Column, target: Column, mass: Column) -> Column:
    """Where a form goes: its own key if being a name of its own is likelier, the best option if it is sure enough, else null."""
    own = F.when(full.isNotNull(), F.lit(ALONE) + F.log(F.greatest(freq, F.lit(1)))).otherwise(F.lit(ALONE - 3))
    share = F.exp(best) / (mass + F.exp(own))
    return F.when(best.isNull() | (own >= best), key).when(share >= SURE, target).otherwise(F.when(full.isNotNull(), key))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record, kind, name``: canonical names (``s``) and aliases (``a``) of the curated table, candidates (``c``)."""
    seeds = table(spark, sf_dir, "entity_seed").where(F.col("entity_id").isNotNull()).select("entity_id", "canonical_name", "aliases").distinct()
    candidates = table(spark, sf_dir, "entity_candidates").where(F.col("candidate_id").isNotNull()).select("candidate_id", "candidate_name").distinct()
    return (
        seeds.select(F.col("entity_id").alias("record"), F.lit("s").alias("kind"), F.col("canonical_name").alias("name"))
        .unionByName(seeds.select(F.col("entity_id").alias("record"), F.lit("a").alias("kind"), F.explode("aliases").alias("name")))
        .unionByName(candidates.select(F.col("candidate_id").alias("record"), F.lit("c").alias("kind"), F.col("candidate_name").alias("name")))
        .where(F.col("name").isNotNull())
        .distinct()
    )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([*b.columns[:-1], pa.array([list(parse(n).words) for n in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names[:-1], "words"])


def learn_context(names: DataFrame, scratch: Scratch) -> Context:
    """Context words, their variants and titles, counted over the whole curated table.

    At most 1 / ``CONTEXT_SHARE`` words for each word of a name can have the share that makes a
    context word, and at most 1 / ``LEARNED_SHARE`` variants of each can have theirs, so the
    dictionary is small however large the table.
    """
    words = scratch.save(names.where("kind <> 'c'").select("record", "kind", "name").mapInArrow(_parsed, "record string, kind string, words array<string>"))
    main = words.where("kind = 's'")
    n = main.select("record").distinct().count()
    counted = main.select("record", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST + CONTEXT_SHARE * n)
    context = {r["word"]: r["n"] for r in counted.collect()}
    if not context:
        return Context({}, {})
    known = F.array(*[F.lit(w) for w in sorted(context)])
    owner = main.select("record", F.array_intersect("words", known).alias("kinds"), F.array_except("words", known).alias("root")).where("size(root) = 1 AND size(kinds) > 0")
    alias = words.where("kind = 'a'").select("record", F.col("words").alias("alias"))
    pairs = owner.join(alias, "record").where(F.array_contains("alias", F.col("root")[0]))
    pairs = pairs.select(F.array_except(F.array_except("alias", "root"), "kinds").alias("extra"), F.array_except("kinds", "alias").alias("missing")).where("size(extra) = 1 AND size(missing) > 0")
    seen = scratch.save(pairs.select(F.col("extra")[0].alias("a"), F.explode("missing").alias("w")).groupBy("a", "w").agg(F.count(F.lit(1)).alias("n")).where(~F.col("a").isin(sorted(context))))
    of_word = seen.groupBy("w").agg(F.sum("n").alias("all"))
    # A title stands for many context words, for none of them mostly: it has far more meanings than a nickname.
    spread = seen.groupBy("a").agg(F.count(F.lit(1)).alias("meanings"), (F.max("n") / F.sum("n")).alias("top"), F.sum("n").alias("uses"))
    whole = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]  # one number
    titles = frozenset(r["a"] for r in spread.where((F.col("meanings") >= TITLE_MEANINGS) & (F.col("top") <= TITLE_TOP) & (F.col("uses") >= LEARNED_SHARE * whole)).collect())
    learned: dict[str, dict[str, int]] = {}
    for r in seen.join(of_word, "w").where((F.col("n") >= 2) & (F.col("n") >= LEARNED_SHARE * F.col("all"))).select("a", "w", "n").collect():
        if r["a"] not in titles:
            learned.setdefault(r["a"], {})[r["w"]] = r["n"]
    return Context(context, learned, titles)


#: Roots of one deletion part that are compared in one task; parts of more are cut into blocks.
PART_BLOCK = 500
#: Parts of more than three roots that are broadcast (16 bytes each); more of them meet the parts in a shuffle.
MANY_PARTS = 500_000


def _near_roots(roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``root, other``: different roots that may be spellings of each other: they share a deletion.

    What is shuffled is two 64-bit hashes for each deletion. Two roots of one hash would only be
    compared once too often, as every pair is checked by its edits. A part of many roots is cut into
    blocks, and each pair of blocks is a join key of its own.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, keys = [], []
            for root in b.column(0).to_pylist():
                found = word_deletions(root)
                own = xxhash.xxh64_intdigest(root) - (1 << 63)
                held += [own] * len(found)
                keys += [xxhash.xxh64_intdigest(part) - (1 << 63) for part in found]
                if len(keys) > 200_000:
                    yield pa.record_batch([pa.array(held, pa.int64()), pa.array(keys, pa.int64())], names=["id", "part"])
                    held, keys = [], []
            yield pa.record_batch([pa.array(held, pa.int64()), pa.array(keys, pa.int64())], names=["id", "part"])

    # Each root becomes dozens of rows, so small inputs are spread over all cores first.
    spread = roots.repartition(max(roots.sparkSession.sparkContext.defaultParallelism, roots.count() // 20_000), "root")
    parts = spread.mapInArrow(expand, "id bigint, part bigint")
    # A part belongs to a few roots; those of one root alone are most of them and fall away in the aggregate.
    # With their smallest, their largest and the exclusive or of all, up to three roots are known without a list of them.
    known = [F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("all"), F.count(F.lit(1)).alias("n")]
    bounds = scratch.save(parts.groupBy("part").agg(*known).where("n > 1"))
    middle = F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    pairs = bounds.where("n <= 3").select(F.col("low").alias("a"), F.col("high").alias("b"))
    three = bounds.where("n = 3").select("low", middle.alias("mid"), "high")
    pairs = pairs.unionByName(three.select(F.col("low").alias("a"), F.col("mid").alias("b"))).unionByName(three.select(F.col("mid").alias("a"), F.col("high").alias("b")))
    many = bounds.where("n > 3").select("part", F.ceil(F.col("n") / PART_BLOCK).cast("int").alias("blocks"))
    if many.count() <= MANY_PARTS:
        met = parts.join(F.broadcast(many), "part")
    else:
        met = lookup_join(parts, many, "part")
    held = scratch.save(met.select("part", "id", "blocks", F.pmod(F.hash("id"), F.col("blocks")).alias("mine")))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = held.select("part", F.col("id").alias("a"), "mine", all_blocks.alias("theirs"))
    right = held.select("part", F.col("id").alias("b"), F.col("mine").alias("theirs"), all_blocks.alias("mine"))
    pairs = pairs.unionByName(left.join(right, ["part", "mine", "theirs"]).where("a < b").select("a", "b")).distinct()
    pairs = scratch.save(pairs.where("a <> b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = scratch.save(roots.select("root").mapInArrow(_with_ids, "root string, id bigint"))
    return both.join(named.select(F.col("id").alias("a"), "root"), "a").join(named.select(F.col("id").alias("b"), F.col("root").alias("other")), "b").select("root", "other")


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([xxhash.xxh64_intdigest(r) - (1 << 63) for r in b.column(0).to_pylist()], pa.int64())], names=["root", "id"])


def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record, group_key``: records whose names are spellings of one name have one group key.

    Names are reduced to forms: a root (family or place name) and what their context words (given
    name, kind of organisation) may mean, by a dictionary learned from all aliases: frequent words
    are context words; what stands in their place in aliases of the same root are nicknames and
    abbreviations. The frequent forms are the candidates for what was meant. Each form goes to the
    candidate of the largest posterior: its frequency times the likelihood of the edits between the
    roots, of the nickname, initial or omission. Roots meet through shared deletions, never through
    all pairs. A form that could mean several names about equally goes to none.

    An alias of one curated entity alone belongs to it whatever it looks like (an epithet, say); one
    that several entities share says nothing. Missing names, placeholders and names of nothing but
    context words have no row. Extra columns are ignored; empty tables give no rows.
    """
    scratch = Scratch(spark, "names")
    names = scratch.save(_entities(spark, sf_dir))
    channel = spark.sparkContext.broadcast(learn_context(names, scratch))

    def to_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [form(n, channel.value) for n in b.column(2).to_pylist()]
            cols = [pa.array([None if f is None else getattr(f, c) for f in found], pa.string()) for c in ("root", "context", "full")]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=["record", "kind", "root", "context", "full"])

    used = scratch.save(
        names.select("record", "kind", "name").mapInArrow(to_forms, "record string, kind string, root string, context string, full string").where("root IS NOT NULL").withColumn("key", F.concat_ws("#", "root", "context")).distinct()
    )
    forms = scratch.save(
        used.groupBy("key").agg(
            F.first("root").alias("root"),
            F.first("context").alias("context"),
            F.first("full").alias("full"),
            F.sum(F.when(F.col("kind") == "s", CURATED).when(F.col("kind") == "c", 1).otherwise(0)).cast("long").alias("freq"),
            F.sum((F.col("kind") != "a").cast("long")).alias("records"),
        )
    )
    canonical = forms.where("full IS NOT NULL AND freq > 0")
    roots = scratch.save(forms.select("root").distinct())
    near = scratch.save(_near_roots(roots, scratch).unionByName(roots.select("root", F.col("root").alias("other"))))
    fields = ["key", "root", "context", "full", "freq", "records"]
    # Every (form, option) is a row of its own; they meet again in an aggregate that combines within tasks.
    options = near.join(canonical.select(F.col("root").alias("other"), F.struct(*fields).alias("y")), "other").select("root", "y")
    asked = forms.select("root", F.struct(*fields).alias("x")).join(options, "root").where("x.key <> y.key").select("x", "y")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [likelihood(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            keep = pa.array([v is not None for v in values])
            keys, targets = pc.struct_field(b.column(0), "key"), pc.struct_field(b.column(1), "key")
            yield pa.record_batch([keys.filter(keep), targets.filter(keep), pa.array([v for v in values if v is not None], pa.float64())], names=["key", "target", "value"])

    best = asked.mapInArrow(weigh, "key string, target string, value double").groupBy("key").agg(F.max(F.struct("value", "target")).alias("best"), F.sum(F.exp("value")).alias("mass"))
    joined = forms.join(best, "key", "left")
    chosen = scratch.save(joined.select("key", decided(F.col("key"), F.col("full"), F.col("freq"), F.col("best.value"), F.col("best.target"), F.col("mass")).alias("target")))
    main = used.where("kind = 's'").select("record", F.col("key").alias("main"))
    # An alias whose entities are all one name links its form; main forms are compared by their targets.
    owners = lookup_join(used.where("kind = 'a'").select("record", "key").join(main, "record"), chosen.select(F.col("key").alias("main"), "target"), "main")
    owned = scratch.save(owners.groupBy("key").agg(F.min(F.coalesce("target", "main")).alias("low"), F.max(F.coalesce("target", "main")).alias("high"), F.min("main").alias("main")))
    shared = owned.where("low <> high").select("key")
    own = owned.where("low = high").select("key", F.col("main").alias("target"))
    plain = forms.join(shared, "key", "left_semi").where("full IS NULL OR full = ''").select("key")
    # What several entities are called is no name of one: such forms link nothing (full names still do).
    doubtful = scratch.save(chosen.where("target IS NULL").select("key").join(own, "key", "left_anti").unionByName(plain).distinct())
    edges = chosen.where("target IS NOT NULL AND target <> key").unionByName(own.where("key <> target")).join(doubtful, "key", "left_anti")
    groups = seed_tree_components(edges, "key", "target").select(F.col("vertex").alias("key"), "component")
    state = groups.unionByName(doubtful.select("key", F.lit(None).cast("string").alias("component")))
    state = state.groupBy("key").agg(F.max("component").alias("component"), F.max(F.col("component").isNull()).alias("doubtful"))
    holders = used.where("kind <> 'a'").select("record", "key")
    return lookup_join(holders, state, "key", "left").where("NOT coalesce(doubtful, false)").select("record", F.coalesce("component", "key").alias("group_key"))


def pairs_within(records: DataFrame, block: int = 1000) -> DataFrame:
    """Every pair of different ``record`` values with the same ``group_key``, the smaller one first.

    A group of more than ``block`` records is cut into blocks by hash, and its pairs of blocks are
    tasks of their own, so that no task holds all pairs of a large group.
    """
    sizes = records.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    held = lookup_join(records.distinct(), sizes.select("group_key", "blocks"), "group_key").withColumn("mine", F.pmod(F.hash("record"), "blocks"))
    left = held.select("group_key", F.col("record").alias("record_a"), "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("theirs"))
    right = held.select("group_key", F.col("record").alias("record_b"), F.col("mine").alias("theirs"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"))
    return left.join(right, ["group_key", "mine", "theirs"]).where("record_a < record_b").select("record_a", "record_b").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(Scratch(spark, "linked").save(linked_records(spark, sf_dir)))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a usable name, with the smallest record of its group and the group's size."""
    linked = Scratch(spark, "linked").save(linked_records(spark, sf_dir))
    return linked.join(linked.groupBy("group_key").agg(F.min("record").alias("group_record"), F.count(F.lit(1)).alias("size")), "group_key").select("group_record", "record", "size")


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table of records: how many there are, and how many of them are in two groups, unknown, or larger than their group's first (all none)."""
    groups = Scratch(spark, "groups").save(p6_groups(spark, sf_dir))
    seeds = table(spark, sf_dir, "entity_seed").select(F.lit("entity_seed").alias("origin"), F.col("entity_id").alias("record"))
    found = table(spark, sf_dir, "entity_candidates").select(F.lit("entity_candidates").alias("origin"), F.col("candidate_id").alias("record"))
    known = seeds.unionByName(found).where("record IS NOT NULL").distinct()
    per = groups.groupBy("record").agg(F.countDistinct("group_record").alias("groups"), F.max(F.col("group_record") > F.col("record")).alias("late"))
    joined = known.join(per, "record", "full_outer").withColumn("origin", F.coalesce("origin", F.lit("nowhere")))
    count = lambda c, n: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n)
    out = joined.groupBy("origin").agg(F.count(F.lit(1)).alias("records"), count(F.col("groups") > 1, "in_two"), count(F.col("late"), "before_first"))
    return out
