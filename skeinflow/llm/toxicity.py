"""Scores for abusive, hateful or sexual passages from the nearest labelled passages."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.runtime import Scratch, table

#: At most this many labelled documents (those of lowest hash) are used as examples.
MAX_LABELS = 5_000
#: Passages: runs of words without sentence punctuation; longer ones in windows of WIDTH words, STRIDE apart.
WIDTH, STRIDE = 8, 4
#: Labelled passages nearer than this cosine vote, with weight cosine ** POWER.
NEAR, POWER = 0.5, 4
#: Weight of the base rate in a vote, and the largest inverse document frequency (so that names don't outweigh all else).
SMOOTH, MAX_IDF = 0.7, 2.5
#: A term of the index is a word in at least two labelled documents and in this share of them.
TERM_SHARE = 0.0005
#: At most about this many distinct labelled passages (those of lowest hash) are examples: a bound on what the sample takes however long its documents are.
MAX_PASSAGES = 2_000_000
#: Passages of fewer different terms tell nothing.
MIN_TERMS = 2
#: A document with a passage of at least this score counts as abusive.
THRESHOLD = 0.5
#: A passage of an abusive document is an offending example if its own neighbours' vote is at least this.
OFFENDING = 0.5
BLOCK = 64
#: Up to this many blocks, the largest impacts of a term are kept as one row of numbers.
DENSE_BLOCKS = 64
#: Longest lists stay closed while their terms together reach less than this share of the floor: more saves additions, less saves blocks.
CLOSED = 0.25

# Letters of other scripts that look like Latin ones, and digits and signs typed for letters.
_LOOKALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
_TYPED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def _fold_table() -> dict[int, str | None]:
    """Accents off, look-alikes to Latin, invisible characters away."""
    out: dict[int, str | None] = {}
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base != chr(code):
            out[code] = base.lower()
    out |= {ord(k): v for k, v in _LOOKALIKE.items()}
    out |= {0xDF: "ss"} | dict.fromkeys(range(0x300, 0x370), None)
    return out


_FOLD = _fold_table()
_INVISIBLE = "\u200b\u00ad\u200c\u200d\u2060\ufeff"
#: A word, letters with a blank or dot between any two of them, or the end of a sentence.
_PIECES = re.compile(r"[\w@$*]{2,}|[^\W\d_](?:[ .\-]{1,2}[^\W\d_](?!\w)){2,}|[\w@$*]|[.!?;:…\n\r]")
_RUN = re.compile(r"(.)\1+")
_ENDS = frozenset(".!?;:…\n\r")


def pieces(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        for c in _INVISIBLE:
            if c in text:
                text = text.replace(c, "")
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return _PIECES.findall(text)


def term(piece: str) -> str:
    """The form under which a piece is looked up: letters typed otherwise restored, runs of a letter made one, numbers ``#``."""
    if not piece.isascii():
        piece = unicodedata.normalize("NFKC", piece).lower().translate(_FOLD)
    if len(piece) > 2 and not piece[1].isalnum() and piece[1] not in "@$*_":
        piece = re.sub(r"[\W_]", "", piece)
    if piece.isdigit():
        return "#"
    if any(c.isdigit() or c in "@$" for c in piece) and any(map(str.isalpha, piece)):
        piece = piece.translate(_TYPED)
    return _RUN.sub(r"\1", piece.strip("*_"))


class Terms:
    """Numbers for the pieces of a text: -2 ends a passage, -1 is no term of the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.memo: dict[str, int] = dict.fromkeys(_ENDS, -2)
        self.masked = [w for w in vocabulary if len(w) > 2]

    def number(self, piece: str) -> int:
        t = term(piece)
        n = self.vocabulary.get(t, -1)
        if n < 0 and "*" in t:
            # Letters hidden by stars: the first vocabulary word that fits, in order of the vocabulary.
            fits = re.compile("".join(f".{{0,{len(p)}}}" if p[0] == "*" else re.escape(_RUN.sub(r"\1", p)) for p in re.findall(r"\*+|[^*]+", piece.strip("_"))))
            n = next((self.vocabulary[w] for w in self.masked if fits.fullmatch(w) and len(w) > len(piece) - 3), -1)
        if len(self.memo) < 500_000:
            self.memo[piece] = n
        return n

    def of(self, text: str) -> list[int]:
        memo, number = self.memo, self.number
        return [memo[p] if p in memo else number(p) for p in pieces(text)]


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all passages in a flat array of term numbers."""
    ends = np.flatnonzero(ids == -2)
    starts = np.concatenate([[0], ends + 1])
    stops = np.concatenate([ends, [len(ids)]])
    size = stops - starts
    starts, stops, size = starts[size > 0], stops[size > 0], size[size > 0]
    n = np.where(size <= WIDTH + 2, 1, -(-(size - STRIDE) // STRIDE))
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[row] + nth * STRIDE
    last = np.where(n[row] == 1, stops[row], np.minimum(first + WIDTH, stops[row]))
    return first, last


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of all i, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class BlockMax:
    """An inverted index over examples with the largest impact of each term in each block of ``BLOCK`` examples.

    A list is a term's blocks, with the largest impact and the postings of each. ``near`` first adds up
    the largest impacts of the terms' lists for each block, the longest lists (as long as their terms
    together reach only ``CLOSED`` of the floor) left closed and counted at their largest; then, for
    the blocks that can reach the floor, those of all lists; postings are only opened where that sum
    reaches it. Nothing that reaches the floor is left out, and its score is exact.
    Examples should come in an order that puts similar ones together.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((example, term))
        example, term, impact = example[order], term[order], impact[order]
        self.blocks = int(example.max()) // BLOCK + 1 if len(example) else 1
        key = term.astype(np.int64) * self.blocks + example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key = key[first]
        self.block = (self.key % self.blocks).astype(np.int32)
        self.start = np.append(first, len(key))
        self.most = np.maximum.reduceat(impact, first) if len(key) else np.zeros(0)
        self.inside, self.impact = (example % BLOCK).astype(np.int32), impact
        # The lists of term t are at[t] : at[t + 1].
        self.at = np.searchsorted(self.key, np.arange(n_terms + 1, dtype=np.int64) * self.blocks)
        self.top = np.zeros(n_terms)
        if len(key):
            np.maximum.at(self.top, term, impact)
        self.dense = None
        used = np.flatnonzero(self.at[1:] > self.at[:-1])
        if self.blocks <= DENSE_BLOCKS:
            self.slot = np.zeros(n_terms, np.int64)
            self.slot[used] = np.arange(1, len(used) + 1)
            self.dense = np.zeros((len(used) + 1, self.blocks))
            self.dense[self.slot[self.key // self.blocks], self.block] = self.most

    def near(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, example, score) wherever the score, the sum of weight times impact, reaches the row's ``floor``.

        Row ``r`` has the terms ``term[row == r]``; ``row`` is sorted.
        """
        out: list[tuple] = []
        step = max(1, 300_000 // self.blocks)
        for low in range(0, len(floor), step):
            a, b = np.searchsorted(row, [low, low + step])
            if a < b:
                out += self._near(row[a:b] - low, term[a:b], weight[a:b], floor[low : low + step], low)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _near(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, low: int) -> Iterator[tuple]:
        if self.dense is not None:
            # Few blocks: the largest impacts of all of them are added up at once.
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            bound = np.add.reduceat(self.dense[self.slot[term]] * weight[:, None], begin, axis=0)
            at, block = np.nonzero(bound >= floor[row[begin]][:, None] - 1e-6)
            yield from self._opened(row, term, weight, floor, low, row[begin][at] * self.blocks + block)
            return
        long = self.at[term + 1] - self.at[term]
        reach = weight * self.top[term]
        order = np.lexsort((-long, row))
        row, term, weight, long, reach = row[order], term[order], weight[order], long[order], reach[order]
        so_far = np.cumsum(reach)
        begin = np.searchsorted(row, row)
        so_far -= np.where(begin > 0, so_far[begin - 1], 0.0)
        opened = (so_far >= CLOSED * floor[row] - 1e-9) & (long > 0)
        closed = np.bincount(row, np.where(opened, 0.0, reach), len(floor))
        lists = _spans(self.at[term[opened]], long[opened])
        r = np.repeat(row[opened], long[opened])
        cell = r * self.blocks + self.block[lists]
        bound = np.bincount(cell, np.repeat(weight[opened], long[opened]) * self.most[lists], len(floor) * self.blocks)
        hits = np.flatnonzero(bound > 0)
        hits = hits[bound[hits] >= (floor - closed)[hits // self.blocks] - 1e-6]
        yield from self._opened(row, term, weight, floor, low, hits)

    def _opened(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, floor: np.ndarray, low: int, hits: np.ndarray) -> Iterator[tuple]:
        """Exact scores in the blocks ``hits`` (row * blocks + block)."""
        for some in np.array_split(hits, max(1, len(hits) // 20_000)):
            if not len(some):
                continue
            # All terms of a row, in the blocks in question.
            owner = some // self.blocks
            first, n = np.searchsorted(row, owner), np.searchsorted(row, owner, side="right")
            n = n - first
            which = _spans(first, n)
            hit = np.repeat(np.arange(len(some)), n)
            wanted = term[which].astype(np.int64) * self.blocks + (some % self.blocks)[hit]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            there = self.key[place] == wanted
            place, hit, w = place[there], hit[there], weight[which[there]]
            # With the closed lists' largest impacts in it, the bound leaves few blocks to open.
            full = np.bincount(hit, w * self.most[place], len(some)) >= floor[owner] - 1e-6
            place, hit, w = place[full[hit]], hit[full[hit]], w[full[hit]]
            size = self.start[place + 1] - self.start[place]
            posting = _spans(self.start[place], size)
            slot = np.repeat(hit, size) * BLOCK + self.inside[posting]
            score = np.bincount(slot, np.repeat(w, size) * self.impact[posting], len(some) * BLOCK)
            good = np.flatnonzero(score > 0)
            good = good[score[good] >= floor[owner[good // BLOCK]]]
            yield owner[good // BLOCK] + low, (some[good // BLOCK] % self.blocks) * BLOCK + good % BLOCK, score[good]


class Examples:
    """Distinct labelled passages with their label counts, in exact cosine indexes by blocks.

    ``votes`` finds all examples near a passage; ``gate`` tells which windows have an offending example
    (or another chosen one) nearer than ``NEAR``: windows that can't reach it by the terms of the chosen
    examples at all are left before anything is looked up. Neither leaves out anything that counts.
    """

    def __init__(self, bags: list[tuple[int, ...]], clean: list[int], abusive: list[int], docs: list[int], idf: np.ndarray, base: float) -> None:
        # Similar examples, by their rarest terms, go into one block.
        order = sorted(range(len(bags)), key=lambda e: sorted(bags[e], key=lambda t: (-idf[t], t))[:3])
        self.bags = [bags[e] for e in order]
        self.idf, self.base, self.docs = idf, base, np.asarray(docs, np.int64)[order]
        self.clean, self.abusive = np.asarray(clean, np.float64)[order], np.asarray(abusive, np.float64)[order]
        self.index = BlockMax(*self._impacts(np.arange(len(bags))), len(idf))

    def _impacts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``chosen``, term, impact) of these examples; an example's impacts have length one."""
        bags = [self.bags[e] for e in chosen.tolist()]
        size = np.fromiter(map(len, bags), np.int64, len(bags))
        entry = np.repeat(np.arange(len(bags)), size)
        flat = np.fromiter((t for b in bags for t in b), np.int64, int(size.sum()))
        return self._unit(entry, flat, len(bags))[:3]

    def _unit(self, entry: np.ndarray, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pair, tf = np.unique(entry * (len(self.idf) + 1) + flat, return_counts=True)
        entry, flat = pair // (len(self.idf) + 1), pair % (len(self.idf) + 1)
        weight = tf * self.idf[flat]
        norm = np.sqrt(np.bincount(entry, weight**2, n))
        return entry, flat, weight / np.maximum(norm[entry], 1e-12), norm

    def votes(self, queries: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        """For each bag of terms its score, and its nearest example that has an abusive label, or -1."""
        size = np.fromiter(map(len, queries), np.int64, len(queries))
        flat = np.concatenate([np.asarray(q, np.int64) for q in queries]) if len(queries) else np.zeros(0, np.int64)
        row, term, weight, _ = self._unit(np.repeat(np.arange(len(queries)), size), flat, len(queries))
        row, near, score = self.index.near(row, term, weight, np.full(len(queries), NEAR))
        w = score**POWER
        pos, neg = np.bincount(row, w * self.abusive[near], len(queries)), np.bincount(row, w * self.clean[near], len(queries))
        value = np.where(pos + neg > 0, (pos + SMOOTH * self.base) / (pos + neg + SMOOTH), 0.0)
        best = np.full(len(queries), -1, np.int64)
        bad = self.abusive[near] > 0
        order = np.lexsort((-near[bad], score[bad], row[bad]))
        best[row[bad][order]] = near[bad][order]  # the last one of a row is its nearest
        return value, best

    def choose(self, chosen: np.ndarray) -> None:
        """Lay out the examples that ``gate`` looks for."""
        self.chosen = BlockMax(*self._impacts(chosen), len(self.idf))

    def gate(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Numbers of the windows with a chosen example nearer than ``NEAR``."""
        known = np.where(ids >= 0, ids, len(self.idf))
        weight = np.append(self.idf, 0.0)[known]  # -1 and -2 weigh nothing
        run = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        square, most = run(weight**2), run(np.append(self.chosen.top, 0.0)[known] * weight)
        # With repeated words the norm is at least the root of this sum, so the bound holds.
        norm = np.sqrt(np.maximum(square[last] - square[first], 1e-12))
        maybe = np.flatnonzero((most[last] - most[first]) / norm >= NEAR - 1e-5)
        listed = np.append(self.chosen.top > 0, False)
        out = [np.zeros(0, np.int64)]
        for part in np.array_split(maybe, max(1, len(maybe) // 20_000)):
            size = last[part] - first[part]
            place = _spans(first[part], size)
            row = np.repeat(np.arange(len(part)), size)
            # Terms that no chosen example has count in the norm only.
            real = listed[known[place]]
            t, r = ids[place][real], row[real]
            found, _, _ = self.chosen.near(r, t, self.idf[t] / norm[part][r], np.full(len(part), NEAR - 1e-6))
            out.append(part[np.unique(found)])
        return np.concatenate(out)


def _label_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, doc_id, toxic) for each distinct passage of a labelled document; words joined by blanks."""
    for b in batches:
        words, docs, labels = [], [], []
        for doc, text, toxic in zip(*(c.to_pylist() for c in b.columns)):
            found = [p if p in _ENDS else term(p) for p in pieces(text or "")]
            ids = np.array([-2 if p in _ENDS else 0 for p in found], np.int64)
            for s, e in zip(*windows(ids)):
                words.append(" ".join(sorted(found[s:e])))
                docs.append(doc)
                labels.append(toxic)
        yield pa.record_batch([pa.array(words, pa.string()), pa.array(docs, pa.int64()), pa.array(labels, pa.int32())], names=["words", "doc_id", "toxic"])


def _encode(documents: DataFrame, vocabulary, keep: list, width: str) -> DataFrame:
    """``doc_id``, the columns ``keep`` and the text as term numbers (plus 2), unsigned integers of ``width``."""
    out = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(vocabulary.value)
        for b in batches:
            codes = [(np.array(terms.of(t), np.int64) + 2).astype(width).tobytes() if t else b"" for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(codes, pa.binary())], names=["doc_id", *[f.name for f in keep], "codes"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[f.name for f in keep], "text").mapInArrow(run, f"doc_id bigint{out}, codes binary")


def _codes(column: pa.Array, width: str) -> list[np.ndarray]:
    return [np.frombuffer(c, width).astype(np.int64) - 2 for c in column.to_pylist()]


def _frequencies(encoded: DataFrame, n_terms: int, width: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(n_terms + 2, np.int64), 0
        for b in batches:
            for ids in _codes(b.column(0), width):
                n += 1
                seen[np.unique(ids)] += 1
        ids = np.flatnonzero(seen[:-2])
        yield pa.record_batch([pa.array(np.append(ids, -1), pa.int64()), pa.array(np.append(seen[ids], n), pa.int64())], names=["id", "n"])

    counts = {r["id"]: r["n"] for r in encoded.select("codes").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    return np.array([counts.get(i, 0) for i in range(n_terms)], np.float64), counts.get(-1, 0)


def _passages(documents: DataFrame, labels: DataFrame, max_labels: int, scratch: Scratch) -> DataFrame:
    """``words, doc_id, toxic``: the distinct passages of the labelled documents that are used."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    return scratch.save(labelled.mapInArrow(_label_bags, "words string, doc_id bigint, toxic int").distinct())


def _examples(passages: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, base: float, graded: bool, max_passages: int) -> Examples:
    """The index of the labelled passages; those that their own neighbours call abusive are the offending ones.

    ``gate`` is to find windows near offending examples, or, ``graded``, near any with an abusive label.
    """
    spark = passages.sparkSession
    merged: dict[tuple[int, ...], list[int]] = {}
    grouped = passages.groupBy("words").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("bad"), F.min(F.when(F.col("toxic") > 0, F.col("doc_id"))).alias("doc"))
    grouped = Scratch(spark, "passages").save(grouped)
    distinct = grouped.count()
    if distinct > max_passages:
        grouped = grouped.where(F.pmod(F.xxhash64("words"), F.lit(1 << 31)) < int((1 << 31) * max_passages / distinct))
    for r in grouped.collect():  # bounded: see MAX_PASSAGES
        key = tuple(sorted(vocabulary[w] for w in r["words"].split(" ") if w in vocabulary))
        if len(set(key)) >= MIN_TERMS:
            now = merged.setdefault(key, [0, 0, -1])
            now[0] += r["clean"]
            now[1] += r["bad"]
            if r["doc"] is not None and (now[2] < 0 or r["doc"] < now[2]):
                now[2] = r["doc"]
    keys = sorted(merged)
    examples = Examples(keys, [merged[k][0] for k in keys], [merged[k][1] for k in keys], [merged[k][2] for k in keys], idf, base)
    bad = np.flatnonzero(examples.abusive > 0)
    if graded:
        examples.choose(bad)
        return examples
    shared = spark.sparkContext.broadcast(examples)

    def self_vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            yield pa.record_batch([b.column(0), pa.array(shared.value.votes([shared.value.bags[e] for e in found])[0], pa.float64())], names=["e", "v"])

    listed = spark.createDataFrame([(int(e),) for e in bad], "e bigint").repartition(max(1, spark.sparkContext.defaultParallelism), "e")
    voted = listed.mapInArrow(self_vote, "e bigint, v double").where(F.col("v") >= OFFENDING).collect()
    shared.destroy()
    examples.choose(np.array(sorted(r["e"] for r in voted), np.int64))
    return examples


def score(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), max_labels: int = MAX_LABELS, graded: bool = False, max_passages: int = MAX_PASSAGES) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``score``, ``passage`` and ``example_doc_id`` for every document.

    Labels are of whole documents, so a passage inherits its document's. Harmless passages of
    abusive documents are outvoted by their like in clean ones; only passages whose own
    neighbours call them abusive become offending examples. Examples come from at most
    ``max_labels`` documents; document frequencies are counted over all documents.

    A document's score is the largest of its passages': the cosine-weighted share of abusive labels
    among the labelled passages nearer than ``NEAR``, 0 where none of these is an offending example
    (or, ``graded``, where none has an abusive label: what is near harmless passages of abusive
    documents then has the small score of its vote). The vectors' terms are the words in at least
    two labelled documents and ``TERM_SHARE`` of them; the cosine is exact over these, other words
    are as if they weren't there.
    ``passage`` is that passage's terms, ``example_doc_id`` the labelled document of its nearest
    abusive example: the evidence. Whole texts are read, once: the term numbers go to the shared
    folder for the counts and the scores.

    Null, empty and blank texts score 0, and so does everything without labels of both kinds. Null
    labels and labels of unknown documents count nothing; of several labels of one document the
    largest counts.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    extra = [f for f in documents.schema if f.name in keep]
    passages = _passages(documents, labels, max_labels, scratch)
    totals = passages.select("doc_id", "toxic").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()[0]
    if not totals["bad"]:
        zero = [F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("passage"), F.lit(None).cast("long").alias("example_doc_id")]
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[f.name for f in extra], *zero)
    least = max(2.0, TERM_SHARE * totals["n"])
    in_labelled = passages.select("doc_id", F.explode(F.split("words", " ")).alias("term")).where("term <> ''").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    # Words of the bounded sample, two or four bytes a number.
    words = [r["term"] for r in in_labelled.where(F.col("n") >= least).orderBy(F.desc("n"), "term").collect()]
    width = "uint16" if len(words) + 2 <= 1 << 16 else "uint32"
    vocabulary = {w: i for i, w in enumerate(words)}
    encoded = scratch.save(_encode(documents, spark.sparkContext.broadcast(vocabulary), extra, width))
    found, all_docs = _frequencies(encoded, len(words), width)
    idf = np.minimum(MAX_IDF, np.log((all_docs + 1) / (found + 1)) + 0.3)
    model = spark.sparkContext.broadcast((words, _examples(passages, vocabulary, idf, totals["bad"] / totals["n"], graded, max_passages)))
    out = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, examples = model.value
        cache: dict[bytes, tuple[float, int]] = {}
        for b in batches:
            texts = _codes(b.column(b.num_columns - 1), width)
            value, passage, source = np.zeros(len(texts)), [None] * len(texts), [None] * len(texts)
            at = 0
            while at < len(texts):
                start, size, held = at, 0, []
                while at < len(texts) and size < 200_000:
                    held += [texts[at], np.array([-2])]
                    size += len(texts[at]) + 1
                    at += 1
                ids = np.concatenate(held)
                doc_end = np.cumsum([len(t) + 1 for t in texts[start:at]])
                first, last = windows(ids)
                if not len(first):
                    continue
                passed: list[tuple[int, bytes]] = []
                asked: dict[bytes, np.ndarray] = {}
                for k in examples.gate(ids, first, last).tolist():
                    part = ids[first[k] : last[k]]
                    key = np.sort(part[part >= 0])
                    if key[0] == key[-1]:
                        continue
                    name = key.tobytes()
                    passed.append((k, name))
                    if name not in cache:
                        asked[name] = key
                if asked:
                    if len(cache) > 200_000:
                        cache = {name: cache[name] for _, name in passed if name in cache}
                    cache.update(zip(asked, zip(*(v.tolist() for v in examples.votes(list(asked.values()))))))
                for k, name in passed:
                    got = cache[name]
                    doc = start + int(np.searchsorted(doc_end, first[k], side="right"))
                    if got[0] > value[doc]:
                        value[doc] = got[0]
                        passage[doc] = " ".join(names[i] for i in ids[first[k] : last[k]].tolist() if i >= 0)
                        source[doc] = int(examples.docs[got[1]]) if got[1] >= 0 else None
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(np.round(value, 6)), pa.array(passage, pa.string()), pa.array(source, pa.int64())],
                names=["doc_id", *[f.name for f in extra], "score", "passage", "example_doc_id"],
            )

    return encoded.mapInArrow(run, f"doc_id bigint{out}, score double, passage string, example_doc_id bigint")


def _scored(spark: SparkSession, sf_dir: str, *keep: str, graded: bool = False) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), keep, graded=graded)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, graded also where no offending example is near."""
    return _scored(spark, sf_dir, "source", graded=True)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their rate for each source; a null source is a row of its own."""
    bad = F.sum((F.col("score") >= THRESHOLD).cast("long"))
    return _scored(spark, sf_dir, "source").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), bad.alias("abusive")).withColumn("rate", F.col("abusive") / F.col("documents"))


def p9_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often documents of each tenth of the score carry an abusive label, for labels that weren't used: two of three are, by hash."""
    labels = table(spark, sf_dir, "review_labels").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0
    scored = score(table(spark, sf_dir, "documents"), labels.where(~held), graded=True).select("doc_id", "score")
    tenth = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("long")
    by = scored.join(labels.where(held), "doc_id").groupBy(tenth.alias("tenth"))
    return by.agg(F.count(F.lit(1)).alias("documents"), F.sum("toxic").cast("long").alias("labelled_abusive"), F.avg("score").alias("mean_score"), F.avg("toxic").alias("label_rate"))
