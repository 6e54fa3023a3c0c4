"""The boundary to language models: a client that can be replaced, and table functions around it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.runtime import ship


class ModelClient(Protocol):
    """Answers a prompt with text. Instances are pickled to the executors."""

    def complete(self, prompt: str) -> str: ...


class StubClient:
    """A deterministic client: the answer of the first rule whose pattern is in the prompt, else ``default``."""

    def __init__(self, rules: list[tuple[str, str]], default: str = "{}") -> None:
        self.rules, self.default = rules, default

    def complete(self, prompt: str) -> str:
        return next((answer for pattern, answer in self.rules if re.search(pattern, prompt)), self.default)


def tolerant_json(text: str | None):
    """The first JSON object or array in an answer, code fences and talk around it ignored; None if there is none."""
    text = text or ""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def answers(rows: DataFrame, key: str, prompt: str, client: ModelClient, items: str, fields: list[str], retries: int = 1) -> DataFrame:
    """``key, item_no, ok`` and ``fields`` of the items that the model names for each prompt.

    An item is an object in the list ``items`` of the answer. Prompts whose answer can't be read
    after ``retries`` further tries, or fails, give one row with ``ok`` false, so nothing is lost
    and failures can be asked again. Values are strings; what isn't an object is left out.
    """
    ship(rows.sparkSession)
    schema = ", ".join([f"`{key}` string", "item_no bigint", "ok boolean", *[f"`{f}` string" for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = None
                for _ in range(retries + 1):
                    try:
                        got = tolerant_json(client.complete(text or ""))
                    except Exception:
                        got = None
                    found = got.get(items) if isinstance(got, dict) else got if isinstance(got, list) else None
                    if isinstance(found, list):
                        break
                if not isinstance(found, list):
                    out.append((k, 0, False, *[None] * len(fields)))
                    continue
                for i, item in enumerate(x for x in found if isinstance(x, dict)):
                    out.append((k, i + 1, True, *[None if item.get(f) is None else str(item[f]) for f in fields]))
            cols = list(zip(*out)) or [()] * (3 + len(fields))
            kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.string()] * len(fields)]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[key, "item_no", "ok", *fields])

    return rows.select(F.col(key).cast("string").alias(key), prompt).mapInArrow(run, schema)


def with_fallback(rows: DataFrame, key: str, answered: DataFrame, value: str, heuristic) -> DataFrame:
    """``rows`` with ``value`` from the first good answer of each key, else from the expression ``heuristic``; ``by`` says which."""
    good = answered.where("ok").groupBy(key).agg(F.min_by(value, "item_no").alias("_answer"))
    joined = rows.join(good, key, "left")
    return joined.withColumn(value, F.coalesce("_answer", heuristic)).withColumn("by", F.when(F.col("_answer").isNotNull(), "model").otherwise("heuristic")).drop("_answer")


def resolved_reference(ref, ids):
    """A message named by id or by its number from 1 in the array ``ids``; null if it is neither."""
    at = ref.try_cast("int")
    by_number = F.when((at >= 1) & (at <= F.size(ids)), F.get(ids, at - 1))
    return F.when(F.array_contains(ids, ref), ref).otherwise(by_number)


Heuristic = Callable[[str], list[dict]]
