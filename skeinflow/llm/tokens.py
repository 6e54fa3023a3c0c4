"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE; a parameter of every operator that sizes texts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def build_encoder(ranks_file: bytes):
    """An encoder from the content of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str):
    with open(path, "rb") as f:
        return build_encoder(f.read())


_BUILT: dict = {}


def token_counts(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with its size in tokens: 0 for null and empty texts.

    Whole texts are tokenized, in Arrow batches; the text goes no further than the Python worker.
    The rank file is read by the driver and broadcast (it has a fixed size), so workers need no file.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    with open(tokenizer, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _BUILT:  # once for each worker, which serves many tasks
            _BUILT[tokenizer] = build_encoder(ranks.value)
        encode = _BUILT[tokenizer].encode_ordinary
        for b in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.record_batch([*b.columns[: len(keep)], sizes], names=[*keep, out])

    return df.select(*keep, F.col(text)).mapInArrow(count, f"{schema}, `{out}` bigint" if keep else f"`{out}` bigint")
