"""Declared schemas of exported pages and messages."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _I = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


AUTHOR = _struct(id=_S, username=_S, global_name=_S, bot=_B)
EMBED = _struct(title=_S, description=_S, author=_struct(name=_S), provider=_struct(name=_S))
#: One message of an export page, as written.
RAW_MESSAGE = _struct(
    id=_S, timestamp=_S, channel_id=_S, content=_S, author=AUTHOR, embeds=T.ArrayType(EMBED), attachments=T.ArrayType(T.MapType(_S, _S)), application_id=_S, webhook_id=_S
)
#: A normalised message.
MESSAGE = _struct(
    message_id=_S, thread_id=_S, channel_id=_S, timestamp_utc=T.TimestampType(), author_id=_S, author_name=_S, author_is_bot=_B, is_bot_or_application=_B, application_id=_S, webhook_id=_S,
    content_raw=_S, content_normalized=_S, attachments_count=_I, embeds_count=_I, sensitivity_flags=T.ArrayType(_S), provenance=_struct(json_path=_S, parser_version=_S, content_hash=_S),
)
