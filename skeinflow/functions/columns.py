"""Column functions: keys, ids, coercions and text shaping. Nulls give null unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x0B\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def clean_text(col: Column) -> Column:
    """Without NUL characters, white space of any kind collapsed to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(col, F.lit("\x00"), F.lit("")), _WS, " "))


def name_key(col: Column, separator: str = " ") -> Column:
    """The join key of names: lower case, everything but a-z and 0-9 to one ``separator``, ends trimmed."""
    spaced = F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))
    return spaced if separator == " " else F.replace(spaced, F.lit(" "), F.lit(separator))


def slug(col: Column) -> Column:
    return name_key(col, "-")


def stable_id(prefix: str, *parts: Column, separator: str = "") -> Column:
    """``prefix_`` and 16 hex digits of the SHA-256 of the parts; a null part counts as empty.

    Without a separator ("ab", "c") and ("a", "bc") have the same id, as existing ids do.
    """
    joined = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def clamp01(col: Column, default: float = 0.0) -> Column:
    """A number between 0 and 1; what is no number becomes ``default``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col.try_cast("double"), F.lit(default))))


def clean_list(col: Column, limit: int | None = None, clip: int | None = None) -> Column:
    """Trimmed entries in order, without blanks, nulls and repetitions; at most ``limit``, each at most ``clip`` long."""
    out = F.filter(F.transform(col, lambda x: clean_text(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    if clip is not None:
        out = F.transform(out, lambda x: F.substring(x, 1, clip))
    out = F.array_distinct(out)
    return out if limit is None else F.slice(out, 1, limit)


def one_of(col: Column, values: Sequence[str], default: str, synonyms: Mapping[str, str] | None = None) -> Column:
    """An enumeration value: lower case, synonyms resolved, anything else ``default``."""
    key = F.lower(F.trim(col))
    if synonyms:
        pairs = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        key = F.coalesce(F.try_element_at(pairs, key), key)
    return F.when(key.isin(list(values)), key).otherwise(F.lit(default))


def ellipsis(col: Column, size: int, mark: str = "...") -> Column:
    """White space collapsed, cut to ``size`` characters with ``mark`` at the end of what was cut."""
    text = clean_text(col)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size - len(mark))), F.lit(mark)))


def sentences(col: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; no empty pieces."""
    return F.filter(F.split(F.trim(col), r"(?<=[.!?])\s+"), lambda s: s != "")


def without_sentences(col: Column, pattern: str) -> Column:
    """The text without the sentences that match ``pattern``."""
    return F.array_join(F.filter(sentences(col), lambda s: ~s.rlike(pattern)), " ")


def word_count(col: Column) -> Column:
    """Words of letters, digits, ``_``, ``'`` and ``-``; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[A-Za-z0-9_]['\-A-Za-z0-9_]*")), F.lit(0)).cast("long")


def without_repeats(col: Column) -> Column:
    """Words equal to the one before them (letter case ignored) dropped, punctuation at the ends off."""
    words = F.split(clean_text(F.regexp_replace(col, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")), " ")
    kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get(words, i - 1)).alias("before"))), lambda x: ~F.coalesce(F.lower(x["w"]) == F.lower(x["before"]), F.lit(False)))
    return F.array_join(F.transform(kept, lambda x: x["w"]), " ")


def paragraphs(col: Column) -> Column:
    """Single line breaks to blanks; blank lines stay as paragraph breaks."""
    text = F.regexp_replace(F.regexp_replace(col, r"\r\n?", "\n"), r"\n[ \t]*\n\s*", "\u0001")
    return F.replace(F.trim(F.regexp_replace(text, r"[ \t]*\n[ \t]*", " ")), F.lit("\u0001"), F.lit("\n\n"))


def number_after(col: Column, word: str) -> Column:
    """The integer after ``word`` ("Year 12"), letter case ignored; null where there is none."""
    return F.nullif(F.regexp_extract(col, rf"(?i)\b{word}\s+(\d{{1,9}})\b", 1), F.lit("")).try_cast("int")


def flags(**rules: Column) -> Column:
    """The names of the rules that hold, in the order given; a null rule doesn't."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return out


def joined_fields(items: Column, fields: Sequence[str], separator: str = " — ") -> Column:
    """The non-empty ``fields`` of an array of structs, all in one string."""
    parts = F.flatten(F.transform(items, lambda e: F.array(*[e[f].cast("string") for f in fields])))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), separator)


def display_name(col: Column, overrides: Mapping[str, str] | None = None, acronym: int = 8) -> Column:
    """Title case; short all-capital names stay; ``overrides`` (by name key) win."""
    text = clean_text(col)
    shown = F.when((F.length(text) <= acronym) & (text == F.upper(text)), text).otherwise(F.initcap(text))
    if not overrides:
        return shown
    pairs = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name_key(col)), shown)


def boundary_pattern(words: Sequence[str]) -> str:
    """A pattern that finds any of ``words`` (in key form) standing alone in key-form text."""
    escaped = "|".join(sorted((w.replace("\\", "").replace(".", r"\.") for w in words), key=lambda w: (-len(w), w)))
    return rf"(^|[^a-z0-9])({escaped})([^a-z0-9]|$)"


def utc(col: Column) -> Column:
    """ISO-8601 text to a timestamp; without offset it is UTC; null where it can't be read."""
    has_zone = col.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
    return F.try_to_timestamp(F.when(has_zone, col).otherwise(F.concat(F.trim(col), F.lit("Z"))))


def rename_keys(col: Column, names: Mapping[str, str]) -> Column:
    """A map with its keys renamed; keys without a new name stay."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(col, lambda k, _: F.coalesce(F.try_element_at(pairs, k), k))


def merge_list_maps(a: Column, b: Column) -> Column:
    """Two maps of lists as one, lists of a shared key united in order."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))
