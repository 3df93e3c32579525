"""Text preprocessing as native column expressions (no Python UDF; whole-stage codegen).

* C1 ``replace_emoticons``: 13 emoticons replaced in list order, each by `` word `` (case-sensitive,
  sequential, so ``:/`` inside ``http://`` is replaced too -- kept on purpose)
* C2 ``replace_emojis``: emojis replaced by `` name `` from a dictionary table. The default
  dictionary is built by rule: every code point of the emoji block U+1F300..U+1FAFF that has a
  Unicode character name, named lower-case with ``_`` for spaces. Callers may pass their own.
* C3 ``preprocess_text``: C1 then C2
* C4 ``truncate_words``: at most ``n`` whitespace-separated words, joined by single spaces
  (word-level stand-in for the sub-word truncation of the scoring model)
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 13 emoticons of the preprocessing step, in their replacement order.
EMOTICONS = [
    (":)", "happy"),
    (":-)", "happy"),
    (":D", "very happy"),
    (":-D", "very happy"),
    (":(", "sad"),
    (":-(", "sad"),
    (":'(", "crying"),
    (":/", "confused"),
    (":-/", "confused"),
    (";)", "wink"),
    (";-)", "wink"),
    ("<3", "love"),
    (":|", "neutral"),
]

EMOJI_FIRST, EMOJI_LAST = 0x1F300, 0x1FAFF


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once a row, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def replace_emoticons(text, emoticons: list[tuple[str, str]] = EMOTICONS) -> Column:
    """The replacements in list order; a text without an emoticon's first character is let through by one scan."""
    t = out = _c(text)
    for emo, word in emoticons:
        out = F.replace(out, F.lit(emo), F.lit(f" {word} "))
    if not emoticons or not all(emo for emo, _ in emoticons):
        return out
    first = "".join(f"\\x{{{cp:X}}}" for cp in sorted({ord(emo[0]) for emo, _ in emoticons}))
    # words may bring in first characters, but only where an emoticon was found before
    return F.when(t.rlike(f"[{first}]"), out).otherwise(t)


@lru_cache(maxsize=1)
def default_emoji_names() -> tuple[tuple[str, str], ...]:
    """(emoji, name) for every named code point of the emoji block, by rule from Unicode names."""
    out = []
    for cp in range(EMOJI_FIRST, EMOJI_LAST + 1):
        name = unicodedata.name(chr(cp), None)
        if name:
            out.append((chr(cp), name.lower().replace(" ", "_")))
    return tuple(out)


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(items: list[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def _emoji_name(found: Column, names) -> Column:
    """The name of a found emoji in constant time. Single code points are addressed directly, in pages of 256 code
    points; sequences lie in a table of buckets by the crc32 of their bytes. All tables are folded to literals."""
    single = {ord(k): v for k, v in names if len(k) == 1}
    sequences = {k: v for k, v in names if len(k) > 1}
    name = F.lit(None).cast("string")
    if single:
        first, last = min(single) >> 8, max(single) >> 8
        used = sorted({cp >> 8 for cp in single})
        number = {page: i for i, page in enumerate(used)}
        pages = [_array([_sql_str(single[cp]) if cp in single else "CAST(NULL AS STRING)" for cp in range(page << 8, (page + 1) << 8)]) for page in used]
        of = F.expr(_array([str(number.get(page, -1)) for page in range(first, last + 1)]))
        cp = F.ascii(found)
        page = F.get(of, F.shiftright(cp, 8) - first)
        name = F.get(F.get(F.expr(_array(pages)), page), cp.bitwiseAND(255))
    if sequences:
        buckets: list[dict[str, str]] = [{} for _ in range(1 << (len(sequences) - 1).bit_length())]
        for k, v in sequences.items():
            buckets[zlib.crc32(k.encode()) % len(buckets)][k] = v
        maps = ["CAST(map(" + ", ".join(f"{_sql_str(k)}, {_sql_str(v)}" for k, v in b.items()) + ") AS map<string, string>)" for b in buckets]
        side = F.get(F.expr(_array(maps)), (F.crc32(found.cast("binary")) % len(buckets)).cast("int"))[found]
        name = F.when(F.length(found) > 1, side).otherwise(name)
    return name


def _common_bytes(names) -> bytes:
    """The bytes that every emoji of the dictionary begins with."""
    return os.path.commonprefix([k.encode() for k, _ in names if k])


def emoji_pattern(names) -> str:
    """A regex for the dictionary's keys, the longest first: its sequences one by one, then all its single code
    points as ranges."""
    keys = {k for k, _ in names if k}
    code = lambda c: f"\\x{{{ord(c):X}}}"  # noqa: E731  Java's spelling of a code point
    parts = ["".join(map(code, k)) for k in sorted((k for k in keys if len(k) > 1), key=lambda k: (-len(k), k))]
    single, ranges = sorted(ord(k) for k in keys if len(k) == 1), []
    for cp in single:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    if ranges:
        parts.append("[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]")
    return "|".join(parts)


def replace_emojis(text, names=None) -> Column:
    """Split the text at the dictionary's emojis (single code points and whole sequences, the longest first) and
    put `` name `` in each gap. A text without the bytes that all emojis begin with is let through by a plain byte search;
    others take one regex split and one extract."""
    names = names if names is not None else default_emoji_names()
    t = _c(text)
    pattern = emoji_pattern(names)
    if not pattern:
        return t
    pieces = F.split(t, pattern, -1)
    found = F.regexp_extract_all(t, F.lit(pattern), 0)
    words = F.transform(found, lambda e: F.concat(F.lit(" "), _emoji_name(e, names), F.lit(" ")))
    joined = F.array_join(F.flatten(F.zip_with(pieces, words, lambda p, w: F.array(p, w))), "")
    prefix = _common_bytes(names)
    some = F.contains(t.cast("binary"), F.lit(prefix)) if prefix else t.rlike(pattern)
    return F.when(some, joined).otherwise(t)


def preprocess_text(text, names=None) -> Column:
    return _once(replace_emoticons(text), lambda t: replace_emojis(t, names))


def truncate_words(text, n: int = 512) -> Column:
    """Words that single spaces part are cut off without a regex split; elsewhere the split stops behind the n-th word,
    so the rest of a long text is copied once and never cut up."""
    def cut(t: Column) -> Column:
        parts = F.array_join(F.slice(F.split(t, r"\s+", n + 1), 1, n), " ")
        return F.when(t.rlike(r"[\t\n\x0b\f\r]| \s"), parts).otherwise(F.substring_index(t, " ", n))

    return _once(F.btrim(_c(text), F.lit(" \t\n\x0b\f\r")), cut)


# ---------------------------------------------------------------- DuckDB text (oracle side)

def replace_emoticons_sql(x: str) -> str:
    out = x
    for emo, word in EMOTICONS:
        e = emo.replace("'", "''")
        out = f"replace({out}, '{e}', ' {word} ')"
    return out


def replace_emojis_sql(x: str) -> str:
    """Character by character, without the engine's pattern."""
    m = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in default_emoji_names()) + "}"
    word = f"CASE WHEN ord(c) < 5000 THEN c ELSE coalesce(' ' || map_extract_value({m}, c) || ' ', c) END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: {word}), '')"


def truncate_words_sql(x: str, n: int = 512) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"array_to_string(list_slice(regexp_split_to_array({t}, '\\s+'), 1, {n}), ' ')"
