"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that stands next to each other inside no vocabulary token can never be merged over, so it is a
certain cut: a word is split at all such pairs, the fragments are merged independently of each other, and
their ids are concatenated. The result equals merging the whole word.

Defined results: a null or empty text has no ids and decodes to the empty string; special tokens in a text
are matched before normalisation, as the vocabulary file says; other input columns pass through unread, and
an output column takes the place of an input column of its name; repeated rows are encoded each, and there are no
ties; very long texts are encoded whole; an empty table gives an empty table. Letters and numbers are those that the
installed tokenizers library knows, also where the Unicode tables of Python are newer.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import extend, worker_cache

CACHE_WORDS = 350_000   # recent words whose ids a worker remembers, and as many older ones
CACHE_CHARS = 64        # longer words are not remembered
#: Characters that str.split() takes for white space and the vocabulary's pattern doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

_NONE = 1 << 60
_LOW = (1 << 20) - 1


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class _Words(dict):
    """Run of characters without white space -> its ids as int32 bytes, filled on demand. When it is full it
    becomes the older generation, from which words in use move back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = array("i", [i for w in self.codec.split(run) for i in self.codec.word_ids(w)]).tobytes()
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[run] = ids
        return ids


@cache
def newer_characters() -> str:
    """Letters and numbers of this Python that are neither for the tokenizers library, whose Unicode tables are
    older. Asked of the library itself, so the two agree whatever is installed."""
    known = regex.compile(r"[\p{L}\p{N}]")
    mine = "".join(c for i in range(0x110000) if not 0xD800 <= i < 0xE000 and known.match(c := chr(i)))
    left = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed").pre_tokenize_str(mine)
    return "".join(piece for piece, _ in left)


@cache
def newer_capitals() -> dict[str, str]:
    """Lower case of the letters that Python's own Unicode tables lack and the tokenizers library folds."""
    known, lower = regex.compile(r"\p{L}"), normalizers.Lowercase().normalize_str
    lacking = [c for i in range(0x110000) if unicodedata.category(c := chr(i)) == "Cn" and known.match(c)]
    return {c: low for c in lacking if (low := lower(c)) != c}


class Codec:
    """A byte-level BPE vocabulary with a word-end suffix, read from a tokenizers JSON file. ``newer``: letters and
    numbers that count as neither; ``capitals``: lower case that ``str.lower`` lacks."""

    def __init__(self, spec: str, newer: str = "", capitals: dict[str, str] | None = None):
        j = json.loads(spec)
        self.lower = str.maketrans(capitals or {})
        self.capital = re.compile("[" + "".join(capitals) + "]") if capitals else None
        self.newer = frozenset(newer)
        #: a private-use character, which is no letter, number or white space, for each of them
        self.plain_sign = dict.fromkeys(map(ord, newer), "\ue000")
        model = j["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        #: (left id, right id) packed -> rank and the id of the joined token, packed
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i << 20 | self.vocab[a + b] for i, (a, b) in enumerate(pairs)}
        self.byte_char = _byte_chars()
        char_byte = {c: b for b, c in enumerate(self.byte_char)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"] if t["special"]}
        self.token = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        #: joins[a, b]: bytes a and b are neighbours inside some token
        joins = np.zeros((256, 256), bool)
        for t in self.vocab:
            if t in self.special:
                continue
            b = [char_byte[c] for c in (t.removesuffix(self.suffix) if self.suffix else t)]
            joins[b[:-1], b[1:]] = True
        self.joins = joins.tobytes()
        self.inner = [self.vocab[c] for c in self.byte_char]
        self.final = [self.vocab[c + self.suffix] for c in self.byte_char]
        pre = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern, self.space = regex.compile(pre), regex.compile(r"\s+")
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = _Words(self)

    def split(self, run: str) -> list[str]:
        """The words of a run of characters without white space."""
        if run.isascii() or self.newer.isdisjoint(run):
            return self.pattern.findall(run)
        return [run[m.start(): m.end()] for m in self.pattern.finditer(run.translate(self.plain_sign))]

    def normalise(self, text: str) -> str:
        """NFC and lower case letter by letter (white space is dropped later, so it needs no folding)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.capital and self.capital.search(text):
                text = text.translate(self.lower)
        return text.lower()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as int32 bytes."""
        if self.special_re is None or "<|" not in text:
            return self._plain(text)
        parts = self.special_re.split(text)
        return b"".join(np.array([self.special[p]], np.int32).tobytes() if i % 2 else self._plain(p)
                        for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        text = self.normalise(text)
        runs = self.space.split(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, runs))

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space, the rule of a vocabulary file without a decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        out: list[int] = []
        begin, joins = 0, self.joins
        for i in range(1, len(raw)):
            if not joins[raw[i - 1] << 8 | raw[i]]:
                out += self._merged([self.inner[x] for x in raw[begin:i]])
                begin = i
        return out + self._merged([*[self.inner[x] for x in raw[begin:-1]], self.final[raw[-1]]])

    def _merged(self, s: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        if len(s) > 40:
            return self._merged_long(s)
        get = self.rank.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(s, s[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            s[i: i + 2] = [best & _LOW]
            del ranks[i]
            if i:
                ranks[i - 1] = get(s[i - 1] << 20 | s[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(s[i] << 20 | s[i + 1], _NONE)
        return s

    def _merged_long(self, s: list[int]) -> list[int]:
        """The same in n log n, through a heap over a linked list."""
        n, get = len(s), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := get(s[i] << 20 | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = r & _LOW, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(s[i] << 20 | s[k])) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[k]))
            if (h := before[i]) >= 0 and (r := get(s[h] << 20 | s[i])) is not None:
                heapq.heappush(heap, (r, h, s[h], s[i]))
        return [x for x in s if x >= 0]


def _codec(spec: tuple) -> Codec:
    held, key = worker_cache("bpe"), (hash(spec[0]), hash(spec[1]))
    if key not in held:
        held.clear()
        held[key] = Codec(*spec)
    return held[key]


def load_spec(path: str) -> str:
    """The vocabulary file's text (a few MB). It is read where the query is built and travels with the tasks,
    so workers need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _spec(path: str) -> tuple:
    """What a ``Codec`` is built from."""
    return load_spec(path), newer_characters(), newer_capitals()


def _ids_array(parts: list[bytes]) -> pa.ListArray:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text``, and with their decoded text too where ``decoded`` names it."""
    spec = df.sparkSession.sparkContext.broadcast(_spec(path))

    def compute(b: pa.RecordBatch) -> list:
        codec = _codec(spec.value)
        parts = [codec.encode(t) if t else b"" for t in b.column(text).to_pylist()]
        out = [_ids_array(parts)]
        if decoded:
            out.append(pa.array([codec.decode(np.frombuffer(p, np.int32)) for p in parts], pa.string()))
        return out

    add = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return extend(df, "bpe", text, add + ([T.StructField(decoded, T.StringType())] if decoded else []), compute)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its id lists (null reads as empty; special tokens are kept)."""
    spec = df.sparkSession.sparkContext.broadcast(_spec(path))

    def compute(b: pa.RecordBatch) -> list:
        codec = _codec(spec.value)
        return [pa.array([codec.decode(np.array(x, np.int32)) if x else "" for x in b.column(ids).to_pylist()], pa.string())]

    return extend(df, "bpe", ids, [T.StructField(out, T.StringType())], compute)
