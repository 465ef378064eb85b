"""Tokenizers over pre-token caches.

Byte-pair merges never cross a pre-token's edge, so a text's tokens are its pre-tokens' tokens in turn, and those of
frequent pre-tokens come from a table. The library itself encodes every pre-token that a table lacks and every text
that could be split differently here and there.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex

#: Code points on which this module's and the library's tables of letters, digits and white space might differ, and white space other than space and line end.
ODD = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0ɐ-\U0010ffff]")
PAIRS = ("  ", "\n\n", " \n", "\n ", "\0")
#: Signs that are a pre-token of their own between a letter and an end.
MARKS = frozenset(".,;:!?")
#: The pre-tokenizer's pattern of byte-level BPE vocabularies; fixed.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries of a worker's cache, which lives as long as the worker's process. A full one keeps what it has; what it lacks is then encoded in each batch anew.
CACHE_MAX = 400_000
IDS_CACHE_MAX = 800_000
#: Texts that are cut at once: their pieces take some ten times their size.
SLICE = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoded(dict):
    """A bounded cache. What it has no room for is in new, for one batch."""

    new: dict = {}

    def __missing__(self, key):
        return self.new[key]

    def add(self, new: dict, most: int) -> None:
        self.new = new
        if len(self) < most:
            self.update(new)


class Pieces(dict):
    """A bounded cache of what make gives. What it has no room for is in new, until that is cleared."""

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.new = make, most, {}

    def __missing__(self, key):
        held = self.new.get(key)
        if held is None:
            held = self.make(key)
            (self if len(self) < self.most else self.new)[key] = held
        return held


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Settings of a tokenizer file under which texts may be cut before spaces and around line ends.
PLAIN = {
    "normalizer": None,
    "truncation": None,
    "padding": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False},
}


def is_plain(path: str) -> bool:
    """Whether a tokenizer file has the settings PLAIN, and no added tokens but special ones that stand for themselves."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    same = all({k: (held.get(name) or {}).get(k) for k in v} == v if isinstance(v, dict) else held.get(name) == v for name, v in PLAIN.items())
    alone = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in held.get("added_tokens", []))
    return same and alone


class ByteLevelIds:
    """Ids that a byte-level BPE file of the tokenizers library gives, without special tokens added, as little-endian unsigned 32-bit integers.

    Texts are cut before spaces and around line ends, all edges of the library's own pattern, and the ids of frequent
    pieces are kept. A piece of letters goes to the library's model, with a sign behind it to the model in two parts, any
    other through the library's pre-tokenizer. Texts with white space side by side are cut by the pattern itself, and
    where the pattern could differ from the library's, or the file has other settings than PLAIN, the library takes the
    whole text."""

    def __init__(self, path: str, cache_max: int = IDS_CACHE_MAX) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = is_plain(path)
        self.model = self.library.model
        if self.plain:
            # Rare pieces only get here; the model's own cache would cost more than it saves.
            getattr(self.model, "_resize_cache", lambda n: None)(0)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.signs = byte_signs()
        self.pieces = Pieces(self._piece, cache_max)
        self.pieces[""] = b""

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        body = piece[piece[0] == " " :]
        if body.isalpha():
            signs = body if body.isascii() else body.encode().decode("latin-1").translate(self.signs)
            return array("I", [t.id for t in self.model.tokenize(self.signs[32] + signs if piece[0] == " " else signs)]).tobytes()
        if body[-1:] in MARKS and body[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.pieces[piece[-1]]
        return self._library([piece])[0]

    def cut(self, text: str) -> list[str] | None:
        if not self.plain or ODD.search(text) or any(x in text for x in self.special):
            return None
        if any(x in text for x in PAIRS):
            return BYTE_LEVEL.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.pieces.__getitem__
        self.pieces.new.clear()
        parts = [self.cut(t) for t in texts]
        whole = iter(self._library([t for t, p in zip(texts, parts) if p is None]))
        return [next(whole) if p is None else b"".join(map(get, p)) for p in parts]


@lru_cache(2)
def byte_level(path: str) -> ByteLevelIds:
    """The worker's own, for all of its tasks."""
    return ByteLevelIds(path)


#: Spaces and what follows them up to the next, or a line end and what follows it.
PIECES = re.compile(" +[^ \n]*|\n[^ \n]*")
SPACE_MARK = "▁"


class PieceLengths:
    """Number of tokens that a sentencepiece BPE model gives a text, by two tables: a given one of frequent pre-tokens' lengths and a worker's own of the others.

    A pre-token is what stands between two single spaces. The model has no piece in which a space mark follows another
    character, and none with a line end (checked on loading), so no merge crosses the edges at which texts are cut."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_max: int = CACHE_MAX) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.cuts = not any("\n" in p or re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces) and self.library.encode(" a  b\nc", out_type=str)[0] == SPACE_MARK
        self.frequent = Encoded(frequent or {})
        self.words = self.frequent.new = Encoded({"": 1})
        self.cache_max = cache_max

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)] if texts else []

    def _spaced(self, text: str) -> int:
        """Of a text with a space in front or with spaces side by side. The library puts a space mark in front, which stands for a piece's first space or, before a line end, is one token more."""
        parts = PIECES.findall(" " + text)
        return sum(n - (p[0] == "\n") for p, n in zip(parts, self._lengths([p[1:] if p[0] == " " else p for p in parts]))) + parts.count(" ")

    def count(self, texts: list[str]) -> list[int]:
        words, frequent = self.words, self.frequent
        plain = [bool(t) and self.cuts and t[0] != " " and "  " not in t and SPACE_MARK not in t for t in texts]
        parts = [t.split(" ") if p else [] for t, p in zip(texts, plain)]
        missing = list(set().union(*parts).difference(frequent).difference(words))
        words.add(dict(zip(missing, self._lengths(missing))), self.cache_max)
        get = frequent.__getitem__
        out = []
        for t, p, own in zip(texts, plain, parts):
            if p:
                out.append(sum(map(get, own)))
            else:
                out.append(self._spaced(t) if t and self.cuts and SPACE_MARK not in t else len(self.library.encode(t)))
        return out


@lru_cache(2)
def piece_lengths(path: str) -> PieceLengths:
    """The worker's own, for all of its tasks."""
    return PieceLengths(path)


def with_frequent(path: str, frequent: dict[str, int]) -> PieceLengths:
    """The worker's own, with a table of frequent pre-tokens for the task at hand."""
    own = piece_lengths(path)
    own.frequent = Encoded(frequent)
    own.frequent.new = own.words
    return own
