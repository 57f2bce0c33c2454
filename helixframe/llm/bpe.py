"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge can only ever produce a vocabulary token, so two neighbouring bytes that stand side by side in no token can never
end up in one: between them lies a certain cut. Each pre-token is cut there, the fragments are encoded on their own and
their ids are concatenated; the result is exactly the tokenizer's. Pre-tokens repeat, so their ids are kept in a bounded
table per worker.

Two pre-tokenizers are known: "word" (lower case, white space dropped, word-end suffix) and "byte" (byte-level, a blank
belongs to the word after it). Texts of everyday characters take a fast path; any others are normalised and split by the
library's own components, so that rare characters follow its Unicode tables.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import by_rows

#: Entries of a worker's table of pre-tokens before it becomes the older one.
CACHE_ENTRIES = 250_000
#: Longer pre-tokens are encoded but not kept.
CACHE_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _class(kinds: str, top: int = 0x130) -> str:
    return "".join(f"\\u{c:04x}" for c in range(top) if unicodedata.category(chr(c))[0] in kinds)


#: Characters of the fast path: below U+0130 and some punctuation; no control codes that only one of the two libraries takes for white space.
_RARE = re.compile("[^\x00-\x1b\x20-į‐-―‘-„•…€]")
_END = b"\xff"
_SPACE = r" \t\n\x0b\x0c\r\x85\xa0"
_LETTER, _NUMBER = _class("L"), _class("N")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PATTERN = re.compile(f"{_CONTRACTIONS}|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BYTE_PATTERN = re.compile(f"{_CONTRACTIONS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class ForcedBoundaryEncoder:
    """Encodes and decodes as the tokenizers library does with the given file, unpadded, untruncated, without added specials.

    `specials`: whether strings of special tokens inside texts become their ids, as the library does by default.
    """

    def __init__(self, path: str, specials: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self._library = Tokenizer.from_file(path)
        self.kind = "word" if self.suffix else "byte"
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain special tokens are supported")
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.specials = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.joined_by_blank = spec["decoder"] is None
        self._byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.inside = self._pairs()
        self._core = tiktoken.Encoding("fragments", pat_str=".", mergeable_ranks=self._ranks(), special_tokens={})._core_bpe

    def _ranks(self) -> dict[bytes, int]:
        """The vocabulary as ranks: ids rise in the order of the merges. The word end stands as byte 255, which UTF-8 never holds.

        The single bytes with a word end have the lowest ids after the bytes, so the end joins its byte before any other merge.
        """
        ranks = {}
        for token, i in self.vocab.items():
            body, end = (token[: -len(self.suffix)], _END) if self.suffix and token.endswith(self.suffix) and token != self.suffix else (token, b"")
            if all(c in self._byte_of for c in body):
                ranks[bytes(self._byte_of[c] for c in body) + end] = i
        return {k: i for k, i in ranks.items() if self.tokens[i] not in self.specials}

    def _pairs(self) -> set[tuple[int, int]]:
        """The pairs of bytes that stand side by side inside some token."""
        pairs = set()
        for token in self.vocab:
            body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and token != self.suffix else token
            codes = [self._byte_of[c] for c in body if c in self._byte_of]
            pairs.update(zip(codes, codes[1:]))
        return pairs

    def fragments(self, data: bytes) -> list[bytes]:
        """Cuts at every pair of bytes that no token holds."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(data, data[1:]), 1) if pair not in inside]
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])] if cuts else [data]

    def encode_pretoken(self, pretoken: str) -> list[int]:
        """Ids of one pre-token (not yet in the byte alphabet)."""
        parts = self.fragments(pretoken.encode())
        if self.suffix:
            parts[-1] += _END
        encode = self._core.encode_single_piece
        return encode(parts[0]) if len(parts) == 1 else [i for part in parts for i in encode(part)]

    def merged(self, pretoken: str) -> list[int]:
        """The same ids by one merge of the whole pre-token: cheaper where pre-tokens are short words."""
        data = pretoken.encode()
        return self._core.encode_single_piece(data + _END if self.suffix else data)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, normalised."""
        if not _RARE.search(text):
            return _WORD_PATTERN.findall(text.lower()) if self.kind == "word" else _BYTE_PATTERN.findall(text)
        library = self._library
        if library.normalizer is not None:
            text = library.normalizer.normalize_str(text)
        back = self._byte_of
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[str]:
        """The text, split at special tokens; these stand alone."""
        return [s for s in self._added.split(text) if s] if self._added and self._added.search(text) else [text]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for segment in self.segments(text):
            if segment in self.added:
                ids.append(self.added[segment])
            else:
                for pretoken in self.pretokens(segment):
                    ids += self.encode_pretoken(pretoken)
        return ids

    def looked_up(self, text: str, memo: Memo) -> list:
        """What `memo` has for the pre-tokens and special tokens of a text, in order; specials are asked for as 1-tuples."""
        if self._added is None or not self._added.search(text):
            return list(map(memo.__getitem__, self.pretokens(text)))
        return [x for s in self.segments(text) for x in ([memo[(s,)]] if s in self.added else map(memo.__getitem__, self.pretokens(s)))]

    def ids_for(self, key: str | tuple[str]) -> list[int]:
        """Ids of a pre-token, or of a special token given as a 1-tuple."""
        return [self.added[key[0]]] if isinstance(key, tuple) else self.encode_pretoken(key)

    def decode(self, ids) -> str:
        """Text of the ids, special tokens included; unknown ids are left out, as the library does."""
        tokens = [self.tokens[i] for i in ids if i in self.tokens]
        if self.joined_by_blank:
            return " ".join(tokens)
        back = self._byte_of
        data = b"".join(bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens)
        return data.decode("utf-8", "replace")


class Memo(dict):
    """What `make` gives for a pre-token. The last one or two times CACHE_ENTRIES that were asked for are kept, so that a worker's memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = True) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path, specials)


@lru_cache(maxsize=4)
def _texts(path: str, specials: bool) -> Memo:
    """Of each pre-token: number of ids, the ids in decimal, the decoded tokens."""
    enc = encoder(path, specials)

    def make(key: str | tuple[str]) -> tuple[int, str, str]:
        ids = enc.ids_for(key)
        return len(ids), " ".join(map(str, ids)), enc.decode(ids)

    return Memo(make)


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", specials: bool = True, ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text; one row per row of `docs`, in place (no shuffle).

    Returns key (as `doc_id`), n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 and, with
    `ids`, the ids and the decoded text. A null text counts as empty: no ids, and digests of the empty string. Repeated
    rows and null keys are kept as they are; other columns of `docs` are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(columns: list[list]) -> list[list]:
        enc, memo = encoder(path, specials), _texts(path, specials)
        glue = " " if enc.joined_by_blank else ""
        out: list[tuple] = []
        for value in columns[1]:
            got = enc.looked_up(value or "", memo)
            joined, back = " ".join([x[1] for x in got]), glue.join([x[2] for x in got])
            row = (sum([x[0] for x in got]), sha256(joined.encode()).hexdigest(), sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            out.append(row + (([int(i) for i in joined.split()], back) if ids else ()))
        return [columns[0], *map(list, zip(*out, strict=True))]

    return by_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, schema)
