"""BPE encoding and decoding of whole texts by dynamic programming over prefixes.

For every prefix of a word there is at most one token that can end its BPE encoding.
All tokens that end at a position come from an automaton with suffix links over the
vocabulary (Aho and Corasick's); a token is the right one if the encoding of the prefix before it ends with a token that is
compatible with it: merging over the border would never have come first. The last token
of each prefix is stored, and following the back-pointers gives the ids in linear time,
whatever the length of a word. Compatible pairs and encoded words are remembered per
task, up to fixed numbers.

Each document is a row of its own: no shuffle, one pass, and memory for one Arrow batch.

Defined cases: a null or empty text has no ids, and decodes to an empty text; a special
token's own string inside a text becomes that token's id, as in the library; characters
dropped by the pre-tokenizer give no ids; rows that are repeated, share an id or have
none are encoded each for itself; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_KEPT = 300_000  # encoded stretches remembered per worker
PAIRS_KEPT = 1_000_000  # tested token pairs remembered per worker
# Characters with the White_Space property (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _class(kind: str) -> str:
    """The inside of a character class for a major category, from the Unicode table."""
    runs, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            runs.append((start, c - 1))
            start = None
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in runs)


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, lower-cased words and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.split: dict[int, tuple[int, int]] = {}  # token -> the pair it was merged from
        self.merged: dict[int, int] = {}  # pair -> token
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            token = vocab[self.strings[left] + self.strings[right]]
            self.merged[left << 20 | right] = token
            self.split[token] = (left, right)
            self.rank[token] = rank
        import ahocorasick

        # The automaton reads bytes; a word's last byte is shifted out of the others' range.
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.automaton = ahocorasick.Automaton()
        for string, token in vocab.items():
            if string in self.special:
                continue
            body = string.removesuffix(self.end)
            units = [byte_of[c] for c in body]
            if body != string:
                units[-1] += 256
            self.automaton.add_word("".join(map(chr, units)), len(units) << 20 | token)
        self.automaton.make_automaton()
        letter, number = _class("L"), _class("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+")
        self.white = re.compile(f"[{WHITE}]+")
        self.separators = re.compile("[\x1c-\x1f]")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[str, str, int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two adjacent tokens.

        Both tokens are taken apart along their shared border, always the one whose
        merge came later; of two equal ones the right, since merges of one rank go
        from left to right. If the two pieces at the border form a merge that ranks
        before the merges undone so far, BPE would have joined them first.
        """
        none = len(self.rank)
        limit = none
        while True:
            joined = self.merged.get(left << 20 | right)
            if joined is not None and self.rank[joined] < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.split[left][1]
            else:
                limit, right = b + 1, self.split[right][0]

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        units = word.encode("utf-8")
        text = units[:-1].decode("latin-1") + chr(units[-1] + 256)
        last = [0] * (len(units) + 1)  # length and token that end each prefix
        pairs = self.pairs
        for end, found in self.automaton.iter(text):
            here = end + 1
            if last[here]:
                continue
            start = here - (found >> 20)
            if start:
                before = last[start]
                if not before:
                    continue
                key = (before & 0xFFFFF) << 20 | found & 0xFFFFF
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(key >> 20, key & 0xFFFFF)
                if not fits:
                    continue
            last[here] = found
        out, at = [], len(units)
        while at:
            if not last[at]:
                raise ValueError(f"the vocabulary has no encoding of {word!r}")
            out.append(last[at] & 0xFFFFF)
            at -= last[at] >> 20
        return out[::-1]

    def chunks(self, text: str) -> Iterator[str | int]:
        """Stretches without white space in order, and the ids of special tokens between them."""
        at = 0
        for mark in self.marks.finditer(text):
            yield from self.blanks(self.normal(text[at : mark.start()]))
            yield self.special[mark[0]]
            at = mark.end()
        yield from self.blanks(self.normal(text[at:] if at else text))

    def blanks(self, text: str) -> list[str]:
        # str.split() also parts at the four separators that are not White_Space.
        return self.white.split(text) if self.separators.search(text) else text.split()

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pre-tokens in order, and the ids of special tokens between them."""
        for chunk in self.chunks(text):
            if isinstance(chunk, int):
                yield chunk
            else:
                yield from self.words.findall(chunk)

    @staticmethod
    def normal(text: str) -> str:
        # Every character is lowered by itself: no special form of sigma at a word's end.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text or "") for i in ([p] if isinstance(p, int) else self.word(p))]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def written(self, text: str | None) -> tuple[str, str, int]:
        """The ids and the decoded text of a whole text as strings, and the number of ids."""
        known, ids, tokens, n = self.known, [], [], 0
        for chunk in self.chunks(text or ""):
            found = known.get(chunk)
            if found is None:
                if isinstance(chunk, int):
                    own = [chunk]
                else:
                    own = [i for p in self.words.findall(chunk) for i in self.word(p)]
                if len(known) >= WORDS_KEPT:
                    known.clear()
                found = (" ".join(map(str, own)), self.decode(own), len(own))
                if isinstance(chunk, int) or len(chunk) <= 64:  # bounds the memory of what is kept
                    known[chunk] = found
            if found[2]:
                ids.append(found[0])
                tokens.append(found[1])
                n += found[2]
        return " ".join(ids), " ".join(tokens), n


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One vocabulary per worker process."""
    return WordBpe(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for value in b.column(1):
                x, y, z = bpe.written(value.as_py())
                n.append(z)
                ids.append(sha(x))
                decoded.append(sha(y))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
