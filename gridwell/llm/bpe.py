"""Byte-pair encoding without a merge loop, and decoding by an offset table.

The vocabulary's tokens, spelled in the model's first symbols, go into an
Aho-Corasick automaton. Encoding takes the longest token at each place, checks
it against the token before by a table of pairs that may stand side by side
(they may if merging would leave the border between them open), and steps back
to a shorter token where it may not. The result is exactly what merging by rank
gives, in time linear in the text.

Decoding looks up each id's bytes in one blob by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

#: Most words of a generation whose ids a worker remembers.
WORD_CACHE = 120_000
#: Most pairs whose border is remembered.
PAIRS = 150_000
#: Words longer than this aren't remembered.
LONGEST_KEPT = 64


def byte_symbols() -> list[str]:
    """The character that byte-level models show for each byte: printable
    Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """The encoder of one BPE model over strings of symbols.

    ranks: tokens in the order in which merging makes them, the first symbols
    first; halves: the two tokens that each is merged from, or None.
    """

    def __init__(self, spelled: list[str], halves: list[tuple[int, int] | None]):
        self.spelled, self.halves = spelled, halves
        self.sizes = [len(s) for s in spelled]
        self.made = {h: t for t, h in enumerate(halves) if h is not None}
        self.automaton = ahocorasick.Automaton()
        for t, s in enumerate(spelled):
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        of = {s: t for t, s in enumerate(spelled)}
        #: the longest token that is a proper prefix of each, or -1
        self.shorter = [next((of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in of), -1) for s in spelled]
        self.beside: dict[tuple[int, int], bool] = {}

    def border_stays(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between the two tokens open.

        Undoes the latest merge of either side until only first symbols touch
        the border. At each step the pair that touches it must not be one that
        merges before the merge that was undone last.
        """
        known = self.beside.get((left, right))
        if known is not None:
            return known
        a, b, until, ok = left, right, len(self.spelled) + 1, True
        while True:
            joined = self.made.get((a, b))
            if joined is not None and joined < until:
                ok = False
                break
            ha, hb = self.halves[a], self.halves[b]
            if ha is None and hb is None:
                break
            # of two equal ranks the left one is merged first, so the right one is undone first
            if hb is None or (ha is not None and a > b):
                until, a = a, ha[1]
            else:
                until, b = b + 1, hb[0]
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        self.beside[left, right] = ok
        return ok

    def encode(self, text: str) -> list[int]:
        """Ranks of the text's tokens."""
        size = len(text)
        longest = [-1] * size
        sizes, shorter, stays = self.sizes, self.shorter, self.border_stays
        for end, t in self.automaton.iter(text):  # by end, so the longest at a place comes last
            longest[end + 1 - sizes[t]] = t
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at = 0
        token = longest[0] if size else -1
        while at < size:
            if token < 0:  # nothing fits here: the token before must be shorter
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                alive[at] = 0
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
                continue
            end = at + sizes[token]
            if alive[end] and (not out or stays(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                token = shorter[token]
        return out


class Words(dict):
    """word -> its packed ids. Two generations: when one is full, the words
    that were looked up since it began are kept and older ones go."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            symbol = self.bpe.symbol
            packed = self.bpe.packed("".join([symbol[b] for b in word.encode("utf-8")]))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORD_CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class WordBpe:
    """A ``tokenizers`` file of the kind of ``word_bpe_49k.json``: NFC, lower
    case, words by a pattern, byte symbols, the last of a word marked."""

    #: The file's own pattern among the characters of COMMON, in terms that ``re`` knows.
    COMMON_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\t-\r \x85\xa0\u2028\u2029]|_)+")
    LAST = 0x400  # added to a symbol that ends a word
    #: Texts of these characters are normalised and split here. Python and the
    #: library go by other editions of Unicode, so any other text is normalised
    #: and split by the library's own parts.
    COMMON = re.compile("[\0-\u024f\u0386-\u03ce\u0410-\u044f\u2010-\u2027\u20ac\u2122\u3001\u3002\u3041-\u3093\u4e00-\u9fa5]*")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = [a + b for a, b in merges]
        merged = set(made)
        first = [t for t in vocab if t not in merged]
        order = first + made
        rank = {t: i for i, t in enumerate(order)}
        spell = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + self.LAST) if t.endswith(suffix) and t != suffix else t
        self.merges = Merges([spell(t) for t in order], [None] * len(first) + [(rank[a], rank[b]) for a, b in merges])
        self.ids = [vocab[t] for t in order]
        self.symbol = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        texts = {i: t for t, i in (vocab | self.added).items()}
        blobs = [texts.get(i, "").encode() + b" " for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offsets = np.cumsum([0, *map(len, blobs)]).astype(np.int64)
        self.cache = Words(self)
        self.path = path

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def packed(self, symbols: str) -> bytes:
        """The ids of a word in byte symbols."""
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + self.LAST)
        return array("I", [self.ids[t] for t in self.merges.encode(symbols)]).tobytes()

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        get = self.cache.__getitem__
        for k, part in enumerate(self.split.split(text) if self.split and "<|" in text else [text]):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            if not part.isascii():
                if not self.COMMON.fullmatch(part):
                    library = self.library
                    words = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
                    out += [self.packed(w) for w, _ in words]
                    continue
                # capital sigma: letters are lower-cased one by one, wherever they stand
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += map(get, self.COMMON_PIECES.findall(part.lower()))
        return b"".join(out)

    def decode(self, ids: np.ndarray, chunk: int = 1 << 18) -> bytes:
        """The tokens' texts with one space between them, in UTF-8."""
        parts = []
        for k in range(0, len(ids), chunk):
            i = ids[k : k + chunk].astype(np.int64)
            start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
            end = np.cumsum(size)
            parts.append(self.blob[np.repeat(start - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(parts)[:-1]


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, its ids (packed, little-endian) and the decoded text.

    A null text is encoded as an empty one: no ids, an empty decoded text.
    Documents are independent, repeated rows stay, whole texts are encoded in
    time linear in their length, and an empty table stays empty. Other columns
    are not read.
    """
    path = path or default_path()

    def make():
        bpe = word_bpe(path)

        def of(t: str):
            ids = bpe.encode(t)
            return ids, bpe.decode(np.frombuffer(ids, "<u4"))

        return of

    return per_text(docs, [key], text, "ids binary, decoded binary", make)


def digested(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encoded``, with digests in place of ids and decoded texts, which so stay in the worker."""
    path = path or default_path()

    def make():
        bpe = word_bpe(path)

        def of(t: str):
            ids = bpe.encode(t)
            decoded = bpe.decode(np.frombuffer(ids, "<u4"))
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return of

    return per_text(docs, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding, as digests."""
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
