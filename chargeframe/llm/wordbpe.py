"""Word-level encoding with a public BPE vocabulary whose words never merge across a split.

The vocabulary lower-cases, drops white space and encodes every split word on its
own, so the ids of a text are the ids of its words one after the other. A bounded
table of words already met makes that several times faster than encoding whole
texts. Texts with a special token or with characters outside the plain Latin range
go through the library as they are.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from itertools import filterfalse

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Words kept per Python worker (about 200 bytes each, 350 where texts are decoded too).
CACHE_WORDS = 120_000
#: Words whose counts are kept (about 130 bytes each).
COUNTED_WORDS = 300_000

_PLAIN = "".join(c for c in map(chr, range(0x250)) if c in "\t\n\r" or (c >= " " and c not in "\x7fİ" and not "\x80" <= c <= "\x9f"))
_OTHER = re.compile("[^" + re.escape(_PLAIN) + "]|<\\|")

_PLAIN_ASCII = "".join(filter(str.isascii, _PLAIN)).encode()


def _is_plain(text: str) -> bool:
    """Whether a text has no special token and no character outside the plain Latin range."""
    if text.isascii():
        return "<|" not in text and not text.encode().translate(None, _PLAIN_ASCII)
    return not _OTHER.search(text)


def _class(kind: str) -> str:
    """The characters of a Unicode kind that lower-cased plain text can hold."""
    lowered = {d for c in _PLAIN for d in c.lower()}
    return "".join(sorted(c for c in lowered if unicodedata.category(c)[0] == kind))


#: The vocabulary's own split rule, for plain text.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^\\s{0}{1}]+".format(_class("L"), _class("N")))
#: Ends a text among several: white space to the split rule, and in no plain text.
_END = "\x1f"
_WORD_OR_END = re.compile(_WORD.pattern + "|" + _END)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: a printable
    byte stands for itself, the others follow from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes whole texts; one per Python worker."""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache_words = cache_words
        self._symbols = byte_symbols()
        self._ids: dict[str, bytes] = {}
        self._tokens: dict[str, str] = {}
        self._old_ids, self._old_tokens = self._ids, self._tokens
        self._counts: dict[str, int] = {}

    def library_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str], decoding: bool) -> None:
        """Put the words of one text into the table, which holds them until the next call.

        Their decoded tokens have a table of their own, which is only filled where they are asked for. A table
        with half of the words becomes the old one, from which words met again are taken over."""
        table = self._tokens if decoding else self._ids
        new = set(filterfalse(table.__contains__, words))
        if len(table) + len(new) > self.cache_words // 2:
            self._old_ids, self._old_tokens = self._ids, self._tokens
            self._ids, self._tokens, new = {}, {}, set(words)
        old = self._old_tokens if decoding else self._old_ids
        tokenize, symbols = self.tokenizer.model.tokenize, self._symbols
        for word in new:
            if word in old:
                self._ids[word] = self._old_ids[word]
                if decoding:
                    self._tokens[word] = old[word]
                continue
            # the printable bytes of ASCII stand for themselves
            tokens = tokenize(word if word.isascii() and word.isprintable() else "".join([symbols[b] for b in word.encode()]))
            self._ids[word] = _bytes([t.id for t in tokens])
            if decoding:
                self._tokens[word] = " ".join([t.value for t in tokens])

    def _words(self, text: str, decoding: bool = False) -> list[str] | None:
        if not _is_plain(text):
            return None
        words = _WORD.findall(text.lower())
        self._learn(words, decoding)
        return words

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self._words(text)
        if words is None:
            return np.array(self.library_ids(text), "<u4").tobytes()
        return b"".join(map(self._ids.__getitem__, words))

    def count(self, text: str) -> int:
        """How many ids ``encode`` gives."""
        return int(self.count_all([text])[0])

    def count_all(self, texts: list[str]) -> np.ndarray:
        """How many ids ``encode`` gives for each text; the words of all plain texts are split at once."""
        out, plain = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            if (text.isascii() and text.isprintable() and "<" not in text) or not _OTHER.search(text):
                plain.append(i)
            else:
                out[i] = len(self.library_ids(text))
        if not plain:
            return out
        words, table = _WORD_OR_END.findall(_END.join([texts[i] for i in plain]).lower()), self._counts
        new = set(words).difference(table)
        if len(table) + len(new) > COUNTED_WORDS:
            table = self._counts = {}
            new = set(words)
        tokenize, symbols = self.tokenizer.model.tokenize, self._symbols
        for word in new:
            # the printable bytes of ASCII stand for themselves
            table[word] = len(tokenize(word if word.isascii() and word.isprintable() else "".join([symbols[b] for b in word.encode()])))
        table[_END] = -1
        counts = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        ends = counts < 0
        counts[ends] = 0
        out[plain] = np.bincount(np.cumsum(ends), counts, len(plain))
        return out

    def forget_counts(self) -> None:
        self._counts = {}

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        """Ids as in ``encode``, and the text that the library decodes them to."""
        words = self._words(text, decoding=True)
        if words is None:
            ids = self.library_ids(text)
            return np.array(ids, "<u4").tobytes(), self.decode(ids)
        return b"".join(map(self._ids.__getitem__, words)), " ".join(map(self._tokens.__getitem__, words))

    def decode(self, ids) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
