"""Quality rules by tokeniser fertility.

Three public vocabularies measure each whole text, white space included: a byte-level one and
a sentencepiece one give characters per token, the share of byte-fallback tokens (parts of a
character) and the entropy of the tokens, a word-level one characters per token. Bands per script
reject what falls outside; they are wide enough for clean prose of any topic and catch encoded
data, broken text and texts that say the same over and over. In scripts that neither of the first two
vocabularies covers, noise of letters with the lengths of words cannot be told from prose. Every text
is judged where it is read: no shuffle, no state.

A batch of texts is measured at once. No token of the three vocabularies crosses a single space between
two other characters except as the first character of the next token, so each distinct stretch between
such spaces is encoded once, and the tokens of all texts are counted in one sort.
"""

from __future__ import annotations

import base64
import math
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.memory import releasing
from chargeframe.llm.shingles import mix, windows, word_hashes
from chargeframe.llm.wordbpe import encoder, vocabulary_path

#: A byte-level vocabulary for many languages, as ranks.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A sentencepiece vocabulary with byte fallback.
PIECES = "piece_bpe_32k.model"
#: Fewest words; largest share (percent) of words in repeated windows of this many words.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Texts of fewer tokens are too short for the bands.
MIN_TOKENS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


class Band(NamedTuple):
    """What a script accepts. The entropy in bits must reach ``entropy``, or ``spread`` times
    the largest that so few tokens can have. The fields from ``pieces_low`` on are for the sentencepiece
    vocabulary, the last one for the word-level vocabulary."""

    chars_low: float
    chars_high: float
    byte_share: float
    entropy: float
    spread: float
    pieces_low: float
    pieces_byte_share: float
    pieces_entropy: float
    words_low: float


#: Bands per script, between what clean prose of its languages and what noise, encoded data and text read in a
#: wrong encoding measure. "other" are scripts whose letters the sentencepiece vocabulary knows (Devanagari,
#: Bengali, Tamil, Thai, Georgian, Armenian) and all that is no letter of a script named
#: here; for "rare" ones both vocabularies fall back to bytes.
BANDS = {
    "latin": Band(1.5, 9.0, 0.1, 5.2, 0.72, 1.2, 0.1, 5.2, 1.2),
    "accented": Band(0.85, 9.0, 0.3, 4.5, 0.6, 0.8, 0.2, 4.5, 0.6),
    "cyrillic": Band(1.25, 9.0, 0.3, 5.0, 0.6, 1.2, 0.1, 5.0, 0.5),
    "greek": Band(0.8, 9.0, 0.55, 4.5, 0.6, 0.6, 0.2, 3.8, 0.4),
    "semitic": Band(1.0, 9.0, 0.3, 4.5, 0.6, 0.6, 0.2, 3.6, 0.4),
    "cjk": Band(0.65, 3.0, 0.65, 4.0, 0.5, 0.5, 0.6, 4.0, 0.36),
    "other": Band(0.3, 9.0, 1.0, 3.0, 0.4, 0.5, 0.5, 3.8, 0.4),
    "rare": Band(0.25, 9.0, 1.0, 3.0, 0.4, 0.3, 0.93, 3.4, 0.25),
}

#: First code points and the script from there on; None is not counted.
_RANGES = [(0, None), (0x41, "latin"), (0x5B, None), (0x61, "latin"), (0x7B, None), (0xC0, "latin"), (0x250, "other"),
           (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "semitic"), (0x700, "rare"), (0x750, "semitic"),
           (0x780, "rare"), (0x8A0, "semitic"), (0x900, "other"), (0xA00, "rare"), (0xB80, "other"), (0xC00, "rare"), (0xC80, "other"),
           (0xD00, "rare"), (0xE00, "other"), (0xE80, "rare"), (0x10A0, "other"), (0x1100, "cjk"), (0x1200, "rare"), (0x1C80, "cyrillic"),
           (0x1C90, "other"), (0x1E00, "accented"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "cjk"), (0xA000, "rare"), (0xA640, "cyrillic"),
           (0xA6A0, "rare"), (0xA720, "other"), (0xA800, "rare"), (0xAC00, "cjk"), (0xD7A4, "other"), (0xF900, "cjk"), (0xFB00, "other"),
           (0xFB1D, "semitic"), (0xFE00, "other"), (0xFE70, "semitic"), (0xFEFF, "other"), (0xFF66, "cjk"), (0xFFA0, "other"), (0xFFF0, None), (0x10000, "other"), (0x20000, "cjk"),
           (0x40000, "other")]
_SCRIPTS = [*BANDS, None]
_FIRST = np.array([first for first, _ in _RANGES], np.uint32)
_SCRIPT = np.array([_SCRIPTS.index(name) for _, name in _RANGES])
#: Share of the Latin letters from the additional block that makes a text accented.
ACCENTED = 0.05


def script(text: str) -> str:
    """The script of most letters; texts without letters count as Latin."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = dict(zip(_SCRIPTS, np.bincount(_SCRIPT[np.searchsorted(_FIRST, codes, "right") - 1], minlength=len(_SCRIPTS)).tolist()))
    accented = counts.pop("accented")
    counts["latin"] += accented
    del counts[None]
    name = max(counts, key=counts.__getitem__)
    return "accented" if name == "latin" and accented > ACCENTED * counts["latin"] else name


class Measures(NamedTuple):
    chars: float | None = None
    byte_share: float | None = None
    entropy: float | None = None
    n_tokens: int = 0
    pieces_chars: float | None = None
    pieces_byte_share: float | None = None
    pieces_entropy: float | None = None
    n_pieces: int = 0
    words_chars: float | None = None


#: Stretches kept while a task runs (about 200 bytes each), and the longest one kept.
CACHE_STRETCHES, LONGEST_KEPT = 300_000, 48
#: Where a text may be cut. A space may also follow other white space, so texts without a loose one are cut at each.
_CUT, _LOOSE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" \s")
#: What the sentencepiece vocabulary writes for a space; texts with the character itself are not cut.
_MARK = "\u2581"


def _stretches(text: str) -> list[str]:
    """The parts of a text to encode on their own. The first one, which no space precedes, starts with a space to tell it apart."""
    if _MARK in text:
        return [" " + text]
    parts = _CUT.split(text) if text[0] == " " or text[-1] == " " or _LOOSE.search(text) else text.split(" ")
    parts[0] = " " + parts[0]
    return parts


class _Ids:
    """The ids of numbered stretches, one array after the other."""

    def __init__(self) -> None:
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def truncate(self, n: int) -> None:
        self.flat, self.ends = self.flat[:self.ends[n]], self.ends[:n + 1]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches in turn, and how many each has."""
        begin = self.ends[numbers]
        lengths = self.ends[numbers + 1] - begin
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(begin - before, lengths) + np.arange(lengths.sum())], lengths


def _counted(ids: np.ndarray, n_tokens: np.ndarray, is_part: np.ndarray, n_chars: np.ndarray) -> list[tuple]:
    """Characters per token, share of parts, entropy and number of tokens of each text, from the ids of all in turn.

    A text has at least one token, since it has characters other than white space."""
    n, size = len(n_tokens), len(is_part)
    text = np.repeat(np.arange(n, dtype=np.uint32 if n * size < 1 << 32 else np.uint64), n_tokens)
    keys = np.sort(text * text.dtype.type(size) + ids)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    owner = (keys[first] // text.dtype.type(size)).astype(np.int64)
    share = np.diff(np.append(first, len(keys))) / n_tokens[owner]
    entropy = -np.bincount(owner, share * np.log2(share), n)
    parts = np.add.reduceat(is_part[ids].astype(np.int64), np.cumsum(n_tokens) - n_tokens)
    return list(zip((n_chars / n_tokens).tolist(), (parts / n_tokens).tolist(), entropy.tolist(), n_tokens.tolist()))


class Meter:
    """Measures whole texts; one per Python worker."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path or vocabulary_path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.vocabulary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_part, self.token_bytes = np.zeros(max(ranks.values()) + 1, bool), np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.is_part[rank], self.token_bytes[rank] = not _is_text(token), len(token)
        self.pieces, self.words = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES)), encoder()
        byte = {f"<0x{b:02X}>" for b in range(256) if chr(b) not in SPACES}
        self.is_byte = np.array([self.pieces.id_to_piece(i) in byte for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        """Forget all stretches."""
        self.numbers: dict[str, int] = {}
        self.token_ids, self.piece_ids, self.n_words = _Ids(), _Ids(), np.empty(0, np.int64)
        self.words.forget_counts()

    def _learn(self, stretches: set[str]) -> int:
        """Numbers and encodes what is not known; from the number returned on, stretches are too long to be kept."""
        new = [s for s in stretches if s not in self.numbers]
        if len(self.numbers) + len(new) > CACHE_STRETCHES:
            self.clear()
            new = list(stretches)
        joined, alone, long = [], [], []
        for s in new:
            # stretches without a space that white space neither starts nor ends can follow each other in one text
            (long if len(s) > LONGEST_KEPT else alone if " " in s or s[-1].isspace() or s[0].isspace() else joined).append(s)
        kept = len(self.numbers) + len(joined) + len(alone)
        alone += long
        if joined:
            text = " " + " ".join(joined)
            ids = np.asarray(self.vocabulary.encode_to_numpy(text, disallowed_special=()))
            begin = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == ord(" "))
            ends = np.cumsum(self.token_bytes[ids])
            self.token_ids.add(ids, np.diff(np.searchsorted(ends - self.token_bytes[ids], begin), append=len(ids)))
        new = joined + alone
        found = [self.vocabulary.encode_ordinary(s[1:] if s[0] == " " else " " + s) for s in alone]
        for vocabulary, lists in ((self.token_ids, found), (self.piece_ids, self.pieces.encode([s[s[0] == " ":] for s in new], num_threads=1))):
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            vocabulary.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths)
        self.n_words = np.concatenate([self.n_words, self.words.count_all(new)])
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        return kept

    def measure_all(self, texts: list[str], n_chars: list[int]) -> list[Measures]:
        """The measures of whole texts whose characters other than white space are ``n_chars``."""
        some = [i for i, n in enumerate(n_chars) if n]
        out = [Measures()] * len(texts)
        if not some:
            return out
        parts = [_stretches(texts[i]) for i in some]
        kept = self._learn(set(chain.from_iterable(parts)))
        first = np.cumsum([0, *map(len, parts[:-1])])
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(parts)), np.int64)
        chars, n_words = np.array([n_chars[i] for i in some]), np.add.reduceat(self.n_words[numbers], first).tolist()
        measured = []
        for vocabulary, is_part in ((self.token_ids, self.is_part), (self.piece_ids, self.is_byte)):
            ids, lengths = vocabulary.of(numbers)
            measured.append(_counted(ids, np.add.reduceat(lengths, first), is_part, chars))
            vocabulary.truncate(kept)
        self.n_words = self.n_words[:kept]
        while len(self.numbers) > kept:  # the long ones were added last
            self.numbers.popitem()
        for i, tokens, pieces, n in zip(some, *measured, n_words):
            out[i] = Measures(*tokens, *pieces, n_chars[i] / n if n else None)
        return out

    def measure(self, text: str, n_chars: int) -> Measures:
        """The measures of one text."""
        return self.measure_all([text], [n_chars])[0]


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first one included."""
    if len(words) <= size:
        return 0
    codes: dict = {}
    seen = windows(np.array([codes.setdefault(w, len(codes)) for w in words], np.uint64), size)
    ordered = np.sort(seen)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, which, counts = np.unique(seen, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[which] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + size, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def repeated_words_all(words: list[np.ndarray], size: int = WINDOW) -> np.ndarray:
    """``repeated_words`` of several texts, from the hashes of their words."""
    n = np.array([len(w) for w in words])
    first = np.cumsum(n) - n
    flat = np.concatenate(words)
    out = np.zeros(len(words), np.int64)
    if len(flat) < size:
        return out
    text = np.repeat(np.arange(len(words)), n)
    begin = np.flatnonzero(text[size - 1:] == text[:len(flat) - size + 1])
    seen = mix(windows(flat, size)[begin] + mix(text[begin].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(seen)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    at = np.searchsorted(twice, seen)
    hit = begin[twice[np.minimum(at, len(twice) - 1)] == seen]
    steps = np.bincount(hit, minlength=len(flat) + 1) - np.bincount(hit + size, minlength=len(flat) + 1)
    covered = np.cumsum(np.cumsum(steps[:-1]) > 0)
    upto = np.concatenate([[0], covered])
    return upto[first + n] - upto[first]


def _line_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return (len(words), *_line_counts(text), repeated_words(words))


def base_counts_all(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """``base_counts`` of several texts."""
    words = word_hashes([t.encode() for t in texts], lower=False)
    return [(len(w), *_line_counts(t), n) for t, w, n in zip(texts, words, repeated_words_all(words).tolist())]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


def in_band(band: Band, chars: float | None, byte_share: float | None, entropy: float | None, n_tokens: int,
            pieces_chars: float | None = None, pieces_byte_share: float | None = None, pieces_entropy: float | None = None,
            n_pieces: int = 0, words_chars: float | None = None) -> bool:
    """Whether all measures are inside; those of a vocabulary that gave too few tokens do not count."""
    if n_tokens >= MIN_TOKENS and not (band.chars_low <= chars <= band.chars_high and byte_share <= band.byte_share
                                       and entropy >= min(band.entropy, band.spread * math.log2(n_tokens))):
        return False
    return n_pieces < MIN_TOKENS or (band.pieces_low <= pieces_chars <= band.chars_high and pieces_byte_share <= band.pieces_byte_share
                                     and pieces_entropy >= min(band.pieces_entropy, band.spread * math.log2(n_pieces))
                                     and (words_chars is None or band.words_low <= words_chars <= band.chars_high))


_METERS: dict[str | None, Meter] = {}


#: Rows and characters judged at once; a longer text is judged alone, its words one by one.
ROWS, CHARACTERS = 512, 1 << 20


def _judge(text: str | None, meter: Meter, bands: dict[str, Band]) -> tuple:
    return _judge_all([text], meter, bands)[0]


def _judge_all(texts: list[str | None], meter: Meter, bands: dict[str, Band]) -> list[tuple]:
    """A row of counts, verdicts and measures for each text."""
    rows, texts, at = [], [t or "" for t in texts], 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < min(len(texts), at + ROWS) and size + len(texts[upto]) <= CHARACTERS:
            size, upto = size + len(texts[upto]), upto + 1
        part, at = texts[at:upto], upto
        counts = base_counts_all(part) if size <= CHARACTERS else [base_counts(t, t.encode().split()) for t in part]
        for text, count, measured in zip(part, counts, meter.measure_all(part, [c[1] for c in counts])):
            failed, name = base_failed(count[0], count[4]), script(text)
            rows.append((*count, failed, not failed and in_band(bands[name], *measured), name, *measured))
    return rows


def _meter(path: str | None) -> Meter:
    if path not in _METERS:
        _METERS[path] = Meter(path)
    return _METERS[path]


_COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
            ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("script", "string"),
            ("chars_per_token", "double"), ("byte_share", "double"), ("entropy", "double"), ("n_tokens", "long"),
            ("chars_per_piece", "double"), ("piece_byte_share", "double"), ("piece_entropy", "double"), ("n_pieces", "long"),
            ("chars_per_word_token", "double")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def rate(docs: DataFrame, bands: dict[str, Band] | None = None, path: str | None = None,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, measures and verdict of every whole text.

    Returns per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, script and the measures. A null or empty text has no words: it fails
    the base rule, and its measures are null. Rows are judged one by one, so repeated rows
    and null ids each give a row; an empty table gives none; other columns are ignored.
    """
    bands = bands or BANDS

    def run(batches):
        meter = _meter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = list(zip(*_judge_all(part.column(1).to_pylist(), meter, bands)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(found, _COLUMNS))],
                    ["doc_id", *(name for name, _ in _COLUMNS)])
        meter.clear()

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(releasing(run), "doc_id long, " + ", ".join(f"{n} {k}" for n, k in _COLUMNS))


def keep(docs: DataFrame, bands: dict[str, Band] | None = None, path: str | None = None, text: str = "text") -> DataFrame:
    """The rows whose text ``rate`` keeps, with all their columns."""
    bands, at_column = bands or BANDS, docs.columns.index(text)

    def run(batches):
        meter = _meter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array([row[6] for row in _judge_all(part.column(at_column).to_pylist(), meter, bands)], pa.bool_()))
        meter.clear()

    return docs.mapInArrow(releasing(run), docs.schema)
