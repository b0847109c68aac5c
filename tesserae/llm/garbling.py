"""Text that was decoded with the wrong character encoding.

The detector works in three steps, all of them fed by counts over the whole
corpus:

1. every adjacent character pair of every value is counted into a sketch of
   fixed size (``PairCounts``), partition by partition, and the sketches add.
   Values outside ASCII count once, however many rows hold them and whatever
   their numbers are: a wrong reading that is held by many rows is no more
   probable for it;
2. in a word, each pair gets its mutual information under those counts.  A
   pair is held out of the joint count where the corpus holds what it would be
   in another reading more often than itself (two characters, one, or the
   UTF-8 character that it is part of), so garbling that is frequent in a
   corpus cannot vouch for itself.  What the pairs lack in mutual information
   is their score, and the maximum-scoring segments are the runs;
3. only inside those runs, widened to their words, inverse mappings (encode as
   it was read, decode as it was written) are tried, up to three deep.  A
   mapping is accepted when the text it gives is sufficiently more probable
   than the run itself.

A pair of small letters is not held out for one of capitals: text in capitals
whose wrong reading is in small letters has to lack mutual information itself.

Defined results: null and '' are never garbled and are given back as they
are; text without any character above U+007F is never garbled; U+FFFD is
garbled and cannot be recovered (``restored`` is null unless the rest of the
value can be repaired around it, in which case the marks stay).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_WIDTH = 20  # cells per sketch row: 2 ** LOG_WIDTH, whatever the corpus
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_UNIGRAM = 0x1FFFFF  # second "character" of a cell that counts one character
_TOTAL = 0x1FFFFE

# Fixed values: (codec the bytes were read with, codec they were written in).
READ_AS_WRITTEN_IN = (
    ("cp1252", "utf-8"), ("cp1251", "utf-8"), ("cp1250", "utf-8"), ("cp437", "utf-8"),
    ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("gbk", "utf-8"), ("cp932", "utf-8"),
    ("cp1253", "utf-8"), ("cp1254", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "utf-8"), ("cp949", "utf-8"),
    ("big5", "utf-8"),
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "cp1253"),
    ("cp1252", "cp1250"), ("cp1252", "cp1254"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1252", "mac_roman"), ("cp1252", "gbk"), ("cp1252", "cp932"), ("cp1252", "euc_jp"),
    ("cp1252", "cp949"), ("cp1252", "big5"),
    ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("cp1251", "cp1252"),
    ("koi8_r", "cp1251"), ("koi8_r", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8_r"),
    ("cp437", "cp1252"), ("cp437", "cp866"), ("cp437", "cp1251"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("cp1250", "cp1252"), ("cp1250", "cp852"), ("cp1252", "cp852"),
    ("gbk", "cp932"), ("cp932", "gbk"), ("gbk", "big5"), ("big5", "gbk"),
)
_MULTI = {"utf-8", "gbk", "cp932", "euc_jp", "cp949", "big5"}
#: Bits by which a restored run must be more probable than the run as it stands, by the kind of the writing codec.
MARGIN_UTF8, MARGIN_MULTI, MARGIN_SINGLE = 0.0, 10.0, 4.0
#: A pair is improbable below so many bits of (support-discounted) mutual information.
IMPROBABLE_BITS = 1.0
#: Bits that a whole multi-byte sequence is worth as evidence of UTF-8, by its length: bytes in this form are no accident.
SEQUENCE_BITS = {2: 3.0, 3: 24.0, 4: 24.0}
#: The same for dashes, quotes and signs (U+2000 to U+22FF), which corpora hold too rarely to speak for themselves.
PUNCTUATION_BITS = 44.0
#: Share of known pairs that a text restored by other mappings than UTF-8 needs.
KNOWN_SHARE = 0.7
#: Longer words and runs are worked out each time.
REMEMBERED_LENGTH = 64
_SEPARATORS = frozenset(" _-.,()")
_INVISIBLE = frozenset(" ­   　​‌‍⁠﻿")


def _symbols() -> np.ndarray:
    """Code point -> symbol: lower case, one symbol for digits, one for ASCII separators."""
    table = np.arange(0x110000, dtype=np.int64)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    ascii_part = np.arange(128)
    table[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in ascii_part]
    return table


_SYMBOLS: np.ndarray | None = None


def symbols() -> np.ndarray:
    global _SYMBOLS
    if _SYMBOLS is None:
        _SYMBOLS = _symbols()
    return _SYMBOLS


def _cells(a: np.ndarray, b: np.ndarray, log_width: int) -> list[np.ndarray]:
    key = (a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)
    return [((key * np.uint64(m)) >> np.uint64(64 - log_width)).astype(np.int64) for m in _MULTIPLIERS]


def _add(counts: np.ndarray, width: int, log_width: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
    for row, cell in enumerate(_cells(a, b, log_width)):
        np.add.at(counts, row * width + cell, 1 if n is None else n)


def count_pairs(batches: Iterable[pa.RecordBatch], log_width: int) -> Iterator[pa.RecordBatch]:
    """Per partition: the non-zero cells of the pair sketch of all text columns of its batches.

    Values in ASCII are counted straight from the Arrow buffer into a table of
    128 by 128; only the others are looked at as code points.
    """
    width = 1 << log_width
    counts = np.zeros(2 * width, dtype=np.int64)
    small = np.zeros(128 * 128, dtype=np.int64)
    fold = symbols()[:128].astype(np.int32)
    total = 0
    for batch in batches:
        for column in batch.columns:
            column = column.drop_null()
            plain = pc.equal(pc.binary_length(column), pc.utf8_length(column))
            ascii_only = pc.binary_join_element_wise(column.filter(plain), "", " ")
            ascii_only = pa.concat_arrays([pa.array([" "], ascii_only.type), ascii_only])
            offsets = np.frombuffer(ascii_only.buffers()[1], np.int32)
            codes = fold[np.frombuffer(ascii_only.buffers()[2], np.uint8)[: offsets[len(ascii_only)]]]
            small += np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128)
            rest = column.filter(pc.invert(plain)).to_pylist()
            if rest:
                text = " ".join(["", *rest, ""]).encode("utf-32-le", "surrogatepass")
                codes = symbols()[np.frombuffer(text, np.uint32)]
                keep = (codes[:-1] != 32) | (codes[1:] != 32)
                _add(counts, width, log_width, codes[:-1][keep], codes[1:][keep])
                alone = codes[codes != 32]
                _add(counts, width, log_width, alone, np.full(len(alone), _UNIGRAM))
                total += len(codes) - 1
    small[32 * 128 + 32], spaces = 0, small[32 * 128 + 32]
    (pairs,) = np.nonzero(small)
    _add(counts, width, log_width, pairs // 128, pairs % 128, small[pairs])
    alone = small.reshape(128, 128).sum(axis=1)
    alone[32] = 0
    (letters,) = np.nonzero(alone)
    _add(counts, width, log_width, letters, np.full(len(letters), _UNIGRAM), alone[letters])
    _add(counts, width, log_width, np.array([_TOTAL]), np.array([_TOTAL]), np.array([total + int(small.sum()) + int(spaces)]))
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["cell", "n"])


class PairCounts:
    """Counts of adjacent characters, in two hashed rows of fixed width (the smaller of two cells counts)."""

    def __init__(self, counts: np.ndarray, log_width: int) -> None:
        self.log_width, self.width = log_width, 1 << log_width
        self.rows = counts.reshape(2, self.width)
        #: What a cell holds of pairs that merely share it: nothing, until the sketch is half full.
        self.noise = [float(x) for x in np.median(self.rows, axis=1)]
        self.cache: dict[tuple[str, str], tuple[float, float]] = {}
        self.words: dict[str, bool] = {}
        self.total = max(1.0, self._get(_TOTAL, _TOTAL))

    @classmethod
    def of_values(cls, values: Iterable[str | None], log_width: int = LOG_WIDTH) -> PairCounts:
        (out,) = count_pairs([pa.RecordBatch.from_arrays([pa.array(list(values), pa.string())], ["v"])], log_width)
        return cls.of_cells(out.column(0).to_numpy(), out.column(1).to_numpy(), log_width)

    @classmethod
    def of_cells(cls, cells: np.ndarray, n: np.ndarray, log_width: int) -> PairCounts:
        counts = np.zeros(2 << log_width, dtype=np.float32)
        counts[cells] = n
        return cls(counts, log_width)

    def _get(self, a: int, b: int) -> float:
        key = ((a << 21) | b) & 0xFFFFFFFFFFFFFFFF
        shift = 64 - self.log_width
        one, two = (((key * m) & 0xFFFFFFFFFFFFFFFF) >> shift for m in _MULTIPLIERS)
        return max(0.0, float(min(self.rows[0, one] - self.noise[0], self.rows[1, two] - self.noise[1])))

    def pair(self, a: str, b: str) -> tuple[float, float]:
        """(log2 P(b | a), support-discounted mutual information) of two adjacent characters."""
        if (got := self.cache.get((a, b))) is not None:
            return got
        s = symbols()
        x, y = int(s[ord(a)]), int(s[ord(b)])
        both = self._get(x, y)
        one, two = self._get(x, _UNIGRAM) if x != 32 else self.total / 5, self._get(y, _UNIGRAM) if y != 32 else self.total / 5
        p_b = (two + 0.5) / (self.total + 0.5 * 0x110000 / 64)
        log_p = math.log2((both + 2 * p_b) / (one + 2))
        info = 0.0
        if both and not any(self._held_by(form, both) for form in _pair_forms(a, b)):
            info = math.log2(both * self.total / ((one + 1) * (two + 1))) * both / (both + 1)
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[(a, b)] = got = (float(log_p), float(info))
        return got

    def _held_by(self, form: str, both: float) -> bool:
        """Whether the corpus holds a form (one character or two) more often than the pair that may be a wrong reading of it."""
        s = symbols()
        x = int(s[ord(form[0])])
        return self._get(x, int(s[ord(form[1])]) if len(form) > 1 else _UNIGRAM) > both

    def improbable(self, word: str) -> list[tuple[int, int]]:
        """The improbable runs [start, end) of a word: maximum-scoring segments of what its pairs lack in mutual information.

        Both characters of a pair that the corpus holds by chance, not at all,
        or more often in another reading, lack ``IMPROBABLE_BITS``.
        """
        held = [False] * len(word)
        for start, end, char in _utf8_spans(word):
            n = self._get(int(symbols()[ord(char)]), _UNIGRAM)
            for i in range(start, end - 1):
                held[i] |= not word[i + 1].isalpha() or n >= self._get(int(symbols()[ord(word[i])]), int(symbols()[ord(word[i + 1])]))
        scores = []
        for i, (a, b) in enumerate(zip(word, word[1:], strict=False)):
            if a == "�" or b == "�":
                scores.append(2 * IMPROBABLE_BITS)
            elif a < "\x80" and b < "\x80":
                scores.append(-IMPROBABLE_BITS)
            else:
                scores.append(IMPROBABLE_BITS - (0.0 if held[i] else self.pair(a, b)[1]))
        return [(start, end + 1) for start, end in segments(scores)]

    def suspect(self, word: str) -> bool:
        """Whether a word holds an improbable run; remembers a bounded number of short words."""
        if len(word) > REMEMBERED_LENGTH:
            return "�" in word or bool(self.improbable(word))
        if (known := self.words.get(word)) is None:
            if len(self.words) >= 200_000:
                self.words.clear()
            self.words[word] = known = "�" in word or bool(self.improbable(word))
        return known

    def known(self, text: str) -> float:
        """The share of a run's pairs outside ASCII that the corpus holds."""
        pairs = [(a, b) for a, b in zip(" " + text, text + " ", strict=True) if a > "\x7f" or b > "\x7f"]
        s = symbols()
        return sum(self._get(int(s[ord(a)]), int(s[ord(b)])) > 0 for a, b in pairs) / max(1, len(pairs))

    def bits(self, text: str, reader: str | None = None) -> float:
        """log2 of the probability of a run between separators.

        reader: a single-byte codec under which the run is UTF-8; the pairs inside its characters are then held out.
        """
        total, before = 0.0, " "
        table = _ENCODERS.get(reader, {})
        for c in text + " ":
            inside = before > "\x7f" and c > "\x7f" and 0x80 <= table.get(c, 0) <= 0xBF
            total += self._unseen(before, c) if inside else self.pair(before, c)[0]
            before = c
        return total

    def _unseen(self, a: str, b: str) -> float:
        """log2 P(b | a) as if the corpus did not hold the pair."""
        s = symbols()
        one, two = self._get(int(s[ord(a)]), _UNIGRAM), self._get(int(s[ord(b)]), _UNIGRAM)
        return math.log2(2 * (two + 0.5) / (self.total + 0.5 * 0x110000 / 64) / (one + 2))


def _encoders() -> dict[str, dict[str, int]]:
    """For each single-byte reader: character -> byte, with the C1 controls that lenient readers let through."""
    out = {}
    for codec in {read for read, _ in READ_AS_WRITTEN_IN} - _MULTI:
        table = {chr(b): b for b in range(0x80, 0xA0)}
        for b in range(256):
            try:
                table[bytes([b]).decode(codec)] = b
            except UnicodeDecodeError:
                table.setdefault(chr(b), b)
        out[codec] = table
    return out


_ENCODERS = _encoders()
_LEADS = {c for t in _ENCODERS.values() for c, b in t.items() if 0xC2 <= b <= 0xF4 and ord(c) > 127}
_TRAILS = {c for t in _ENCODERS.values() for c, b in t.items() if 0x80 <= b <= 0xBF and ord(c) > 127}
#: For each single-byte reader and writer: character as read -> as written.
_ONE_TO_ONE = [
    {c: out for c, b in _ENCODERS[read].items() if b >= 0x80 and len(out := bytes([b]).decode(written, "ignore")) == 1}
    for read, written in READ_AS_WRITTEN_IN
    if read not in _MULTI and written not in _MULTI
]


def _pair_forms(a: str, b: str) -> Iterator[str]:
    """What two adjacent characters may have been: two characters, or one, under each inverse mapping of a pair by itself."""
    for table in _ONE_TO_ONE:
        one, two = (c if c < "\x80" else table.get(c) for c in (a, b))
        if one and two and (one, two) != (a, b) and not (a.islower() and b.islower() and one.isupper() and two.isupper()):
            yield one + two
    for read, written in READ_AS_WRITTEN_IN:
        if read in _MULTI and a > "\x7f" and b > "\x7f":
            raw = _encode(a + b, read)
        elif read not in _MULTI and written in _MULTI - {"utf-8"}:
            raw = _encode(a + b, read)
        else:
            continue
        if raw is None:
            continue
        if written != "utf-8":
            try:
                yield raw.decode(written)[:2]
            except UnicodeDecodeError:
                pass
            continue
        for at in (0, 1):
            form = raw[at:].decode("utf-8", "ignore")
            if form and ord(form[0]) > 0x7F and len(form[:2].encode()) + at >= 3:
                yield form[:2]


def _utf8_spans(word: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, character) wherever some characters are together one of UTF-8 under a single-byte reader, put to lower case afterwards or not."""
    for variant in dict.fromkeys((word, _upper(word))):
        for table in _ENCODERS.values():
            raw = [table.get(c, 0) if c > "\x7f" else 0 for c in variant]
            for i, lead in enumerate(raw):
                n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if n and i + n <= len(raw) and all(0x80 <= b <= 0xBF for b in raw[i + 1 : i + n]) and (char := bytes(raw[i : i + n]).decode("utf-8", "ignore")):
                    yield i, i + n, char


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence, in linear time (Ruzzo and Tompa, 1999)."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to and including, the nearest one below that began lower
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, low, j = i, before, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
        stack.append((start, i + 1, low, total, j))
    return [(start, end) for start, end, *_ in stack]


_WORD = re.compile("[^ _.,()-]+")


def runs(text: str, counts: PairCounts) -> list[tuple[int, int]]:
    """The words of a value that hold an improbable run."""
    words = [m.span() for m in _WORD.finditer(text)]
    return [(a, b) for a, b in words if not text[a:b].isascii() and counts.suspect(text[a:b])]


def _encode(run: str, codec: str) -> bytes | None:
    if codec in _MULTI:
        try:
            return run.encode(codec)
        except UnicodeEncodeError:
            return None
    table = _ENCODERS[codec]
    try:
        return bytes([table[c] for c in run])
    except KeyError:
        return None


def _plain(text: str) -> bool:
    """No control, private-use or unassigned characters."""
    return all(unicodedata.category(c) not in ("Cc", "Co", "Cn", "Cs") for c in text)


def _upper(run: str) -> str:
    """A run whose wrong reading was put to lower case afterwards, back in the capitals the bytes had."""
    return "".join(u if c > "\x7f" and len(u := c.upper()) == 1 else c for c in run)


_WRITERS: dict[str, list[str]] = {}
for _read, _written in READ_AS_WRITTEN_IN:
    _WRITERS.setdefault(_read, []).append(_written)


def _may_hold_utf8(run: str) -> bool:
    return any(a in _LEADS and b in _TRAILS or a > "\u2e7f" for a, b in zip(run, run[1:], strict=False))


def _sequence_bits(text: str) -> float:
    return sum(
        PUNCTUATION_BITS if "\u2000" <= c <= "\u22ff" else SEQUENCE_BITS[len(c.encode("utf-8"))]
        for c in text
        if c > "\x7f" and c != "\ufffd"
    )


def _decodings(run: str, strict: bool) -> Iterator[tuple[str, float, bool, str | None]]:
    """(text, margin it must win by, whether all of it was recovered, codec that reads the run as UTF-8) of every inverse mapping that applies.

    strict: only whole UTF-8, for runs that hold another problem's dirt."""
    for variant in (run,) if strict and max(run) > "\xff" else dict.fromkeys((run, _upper(run))):
        only_utf8 = strict or variant != run
        utf8 = _may_hold_utf8(variant)
        if only_utf8 and not utf8:
            continue
        for read, writers in _WRITERS.items():
            raw = _encode(variant, read)
            if raw is None:
                continue
            reader = read if variant == run and read not in _MULTI else None
            for written in writers:
                if written == "utf-8" and not utf8 or written != "utf-8" and only_utf8:
                    continue
                try:
                    text = raw.decode(written)
                except UnicodeDecodeError:
                    if written != "utf-8":
                        continue
                    text = raw.decode("utf-8", "replace")
                    lost = text.count("\ufffd")
                    good = sum(c > "\x7f" and c != "\ufffd" and c.isalpha() for c in text)
                    if good > lost and not strict:
                        yield text, MARGIN_UTF8 + 12 * lost - _sequence_bits(text), False, reader
                    continue
                if text == variant or text.isascii() or not _plain(text):
                    continue
                if written == "utf-8":
                    yield text, MARGIN_UTF8 - _sequence_bits(text), True, reader
                elif variant.isupper() and text.islower():  # the letters of one code are the capitals of the other
                    yield text, 0.0, True, None
                else:
                    yield text, MARGIN_MULTI if written in _MULTI else MARGIN_SINGLE, True, None


def _only_dirt(run: str) -> bool:
    """Whether a run is Latin but for spaces, joiners, marks, styled forms and look-alikes: another problem's dirt, not a wrong reading."""
    from .lookalikes import STANDING_IN

    rest = [c for c in run if c not in STANDING_IN and unicodedata.category(c) != "Mn"]
    return len(rest) < len(run) and any(map(str.isalpha, rest)) and all(c.isascii() or unicodedata.name(c, "").startswith("LATIN") for c in rest)


def repair_run(run: str, counts: PairCounts, depth: int = 3) -> tuple[str, bool] | None:
    """(restored text, whether all of it could be recovered) of a garbled run; None where the run is as it was written."""
    best, now = None, counts.bits(run)
    dirt = _only_dirt(run)
    best_gain = 0.0
    for text, margin, whole, reader in _decodings(run, dirt):
        stands = min(now, counts.bits(run, reader)) if reader else now
        gain = counts.bits(text) - stands - margin
        # without the form of UTF-8 to speak for it, or in a run of stand-ins, a text must be made of pairs that the corpus knows
        formed = not dirt and (margin < MARGIN_UTF8 or not whole)
        if gain > best_gain and (formed or counts.known(text) >= KNOWN_SHARE):
            best, best_gain = (text, whole), gain
    if best and depth > 1 and best[1] and not best[0].isascii() and (more := repair_run(best[0], counts, depth - 1)):
        return more
    return best


class Repairer:
    """Repairs values; remembers runs that it has seen (a bounded number)."""

    def __init__(self, counts: PairCounts, remembered: int = 100_000) -> None:
        self.counts, self.remembered, self.seen = counts, remembered, {}

    def run(self, run: str) -> tuple[str, bool] | None:
        if len(run) > REMEMBERED_LENGTH:
            return self._run(run)
        if run not in self.seen:
            if len(self.seen) >= self.remembered:
                self.seen.clear()
            self.seen[run] = self._run(run)
        return self.seen[run]

    def _run(self, run: str) -> tuple[str, bool] | None:
        if "�" in run:
            return run, False
        if fixed := repair_run(run, self.counts):
            return fixed
        parts = _split(run)
        if len(parts) > 1:  # one part may be garbled beside parts that are not
            fixed_parts = [p if p[0] in _SEPARATORS or p.isascii() else self.run(p) for p in parts]
            if any(isinstance(x, tuple) for x in fixed_parts):
                joined = [x if isinstance(x, str) else x[0] if x else p for x, p in zip(fixed_parts, parts, strict=True)]
                return "".join(joined), all(x[1] for x in fixed_parts if isinstance(x, tuple))
        return None

    def value(self, text: str | None) -> tuple[str, bool] | None:
        """(restored, fully recovered) of a garbled value, else None."""
        if not text or text.isascii():
            return None
        out, at, whole, hit = [], 0, True, False
        for start, end in runs(text, self.counts):
            if fixed := self.run(text[start:end]):
                out += [text[at:start], fixed[0]]
                at, hit, whole = end, True, whole and fixed[1]
        return ("".join(out) + text[at:], whole) if hit else None


_KEPT: tuple[object, Repairer] | None = None


def repairer_of(cells: np.ndarray, log_width: int) -> Repairer:
    """The repairer of broadcast counts: one for all tasks of a worker, so that what it has looked up stays."""
    global _KEPT
    if _KEPT is None or _KEPT[0] is not cells:
        _KEPT = cells, Repairer(PairCounts(cells, log_width))
    return _KEPT[1]


def _split(run: str) -> list[str]:
    parts: list[str] = []
    for c in run:
        if parts and (c in _SEPARATORS) == (parts[-1][0] in _SEPARATORS):
            parts[-1] += c
        else:
            parts.append(c)
    return parts


# --------------------------------------------------------------------------- on DataFrames


def _form(column: str):
    """A value without what sets the names of a series apart: case, numbers and separators in ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    numbers = F.regexp_replace(F.translate(F.col(column), upper, lower), "[0-9]+", "0")
    return F.regexp_replace(numbers, r"[\x00-/:-@\[-`{-\x7f]+", " ")


def pair_counts(frames: list[DataFrame], log_width: int = LOG_WIDTH) -> PairCounts:
    """Pair counts over all text columns of all given frames (each frame: only text columns).

    Values in ASCII are counted row by row, the others once for each form
    (:func:`_form`), so no value outside ASCII gains by the rows that hold it.
    What reaches the driver is at most 2 * 2**log_width cells of two longs,
    whatever the size of the corpus.  Empty input gives empty counts.
    """
    plain = [df.select(*[F.when(~not_ascii(c), F.col(c)).alias(c) for c in df.columns]) for df in frames]
    others = [
        df.filter(reduce(lambda a, b: a | b, [not_ascii(c) for c in df.columns])).select(F.explode(F.array(*df.columns)).alias("value")).filter(not_ascii("value"))
        for df in frames
    ]
    forms = reduce(DataFrame.unionAll, others).select(_form("value").alias("form")).distinct()
    counted = [df.mapInArrow(lambda batches: count_pairs(batches, log_width), "cell long, n long") for df in (*plain, forms)]
    summed = reduce(DataFrame.unionAll, counted).groupBy("cell").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    return PairCounts.of_cells(table["cell"].to_numpy(), table["n"].to_numpy(), log_width)


def not_ascii(column: str):
    """Rows that may hold a wrong reading at all: a JVM-side filter before any Python."""
    return F.octet_length(F.col(column)) != F.char_length(F.col(column))


def detect(spark: SparkSession, values: DataFrame, counts: PairCounts) -> DataFrame:
    """Garbled values with their repair.

    values: source_table, record_id, field_name, value (any further columns
    are left out).  Result: these four, ``restored`` (null where nothing could
    be recovered) and ``recovered`` (whether all of it was).
    """
    shared = spark.sparkContext.broadcast((counts.rows, counts.log_width))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = repairer_of(*shared.value)
        for batch in batches:
            keep, restored, recovered = [], [], []
            for i, text in enumerate(batch.column("value").to_pylist()):
                if fixed := repairer.value(text):
                    keep.append(i)
                    restored.append(fixed[0] if fixed[0] != text else None)
                    recovered.append(fixed[1])
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(restored, pa.string()), pa.array(recovered, pa.bool_())],
                names=[*out.schema.names, "restored", "recovered"],
            )

    wanted = values.select("source_table", "record_id", "field_name", "value").filter(not_ascii("value"))
    return wanted.mapInArrow(
        find,
        "source_table string, record_id long, field_name string, value string, restored string, recovered boolean",
    )
