"""Encoding of a corpus with a public byte-level BPE vocabulary, in batched numpy merge rounds.

A slice of texts of at most ``SLICE_BYTES`` bytes is worked on as one byte
array: character classes cut it into words, equal words are found by their
packed bytes (compared exactly, never by hash alone), and only words that were
not met before go through the merge rounds.  In a round the symbols of all
these words lie in one flat array; the rank of every adjacent pair is found by
binary search over the sorted pair keys, each word merges its lowest-ranked
pair everywhere it occurs, and words without a pair are done.

Defined ids: an empty and a null text have the empty list; blank text is
encoded like any other; special tokens are never produced, their strings are
ordinary text.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SLICE_BYTES = 1 << 20
#: Words that a worker remembers; beyond it starts anew (a bound on memory, not on what is encoded).
REMEMBERED_WORDS = 300_000
#: Symbols of a long word that are looked at together; a word of more than two stretches is worked on by itself.
STRETCH = 256
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_NO_RANK = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class Vocabulary:
    """Byte ids and ranked pairs of a vocabulary file, the pairs as sorted keys for binary search."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], dtype=np.int64)
        new = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.new_ids = keys[order], order.astype(np.int64), new[order]
        self.by_rank = new
        # what each id stands for: its bytes in one pool
        spelt = sorted((i, bytes(letters[c] for c in word)) for word, i in ids.items() if all(c in letters for c in word))
        self.piece_size = np.zeros(max(ids.values()) + 1, np.int64)
        self.piece_size[[i for i, _ in spelt]] = [len(b) for _, b in spelt]
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.pieces = np.frombuffer(b"".join(b for _, b in spelt), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts one after the other, where each of them ends) of flat ids and the number of ids of each text."""
        sizes = self.piece_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        return self.pieces[_gather(self.piece_at[ids], sizes)].tobytes(), ends


_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    global _CLASSES
    if _CLASSES is None:
        first = {"L": _LETTER, "N": _NUMBER}
        _CLASSES = np.full(0x110000, _OTHER, np.uint8)
        # no letter or number is assigned beyond plane 3
        _CLASSES[:0x40000] = np.fromiter((first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x40000)), np.uint8, 0x40000)
        # White_Space of the Unicode character database
        for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            _CLASSES[c] = _SPACE
    return _CLASSES


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, class) of every character of UTF-8 bytes."""
    table = _classes()
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    kind = table[lead]
    (wide,) = np.nonzero(lead >= 0x80)
    if len(wide):
        p, b = at[wide], lead[wide].astype(np.int64)
        follow = [data[np.minimum(p + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        code = np.where(
            b < 0xE0, (b & 0x1F) << 6 | follow[0],
            np.where(b < 0xF0, (b & 0x0F) << 12 | follow[0] << 6 | follow[1], (b & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]),
        )
        kind[wide] = table[np.minimum(code, 0x10FFFF)]
    return at, kind


def word_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Byte positions where a word of the pre-tokenizer begins.

    Words are: an apostrophe with s, t, re, ve, m, ll or d; runs of letters,
    of numbers or of other signs, each with one space before it; white space,
    whose last character stands alone where more text follows.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    at, kind = _characters(data)
    n = len(at)
    first = np.zeros(n, dtype=bool)
    first[np.searchsorted(at, text_starts[text_starts < len(data)])] = True
    run = first.copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last character of white space before more text of the same document
    before = np.flatnonzero(run[1:] & ~first[1:] & (kind[:-1] == _SPACE))
    start[before] = True
    start[before[data[at[before]] == 0x20] + 1] = False
    # contractions: a lone apostrophe that no space precedes
    (quote,) = np.nonzero((data[at] == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one = data[at[quote + 1]]
        two_at = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[two_at], data[at[two_at]], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        for chosen, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[chosen + 1] = False
            rest = chosen + size
            rest = rest[rest < n]
            # letters that go on after the contraction begin a word; anything else does so already
            start[rest[(kind[rest] == _LETTER)]] = True
    return at[start]


def _ranks(left: np.ndarray, right: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The rank of each pair of symbols, by binary search over the sorted pair keys."""
    key = left << 20 | right
    slot = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
    return np.where(vocabulary.keys[slot] == key, vocabulary.ranks[slot], _NO_RANK)


def _every_second(at: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Of hits in a row (``joined``: a hit overlaps the one before it) every second one, from the left."""
    if not joined.any():
        return at
    row = np.concatenate(([True], ~joined))
    row_start = np.maximum.accumulate(np.where(row, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - row_start) % 2 == 0]


def merge_stretches(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The ids of one long word: rounds that touch only the stretches with the lowest-ranked pair.

    The lowest rank of each stretch is kept; a round looks at those of all
    stretches and, in those that hold the lowest of all, merges it and finds
    the ranks of the pairs beside it anew.
    """
    n = len(symbols)
    stretches = -(-n // STRETCH)
    flat = symbols.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ranks = np.full(stretches * STRETCH, _NO_RANK)
    ranks[: n - 1] = _ranks(flat[:-1], flat[1:], vocabulary)
    by_stretch = ranks.reshape(stretches, STRETCH)
    lowest = by_stretch.min(axis=1)
    alive = np.ones(n, dtype=bool)
    while (low := lowest.min()) != _NO_RANK:
        (holding,) = np.nonzero(lowest == low)
        row, column = np.nonzero(by_stretch[holding] == low)
        at = holding[row] * STRETCH + column
        at = _every_second(at, after[at[:-1]] == at[1:])
        gone = after[at]
        alive[gone] = False
        ranks[gone] = _NO_RANK
        flat[at] = vocabulary.by_rank[low]
        after[at] = after[gone]
        next_ = after[at]
        inside = next_ < n
        before[next_[inside]] = at[inside]
        left = before[at]
        changed = np.concatenate((at, left[left >= 0]))
        right = after[changed]
        ranks[changed] = np.where(right < n, _ranks(flat[changed], flat[np.minimum(right, n - 1)], vocabulary), _NO_RANK)
        touched = np.unique(np.concatenate((changed, gone)) // STRETCH)
        lowest[touched] = by_stretch[touched].min(axis=1)
    return flat[alive].astype(np.int32)


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of words given as one flat array of byte ids and their lengths."""
    n_words = len(lengths)
    done_ids: list[np.ndarray] = []
    done_word: list[np.ndarray] = []
    word = np.repeat(np.arange(n_words), lengths)
    flat = symbols.astype(np.int64)
    long = lengths > 2 * STRETCH
    if long.any():
        ends = np.cumsum(lengths)
        for w in np.flatnonzero(long):
            done_ids.append(merge_stretches(symbols[ends[w] - lengths[w] : ends[w]], vocabulary).astype(np.int64))
            done_word.append(np.full(len(done_ids[-1]), w))
        short = ~long[word]
        flat, word = flat[short], word[short]
    while len(flat):
        same = np.empty(len(flat), dtype=bool)
        same[:-1] = word[1:] == word[:-1]
        same[-1] = False
        rank = np.full(len(flat), _NO_RANK)
        (left,) = np.nonzero(same)
        rank[left] = _ranks(flat[left], flat[left + 1], vocabulary)
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(begins, len(flat)))
        lowest = np.minimum.reduceat(rank, begins)
        finished = lowest == _NO_RANK
        if finished.any():
            out = np.repeat(finished, sizes)
            done_ids.append(flat[out])
            done_word.append(word[out])
            keep = ~out
            flat, word, rank = flat[keep], word[keep], rank[keep]
            if not len(flat):
                break
            lowest, sizes = lowest[~finished], sizes[~finished]
        hit = rank == np.repeat(lowest, sizes)
        (at,) = np.nonzero(hit)
        at = _every_second(at, np.diff(at) == 1)
        flat[at] = vocabulary.by_rank[rank[at]]
        keep = np.ones(len(flat), dtype=bool)
        keep[at + 1] = False
        flat, word = flat[keep], word[keep]
    if not done_ids:
        return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
    ids, of = np.concatenate(done_ids), np.concatenate(done_word)
    order = np.argsort(of, kind="stable")
    return ids[order].astype(np.int32), np.bincount(of, minlength=n_words)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all given stretches, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes slices of texts; remembers the words of up to 16 bytes that it has met."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # sorted
        self.low, self.high, self.size = (np.zeros(0, np.uint64) for _ in range(3))
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    @staticmethod
    def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        last = len(data) - 1
        for j in range(16):
            (more,) = np.nonzero(lengths > j)
            if not len(more):
                break
            byte = data[np.minimum(starts[more] + j, last)].astype(np.uint64) << np.uint64(8 * (j % 8))
            if j < 8:
                low[more] |= byte
            else:
                high[more] |= byte
        return low, high

    def _words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, begin and length in the pool of each word)."""
        short = lengths <= 16
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        low, high = self._packed(data, starts[short], lengths[short])
        size = lengths[short].astype(np.uint64)
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + size) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        unique, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        u_low, u_high, u_size = low[first], high[first], size[first]
        clash = (u_low[which] != low) | (u_high[which] != high) | (u_size[which] != size)
        if len(self.hash) > REMEMBERED_WORDS:
            self._forget()
        slot = np.searchsorted(self.hash, unique)
        there = slot < len(self.hash)
        there[there] = self.hash[slot[there]] == unique[there]
        met = there.copy()
        s = slot[there]
        met[there] = (self.low[s] == u_low[there]) & (self.high[s] == u_high[there]) & (self.size[s] == u_size[there])
        new = ~met
        if new.any():
            at = starts[short][first[new]]
            n = u_size[new].astype(np.int64)
            ids, counts = merge_rounds(self.vocabulary.byte_ids[data[_gather(at, n)]], n, self.vocabulary)
            begins = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate((self.ids, ids))
            replaced = np.zeros(len(self.hash), bool)
            replaced[slot[there & new]] = True
            keep = ~replaced
            merged = np.concatenate((self.hash[keep], unique[new]))
            order = np.argsort(merged)
            self.hash = merged[order]
            for name, fresh in (("low", u_low[new]), ("high", u_high[new]), ("size", u_size[new]), ("at", begins), ("count", counts)):
                setattr(self, name, np.concatenate((getattr(self, name)[keep], fresh))[order])
        slot = np.searchsorted(self.hash, unique)
        begin[short], count[short] = self.at[slot][which], self.count[slot][which]
        alone = ~short
        if clash.any():
            alone = alone.copy()
            alone[np.flatnonzero(short)[clash]] = True
        pool = self.ids
        if alone.any():
            n = lengths[alone]
            ids, counts = merge_rounds(self.vocabulary.byte_ids[data[_gather(starts[alone], n)]], n, self.vocabulary)
            begin[alone], count[alone] = len(pool) + np.cumsum(counts) - counts, counts
            pool = np.concatenate((pool, ids))
        return pool, begin, count

    def slice(self, texts: pa.Array, only_counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of texts without nulls."""
        data, offsets = _bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = word_starts(data, offsets[:-1])
        lengths = np.diff(np.append(starts, len(data)))
        pool, begin, count = self._words(data, starts, lengths)
        bounds = np.searchsorted(starts, offsets)
        total = np.concatenate(([0], np.cumsum(count)))
        per_text = total[bounds[1:]] - total[bounds[:-1]]
        return (np.zeros(0, np.int32) if only_counts else pool[_gather(begin, count)]), per_text

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Cuts of a column into slices of at most SLICE_BYTES bytes (one text at least)."""
        _, offsets = _bytes(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield at, end
            at = end


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary: one for all tasks of a worker, so that the words it has met stay."""
    return Encoder(path)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return texts.fill_null("") if texts.null_count else texts


def encode(df: DataFrame, text: str, keys: list[str], path: str = DEFAULT_VOCABULARY, ids: str = "ids") -> DataFrame:
    """``keys`` and the token ids of ``text``; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            column = _filled(batch.column(batch.num_columns - 1))
            for at, end in encoder.slices(column):
                flat, counts = encoder.slice(column.slice(at, end - at))
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                kept = [c.slice(at, end - at) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keys, ids])

    chosen = df.select(*keys, df[text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keys)])
    return chosen.mapInArrow(run, f"{schema}, `{ids}` array<int>")


def count_tokens(df: DataFrame, text: str, keys: list[str], path: str = DEFAULT_VOCABULARY, name: str = "tokens") -> DataFrame:
    """``keys`` and the number of token ids of ``text``; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            column = _filled(batch.column(batch.num_columns - 1))
            counts = [encoder.slice(column.slice(at, end - at), only_counts=True)[1] for at, end in encoder.slices(column)]
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int64())], names=[*keys, name])

    chosen = df.select(*keys, df[text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keys)])
    return chosen.mapInArrow(run, f"{schema}, `{name}` long")


def decode(df: DataFrame, ids: str, keys: list[str], path: str = DEFAULT_VOCABULARY, name: str = "text") -> DataFrame:
    """``keys`` and the text whose ids (a list) are given: the reverse of :func:`encode`, '' for no ids; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(path).vocabulary
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            counts = np.array([n or 0 for n in pc.list_value_length(lists).to_pylist()], np.int64)
            data, ends = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keys, name])

    chosen = df.select(*keys, df[ids])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keys)])
    return chosen.mapInArrow(run, f"{schema}, `{name}` string")
