"""Records that are the same apart from formatting: a ledger of canonical keys.

The key of a text ignores white space, letter case, punctuation and the order
of its parts.  Two levels are kept: the *coarse* key (all letters and digits,
sorted) also holds for texts whose white space was left out altogether; the
*fine* key inside it (the words, sorted, and the ending) tells other words and
other digit orders apart.  The ledger counts fine keys in buckets: a batch is
aggregated first (map-side, so a group that holds a third of all rows becomes
one row a task), then full-outer-joined with the ledger on bucket and key;
counts add up and the earliest representative stays.

Fine keys of one coarse key are compared once, on the ledger and not on the
rows: they are one class when the words of one can be put together from the
words of the other, or when the words of both run together to the same letters.

Defined results: null and '' texts, and null values in the columns that must
be equal, are in no class; fully equal rows are copies; the representative is
the smallest id; columns of the input beyond those named are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Conflict, Pointers
from . import overhangs

BUCKETS = 1024
#: A key with at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: A smaller class is never hot: any task can hold it.
HOT_LEAST = 1000
#: Texts of up to so many words are met by all orders of their words, longer ones are compared.
ORDERED = 5
#: Steps in which longer texts are compared by their pieces; what these leave open is settled by ``overhangs``.
SEARCHED = 20_000
_BETWEEN = r"[\p{P}\p{Z}\p{C}\s+~|^=<>$`´¨]+"
_ENDING = r"\.([a-z0-9]{1,5})$"


def keys(df: DataFrame, text: str, row_id: str, equal: list[str], has_ending: bool, source: str, kept: Sequence[str] = ()) -> DataFrame:
    """source_table, id, coarse (a digest of 16 bytes), fine (a hash that tells its spellings apart) and spelling (ending and words) of every row that can have copies, and the columns ``kept``."""
    lower = F.lower(F.col(text))
    ending: Column = F.regexp_extract("_lower", _ENDING, 1) if has_ending else F.lit("")
    stem = F.when(F.length("_ending") > 0, F.expr("left(_lower, length(_lower) - length(_ending) - 1)")).otherwise(F.col("_lower"))
    spaced = F.regexp_replace(F.regexp_replace(stem, _BETWEEN, " "), r"(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})", " ")
    words = F.sort_array(F.array_remove(F.split("_spaced", " "), ""))
    same = [F.col(c).cast("string") for c in equal]
    rows = (
        df.select(F.col(row_id).alias("id"), lower.alias("_lower"), *[s.alias(f"_same{i}") for i, s in enumerate(same)], *[F.col(c).alias(f"_kept_{c}") for c in kept])
        .filter(F.col("_lower") != "")
        .dropna(subset=[f"_same{i}" for i in range(len(same))])
        .withColumn("_ending", ending)
        .withColumn("_spaced", spaced)
        .withColumn("_words", words)
        .withColumn("spelling", F.concat_ws(" ", F.concat(F.lit("."), "_ending"), F.array_join("_words", " ")))
        .withColumn("_letters", F.array_join(F.sort_array(F.split(F.concat(F.array_join("_words", ""), "_ending"), "")), ""))
    )
    scope = [F.lit(source), *[F.col(f"_same{i}") for i in range(len(same))]]
    # a text of punctuation only has no letters; it is compared as it stands
    letters = F.when(F.col("_letters") == "", F.col("_lower")).otherwise(F.col("_letters"))
    spelling = F.when(F.col("_letters") == "", F.col("_lower")).otherwise(F.col("spelling"))
    coarse = F.unhex(F.md5(F.concat_ws("\u0001", *scope, letters)))
    return rows.select(F.lit(source).alias("source_table"), "id", coarse.alias("coarse"), F.xxhash64(spelling).alias("fine"), spelling.alias("spelling"), *[F.col(f"_kept_{c}").alias(c) for c in kept])


_LEDGER = ["bucket", "source_table", "coarse", "fine", "spelling", "copies", "first_id"]
_KEY = ["bucket", "source_table", "coarse", "fine"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("coarse"), F.lit(buckets)).cast("int")


def aggregate(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The ledger of one batch of keyed rows, spread as :func:`update` joins it."""
    return (
        rows.withColumn("bucket", _bucket(buckets))
        .groupBy(*_KEY)
        .agg(F.min("spelling").alias("spelling"), F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .select(*_LEDGER)
    )


def update(ledger: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The ledger after another batch (both as from :func:`aggregate`): counts add up, the earliest representative stays."""
    if ledger is None:
        return batch
    old = ledger.select(*_KEY, *[F.col(c).alias(f"old_{c}") for c in ("spelling", "copies", "first_id")])
    joined = old.join(batch.select(*_LEDGER), _KEY, "full_outer")
    return joined.select(
        *_KEY,
        F.coalesce("old_spelling", "spelling").alias("spelling"),
        (F.coalesce("old_copies", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("copies"),
        F.least("old_first_id", "first_id").alias("first_id"),
    ).select(*_LEDGER)


_SCHEMA = "bucket int, source_table string, coarse binary, fine long, spelling string, copies long, first_id long"


class Ledger:
    """The ledger stored in a shared folder, bucket by bucket.

    A batch joins the buckets that it touches and writes them as a new
    version; one pointer then names the version of every bucket and the
    batches that are in.  So a job that dies leaves the ledger as it was, a
    batch that comes again changes nothing, and of two writers that meet the
    second starts again from the state of the first.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.pointers = Pointers(spark, self.path)

    def _stored(self, content: dict, wanted: set[int] | None = None) -> DataFrame | None:
        of_version: dict[str, list[int]] = {}
        for bucket, version in enumerate(content.get("versions", [])):
            if version and (wanted is None or bucket in wanted):
                of_version.setdefault(version, []).append(bucket)
        read = self.spark.read.schema(_SCHEMA)
        parts = [read.parquet(f"{self.path}/{v}").filter(F.col("bucket").isin(b)) for v, b in of_version.items()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def read(self) -> DataFrame:
        """All entries as they are now."""
        stored = self._stored(self.pointers.latest()[1])
        return self.spark.createDataFrame([], _SCHEMA) if stored is None else stored

    def take(self, rows: DataFrame, batch: str, tries: int = 5) -> bool:
        """Takes the keyed rows of a batch in, once; False where the batch was in already."""
        # at most one small row a bucket
        touched = {r["b"] for r in rows.select(_bucket(self.buckets).alias("b")).distinct().collect()}
        for left in reversed(range(tries)):
            number, content = self.pointers.latest()
            if batch in content.get("batches", []):
                return False
            versions = list(content.get("versions", [""] * self.buckets))
            version = f"v-{uuid.uuid4().hex}"
            merged = update(self._stored(content, touched), aggregate(rows, self.buckets))
            # inside a file by bucket, so that a later batch reads the row groups of its buckets
            merged.sortWithinPartitions("bucket").write.parquet(f"{self.path}/{version}")
            for b in touched:
                versions[b] = version
            try:
                self.pointers.publish({"versions": versions, "batches": [*content.get("batches", []), batch]}, number)
                return True
            except Conflict:
                if not left:
                    raise
        return False


def _composed(whole: list[str], parts: list[str]) -> bool:
    """Whether each word of ``whole`` is some of ``parts`` in a row, all of them used once."""
    if not whole:
        return not parts
    word, seen = whole[0], set()

    def fill(rest: str, left: tuple[str, ...]) -> bool:
        if not rest:
            return _composed(whole[1:], list(left))
        for i, p in enumerate(left):
            if rest.startswith(p) and (state := (rest[len(p) :], tuple(sorted(left[:i] + left[i + 1 :])))) not in seen:
                if fill(*state):
                    return True
                seen.add(state)
        return False

    return fill(word, tuple(parts))


def _without(words: tuple[str, ...], word: str) -> tuple[str, ...]:
    at = words.index(word)
    return words[:at] + words[at + 1 :]


def _pieces(one: tuple[str, ...], two: tuple[str, ...], must: str, budget: list[int]) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """What both sides have left after each shortest piece that both can spell and in which ``one`` uses the word ``must``."""
    # (letters that a side has ahead of the other, whether that is side one, what is left of both, whether the word is in)
    open_ = [(w, True, _without(one, w), two, w == must) for w in dict.fromkeys(one)]
    seen = set()
    while open_ and budget[0] > 0:
        state = open_.pop()
        if state in seen:
            continue
        seen.add(state)
        budget[0] -= 1
        ahead, of_one, left_one, left_two, has = state
        for word in dict.fromkeys(left_two if of_one else left_one):
            if word[0] != ahead[0] or not (ahead.startswith(word) or word.startswith(ahead)):
                continue
            after_one = left_one if of_one else _without(left_one, word)
            after_two = _without(left_two, word) if of_one else left_two
            now_has = has or not of_one and word == must
            if len(word) == len(ahead):
                if now_has:
                    yield after_one, after_two
            elif len(word) < len(ahead):
                open_.append((ahead[len(word) :], of_one, after_one, after_two, now_has))
            else:
                open_.append((word[len(ahead) :], not of_one, after_one, after_two, now_has))


def _runs_alike(one: list[str], two: list[str]) -> bool:
    """Whether both lists of words, each in some order, run together to the same letters.

    The letters then fall into pieces that both sides spell, and the pieces
    may come in any order; so the piece that holds the longest word is taken
    first, and what is left is the same question.  Words that both sides have
    are taken as pieces of their own in these steps; where they are needed as
    parts of others, or the steps run out, :mod:`overhangs` decides.
    """
    common = Counter(one) & Counter(two)
    # (what both sides have left, the word whose pieces are still to be looked for); the last is looked at first
    open_: list[tuple[tuple[str, ...], tuple[str, ...], str]] = [
        (tuple(sorted((Counter(one) - common).elements())), tuple(sorted((Counter(two) - common).elements())), ""),
    ]
    seen, budget = set(), [SEARCHED]
    while open_ and budget[0] > 0:
        state = open_.pop()
        if state in seen:
            continue
        seen.add(state)
        left_one, left_two, must = state
        if must:
            open_ += [(*left, "") for left in _pieces(left_one, left_two, must, budget)]
        elif not left_one or not left_two:
            if left_one == left_two:
                return True
        else:
            open_.append((left_one, left_two, max(left_one, key=len)))
    return (bool(common) or budget[0] <= 0) and overhangs.run_alike(one, two)


def _cut(spelling: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(ending, words, numbers) of a spelling, both sorted; letters and digits are never one word."""
    ending, *words = spelling.split(" ")
    pieces = [p for w in words for p in ((w,) if w.isalpha() else ("".join(g) for _, g in itertools.groupby(w, _is_digit)))]
    return ending, tuple(sorted(p for p in pieces if not _is_digit(p[0]))), tuple(sorted(p for p in pieces if _is_digit(p[0])))


def _is_digit(c: str) -> bool:
    return unicodedata.category(c)[0] == "N"


def _with_ending(ending: str, words: tuple[str, ...], numbers: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words and numbers of a name whose ending is not set off."""
    _, more, digits = _cut(f". {ending[1:]}")
    return tuple(sorted(words + more)), tuple(sorted(numbers + digits))


def _orders(words: tuple[str, ...]) -> set[str]:
    """All ways in which words can run together (at most ``ORDERED`` of them)."""
    return {"".join(p) for p in itertools.permutations(words)}


def _digests(words: tuple[str, ...]) -> set[str | bytes]:
    """The same, long texts by their digests."""
    if sum(map(len, words)) <= 256:
        return _orders(words)
    return {hashlib.blake2b("".join(p).encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in itertools.permutations(words)}


def _gluings(numbers: tuple[str, ...]) -> set[tuple[str, ...]]:
    """All lists of numbers that some numbers (at most ``ORDERED``) can be glued to, themselves included."""
    if not numbers:
        return {()}
    first, rest = numbers[0], numbers[1:]
    out = set()
    for n in range(len(rest) + 1):
        for chosen in itertools.combinations(range(len(rest)), n):
            others = _gluings(tuple(r for i, r in enumerate(rest) if i not in chosen))
            for glued in _orders((first, *(rest[i] for i in chosen))):
                out |= {tuple(sorted((glued, *o))) for o in others}
    return out


class _Classes:
    """Union of the spellings of one coarse key that are the same text.

    Spellings with the same numbers meet under each order in which their
    words can run together, and those with glued numbers under the numbers
    that theirs can be glued to, so the work is in proportion to the
    spellings.  Only texts of more than ``ORDERED`` words are compared with
    the other lists of words one by one.
    """

    def __init__(self, spellings: list[str]) -> None:
        self.parent = list(range(len(spellings)))
        cut = [(i, *_cut(s)) for i, s in enumerate(spellings)]
        endings = {e for _, e, _, _ in cut if e != "."}
        # a name without an ending may hold one that is not set off by a dot
        if endings and any(e == "." for _, e, _, _ in cut):
            cut += [(i, ".", *_with_ending(e, w, n)) for i, e, w, n in cut if e != "."]
        orders = self._orders_of({w for _, _, w, _ in cut})
        held: dict[tuple, int] = {}
        for i, ending, words, numbers in cut:
            for order in orders[words]:
                self._join(i, held.setdefault((ending, order, numbers), i))
        lists = {n for _, _, _, n in cut}
        glued = {n: self._glued(n, lists) for n in lists if len(n) > 1} if len(lists) > 1 else {}
        for i, ending, words, numbers in cut:
            for other in glued.get(numbers, ()):
                for order in orders[words]:
                    if (j := held.get((ending, order, other))) is not None:
                        self._join(i, j)

    @staticmethod
    def _orders_of(lists: set[tuple[str, ...]]) -> dict[tuple[str, ...], set]:
        orders: dict[tuple[str, ...], set] = {w: _digests(w) if len(w) <= ORDERED else {w} for w in lists}
        for long in (w for w in lists if len(w) > ORDERED):
            for other in lists:
                if other != long and (len(other) <= ORDERED or other < long) and _runs_alike(list(long), list(other)):
                    orders[long].add((long, other))
                    orders[other].add((long, other))
        return orders

    @staticmethod
    def _glued(numbers: tuple[str, ...], lists: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
        if len(numbers) <= ORDERED:
            return (_gluings(numbers) & lists) - {numbers}
        return {n for n in lists if len(n) < len(numbers) and _composed(list(n), list(numbers))}

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)


def same_text(one: str, two: str) -> bool:
    """Whether two spellings (ending and words) differ at most in white space that was left out and in order.

    Words may be glued in both texts, each in another place; numbers are
    glued in one of the two at most.
    """
    found = _Classes([one, two])
    return found.root(0) == found.root(1)


def _classes_of(entries: list[dict]) -> list[tuple[bytes, int, int]]:
    """(fine, first_id of its class, copies of its class) for the fine keys of one coarse key."""
    found = _Classes([e["spelling"] for e in entries])
    first: dict[int, int] = {}
    copies: dict[int, int] = {}
    for i, e in enumerate(entries):
        r = found.root(i)
        first[r], copies[r] = min(first.get(r, e["first_id"]), e["first_id"]), copies.get(r, 0) + e["copies"]
    return [(e["fine"], first[found.root(i)], copies[found.root(i)]) for i, e in enumerate(entries)]


def _classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables, keys_, out = [], [], []
        for table, coarse, entries in zip(*(batch.column(c).to_pylist() for c in ("source_table", "coarse", "entries")), strict=True):
            found = _classes_of(entries)
            tables += [table] * len(found)
            keys_ += [coarse] * len(found)
            out += found
        fine, first, copies = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(tables, pa.string()), pa.array(keys_, pa.binary()), *[pa.array(x, pa.int64()) for x in (fine, first, copies)]],
            names=["source_table", "coarse", "fine", "first_id", "copies"],
        )


def classes(ledger: DataFrame) -> DataFrame:
    """source_table, coarse, fine, first_id, copies: each fine key with its class.

    Only coarse keys with several spellings reach Python, and of these only
    the ledger's rows: one for each distinct spelling, however many copies.
    """
    grouped = ledger.groupBy("source_table", "coarse").agg(
        F.count("*").alias("spellings"), F.collect_list(F.struct("fine", "spelling", "copies", "first_id")).alias("entries")
    )
    single = grouped.filter("spellings = 1").select("source_table", "coarse", F.col("entries")[0].alias("e")).select("source_table", "coarse", "e.fine", "e.first_id", "e.copies")
    several = grouped.filter("spellings > 1").select("source_table", "coarse", "entries")
    return single.unionByName(several.mapInArrow(_classify, "source_table string, coarse binary, fine long, first_id long, copies long"))


def records(classed: DataFrame) -> DataFrame:
    """One record a class: source_table, first_id, copies (its rows, the first included)."""
    return classed.groupBy("source_table", "first_id").agg(F.max("copies").alias("copies"))


def members(rows: DataFrame, classed: DataFrame) -> DataFrame:
    """source_table, first_id, copy_id: each row of a class beside its first.

    Classes with at least HOT_SHARE of all rows are at most 1 / HOT_SHARE and
    go by broadcast; their rows are then spread by id through the join for
    the rest, so that no task gets a hot class.
    """
    many = classed.filter(F.col("copies") > 1)
    # of classes with several rows only: a class counts once for each spelling, so this share is a bound from above
    total = many.agg(F.sum("copies")).scalar()
    hot = many.filter((F.col("copies") > HOT_LEAST) & (F.col("copies") >= total * F.lit(HOT_SHARE)))
    hot = hot.select("coarse", "fine", F.col("first_id").alias("hot_first"))
    ids = rows.select("source_table", "id", "coarse", "fine").join(F.broadcast(hot), ["coarse", "fine"], "left")
    # a row of a hot class needs no partner: its key is one that no class has
    spread = ids.withColumn("key", F.when(F.col("hot_first").isNull(), F.col("coarse")).otherwise(F.encode(F.col("id").cast("string"), "utf-8"))).drop("coarse")
    rest = many.select(F.col("coarse").alias("key"), "fine", "first_id")
    found = spread.join(rest, ["key", "fine"], "left").select("source_table", F.coalesce("hot_first", "first_id").alias("first_id"), F.col("id").alias("copy_id"))
    return found.filter(F.col("first_id") < F.col("copy_id"))
