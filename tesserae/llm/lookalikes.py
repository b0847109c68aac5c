"""Text that looks the same but is spelt with other characters.

Each value gets a *mapped* form in SQL: full-width and styled forms become the
plain letter, letters of other scripts that stand inside a Latin word become
the Latin letter they look like, accents are composed, invisible characters go
and every kind of space becomes U+0020.  Words wholly in their own script,
joiners inside an emoji and ordinary symbols stay.  The mapped forms of all
values are then grouped under an accent-sensitive Unicode collation
(`UNICODE`), each class takes one canonical member, and that member is joined
back to every value.  Python sees only values whose form has changed, to leave
out those that are garbled.

Defined results: null has no row, '' is its own form, repeated rows each get a
row, further columns of the input are left out.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .garbling import PairCounts, repairer_of

# Letters that look like a Latin letter, by script.
_BY_SCRIPT = {
    "cyrillic": (
        "а a е e о o р p с c у y х x і i ј j ѕ s һ h ԁ d ԛ q ԝ w ӏ l ѵ v ү y ь b к k п n г r в b м m т t н h "
        "А A В B С C Е E Н H І I Ј J К K М M О O Р P Ѕ S Т T Х X У Y Ү Y Ԛ Q Ԝ W Ӏ I Ѵ V Ԍ G"
    ),
    "greek": (
        "α a ο o ν v ρ p ι i κ k υ u ϲ c ϳ j χ x γ y η n τ t ω w σ o ε e μ u β b "
        "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X Ϲ C Ϳ J"
    ),
    "armenian": "ո n ս u օ o ց g հ h զ q յ j ք p Ս U Օ O Լ L Տ S",
    "cherokee": "Ꭺ A Ᏼ B Ꮯ C Ꭰ D Ꭼ E Ꮐ G Ꮋ H Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꮪ S Ꭲ T Ꮩ V Ꮤ W Ꮓ Z",
    "latin": "ɑ a ɡ g ı i ɩ i ʏ y ɪ i ᴀ a ʙ b ᴄ c ᴅ d ᴇ e ɢ g ʜ h ᴊ j ᴋ k ʟ l ᴍ m ɴ n ᴏ o ᴘ p ʀ r ꜱ s ᴛ t ᴜ u ᴠ v ᴡ w ᴢ z ǀ l",
}
_SCRIPT_OF: dict[str, str] = {}
LOOKS_LATIN: dict[str, str] = {}
for _script, _pairs in _BY_SCRIPT.items():
    _items = _pairs.split()
    for _c, _latin in zip(_items[::2], _items[1::2], strict=True):
        LOOKS_LATIN[_c], _SCRIPT_OF[_c] = _latin, _script
# Lower-case Cyrillic and Greek letters that only resemble a Latin letter in some fonts: never alone a reason to map a word.
_WEAK = frozenset("ькпгвмтнγητωσεμβυκ")

_TURKISH = frozenset("ğşçöüâîûĞŞÇÖÜİ")
_FILLERS = frozenset("͏ᅟᅠㅤﾠ᠎឴឵")
_KEPT_SYMBOLS = frozenset("ªº")
_JOINING = ("Arabic", "Syriac", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Mongolian", "Khmer", "Myanmar", "Tibetan")
#: Accent-sensitive and case-sensitive order of Unicode.
COLLATION = "UNICODE"


def _styled(c: str) -> str | None:
    """The ASCII character of a full-width or styled form, by the form's compatibility decomposition."""
    code = ord(c)
    if 0xFF01 <= code <= 0xFF5E:
        return chr(code - 0xFEE0)
    if 0x1D400 <= code <= 0x1D7FF or 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F149 or 0x2100 <= code <= 0x214F:
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and plain.isalnum() and c not in _KEPT_SYMBOLS:
            return plain
    return None


# --------------------------------------------------------------------------- the map, as expressions of the JVM


def _cls(characters: Iterable[str]) -> str:
    """The inside of a character class of Java's regular expressions."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in characters)


# Blocks that hold spaces, format characters, styled forms or letters with a mark; the rest are ideographs, syllables and unassigned.
_BLOCKS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0xE0000, 0xE0200))


def _tables() -> tuple[dict[str, str], str, dict[str, str], dict[str, str]]:
    """(plain form of styled characters and spaces, invisible characters, look-alike to Latin with accents, letter and mark to letter)."""
    plain: dict[str, str] = {}
    invisible: list[str] = []
    latin, composed = dict(LOOKS_LATIN), {}
    for code in itertools.chain(*_BLOCKS):
        c = chr(code)
        category = unicodedata.category(c)
        if category == "Zs":
            plain[c] = " "
        elif (category == "Cf" or c in _FILLERS) and code not in _VISIBLE_FORMATS:
            invisible.append(c)
        elif styled := _styled(c):
            plain[c] = styled
        elif category[0] == "L" and (parts := unicodedata.decomposition(c)) and parts[0] != "<" and unicodedata.normalize("NFC", c) == c:
            one, *rest = (chr(int(p, 16)) for p in parts.split())
            if rest and unicodedata.category(rest[0]) == "Mn":
                composed[one + rest[0]] = c
                apart = unicodedata.normalize("NFD", c)
                if apart[0] in LOOKS_LATIN and len(form := unicodedata.normalize("NFC", LOOKS_LATIN[apart[0]] + apart[1:])) == 1:
                    latin[c] = form
                    _SCRIPT_OF[c] = _SCRIPT_OF[apart[0]]
    return plain, "".join(invisible), latin, composed


#: Signs of Arabic, Syriac and Kaithi numbers: format characters that are seen.
_VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_PLAIN, _INVISIBLE, _LATIN, _COMPOSED = _tables()
#: Every character that some case of the map replaces or leaves out.
STANDING_IN = frozenset([*_PLAIN, *_INVISIBLE, *_LATIN])
_TAGS = "\\x{e0020}-\\x{e007f}"
_SELECTORS = "\\x{fe00}-\\x{fe0f}"
# One sign beyond the basic plane as it stands: without one Java looks behind by a half of a surrogate pair only.
_WIDE = "\U0001f600"
_EMOJI = "\\p{So}\\p{Sk}\\x{200d}\\x{fe0f}\\x{20e3}" + _WIDE
_JOINED = "".join(f"\\p{{Is{s}}}" for s in _JOINING)
#: Invisible characters with no work to do: not inside an emoji, after a symbol, or in a script that joins its letters.
_IDLE = "|".join((
    f"(?<![0-9#*{_WIDE}[\\P{{ASCII}}&&\\P{{L}}]])[{_SELECTORS}]",
    f"(?<![{_JOINED}])\\x{{200d}}(?![{_EMOJI}])", f"(?<![{_JOINED}{_EMOJI}])\\x{{200d}}",
    f"(?<![{_JOINED}])\\x{{200c}}",
    f"(?<![{_EMOJI}{_TAGS}])[{_TAGS}]",
    f"[{_cls(c for c in _INVISIBLE if c not in chr(0x200C) + chr(0x200D) and not 0xE0020 <= ord(c) <= 0xE007F)}]",
))
_LOOKING = _cls(_LATIN)
_OF = {s: _cls(c for c in _LATIN if _SCRIPT_OF[c] == s) for s in _BY_SCRIPT}
_FOREIGN = "".join(x for s, x in _OF.items() if s != "latin")
_STRONG = _cls(c for c in _LATIN if _SCRIPT_OF[c] != "latin" and unicodedata.normalize("NFD", c)[0] not in _WEAK)
#: A word of Latin letters and stand-ins, not wholly in its own script, with a stand-in that is more than a chance likeness
#: (a dotless i among letters that are Turkish too is none).
_STANDS_IN = (
    "^" + "".join(f"(?![{x}\\p{{M}}]+$)" for s, x in _OF.items() if s != "latin")
    + f"(?=.*[{_LOOKING}])(?:(?=.*[{_FOREIGN}])(?=.*[{_STRONG}A-Za-z])|(?!.*[{_FOREIGN}])(?:(?=.*[{_cls(c for c in _LATIN if _SCRIPT_OF[c] == 'latin' and c != 'ı')}])|(?!.*[{_cls(_TURKISH)}])))"
    + f"[\\p{{IsLatin}}\\p{{M}}{_LOOKING}]+$"
)


# What a look at a value's characters must find before anything else is done, in ranges: format characters, marks, spaces and styled
# forms; blocks with look-alikes; and in these, two adjacent letters of which one is in the block and the other is not.
_BLOCKS_WITH = ("\\x{370}-\\x{3ff}\\x{1f00}-\\x{1fff}", "\\x{400}-\\x{52f}", "\\x{531}-\\x{58f}", "\\x{13a0}-\\x{13ff}\\x{ab70}-\\x{abbf}")
_LATIN_LOOKS = "\\x{131}\\x{1c0}\\x{250}-\\x{2af}\\x{1d00}-\\x{1d7f}\\x{a730}-\\x{a731}"
_HIDDEN = f"[\\p{{Cf}}{_SELECTORS}{_cls(_FILLERS)}]"
_DRESSED = (
    f"[\\p{{Cf}}\\p{{Mn}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{ff01}}-\\x{{ff5e}}\\x{{2100}}-\\x{{214f}}\\x{{24b6}}-\\x{{24e9}}\\x{{1d400}}-\\x{{1d7ff}}\\x{{1f130}}-\\x{{1f149}}{_cls(_FILLERS)}]"
)
_IN_BLOCKS = f"[{''.join(_BLOCKS_WITH)}{_LATIN_LOOKS}]"
_MEETING = "|".join(f"[{b}][\\p{{L}}&&[^{b}]]|(?<=[\\p{{L}}{_WIDE}&&[^{b}]])[{b}]" for b in _BLOCKS_WITH) + f"|[{_LATIN_LOOKS}]"


def _composed(text: Column) -> Column:
    """Letters with a mark that they have a composed form with; only clusters that hold a mark are looked at."""
    # folded to one constant
    pairs = F.map_from_arrays(F.split(F.lit(" ".join(_COMPOSED)), " "), F.split(F.lit(" ".join(_COMPOSED.values())), " "))

    def add(done: Column, mark: Column) -> Column:
        both = F.try_element_at(pairs, F.concat(F.left(done, F.lit(1)), mark))
        return F.when(both.isNotNull(), F.concat(both, F.substr(done, F.lit(2)))).otherwise(F.concat(done, mark))

    cluster = lambda c: F.when(F.char_length(c) == 1, c).otherwise(F.aggregate(F.split(c, ""), F.lit(""), add))
    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(?:\P{Mn}\p{Mn}+|[^\p{Mn}]*[^\p{Mn}](?!\p{Mn})|\p{Mn}+)"), F.lit(0)), lambda c: F.when(c.rlike(r"\A(?s:.)\p{Mn}+\z"), cluster(c)).otherwise(c)), "")
    return whole


def _latin_words(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"(?s)\p{L}[\p{L}\p{Mn}]*|[^\p{L}]+"), F.lit(0))
    told = F.transform(words, lambda w: F.when(w.rlike(_STANDS_IN), F.translate(w, "".join(_LATIN), "".join(_LATIN.values()))).otherwise(w))
    return F.array_join(told, "")


def mapped(value: Column) -> Column:
    """The look-alike-mapped form of a value; the value itself where it holds no case."""
    marks, looks = value.rlike(r"\p{Mn}"), value.rlike(_IN_BLOCKS)
    shown = F.when(value.rlike(_HIDDEN), F.regexp_replace(value, _IDLE, "")).otherwise(value)
    styled = F.translate(shown, "".join(_PLAIN), "".join(_PLAIN.values()))
    form = F.when(marks & looks, _composed(_latin_words(_composed(styled)))).when(marks, _composed(styled)).when(looks, _latin_words(styled)).otherwise(styled)
    # marks are dressed, so letters that meet across one are not looked for
    suspect = value.rlike(_DRESSED) | (looks & value.rlike(_MEETING))
    return F.when((F.octet_length(value) == F.char_length(value)) | ~suspect, value).otherwise(form)


# --------------------------------------------------------------------------- on DataFrames


def map_values(values: DataFrame) -> DataFrame:
    """source_table, record_id, field_name, value, mapped of all values that are not null."""
    return values.select("source_table", "record_id", "field_name", "value").filter(F.col("value").isNotNull()).withColumn("mapped", mapped(F.col("value")))


def _written_so(spark: SparkSession, changed: DataFrame, counts: PairCounts) -> DataFrame:
    """The rows without those that the wrong-encoding operator finds: they are no cases here."""
    shared = spark.sparkContext.broadcast((counts.rows, counts.log_width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = repairer_of(*shared.value)
        for batch in batches:
            sound = [repairer.value(text) is None for text in batch.column("value").to_pylist()]
            yield batch.filter(pa.array(sound, pa.bool_()))

    return changed.mapInArrow(run, changed.schema)


def _class_key(text: Column) -> list[Column]:
    """128 bits of the collation's sort key: equal for texts that it holds equal.

    The sort key is hashed, so grouping compares numbers and not texts.
    """
    spark = SparkSession.active()
    utils = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    collated = utils.expression(F.collate(text, COLLATION)._jc)
    key = type(text)(utils.column(spark._jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(collated)))
    return [F.xxhash64(key).alias("class_1"), F.xxhash64(F.lit(2), key).alias("class_2")]


_CLASS = ["class_1", "class_2"]


def classes(forms: DataFrame) -> DataFrame:
    """class_1, class_2, canonical: the equivalence classes of all mapped forms under the collation that hold more than one form.

    The canonical member is the shortest form, then the smallest in binary
    order, so what a class ignores (a selector after a symbol, a stretching
    sign) is left out, however often it is written.
    """
    keyed = forms.select(*_class_key(F.col("mapped")), "mapped", F.xxhash64("mapped").alias("form"))
    held = keyed.groupBy(*_CLASS).agg(F.min(F.struct(F.char_length("mapped").alias("length"), "mapped")).alias("least"), F.min("form").alias("one"), F.max("form").alias("two"))
    return held.filter("one <> two").select(*_CLASS, F.col("least.mapped").alias("canonical"))


def _settled(rows: DataFrame, found: DataFrame) -> DataFrame:
    joined = rows.select("*", *_class_key(F.col("mapped"))).join(found, _CLASS, "left")
    return joined.withColumn("canonical", F.coalesce("canonical", "mapped")).drop(*_CLASS)


_COLUMNS = ["source_table", "record_id", "field_name", "value", "canonical"]


def cases(spark: SparkSession, values: DataFrame, counts: PairCounts) -> DataFrame:
    """The values that are spelt with other characters, with the canonical member of their class.

    A value that is a member of its class as it stands is no case, whatever
    member stands for the class.
    """
    forms = map_values(values)
    changed = _written_so(spark, forms.filter(F.col("mapped") != F.col("value")), counts)
    return _settled(changed, classes(forms)).filter(F.col("canonical") != F.col("value")).select(_COLUMNS)


def canonical(spark: SparkSession, values: DataFrame, counts: PairCounts) -> DataFrame:
    """Every value that is not null with the canonical member of its class; garbled ones stay as they are."""
    forms = map_values(values)
    changed = _written_so(spark, forms.filter(F.col("mapped") != F.col("value")), counts)
    sound = changed.select("source_table", "record_id", "field_name", F.lit(True).alias("sound"))
    rows = forms.filter(F.col("mapped") == F.col("value"))
    garbled = forms.filter(F.col("mapped") != F.col("value")).join(sound, ["source_table", "record_id", "field_name"], "left_anti")
    as_written = garbled.withColumn("canonical", F.col("value")).select(_COLUMNS)
    return _settled(rows.unionByName(changed), classes(forms)).select(_COLUMNS).unionByName(as_written)
