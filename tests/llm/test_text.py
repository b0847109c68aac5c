import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import byte_bpe as B
from tesserae.llm import garbling as G
from tesserae.llm import lookalikes as L
from tesserae.llm import queries as Q

WORDS = ["größte", "façade", "été", "Straße", "niño", "берег", "лодка", "вечер", "море", "θάλασσα", "城市", "風景", "mañana", "crème", "řeka", "quiet", "harbor", "lights"]
CORPUS = [f"{a} {b} {i}.jpg" for i, a in enumerate(WORDS) for b in WORDS] * 20


@pytest.fixture(scope="module")
def counts():
    garbled = ["größte".encode().decode("cp1252"), "море".encode("koi8_r").decode("cp1251")]
    return G.PairCounts.of_values([*CORPUS, *[f"{g} {i}.png" for i in range(20) for g in garbled], None, ""])


def damage(text, written, read):
    return text.encode(written).decode(read)


@pytest.mark.parametrize(
    ("text", "written", "read"),
    [("größte", "utf-8", "cp1252"), ("été", "utf-8", "cp850"), ("niño", "utf-8", "mac_roman"), ("берег", "utf-8", "cp1251"), ("řeka", "utf-8", "cp1250"), ("лодка", "koi8_r", "cp1251"), ("море", "cp866", "cp1251"), ("вечер", "cp1251", "cp1252"), ("城市", "gbk", "cp1252"), ("θάλασσα", "cp1253", "cp1252")],
)
def test_round_trips(counts, text, written, read):
    bad = damage(text, written, read)
    assert G.Repairer(counts).value(f"12 {bad} quiet.jpg") == (f"12 {text} quiet.jpg", True)


def test_twice_lower_and_lost(counts):
    r = G.Repairer(counts)
    twice = damage(damage("façade", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert r.value(f"{twice}.jpg") == ("façade.jpg", True)
    assert r.value(damage("façade", "utf-8", "cp1252").lower()) == ("façade", True)
    assert r.value("harborâ€™s")[0] == "harbor’s"
    assert r.value("gr����te") == ("gr����te", False)


@pytest.mark.parametrize("text", [None, "", "plain.jpg", "größte Straße.jpg", "море 12", "JOÃO SÃO", "└──tree", "√2 ±3 €20 №7", "«harbor» quiet", "cоver", "👩‍🚀", "mañana quiet", "城市 été"])
def test_correct_text_is_left(counts, text):
    assert G.Repairer(counts).value(text) is None


def test_segments_against_brute_force():
    import itertools
    import random

    def brute(scores):
        best = max(((sum(scores[i:j]), -i, j) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=(0, 0, 0))
        return best[0]

    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 9))]
        found = G.segments(scores)
        assert all(sum(scores[a:b]) > 0 for a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(sorted(found), sorted(found)[1:], strict=False))
        assert max((sum(scores[a:b]) for a, b in found), default=0) == max(brute(scores), 0)


def test_counts_add_up_by_partition(spark):
    rows = [(t, t[::-1]) for t in CORPUS[:200]] + [(None, ""), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    whole = G.pair_counts([df])
    alone = G.PairCounts.of_values([x for r in rows for x in r])
    assert (whole.rows[0] == alone.rows[0]).mean() > 0.999 and whole.total == pytest.approx(alone.total, rel=0.01)
    assert G.pair_counts([df.limit(0)]).bits("x") < 0


def test_detect_frame(spark, counts):
    bad = damage("größte", "utf-8", "cp1252")
    df = spark.createDataFrame([("files", 1, "n", bad, "x"), ("files", 1, "n", bad, "x"), ("files", 2, "n", None, ""), ("files", 3, "n", "ü" * 100_000, "")], "source_table string, record_id long, field_name string, value string, restored string")
    found = G.detect(spark, df, counts).collect()
    assert [(r["record_id"], r["restored"], r["recovered"]) for r in found] == [(1, "größte", True)] * 2
    assert G.detect(spark, df.limit(0), counts).count() == 0


HOT = [("crème", "utf-8", "cp1252"), ("море", "cp1251", "cp1252"), ("вечер", "utf-8", "cp1251"), ("берег", "koi8_r", "cp1251")]


@pytest.mark.parametrize(("text", "written", "read"), HOT)
@pytest.mark.parametrize("name", ["{0} 12.jpg", "{0} {1}.jpg"])
def test_a_garbled_name_on_a_third_of_rows(spark, text, written, read, name):
    """Neither one value nor a numbered series of them vouches for itself."""
    bad = damage(text, written, read)
    rows = [(v,) for v in [*CORPUS, *[name.format(bad, i) for i in range(len(CORPUS) // 2)]]]
    r = G.Repairer(G.pair_counts([spark.createDataFrame(rows, "v string")]))
    assert r.value(f"{bad} 12.jpg") == (f"{text} 12.jpg", True)
    assert r.value(f"{text} 12.jpg") is None


@pytest.mark.parametrize(("text", "written", "read"), [("blåbärsö", "utf-8", "cp1252"), ("смородина", "utf-8", "cp1251"), ("вечерег", "cp1251", "cp1252")])
def test_unseen_words_on_a_third_of_rows(spark, text, written, read):
    bad = damage(text, written, read)
    rows = [(v,) for v in [*CORPUS, *[f"{bad} {i}.jpg" for i in range(len(CORPUS) // 2)]]]
    r = G.Repairer(G.pair_counts([spark.createDataFrame(rows, "v string")]))
    assert r.value(f"{bad} 12.jpg") == (f"{text} 12.jpg", True)


def test_a_garbled_word_in_many_names(counts):
    """In names of many forms, the form of UTF-8 still tells a wrong reading from the words that hold it."""
    bad = damage("crème", "utf-8", "cp1252")
    many = G.PairCounts.of_values([*CORPUS, *[f"{bad} {w} {v}" for w in WORDS for v in WORDS] * 10])
    assert G.Repairer(many).value(f"{bad} 12.jpg") == ("crème 12.jpg", True)


# --------------------------------------------------------------------------- look-alikes


@pytest.mark.parametrize(
    ("value", "form"),
    [("ｃｏｖｅｒ（１）.jpg", "cover(1).jpg"), ("café", "café"), ("h﻿oll­ow", "hollow"), ("a b c　d", "a b c d"), ("cоvеr", "cover"), ("𝗕𝗼𝗹𝗱 𝚡", "Bold x"), ("kıte", "kite"), ("Uոtіtlеd", "Untitled"), ("blåbɑ̈r", "blåbär"), ("ѕсаո", "scan"), ("ﾠx", "x")],
)
def test_mapped(spark, value, form):
    assert mapped(spark, value, form) == [form, form]


@pytest.mark.parametrize("value", [None, "", "plain\ttab", "берег", "θάλασσα", "сосо", "ağız", "👨‍👩‍👧", "❤️", "№7 ªº ½ ™", "été", "می‌خواهم", "城市", "naïve", "½"])
def test_not_mapped(spark, value):
    assert mapped(spark, value) == [value]


def mapped(spark, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["m"] for r in df.select("i", L.mapped(F.col("v")).alias("m")).orderBy("i").collect()]


LATIN = "aeiouAEIOUnNcCsSzZyYrRlLtTgGdDhHkKwWuU"
MARKS = "\u0300\u0301\u0302\u0303\u0308\u030a\u030c\u0327\u0328\u0323\u0306\u0304"


def test_composed_forms_against_the_library(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice(LATIN) + rng.choice(["", rng.choice(MARKS)]) for _ in range(9)) for _ in range(300)] + [unicodedata.normalize("NFD", "ệ ǖ Ấn Độ й ё ά 각"), "e" * 50_000 + "\u0301", "\u0301x"]
    for text, form in zip(texts, mapped(spark, *texts), strict=True):
        if not any(c in L.LOOKS_LATIN for c in unicodedata.normalize("NFD", text)):
            assert form == unicodedata.normalize("NFC", text)


def test_clean_members_of_a_class_are_no_cases(spark, counts):
    rows = [("Love ♥",), *[("Love ♥️",)] * 3, ("محمد",), *[("مـحمد",)] * 2, ("क्‍ष",), ("naïve",), ("Love\u00a0♥️",), ("naïve",), ("nai\u0308ve",), (None,), ("",)]
    df = spark.createDataFrame([("files", i, "n", *r, "x") for i, r in enumerate(rows)], "source_table string, record_id long, field_name string, value string, mapped string")
    found = {r["record_id"]: r["canonical"] for r in L.cases(spark, df, counts).collect()}
    assert found == {9: "Love ♥", 11: "naïve"}
    one = {r["record_id"]: r["canonical"] for r in L.canonical(spark, df, counts).collect()}
    assert {one[i] for i in (0, 1, 2, 3, 9)} == {"Love ♥"} and len({one[i] for i in (4, 5, 6)}) == 1 and one[7] == "क्‍ष" and 12 not in one and one[13] == ""
    assert L.cases(spark, df.limit(0), counts).isEmpty()


def test_canonical_frame(spark, counts):
    bad = damage("größte", "utf-8", "cp1252") + " x"
    rows = [("files", 1, "n", "cоver.jpg"), ("files", 2, "n", "cover.jpg"), ("files", 3, "n", "café"), ("files", 4, "n", "café"), ("files", 5, "n", bad), ("files", 6, "n", None), ("files", 7, "n", "берег​"), ("files", 8, "n", "берег"), ("files", 9, "n", "Ω")]
    df = spark.createDataFrame(rows, "source_table string, record_id long, field_name string, value string")
    got = {r["record_id"]: r["canonical"] for r in L.canonical(spark, df, counts).collect()}
    assert got == {1: "cover.jpg", 2: "cover.jpg", 3: "café", 4: "café", 5: bad, 7: "берег", 8: "берег", 9: "Ω"}
    assert all(unicodedata.is_normalized("NFC", v) for k, v in got.items() if k != 9)
    assert L.canonical(spark, df.limit(0), counts).count() == 0


# --------------------------------------------------------------------------- byte BPE

HARD = ["it's we've  we're I'LL 's 't 'dog ''s x's\n's  's", "a" * 50 + " " * 7 + "\n\n \t x", "", " ", "\n", "naïve café x　日本語 👩‍🚀 ٣٤ ½ ²", "x" * 400 + "aaaaaaa", "don't'll've", "'", "a'", "\x00\x00a\x00", "<|endoftext|>", "tab\t\tend ", "123 4567,89", " x y", "-" * 300, "ß" * 99]


def test_ids_equal_the_library():
    library = Tokenizer.from_file(B.DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    encoder = B.Encoder()
    flat, n = encoder.slice(pa.array(HARD))
    ids, at = flat.tolist(), 0
    for text, k in zip(HARD, n.tolist(), strict=True):
        assert ids[at : at + k] == library.encode(text, add_special_tokens=False).ids, text
        at += k
    assert encoder.slice(pa.array(HARD), only_counts=True)[1].tolist() == n.tolist()
    again, _ = encoder.slice(pa.array(HARD))  # now from memory
    assert again.tolist() == ids


def test_random_texts_and_a_small_memory(monkeypatch):
    import random

    monkeypatch.setattr(B, "REMEMBERED_WORDS", 40)
    rng, alphabet = random.Random(3), "ab c\n'st 1.é日 -"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    library, encoder = Tokenizer.from_file(B.DEFAULT_VOCABULARY), B.Encoder()
    for i in range(0, 300, 20):
        flat, n = encoder.slice(pa.array(texts[i : i + 20]))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[i : i + 20]]
        assert flat.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (4, "x" * 300_000, 9), (4, " ", 9)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in B.encode(df, "text", ["doc_id"]).collect()]
    assert got[:3] == [(1, [31373, 995]), (2, []), (3, [])] and got[4] == (4, [220]) and len(got[3][1]) > 1000
    assert B.encode(df.limit(0), "text", ["doc_id"]).count() == 0
    assert [r["tokens"] for r in B.count_tokens(df, "text", ["doc_id"]).collect()] == [len(x) for _, x in got]


def test_queries_named():
    assert {"p1_found", "p2_found", "p3_found", "p5_found", "p6_ids", "p8_found"} <= set(Q.queries())
    assert all(n[0] == "p" and n[1] in "12345678" for n in Q.queries()) and F is not None


GARBLED = [damage(w, "utf-8", r) for w, r in (("größte", "cp1252"), ("façade", "mac_roman"), ("берег", "cp1251"), ("řeka", "cp1250"))] + [damage("лодка", "koi8_r", "cp1251"), damage("вечер", "cp1251", "cp1252"), damage("城市", "gbk", "cp1252"), damage("hôtel", "cp437", "cp1252")]


@pytest.fixture(scope="module")
def mixed():
    """A corpus of which every garbled word is a part, each less often than the word it was."""
    return [*CORPUS * 3, *[f"hôtel {w} {i}.jpg" for i in range(60) for w in WORDS], *[f"{g} {w}.png" for g in GARBLED for w in WORDS]]


def test_runs_isolate(mixed):
    counts = G.PairCounts.of_values(mixed)
    text = f"{GARBLED[0]} берег größte {GARBLED[5]}.jpg"
    assert [text[a:b] for a, b in G.runs(text, counts)] == [GARBLED[0], GARBLED[5]]
    assert all(counts.suspect(g) for g in GARBLED)
    assert sum(map(counts.suspect, [w for w in WORDS if not w.isascii()])) <= 3


def test_a_full_sketch_isolates_alike(mixed):
    import numpy as np

    sound = G.PairCounts.of_values(mixed, 16)
    cells, rng = sound.rows.copy(), np.random.default_rng(3)
    for row in cells:  # nine cells of ten hold a few pairs of others
        other = rng.random(len(row)) < 0.9
        row[other] += rng.integers(1, 4, int(other.sum()))
    full = G.PairCounts(cells.reshape(-1), 16)
    assert min(full.noise) > 0
    assert all(full.suspect(g) for g in GARBLED)
    assert [G.Repairer(full).value(g) for g in GARBLED] == [G.Repairer(sound).value(g) for g in GARBLED]
    assert [G.Repairer(full).value(w) for w in WORDS] == [None] * len(WORDS)


def test_long_words_in_stretches(monkeypatch):
    import random
    import time

    import numpy as np

    vocabulary, rng = B.Vocabulary(), random.Random(9)
    words = ["a" * 700, "ab" * 500, "".join(rng.choice("etaoinshr") for _ in range(3000)), "".join(rng.choice("aab") for _ in range(2000))]
    symbols = [vocabulary.byte_ids[np.frombuffer(w.encode(), np.uint8)] for w in words]
    lengths = np.array([len(s) for s in symbols])
    ids, counts = B.merge_rounds(np.concatenate(symbols), lengths, vocabulary)
    monkeypatch.setattr(B, "STRETCH", 1 << 20)  # all of them in common rounds
    plain, plain_counts = B.merge_rounds(np.concatenate(symbols), lengths, vocabulary)
    assert ids.tolist() == plain.tolist() and counts.tolist() == plain_counts.tolist()
    monkeypatch.undo()
    began = time.perf_counter()
    many = vocabulary.byte_ids[np.frombuffer("".join(rng.choice("etaoinshrdlu") for _ in range(100_000)).encode(), np.uint8)]
    B.merge_stretches(many, vocabulary)
    assert time.perf_counter() - began < 10


def test_segments_in_linear_time():
    import time

    began = time.perf_counter()
    assert len(G.segments([1.0, -2.0] * 200_000)) == 200_000
    assert G.segments([1.0, -0.5] * 200_000) == [(0, 399_999)]
    assert len(G.segments([-1.0 if i % 3 else 1.5 for i in range(300_000)])) == 100_000
    assert time.perf_counter() - began < 5
