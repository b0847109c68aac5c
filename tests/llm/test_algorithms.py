import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import containers as C
from tesserae.llm import copies as D
from tesserae.llm import heavy_hitters as H
from tesserae.llm import percentiles as P
from tesserae.llm import subjects as S

# --------------------------------------------------------------------------- frequent items


def zipf(n, seed=1):
    rng = random.Random(seed)
    return [None if rng.random() < 0.02 else "" if rng.random() < 0.02 else f"v{int(rng.paretovariate(0.7))}" for _ in range(n)]


def test_lossy_counter_keeps_its_bounds():
    values, c = zipf(30_000), H.LossyCounter(0.002)
    for at in range(0, len(values), 777):
        c.add(pa.array(values[at : at + 777], pa.string()))
    true = Counter(v for v in values if v)
    for item, (n, delta) in c.entries.items():
        assert n <= true[item] <= n + delta
    assert all(n <= c.missed() for v, n in true.items() if v not in c.entries)
    assert len(c.entries) <= 500 * math.log(0.002 * len(values)) + 500


def test_merged_intervals_hold_the_truth(spark):
    values = zipf(20_000)
    df = spark.createDataFrame([(v, "x") for v in values], "a string, n string").repartition(6)
    true = Counter(v for v in values if v)
    for r in H.merge(H.summaries(df, ["a", "n"], 0.002)).collect():
        n = true[r["item"]] if r["field_name"] == "a" else 20_000
        assert r["count_low"] <= n <= r["count_high"] and r["row_count"] == 20_000
    frequent = {r["item"] for r in H.frequent(df, ["a"], 0.01, 0.002).collect()}
    exact = {(r["item"], r["n"]) for r in H.exactly(df, ["a"], H.frequent(df, ["a"], 0.01, 0.002), 0.01).collect()}
    assert exact == {(v, n) for v, n in true.items() if n >= 200} and {v for v, _ in exact} <= frequent
    assert H.top(df, ["a"], 3, 0.002).count() == 3
    assert H.frequent(df.limit(0), ["a"], 0.01, 0.002).count() == 0
    with pytest.raises(ValueError, match="epsilon"):
        H.frequent(df, ["a"], 0.001, 0.002)


# --------------------------------------------------------------------------- percentiles


def test_percentiles_within_their_bounds(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", "g", "hot", "hot", "hot"]), rng.choice([None, 0, rng.randint(-9, 9), rng.randint(0, 10**12), -rng.randint(0, 10**6), 5, 2**62])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "grp string, size long").selectExpr("*", "1 AS n", "2 AS cell").repartition(5)
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    ps = (0.0, 0.1, 0.5, 0.999, 1.0)
    whole = P.percentiles(P.summary(df, "size", ["grp"]), ps)
    got = {(r["group_value"], r["p"]): r for r in whole.collect()}
    assert len(got) == len(groups) * len(ps)
    for g, values in groups.items():
        values.sort()
        for p in ps:
            r, true = got[g, p], values[max(1, math.ceil(p * len(values))) - 1]
            assert r["value_low"] <= true <= r["value_high"] and r["n"] == len(values)
            assert r["value_high"] - r["value_low"] <= abs(true) * 2 ** (1 - P.BITS)
    parts = [P.summary(df.filter("size % 2 = 0"), "size", ["grp"]), P.summary(df.filter("size % 2 <> 0"), "size", ["grp"])]
    assert sorted(map(tuple, P.percentiles(P.combine(*parts), ps).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert P.percentiles(P.summary(df.limit(0), "size", ["grp"])).count() == 0


def test_percentiles_of_the_extreme_values(spark):
    values = [-(2**63), -(2**63) + 1, 2**63 - 1, 2**63 - 2, 0]
    df = spark.createDataFrame([(v, "g") for v in values] + [(None, "g"), (None, "h")], "size long, grp string")
    got = {r["p"]: r for r in P.percentiles(P.summary(df, "size", ["grp"]), (0.0, 0.5, 1.0)).collect()}
    assert got[0.5]["value_low"] == got[0.5]["value_high"] == 0 and got[0.5]["n"] == 5
    assert got[0.0]["value_low"] == -(2**63) + 1 and got[1.0]["value_high"] == 2**63 - 1  # the smallest BIGINT counts as the one above it
    assert len(got) == 3


# --------------------------------------------------------------------------- copies

NAMES = [
    (1, "A", 9, "quiet engine - tormeli - 4475.mp4"), (2, "A", 9, "QuietEngineTormeli4475.MP4"), (3, "A", 9, "4475; #tormeli#; «quiet engine».mp4"), (4, "A", 9, "quiet engine - tormeli - 4457.mp4"),
    (5, "A", 9, "quiet engine - tormeli - 4475.mov"), (6, "A", 8, "quiet engine - tormeli - 4475.mp4"), (7, None, 9, "quiet engine - tormeli - 4475.mp4"), (8, "A", None, "quiet engine - tormeli - 4475.mp4"),
    (9, "A", 9, None), (10, "A", 9, ""), (11, "A", 9, "..."), (12, "A", 9, "..."), (13, "A", 9, "icy engine tormeli 4475.mp4"), (14, "A", 9, "quiet engine tormeli 4475.mp4"), (15, "A", 9, "set 12 34.x"), (16, "A", 9, "set1234.x"), (17, "A", 9, "34-set-12.x"), (18, "A", 9, "set 123 4.x"),
]


def found(rows, spark):
    df = spark.createDataFrame(rows, "id long, album_id string, size long, name string").selectExpr("*", "'z' AS fine", "0L AS copies")
    keyed = D.keys(df, "name", "id", ["album_id", "size"], True, "files")
    ledger = D.update(D.update(None, D.aggregate(keyed.filter("id % 2 = 0"))), D.aggregate(keyed.filter("id % 2 = 1")))
    whole = D.aggregate(keyed)
    assert sorted(map(str, ledger.collect())) == sorted(map(str, whole.collect()))
    return keyed, D.classes(ledger)


def test_copies(spark):
    keyed, classed = found(NAMES, spark)
    got = {(r["first_id"], r["copy_id"]) for r in D.members(keyed, classed.filter("copies > 1")).collect()}
    assert {p for p in got if p[0] < 15} == {(1, 2), (1, 3), (1, 14), (11, 12)}
    assert {(15, 16), (15, 17), (15, 18)} <= got  # glued, the numbers can be either
    assert {r["first_id"]: r["copies"] for r in D.records(classed).collect()}[1] == 4
    keyed, classed = found([], spark)
    assert D.members(keyed, classed).count() == 0


def test_a_stored_ledger_takes_batches(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(NAMES, "id long, album_id string, size long, name string")
    keyed = D.keys(df, "name", "id", ["album_id", "size"], True, "files")
    ledger = D.Ledger(spark, str(tmp_path / "ledger"), 16)
    assert ledger.read().isEmpty()
    parts = ("id > 9", "id <= 9 AND id > 2", "id <= 2", "id > 99")
    assert all(ledger.take(keyed.filter(part), part) for part in parts)
    want = sorted(map(str, D.aggregate(keyed, 16).collect()))
    state = lambda: sorted(map(str, ledger.read().collect()))
    assert state() == want
    assert not ledger.take(keyed.filter("id > 9"), "id > 9") and state() == want  # a batch that comes again
    with monkeypatch.context() as m:  # one that dies before its pointer
        m.setattr(D.Pointers, "publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            ledger.take(keyed, "new")
    assert state() == want
    publish = D.Pointers.publish
    met = []

    def late(self, content, base):  # one that meets another writer
        if not met:
            met.append(1)
            D.Ledger(spark, str(tmp_path / "ledger"), 16).take(keyed.filter("id = 1"), "other")
        return publish(self, content, base)

    with monkeypatch.context() as m:
        m.setattr(D.Pointers, "publish", late)
        ledger.take(keyed.filter("id = 1"), "mine")
    assert ledger.read().agg({"copies": "sum"}).first()[0] == D.aggregate(keyed).agg({"copies": "sum"}).first()[0] + 2


def test_many_spellings_of_one_key():
    import time

    digits = itertools.islice(itertools.permutations("12345678"), 30_000)
    rows = [{"spelling": f". album {''.join(d)}", "fine": i, "first_id": i, "copies": 1} for i, d in enumerate(digits)]
    words = [{"spelling": ". " + " ".join(sorted(("".join(p[:3]), "".join(p[3:])))), "fine": i, "first_id": i, "copies": 1} for i, p in enumerate(itertools.permutations("abcdefgh"))][:30_000]
    began = time.perf_counter()
    assert len({f for _, f, _ in D._classes_of(rows)}) == 30_000
    assert len({f for _, f, _ in D._classes_of(words)}) < 30_000
    assert time.perf_counter() - began < 30


def test_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT_LEAST", 10)
    rows = [(i, "A", 1, "Same - name.jpg" if i % 3 else "name SAME.jpg") for i in range(1, 301)] + [(i, "A", 1, f"n {i // 2}.jpg") for i in range(400, 420)]
    keyed, classed = found(rows, spark)
    got = Counter(r["first_id"] for r in D.members(keyed, classed.filter("copies > 1")).collect())
    assert got == Counter({1: 299} | {i: 1 for i in range(400, 420, 2)})


def test_texts_glued_in_different_places():
    assert D.same_text(".x harborvelvet kettle", ".x harbor velvetkettle")
    assert D.same_text(".x 12 harborvelvet kettle", ".x 12 harbor velvetkettle")
    assert D.same_text(". ab cdef g", ". abcd ef g") and D.same_text(". ab cdef gh ij", ". abcd efgh ij")
    assert not D.same_text(".x 1 12 s", ".x 11 2 s") and not D.same_text(".x 12 3 4", ".x 1 2 34")  # other numbers
    assert not D.same_text(".x listen kettle", ".x silent kettle") and not D.same_text(".x harborvelvet kettle", ".x harbor velvetkettel")


def test_same_text_by_all_orders():
    rng, orders = random.Random(8), lambda words: {"".join(p) for p in itertools.permutations(words)}
    for _ in range(400):
        text = "".join(rng.choice("abc") for _ in range(6))
        one, two = ([p for p in "".join(c + rng.choice(["", " "]) for c in text).split() if p] for _ in range(2))
        rng.shuffle(two)
        if rng.random() < 0.5:
            two = ["".join(rng.sample(w, len(w))) for w in two]
        assert D._runs_alike(one, two) == bool(orders(one) & orders(two)), (one, two)


def test_same_text_against_permutations():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice(["ab", "a", "b", "ba", "12", "1", "2"]) for _ in range(4)]
        shuffled = words[:]
        rng.shuffle(shuffled)
        cut = rng.randint(0, 3)
        glued = [*shuffled[:cut], "".join(shuffled[cut:])]
        assert D.same_text(" ".join([".x", *sorted(words)]), " ".join([".x", *sorted(glued)]))
        assert not D.same_text(" ".join([".x", *sorted(words)]), " ".join([".y", *sorted(words)]))
    assert not D.same_text(".x ab cd", ".x abc e")


# --------------------------------------------------------------------------- containers


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_rank_once_and_fits(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(70, 1001, rng.integers(1, 900))
    histogram = dict(Counter(map(int, sizes)))
    starts, places, n = C.plan(histogram, 1000, 16)
    ranked, load, seen = sorted(map(int, sizes), reverse=True), Counter(), set()
    firsts = [s for s, _ in starts]
    for g, a, b, base, per in places:
        for r in range(a, b):
            assert (rank := firsts[g] + r) not in seen
            seen.add(rank)
            load[base + (r - a) // per] += ranked[rank]
    assert seen == set(range(len(ranked))) and max(load.values()) <= 1000 and set(load) == set(range(n))


def test_pack(spark):
    rng = random.Random(4)
    tokens = [0, 0, 5000, 3000, 1000, 1] + [rng.choice([rng.randint(1, 60), rng.randint(60, 1000), 500]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, tokens long").repartition(5)
    kinds = spark.createDataFrame([("s", 1000), ("l", 4000), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    packed = C.pack(spark, items, kinds).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in packed:
        pieces[r["container_kind"], r["doc_id"]].append((r["piece_no"], r["token_from"], r["tokens"]))
        if r["tokens"]:
            load[r["container_kind"], r["container_id"]] += r["tokens"]
        else:
            assert r["container_id"] is None
    capacity = {"s": 1000, "l": 4000}
    assert all(n <= capacity[k] for (k, _), n in load.items()) and {k for k, _ in pieces} == {"s", "l"}
    for (kind, doc), found_pieces in pieces.items():
        found_pieces.sort()
        assert sum(t for _, _, t in found_pieces) == tokens[doc] and [p for p, _, _ in found_pieces] == list(range(len(found_pieces)))
        assert len(found_pieces) == max(1, -(-tokens[doc] // capacity[kind]))
        at = 0
        for _, start, n in found_pieces:
            assert start == at
            at += n
    for kind, c in capacity.items():
        used = sum(1 for k, _ in load if k == kind)
        assert used <= math.ceil(sum(tokens) / c) * 1.05 + 2
    assert len(pieces) == 2 * len(tokens)
    assert C.pack(spark, items.limit(0), kinds).count() == 0 and C.pack(spark, items, kinds.limit(0)).count() == 0


def test_best_fit_takes_the_fullest():
    got = dict(C.best_fit([(5, 0), (3, 1), (3, 2)], [(9, "a"), (5, "b"), (2, "c")], 10, lambda n: f"n{n}"))
    assert got == {0: "b", 1: "a", 2: "a"}


# --------------------------------------------------------------------------- subjects

FIELDS = {"law": "court verdict statute tort notary magistrate docket appeal plaintiff lease", "sport": "match sprint coach league referee stadium goal relay hurdle athlete", "music": "chord tempo violin choir melody rhythm octave sonata drummer tenor"}


def notebooks(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        own = rng.sample(sorted(FIELDS), rng.choice([1, 1, 2]))
        lines = [f"We compare {rng.choice(FIELDS[s].split())} and {rng.choice(FIELDS[s].split())} in the next cells." for s in own for _ in range(6)]
        other = rng.choice([s for s in FIELDS if s not in own])
        lines.append(f"(Side remark about {rng.choice(FIELDS[other].split())}.)")
        out.append((i, "\n".join(lines), own))
    return out


def test_subjects_on_held_out_documents(spark):
    docs = notebooks(600)
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, " \n"), (903, "1 + 1"), (904, "x" * 200_000)], "doc_id long, text string").selectExpr("*", "'q' AS subject_code", "1 AS share")
    labels = spark.createDataFrame([(i, s, a) for i, _, own in docs if i % 5 == 0 for s in own for a in ("x", "y")] + [(0, "none", "x"), (None, "law", "x"), (5000, "law", "z")], "doc_id long, subject_code string, annotator string")
    subjects = spark.createDataFrame([(s, s, "") for s in FIELDS], "subject_code string, subject_name string, description string")
    got = {(r["doc_id"], r["subject_code"]) for r in S.subject_areas(spark, table, subjects, labels).collect()}
    want = {(i, s) for i, _, own in docs if i % 5 for s in own}
    held_out = {(i, s) for i, s in got if i % 5 and i < 600}
    assert len(held_out & want) / len(want) > 0.95 and len(held_out & want) / len(held_out) > 0.95
    assert not {i for i, _ in got} & {900, 901, 902, 903, 904}
    assert S.subject_areas(spark, table.limit(0), subjects, labels).count() == 0
    assert S.composition(S.subject_areas(spark, table, subjects.limit(0), labels)).count() == 0
    assert S.subject_areas(spark, table, subjects, labels.limit(0)).count() >= 0
    assert S.composition(S.subject_areas(spark, table, subjects, labels)).count() == 3


def test_terms():
    assert S.terms("Courts, courts. Nb").tolist()[0] == S.terms("court").tolist()[0]
    assert len(S.terms("Ausfallwahrscheinlichkeit")) == 1 and len(S.terms("x" * 50)) == 1 and len(S.terms("KI in 3 R")) == 3
    assert S.terms("a\\nb \\u00e4rzte")[-1] == S.terms("ärzte")[0] and S.terms("").tolist() == []
    assert len(S.terms("iVBOR" + "Ab1" * 500)) == 0


def test_long_texts_of_one_key_are_told_apart_in_time():
    import time

    began = time.perf_counter()
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    plain, other = [*words, "listen"], [*words, "silent"]
    spelt = lambda w: ". " + " ".join(sorted(w))
    assert not D.same_text(spelt(plain), spelt(other))
    assert D.same_text(spelt(plain), spelt([*words[:50], "".join(words[50:54]), words[55] + words[54], *words[56:], "listen"]))
    many = [f"{chr(97 + i % 26)}{i // 26}".translate(str.maketrans("0123456789", "klmnopqrst")) + "x" * (i % 7) for i in range(1500)]
    assert D.same_text(spelt(many), spelt([*many[2:], many[1] + many[0]]))
    assert D.same_text(". " + "a" * 300_000 + " b", ". " + "a" * 100_000 + " " + "a" * 200_000 + "b")
    assert time.perf_counter() - began < 20
