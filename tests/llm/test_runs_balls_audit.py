"""Periodic runs, SimHash classes and the filter audit against brute force, and on awkward rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from emberlake.llm import filter_audit, periodic, simhash

AWKWARD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("c`d", T.StringType()), T.StructField("ID", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("bits", T.LongType())])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5, 6, 7) for r in rows], AWKWARD)


ROWS = [
    (1, None, "s"), (2, "", None), (3, " \n\t", ""), (4, "a a a a a a a", "s"), (5, "x y x y x y x y x", "s"), (5, "x y x y x y x y x", "s"),
    (6, "one word   two", None), (None, "a a a a a a a", "s"), (7, "a a a a a a a", "t"), (8, "w " * 30_000, "t"), (7, "An other text of id 7", "t"),
]


def brute_runs(s, min_length=6, min_exponent=4):
    found = {}
    for p in range(1, len(s) // min_exponent + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j + p - i >= max(min_length, min_exponent * p) and j > i:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return [(i, j, q) for (i, j), q in sorted(found.items())]


def test_runs_equal_brute_force():
    draw = random.Random(3)
    for _ in range(600):
        s = [draw.randrange(draw.choice([1, 2, 2, 3, 6])) for _ in range(draw.randint(1, 60))]
        for _ in range(draw.randint(0, 3)):
            a, p = draw.randrange(len(s)), draw.randint(1, 6)
            for i in range(a + p, min(len(s), a + p * draw.randint(2, 9))):
                s[i] = s[i - p]
        for least in ((6, 4), (2, 2), (6, 3)):
            own = np.array(s, np.int64)
            assert periodic.runs(own, *least) == brute_runs(s, *least)
            cut = [(low + i, low + j, q) for low, high in periodic.stretches(own, np.zeros(len(s), np.int64), least[1], least[0]) for i, j, q in periodic.runs(own[low:high], *least)]
            assert cut == brute_runs(s, *least)


def test_factors_are_the_longest_earlier_occurrences():
    draw = random.Random(4)
    for _ in range(100):
        s = [draw.randrange(2) for _ in range(draw.randint(1, 40))]
        at = 0
        for begin, length, source in periodic.factors(s):
            assert begin == at
            earlier = [max((k for k in range(len(s) - begin + 1) if s[i : i + k] == s[begin : begin + k]), default=0) for i in range(begin)]
            assert length == max(1, max(earlier, default=0))
            assert (source == -1) == (max(earlier, default=0) == 0) and (source < 0 or s[source : source + length] == s[begin : begin + length])
            at += length
        assert at == len(s)


def test_runs_of_words_that_defeat_hashes_modulo_powers_of_two():
    s = [0]
    for _ in range(11):
        s += [1 - c for c in s]
    s = s + s[:64] * 5  # Thue-Morse words, then a true run
    assert periodic.runs(np.array(s, np.int64)) == brute_runs(s)


def test_periodic_runs_of_awkward_rows(spark):
    got = periodic.periodic_runs(awkward(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, len(words_of(t)), tuple((a, b - a, q) for a, b, q in brute_runs(words_of(t))) if len(t or "") < 1000 else ((0, 30_000, 1),)) for i, t, _ in ROWS)
    assert Counter((r["id"], r["n_words"], tuple(map(tuple, r["runs"]))) for r in got) == want
    assert {r["id"]: r["collapsed"] for r in got if r["id"] in (1, 2, 3, 4, 6, 8)} == {1: "", 2: "", 3: "", 4: "a", 6: "one word   two", 8: "w"}
    assert periodic.periodic_runs(awkward(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(awkward(spark, []), min_exponent=1)


def plain_fingerprint(text):
    own = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 4]).encode(), 42) for i in range(max(1, len(own) - 3))] if own else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    label = {i: i for i in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in nodes:
        for j in nodes:
            if j < i and near(i, j):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: top(i) for i in nodes}


@pytest.mark.parametrize("chunk", [1 << 22, 3_000])
def test_balls_meet_as_all_pairs_do(chunk):
    draw = random.Random(5)
    own = set()
    for _ in range(25):
        centre = draw.getrandbits(64)
        for _ in range(8):
            own.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 7))))
    own = np.array(sorted(own), np.uint64)
    want = plain_components(range(len(own)), lambda i, j: (int(own[i]) ^ int(own[j])).bit_count() <= 4)
    assert simhash.meet(own, np.zeros(len(own), np.int64), own, 0, 4, chunk).tolist() == [want[i] for i in range(len(own))]


def test_prefixes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", 1 << 12)  # some eight bits of prefix
    draw = random.Random(6)
    own = {0}
    for _ in range(30):
        centre = draw.getrandbits(64)
        for _ in range(8):
            own.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))))
    signed = [x - (1 << 64) if x >> 63 else x for x in own]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "bits long")).collect()
    assert all(r["a"] in signed and r["b"] in signed for r in found)
    want = plain_components(sorted(signed), lambda i, j: ((i ^ j) & (2**64 - 1)).bit_count() <= 4)
    linked = {frozenset((r["a"], r["b"])) for r in found}
    assert plain_components(sorted(signed), lambda i, j: frozenset((i, j)) in linked) == want


def test_simhash_of_awkward_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [*ROWS, *[(100 + k, " ".join(base[: 400 - k]), "s") for k in range(6)], *[(200 + k, " ".join(base), "s") for k in range(50)]]
    got = simhash.near_duplicates(awkward(spark, rows)).collect()
    held = [(i, t) for i, t, _ in rows if i is not None]
    assert Counter((r["id"], r["bits"] & (2**64 - 1)) for r in got) == Counter((i, plain_fingerprint(t)) for i, t in held)
    bits = sorted({plain_fingerprint(t) for _, t in held})
    group = plain_components(bits, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for i, t in held:
        own = group[plain_fingerprint(t)]
        least[own] = min(i, least.get(own, i))
    assert Counter((r["id"], r["component"]) for r in got) == Counter((i, least[group[plain_fingerprint(t)]]) for i, t in held)
    assert simhash.near_duplicates(awkward(spark, [])).collect() == []


def plain_audit(rows, labels):
    def failing(i, t):
        t = t or ""
        own = words_of(t)
        bad = set()
        if len(own) < 200:
            bad.add("A")
        if 100 * len(set(own)) < 50 * len(own):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            bad.add("C")
        if set(t) & set("#$%&*|"):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad.add("E")
        return bad

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = [(part or "", failing(i, t), i in good, i in toxic) for i, t, part in rows]
    out, totals = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in own if f in d[1] and not d[1] & before]
                totals[part, f] += len(gone)
                out[part, order, step] = [
                    sum(not d[1] & (before | {f}) for d in own), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own),
                    sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
    return {(*k, *v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_applying_every_order(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 2_000)  # chains are passed on many times
    draw = random.Random(7)
    rows = [*ROWS, *[(20 + k, "THE SAME TEXT #1", draw.choice(["s", "t", None])) for k in range(60)]]
    rows += [(100 + k, " ".join(f"{draw.choice('abcX')}{draw.randrange(150)}{draw.choice(['', '', '%'])}" for _ in range(draw.choice([50, 250]))), draw.choice(["s", "t"])) for k in range(40)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i, _, _ in rows] + [(None, 1, 1), (9_999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in filter_audit.audit(awkward(spark, rows), table).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(awkward(spark, []), table).collect() == []


def test_chains_compare_texts_and_not_hashes():
    chains = filter_audit._Chains()
    lost = [x for i, t in ((5, "a"), (3, "b"), (2, "a"), (9, "b"), (5, "a")) for x in chains.add(0, i, t)]
    assert lost == [5, 9, 5] and sorted(chains.texts()) == [(0, 2, "a"), (0, 3, "b")]


def test_copies_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "doc_id string, text string")
    assert [r["id"] for r in filter_audit.copies(docs).collect()] == ["b"]
