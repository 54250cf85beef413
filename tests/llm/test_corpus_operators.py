"""The ten operators against brute force, round trips and held-out labels."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from emberlake.llm import ann, bpe, fingerprints, importance, langid, line_dedup, mixing, near_dedup, sharding, toxicity
from emberlake.llm.queries import op5_sharding, op8_ann, op10_mixing

SF = "/root/testdata/sf0.001"
# Names that operators use within.
CLASHES = "gone runs n_lines n_dropped hash taken held turn copy copies kept_id n rank part before unit shard key text_id bands wanted draw share toxicity lang_pred token_ids decoded fingerprint __n a.b c``d".split()
SCHEMA = "doc_id long, text string, lang string, source string, id string, row int, size string, label double, " + ", ".join(f"`{c}` int" for c in CLASHES)
LONG = "word " * 60_000
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta\nshared line of text\n", "en", "s1", "x", 1, "a", 0.5),
    (2, "Shared Line of Text  \nother things are here\n\n", "en", "s2", "x", 1, "a", 0.5),
    (3, None, None, None, None, None, None, None),
    (4, "", "fr", "s1", "", 0, "", 0.0),
    (5, "123 !!! 456", None, "s3", "x", 1, "a", 0.5),
    (6, LONG, "en", "s1", "x", 1, "a", 0.5),
    (7, "alpha beta gamma delta epsilon zeta\nshared line of text\n", "en", None, "x", 1, "a", 0.5),
    (7, "alpha beta gamma delta epsilon zeta\nshared line of text\n", "en", None, "x", 1, "a", 0.5),
    (None, "shared line of text", "de", "s2", "x", 1, "a", 0.5),
]


AWKWARD = [r + tuple(range(len(CLASHES))) for r in AWKWARD]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# line dedup


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda s: s.strip(space).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for d, text in rows:
        if d is not None:
            for line in (text or "").split("\n"):
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [s for s in lines if d is None or len(key(s)) < 10 or first[key(s)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark, documents, awkward):
    hot = spark.createDataFrame([(i % 2_000, f"a line that everyone has\nown line number {i % 1_500}") for i in range(6_000)], "doc_id long, text string")
    for docs in (documents.select("doc_id", "text"), awkward, hot):
        got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
        rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()]
        assert sorted(rows, key=repr) == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_lines_keep_columns(awkward, empty):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    assert line_dedup.dedup_lines(empty).count() == 0


# byte-level BPE


def codec():
    ranks = bpe.read_ranks(path("byte_bpe_multi_50k.tiktoken"))
    return bpe.BpeCodec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(documents):
    own, library = codec()
    draw = random.Random(1)
    odd = ["", None, " ", "　a\x1c\x85 ​", "'re 'RE <|endoftext|>", "\x00\x01", "日本 é é 🎉👨‍👩‍👧", "a" * 5000]
    odd.append("".join(draw.choice("abcdeäöß") for _ in range(9000)))
    odd += ["ab" * 4000 + "a" * 333, "".join(draw.choice(["the", "ing", "tion", "e", "er"]) for _ in range(6000)), "日本語" * 3000]
    odd += ["".join(chr(draw.choice([draw.randrange(1, 0x250), draw.randrange(0x1F300, 0x1F700), 32, 10, 0x2028])) for _ in range(200)) for _ in range(40)]
    odd += list(texts_of(documents).values())
    for text, ids in zip(odd, own.encode_batch(odd)):
        assert ids == library.encode_ordinary(text or "")
        assert own.decode(ids) == (text or "").encode()


def test_bpe_long_rows_equal_single_merges():
    """Vocabularies in which a merge can make a pair of a lesser rank."""
    draw = random.Random(8)
    for _ in range(60):
        tokens = sorted({bytes(draw.choice(b"ab") for _ in range(draw.randrange(2, 6))) for _ in range(14)})
        draw.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        own = bpe.BpeCodec(ranks, r".+")
        for _ in range(5):
            data = bytes(draw.choice(b"ab") for _ in range(draw.randrange(2, 60)))
            parts = [data[i : i + 1] for i in range(len(data))]
            while True:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert own._merge_long(own.byte_ids[np.frombuffer(data, np.uint8)]).tolist() == [ranks[x] for x in parts]


def test_bpe_on_awkward_tables(awkward, empty):
    _, library = codec()
    out = bpe.encode(awkward, path("byte_bpe_multi_50k.tiktoken"), PATTERN)
    rows = out.withColumn("digest", bpe.ids_digest()).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["token_ids"] == ids and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["digest"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(empty, path("byte_bpe_multi_50k.tiktoken"), PATTERN).count() == 0


# near-dedup


def bag(text):
    words = text.lower().split()
    return Counter(zip(*[words[i:] for i in range(5)])) if len(words) > 4 else Counter([tuple(words)] if words else [])


def generalised(a, b):
    shared = sum((a & b).values())
    whole = sum(a.values()) + sum(b.values()) - shared
    return shared / whole if whole else 0.0


def brute_classes(texts):
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {d: bag(t) for d, t in texts.items() if t is not None}
    where = defaultdict(set)
    for d, b in bags.items():
        for s in b:
            where[s].add(d)
    pairs = {(a, b) for d in where.values() for a in d for b in d if a < b}
    links = set()
    for a, b in pairs:
        if texts[a] == texts[b] or generalised(bags[a], bags[b]) >= 0.8:
            links.add((a, b))
    by_text = defaultdict(list)
    for d, t in texts.items():
        if t is not None:
            by_text[t].append(d)
    links |= {(min(g), d) for g in by_text.values() for d in g}
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d: find(d) for d in texts}


def test_near_duplicates_match_brute_force(spark, documents):
    texts = texts_of(documents)
    draw = random.Random(3)
    base = [" ".join(f"w{draw.randrange(10_000)}" for _ in range(120)) for _ in range(6)]
    at = 10**6
    for text in base:  # chains of edits, copies and near misses
        words = text.split()
        for _ in range(12):
            texts[at] = " ".join(words)
            at += 1
            words = list(words)
            words[draw.randrange(len(words))] = f"new{at}"
            if draw.random() < 0.3:
                texts[at] = " ".join(words)
                at += 1
    table = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_inside_a_crowd_of_templates(spark):
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    base = words(354)  # 350 shingles
    texts = {}
    for i in range(240):  # alike at 0.75 and a little less
        own = base[:150] + words(47) + base[197:]
        texts[i] = " ".join(own)
        if i % 2:  # with a partner at 0.80 to 0.82
            cut = draw.randrange(31, 35)
            texts[1000 + i] = " ".join(own[:20] + words(cut) + own[20 + cut :])
    table = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    want = brute_classes(texts)
    assert got == want
    assert len(set(want.values())) == 240
    # The exact step alone, without rounds before it.
    assert {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(table, rounds=0).collect()} == want


def test_near_duplicates_on_awkward_tables(awkward, empty):
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(awkward).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}
    assert near_dedup.near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.count() == len(AWKWARD) - 2


def test_near_duplicates_with_repeated_ids(spark):
    draw = random.Random(9)
    a, b = ([f"w{draw.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (4, " ".join(a)), (4, " ".join(a)), (5, None), (5, " ".join(b)), (6, None), (6, None)]
    own = {}
    for d, t in rows:  # the text of the least hash
        key = hashlib.md5(t.encode()).hexdigest() if t is not None else f"null{d}"
        own[d] = min(own.get(d, (key, t)), (key, t))
    table = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, kept_id string")
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    want = brute_classes({d: t for d, (_, t) in own.items()})
    assert got == want
    left = sorted((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(table).collect())
    assert left == sorted((d, own[d][1]) for d in set(want.values()))


def test_near_duplicates_of_a_hot_bucket_keep_every_link(spark, monkeypatch):
    """A crowd of near copies in one bucket, hot keys split, and the recall of single pairs."""
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 50)
    draw = random.Random(10)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = {i: " ".join(base[: i % 100] + [f"own{i}"] + base[i % 100 + 1 :]) for i in range(2_500)}
    pairs = []
    for i in range(3_000, 3_400, 2):
        words = [f"p{draw.randrange(10**9)}" for _ in range(204)]
        cut = draw.randrange(100)
        texts[i], texts[i + 1] = " ".join(words), " ".join(words[:cut] + [f"x{i}y{j}" for j in range(14)] + words[cut + 14 :])  # 0.82
        pairs.append((i, i + 1))
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(2_500))
    assert all(generalised(bag(texts[a]), bag(texts[b])) >= 0.8 for a, b in pairs)
    assert np.mean([got[b] == a for a, b in pairs]) >= 0.99


def test_dart_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        n = int(draw.integers(2, 600))
        k = int(n * draw.random())
        a = draw.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:k], draw.integers(0, 2**63, n - k).astype(np.uint64)])
        wa, wb = draw.random(n) * 3, draw.random(n) * 2
        s = near_dedup.dart_signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], n), 2)
        shared = np.minimum(wa[:k], wb[:k]).sum()
        errors.append((s[0] == s[1]).mean() - shared / (wa.sum() + wb.sum() - shared))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


# sharding


def test_shards_are_even_and_gapless(spark, documents, awkward, empty):
    sizes = defaultdict(int)
    slots = defaultdict(list)
    rows = op5_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts_of(documents))
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(24))
    share = sum(sizes.values()) / 24
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) < share + largest and min(sizes.values()) > share - largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r["size"] for r in sharding.shard(awkward).collect()) == sorted(8 + len((t[1] or "").encode()) for t in AWKWARD)
    assert sharding.shard(empty).count() == 0


def test_a_hot_group_is_subdivided_and_others_stay_whole(spark):
    rows = [(i, "the same text again and again" if i % 3 == 0 else f"text {i // 4} of its own " * 3) for i in range(9000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    sizes, groups = Counter(), defaultdict(set)
    texts = dict(rows)
    for r in got:
        sizes[r["shard"]] += r["size"]
        groups[texts[r["id"]]].add(r["shard"])
    share = sum(sizes.values()) / 12
    assert max(sizes.values()) < 1.03 * share and min(sizes.values()) > 0.97 * share
    assert all(len(s) == 1 for t, s in groups.items() if not t.startswith("the same"))


# fingerprints


def test_fingerprints_estimate_similarity(spark, documents):
    rows = {r["id"]: r for r in fingerprints.edit_likeness(documents).collect()}
    texts = texts_of(documents)
    order = sorted(texts, reverse=True)
    errors = []
    for d, nxt in zip(order, order[1:] + order[:1]):
        cut = len(texts[d]) // 3
        edited = texts[d][: len(texts[d]) - cut] + texts[nxt][:cut]
        assert rows[d]["edited"] == edited
        errors.append(rows[d]["near_edited"] - generalised(bag(texts[d]), bag(edited)))
        errors.append(rows[d]["near_next"] - generalised(bag(texts[d]), bag(texts[nxt])))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprints_on_awkward_tables(spark, awkward, empty):
    rows = fingerprints.edit_likeness(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert len({r["fingerprint"] for r in rows if r["id"] in (1, 7)}) == 1
    assert fingerprints.edit_likeness(empty).count() == 0
    one = fingerprints.edit_likeness(spark.createDataFrame([(9, "one two three four five six")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    out = fingerprints.fingerprints(awkward)
    assert out.columns == [*awkward.drop("fingerprint").columns, "fingerprint"] and out.count() == len(AWKWARD)


@pytest.mark.parametrize("slice_bytes", [1, 20_000, 1 << 28])
def test_fingerprints_of_any_slices_are_equal(spark, documents, slice_bytes):
    rows = documents.select(F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("doc_id"), "text")
    got = fingerprints.edit_likeness(rows, slice_bytes=slice_bytes).select("id", F.md5("edited").alias("e")).collect()
    order = sorted(rows.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    own = {r["id"]: r["e"] for r in got if r["id"] is not None}
    assert len(got) == len(order)
    for a, b in zip(order, order[1:]):
        if b["doc_id"] is not None:
            assert own[a["doc_id"]] == hashlib.md5(fingerprints.edited_text(a["text"], b["text"]).encode()).hexdigest()


# importance resampling


def test_importance_prefers_target_text(spark):
    good, bad = "clear plain useful prose about rivers and hills", "buy now cheap pills click here win money"
    rows = [(i, (good if i % 2 else bad) + f" number {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(docs, docs.where("doc_id % 2 = 1 and doc_id < 100"), keep=0.5).collect()
    assert sum(r["selected"] for r in got) == 200
    assert sum(r["id"] % 2 for r in got if r["selected"]) > 180


def test_importance_equals_plain_models(spark):
    draw = random.Random(6)
    texts = {i: " ".join(draw.choice("ab cd ef gh ij kl mn".split()) for _ in range(draw.randrange(0, 9))) for i in range(60)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    grams = lambda t: importance.ngram_buckets([t])[0].tolist()
    words = "ab cd ef".split()
    assert len(grams("ab cd ef")) == 5 and set(grams("ab cd ef")) == {b for w in [*words, "ab cd", "cd ef"] for b in grams(w) if len(w) == 2 or b not in {x for v in words for x in grams(v)}}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i % 3 == 0:
            target.update(grams(t))
    size, one = importance.BUCKETS, importance.SMOOTHING
    ratio = lambda b: np.log((target[b] + one) / (sum(target.values()) + one * size)) - np.log((raw[b] + one) / (sum(raw.values()) + one * size))
    got = importance.resample(docs, docs.where("doc_id % 3 = 0"), keep=0.5).collect()
    for r in got:
        assert r["log_weight"] == pytest.approx(sum(ratio(b) for b in grams(texts[r["id"]])))
    assert sum(r["selected"] for r in got) == 30
    assert min(r["gumbel_key"] for r in got if r["selected"]) > max(r["gumbel_key"] for r in got if not r["selected"])


def test_importance_on_awkward_tables(spark, awkward, empty):
    got = importance.resample(awkward, awkward.where("lang = 'en'")).collect()
    assert len(got) == len(AWKWARD)
    assert importance.resample(empty, empty).count() == 0
    values = spark.createDataFrame([(float(v),) for v in [3, -1, 7, 7, 0, -9]], "v double")
    assert [importance.kth_largest(values, "v", k) for k in range(1, 7)] == [7, 7, 3, 0, -1, -9]


# nearest neighbours


def test_neighbours_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = defaultdict(list)
    for r in op8_ann(spark, "/root/testdata/sf0.01").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        best = set(ids[np.lexsort((ids, -score))[:5]])
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        for _, v, s in mine:
            assert abs(s - score[list(ids).index(v)]) < 1e-12
        hits += len(best & {v for _, v, _ in mine})
        total += 5
    assert hits / total >= 0.9


def test_neighbours_on_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(base, base.where("vec_id in (0, 3, 4, 8)")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]
    assert ann.nearest(base.where("false"), base.where("false")).count() == 0


# language


def test_language_on_held_out_text(documents):
    train = documents.where("doc_id % 4 != 1")
    model = langid.train(train)
    got = langid.identify(documents.where("doc_id % 4 = 1"), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9


def test_language_averages_equal_plain_ones():
    table = np.random.default_rng(3).normal(size=(langid.BUCKETS, 5))
    texts = ["Hello, you!", "Äb c", "", None, "x"]

    def plain(text):
        data = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).encode()
        rows = []
        for word in data.split():
            edged = b" " + word + b" "
            for i in range(len(edged) - 2):
                rows.append(int.from_bytes(edged[i : i + 3], "big"))
            edged += b" "
            for i in range(len(edged) - 3):
                if edged[i + 2] != 32:
                    rows.append(int.from_bytes(edged[i : i + 4], "big") ^ 0x5BD1E995)
        rows = [((k * 2654435761) % 2**32) >> 17 for k in rows]
        return table[rows].mean(axis=0) if rows else np.zeros(5)

    assert np.allclose(langid._averages(table, texts), [plain(t) for t in texts])


def test_language_sample_is_whole_and_even(spark):
    rows = [(i, f"text {i} " * (500 if i % 7 == 0 else 1), "en" if i % 10 else "de") for i in range(600)] + [(900, None, "en"), (901, "x", None)]
    texts, labels = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40)
    assert Counter(labels) == {"en": 40, "de": 40}
    assert set(texts) <= {t for _, t, _ in rows}


def test_language_on_awkward_tables(awkward, empty):
    model = langid.train(awkward)
    rows = langid.identify(awkward, model, reject=False).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert "und" not in {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 6, 7)}
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.train(empty)).collect()} == {"und"}


# toxicity


def plain_kernel(a, b):
    """Gapped pairs and triples of marked words, enumerated one by one."""

    def bag_of(word):
        word, out = f"^{word}$", Counter()
        for i in range(len(word)):
            for j in range(i + 1, min(i + toxicity.SPAN, len(word))):
                out[word[i] + word[j]] += toxicity.DECAY ** (j - i - 1)
                for k in range(j + 1, min(i + toxicity.SPAN, len(word))):
                    out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        return {s: v**0.5 for s, v in out.items()}

    x, y = bag_of(a), bag_of(b)
    norm = lambda z: sum(v * v for v in z.values()) ** 0.5
    return sum(v * y.get(s, 0.0) for s, v in x.items()) / norm(x) / norm(y)


def test_subsequence_kernel_equals_plain_enumeration(monkeypatch):
    words = "idiot idiiot idi0t stupid stuupid clown crown hello a ab worthless worthlless ähnlich".split()
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    found = toxicity.subsequence_features(words)
    assert abs(found @ found.T - want).max() < 0.2  # hashed to few places
    monkeypatch.setattr(toxicity, "DIM", 1 << 18)
    found = toxicity.subsequence_features(words)
    assert abs(found @ found.T - want).max() < 0.01
    assert toxicity.kernel(found[:1], found[1:2]) > 4 * toxicity.kernel(found[:1], found[7:8])


def test_toxicity_learns_which_sentence_is_bad():
    draw = random.Random(2)
    clean = lambda: " ".join("".join(draw.choice("aeioulnrst") for _ in range(6)) for _ in range(8)) + "."
    bags = [(i % 2, [clean() for _ in range(5)] + ["you are such a qwyzzik." if i % 2 else "you are such a fine one."]) for i in range(240)]
    model = toxicity.fit(bags)
    score = lambda s: model.probability(model.margins([toxicity.normalise(t) for t in s.split()])).max()
    assert score("a qwyzzik here") > 0.5 and score("q-w-y-zzik") > 0.5 and score("qwyyzzik") > 0.5
    assert np.mean([score(clean()) < 0.5 for _ in range(100)]) > 0.97
    assert toxicity.fit(bags).margins(["qwyzzik"]) == model.margins(["qwyzzik"])


def test_toxicity_on_held_out_text(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id < 6000")
    model = toxicity.fit(toxicity.training_bags(docs, labels.where("doc_id % 4 != 1")))
    test = docs.join(labels.where("doc_id % 4 = 1"), "doc_id")
    got = toxicity.score(test, model).collect()
    truth = np.array([r["toxic"] for r in got])
    said = np.array([r["toxicity"] >= 0.5 for r in got])
    assert (said == truth).mean() > 0.95 and said[truth == 1].mean() > 0.75
    bent = model.probability(model.margins([toxicity.normalise(w) for w in ("id-iot", "i.d.i.o.t", "stuupid", "m0ron", "trassh", "loseer")]))
    assert (bent > 0.5).all()


def test_toxicity_on_awkward_tables(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.training_bags(spark.read.parquet(f"{sf}/documents.parquet"), labels))
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["toxicity"] < 0.5 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    assert {r["toxicity"] for r in toxicity.score(awkward, None).collect()} == {0.0}
    assert toxicity.training_bags(empty, labels.where("false")) == [] and toxicity.fit([]) is None
    assert toxicity.fit([(0, ["a"])]) is None
    assert "idiot" in toxicity.tokens_of("you i d i o t there")


# mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weights = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / weights for s in order}
        more = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        capped |= more


def test_mix_reaches_targets(spark, documents):
    rows = op10_mixing(spark, SF).collect()
    again = op10_mixing(spark, SF).collect()
    assert sorted(rows) == sorted(again)
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])


def test_knapsack_is_exact():
    draw = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(draw.integers(1, 30, 5))
        left = draw.integers(0, 4, len(lengths))
        budget = int(draw.integers(0, 80))
        sums = {0}
        for length, n in zip(lengths, left):
            sums = {s + k * int(length) for s in sums for k in range(n + 1)}
        taken = mixing.knapsack(lengths, left, budget)
        assert (taken <= left).all()
        assert abs((taken * lengths).sum() - budget) == min(abs(s - budget) for s in sums)


def test_mix_of_a_source_with_very_long_documents(spark):
    def taken(lengths, counts, target):
        lengths, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
        repeats, extra = mixing.fit_budget(lengths, counts, target)
        assert (extra >= 0).all() and (repeats * counts + extra <= 3 * counts).all()
        return int((lengths * (repeats * counts + extra)).sum())

    short = list(range(975, 1025))
    assert taken([*short, 200_000], [1] * 51, 190_000) == 200_000
    assert taken([80_000], [1], 140_000) == 160_000
    assert taken([55_000, 100_000], [1, 1], 110_000) == 110_000
    big = [250_000 + i for i in range(50)]  # past the whole knapsack
    assert taken([*big, 50_000_000], [1] * 51, 47_000_000) == 50_000_000
    assert taken([10, 200_000], [10_000, 1], 190_000) == 190_000
    draw = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.unique(draw.integers(1, 150_000, 4))
        counts = draw.integers(1, 3, len(lengths))
        total = int((lengths * counts).sum())
        target = int(draw.integers(0, total))
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + k * int(length) for s in sums for k in range(3 * n + 1)}
        assert abs(taken(lengths, counts, target) - target) == min(abs(s - target) for s in sums)
    docs = spark.createDataFrame([(0, "w " * 80_000, "a"), (1, "w " * 200_000, "b")], "doc_id long, text string, source string")
    for r in mixing.mix(docs).collect():  # targets 93,333 and 186,667
        assert r["copies"] == 1


def test_mix_on_awkward_tables(spark, awkward, empty):
    mixed = mixing.mix(awkward)
    rows = mixed.collect()
    assert len(rows) == len(AWKWARD) and all(r["copies"] == 0 for r in rows if r["size"] == 0)
    out = mixing.apply_mix(awkward, mixing.mix(awkward))
    assert out.columns == awkward.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0
    hot = spark.createDataFrame([(i, "three words here", "s") for i in range(500)] + [(1000 + i, "one two", "t") for i in range(100)], "doc_id long, text string, source string")
    taken = mixing.mix(hot).groupBy("source_size").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in taken)
