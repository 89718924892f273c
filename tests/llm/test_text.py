"""Tokens, packing, personal data, language, toxicity, decontamination, neighbours."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import ann, common, decontam, langid, packing, pii, tokens, toxicity

from .conftest import prose

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", FILES)
def test_cached_tokenizer(name, rows):
    rnd = random.Random(1)
    bits = ["a", "the", "Ü", "é", "\n", "  ", "\t", " ", ".", ",", "'s", "don't", "12", "3", "<|endoftext|>", " ", "日本", "\x1c", "́", "​", "!?", "😀", "\x00", "\u0085", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(20_000)] + [t or "" for _, t, _ in rows]
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    tok = tokens.CachedTokenizer(public_tokenizers.path(name))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == want


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_as_ordinary_text(name):
    texts = ["a <|endoftext|>b", "<|endoftext|><|endoftext|>", "İ, rİ,"]
    tok = library(name)
    tok.encode_special_tokens = True
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.CachedTokenizer(public_tokenizers.path(name), special=False).encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.CachedTokenizer(public_tokenizers.path(name)).encode(texts)] != want


def test_full_cache(monkeypatch, rows):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    tok = tokens.CachedTokenizer(public_tokenizers.path(FILES[0]))
    texts = [t or "" for _, t, _ in rows]
    want = [e.ids for e in library(FILES[0]).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == want and len(tok.cache) <= 10


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], list(range(3000))])
def test_direct_codes(values):
    codes = tokens.DirectCodes.read(tokens.DirectCodes.encode(np.array(values, dtype=np.uint32)))
    assert codes.all().tolist() == values and len(codes) == len(values)
    assert [codes[i] for i in range(len(values))] == values
    with pytest.raises(IndexError):
        codes[len(values)]


def test_token_files(spark, docs, rows, nothing):
    path = f"{common.shared_root(spark)}/test-codes"
    files = tokens.write_codes(docs, path, public_tokenizers.path(FILES[1]), 1, shard_tokens=500)
    got = sorted(tuple(r) for r in tokens.read_codes(files).collect())
    tok, at, want = library(FILES[1]), 0, []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    one = files.where("shard = 0").orderBy("part").first()
    codes = tokens.DirectCodes.read(bytes(one["blob"]))
    assert codes[one["ends"][0] - 1] == 1
    empty = tokens.write_codes(nothing, path + "-empty", public_tokenizers.path(FILES[1]), 1)
    assert tokens.read_codes(empty).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "b b"), (3, "b b"), (-2, None)], "doc_id bigint, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokens.read_codes(tokens.write_codes(odd, path + "-odd", public_tokenizers.path(FILES[1]), 1)).collect())
    assert got == [(0, None, 2), (2, -2, 1), (3, 3, 3), (6, 3, 3)]


def best_bins(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k, room in enumerate(bins):
            if room >= lengths[i] and room not in bins[:k]:
                go(i + 1, [*bins[:k], room - lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


def test_plans_are_packings_near_the_optimum():
    rnd = random.Random(4)
    lost = 0
    for _ in range(300):
        capacity = rnd.choice([10, 20, 100])
        lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        bins = packing.plan_bins(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in bins)
        assert sorted(itertools.chain.from_iterable(list(p) * m for p, m in bins), reverse=True) == lengths
        lost += sum(m for _, m in bins) - best_bins(lengths, capacity)
    assert lost <= 6


def test_reduction_alone_is_optimal():
    for counts, capacity, bins in [({7: 3, 3: 3}, 10, 3), ({10: 2}, 10, 2), ({5: 5}, 10, 3), ({9: 4, 2: 1}, 10, 5), ({6: 2, 4: 1, 3: 1}, 10, 2)]:
        assert sum(m for _, m in packing.plan_bins(counts, capacity)) == bins


def test_packing(docs, rows, nothing):
    got = [tuple(r) for r in packing.pack(docs, public_tokenizers.path(FILES[0]), 0, 64).collect()]
    tok, want = library(FILES[0]), {}
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, first, *range(first + 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r[0], r[1]): r[2:5] for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= math.ceil(sum(w[1] for w in want.values()) / 64) * 1.05 + 1
    assert packing.pack(nothing, public_tokenizers.path(FILES[0])).count() == 0


def brute_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in pii.BASE_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs, rows, nothing):
    rnd = random.Random(6)
    bits = ["a@b.c", "_d@e.f", "x@y", "@", ".", "..", " ", "1.2.3.4", "256.1.1.1", "01.002.0003.4", ".5.6", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+49 (30) 1234567", "+1", "-", "é😀", "DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "GB82WEST12345698765432", "123-45-6789", "ssn ", "card ", "%+", "\n", "7", "a", "B"]
    odd = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(600)] + [(1000, "1" * 3000), (1001, "a" * 20000 + "@b.c"), (1002, "1 " * 3000), (1003, "a@" + "b." * 4000 + "c")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string")
    for r in pii.digest(pii.find_spans(df)).collect():
        base = brute_base(odd[r["doc_id"]][1] if r["doc_id"] < 1000 else dict(odd)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (odd[min(r["doc_id"], 599)], base, r["spans"])
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE_KINDS] == base
        assert r["n_email"] == sum(s.startswith("email") for s in base)
    assert pii.digest(pii.find_spans(docs)).count() == len(rows) and pii.find_spans(nothing).count() == 0
    more = spark.createDataFrame([(1, "my iban is DE89 3704 0044 0532 0130 00 thanks"), (2, "DE89 3704 0044 0532 0130 01"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789"), (5, None), (5, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_spans(more)).collect()}
    assert got == {1: "iban:11:38", 2: "", 3: "ssn:4:15", 4: "", 5: ""}


def test_language(spark, nothing):
    rnd = random.Random(8)
    data = [(i, prose(rnd, lang, rnd.randint(5, 60)), lang) for i in range(240) for lang in [rnd.choice(["en", "de", "es"])]]
    data += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !?", "de"), (1003, "a" * 3000, None), (1004, "日本語", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in rows.items() if r["held_out"]} == set(held)
    truth = {i: lang for i, _, lang in data}
    own = [i for i in held if i < 1000]
    assert sum(rows[i]["lang_pred"] == truth[i] for i in own) / len(own) > 0.97
    assert [rows[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[1004]["lang_pred"] in ("en", "de", "es")
    assert langid.predict(nothing, model).count() == 0
    blind = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(blind, model).collect()} == {"und"}


def test_long_pieces_are_segments():
    assert max(map(len, langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))) > 8
    pieces = langid.Pieces(["▁", "a", "▁aaaaaaaaaaaa"])
    model = langid.Model(["x"], pieces, np.array([[0.1], [0.2], [0.3]]))
    assert np.allclose(np.exp(model.log_likelihood(["a" * 12, "a" * 13])[:, 0]), [0.3 + 0.1 * 0.2**12, 0.3 * 0.2 + 0.1 * 0.2**13])


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "aba"])
    probs = np.array([[0.1], [0.2], [0.15], [0.25], [0.1], [0.05], [0.15]])
    model = langid.Model(["x"], pieces, probs)
    table = {p: probs[i, 0] for i, p in enumerate(pieces.pieces)}

    def total(s):
        return 1.0 if not s else sum(table.get(s[:k], langid.UNKNOWN if k == 1 else 0) * total(s[k:]) for k in range(1, min(8, len(s)) + 1) if s[:k] in table or k == 1)

    words = ["aba", "ab", "a", "abab", "zb", "abaabab"]
    assert np.allclose(np.exp(model.log_likelihood(words)[:, 0]), [total("▁" + w) for w in words])
    counts = model.expected(["ab"], np.array([2.0]))
    ways = [(["▁", "a", "b"], 0.1 * 0.15 * 0.25), (["▁a", "b"], 0.2 * 0.25), (["▁", "ab"], 0.1 * 0.1), (["▁ab"], 0.05)]
    want = {p: 2 * sum(w * s.count(p) for s, w in ways) / sum(w for _, w in ways) for p in pieces.pieces}
    assert np.allclose(counts, [want[p] for p in pieces.pieces])


def test_toxicity(spark, nothing):
    rnd = random.Random(3)
    bad = {"en": ["idiot", "moron"], "de": ["trottel", "depp"], "es": ["tonto", "burro"]}
    data, labels = [], []
    for i in range(700):
        lang = rnd.choice(list(bad))
        t, toxic = prose(rnd, lang, rnd.randint(20, 80)), int(rnd.random() < 0.3)
        if toxic:
            words = t.split(" ")
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad[lang]))
            t = " ".join(words)
        data.append((i, t, lang, 1))
        labels.append((i, toxic, 0))
    data += [(9000, None, None, 1), (9001, "", "en", 1), (9002, "!!!", "en", 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, score int")
    marks = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (0, labels[0][1], 1)], "doc_id bigint, toxic int, quality int")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, marks).collect()}
    assert len(rows) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i, _ in held)
    assert sum(rows[i]["predicted"] == y for i, y in held) / len(held) > 0.95
    assert rows[9000]["score"] == rows[9001]["score"] == rows[9002]["score"]
    assert toxicity.score(nothing, marks).count() == 0
    none = marks.where("toxic = 0")
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_training_lowers_the_loss(monkeypatch):
    texts, y = ["good day sir", "you bad thing"] * 20, np.array([0, 1] * 20, dtype=np.float32)

    def loss(epochs):
        monkeypatch.setattr(toxicity, "EPOCHS", epochs)
        ids, model = toxicity.WordIds(), toxicity.Model()
        toxicity._train(model, texts, y, ids)
        p = 1 / (1 + np.exp(-model.logits(*toxicity.rows_of_texts(texts, ids))))
        return -np.log(np.where(y == 1, p, 1 - p)).mean()

    losses = [loss(n) for n in (0, 1, 4, 40)]
    assert losses == sorted(losses, reverse=True) and len(set(losses)) == 4


ITEMS = [
    (7, "John has 3 apples and 5 pears; each apple costs 3 dollars in the big market today."),
    (8, "A train of 120 tons leaves the old station and runs for 7 hours to the far coast before it stops."),
    (9, "of"), (10, None), (None, "nobody asks this question about the missing identifiers here"),
]


def test_decontamination(spark, nothing):
    rnd = random.Random(5)
    data = [
        (1, prose(rnd) + " " + ITEMS[0][1] + " " + prose(rnd)),
        (2, "Mary has 4 apples and 9 pears; each apple costs 4 dollars in the big market today."),
        (3, "Mary has 4 apples and 9 pears; each apple costs 7 dollars in the big market today."),
        (4, prose(rnd)),
        (5, None),
        (6, ""),
        (None, ITEMS[0][1]),
        (8, (prose(rnd, n=10) + " A train of 80 kg leaves the old station and runs for 9 days to the far coast before it stops. ") * 5 + ITEMS[0][1]),
        (9, "A train of 120 tons"),
        (1, "the second row of a repeated id"),
    ]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["contaminated"], r["item_ids"]) for r in decontam.verdicts(docs, items).collect())
    assert got == [(0, False, []), (1, True, [7]), (1, True, [7]), (2, True, [7]), (3, False, []), (4, False, []), (5, False, []), (6, False, []), (8, True, [7, 8]), (9, False, [])]
    assert decontam.verdicts(nothing, items).count() == 0
    assert {r["contaminated"] for r in decontam.verdicts(docs, items.limit(0)).collect()} == {False}


def test_decontamination_without_the_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEMS[1][1]), (2, "nothing of the kind is said here at all by anyone")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id bigint, text string")
    monkeypatch.setattr(decontam, "window_filter", lambda bench: np.full(1 << decontam.FILTER_BITS - 3, 255, np.uint8))
    assert {r["doc_id"]: r["item_ids"] for r in decontam.verdicts(docs, items).collect()} == {1: [8], 2: []}


def test_items_of_scripts_without_spaces(spark):
    item = "東京から大阪まで電車で何時間かかりますか"
    data = [(1, f"前の文章です。{item}後に続く文章もあります"), (2, "大阪の天気は明日も晴れるでしょうと言われました"), (3, item[:6] + "abc")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontam.verdicts(docs, items).collect()} == {1: [5], 2: [], 3: []}


POOR = [
    (1, "Compute 12 + 7 * 3"),
    (2, "Did Barack Obama meet Angela Merkel in Berlin in 2015?"),
    (3, "Weigh 5 kg"),
    (4, "Paris"),
]


def test_items_poor_in_plain_words(spark):
    data = [(i, f"Some words come first. {text} And some come after it.") for i, text in POOR[:3]]
    data += [(4, "The answer is below.\nParis\nThat is all."), (5, "We went to Paris in the spring."), (6, "Compute 12 + 8 * 3"), (7, "Did Barack Obama meet Angela Merkel in Berlin in 2016?")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    items = spark.createDataFrame(POOR, "item_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.verdicts(docs, items).collect()}
    # Item 2 has three windows of equal tokens, two of them without the year.
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [], 7: [2]}


STARTS = [
    (1, "What is the tallest mountain in the world?"),
    (2, "Tom has 5 apples. Tom gives 2 to Ann. Ann eats 1. How many are left?"),
    (3, "Days of rain and wind have closed the pass."),
]


def test_sentence_starts(spark):
    data = [
        (1, "Question: What is the tallest mountain in the world? Answer: none."),
        (2, "She asked me what is the tallest mountain in the world, and left."),
        (3, "Exercise. Bob has 7 apples. Bob gives 3 to Eve. Eve eats 2. How many are left? Four."),
        (4, "Exercise. Bob has 7 apples. Joe gives 3 to Eve. Ida eats 2. Why many are left? Four."),
        (5, "After 12 days of rain and wind have closed the pass."),
        (6, "Tell us: What is the tallest building in the world?"),
        (7, "A. B. C. D. E. F. G. H. I. J. " * 50),
    ]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    items = spark.createDataFrame(STARTS, "item_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.verdicts(docs, items).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [], 5: [3], 6: [], 7: []}


def test_neighbours(spark, nothing):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vecs = [(base[i % 40] + rng.normal(scale=0.3, size=16)).astype(np.float32).tolist() for i in range(1500)]
    vecs[100:160] = [vecs[0]] * 60
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0]]
    data = list(enumerate(vecs)) + [(5000 + 50 * i, v) for i, v in enumerate(odd)] + [(None, vecs[3]), (6001, [2.0, 4.0]), (0, vecs[0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn("id", F.lit(1)).withColumn("query", F.lit(False))
    rows = ann.nearest(df, F.col("vec_id") % 50 == 0, 5, block=300).collect()
    v = np.array(vecs, dtype=np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {*range(0, 1500, 50), 5300}
    hits = 0
    for q, own in found.items():
        own.sort()
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
        if q == 5300:
            assert [x[1] for x in own] == [6001] and abs(own[0][2] - 1) < 1e-12
            continue
        cos = (v * v[q]).sum(axis=1) / (norms * norms[q])
        cos[q] = -9
        want = np.lexsort((np.arange(1500), -cos))[:5]
        assert all(abs(s - cos[i]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(want.tolist()))
    assert hits >= 0.95 * 5 * 30
    assert [x[1] for x in found[0]] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def exact(ids, vecs, q, k=5):
    scaled = [np.array(v, dtype=np.float64) / np.abs(v).max() for v in vecs]
    cos = np.array([(x * scaled[q]).sum() / math.sqrt((x * x).sum()) / math.sqrt((scaled[q] ** 2).sum()) for x in scaled])
    order = [i for i in np.lexsort((ids, -cos)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(cos[i])) for i in order]


@pytest.mark.parametrize("block", [40, 10_000])
def test_neighbours_of_any_size_and_many_copies(spark, block):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(400, 12))
    vecs[:60] *= 1e200
    vecs[60:120] *= 1e-200
    vecs[120:125] *= 5e-310 / np.abs(vecs[120:125]).max()
    vecs[200:330] = vecs[200]  # a third of all rows are one vector
    data = [(i, v.tolist()) for i, v in enumerate(vecs)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 10 == 0, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 10))
    hits = 0
    for q, own in got.items():
        want = exact(np.arange(400), vecs, q)
        own.sort()
        hits += len({x[1] for x in own} & {i for i, _ in want})
        assert all(abs(s - dict(exact(np.arange(400), vecs, q, 399))[i]) < 1e-9 for _, i, s in own)
        if 200 <= q < 330:
            assert [x[1] for x in own] == [i for i in range(200, 207) if i != q][:5]
    assert hits >= 0.95 * 5 * len(got)


def test_regions_are_skipped_and_nothing_near_is_lost(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32)) * 5
    vecs = np.concatenate([centres + rng.normal(size=(40, 32)) * 0.2 for _ in range(50)])
    block = ann.Block(np.arange(2000), vecs, 5)
    met = block.tree.distances(block.unit[:50] @ block.matrix)
    who, name, score = block.search(np.arange(0, 2000, 50), vecs[::50])
    hits = sum(len(set(name[who == i].tolist()) & {j for j, _ in exact(np.arange(2000), vecs, 50 * i)}) for i in range(40))
    assert hits >= 0.95 * 200 and met.shape[1] >= 4
    few = block.search(np.arange(0, 2000, 50), vecs[::50], np.full(40, 0.9999999))[2]
    assert len(few) < len(score)
    tree = ann.Regions(block.unit @ block.matrix, 4)
    assert np.bincount(tree(block.unit @ block.matrix), minlength=16).max() <= 2 * 2000 / 16


def test_chi_square_quantiles():
    # Published table values.
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(0.9, 2) - 4.605) < 1e-3


def test_decontamination_holds_the_tokens_of_one_step():
    import tracemalloc

    import pyarrow as pa

    words = random.Random(5)
    texts = [" ".join(f"w{words.randrange(3000)}" for _ in range(200)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    bits = np.full(1 << decontam.FILTER_BITS - 3, 0, np.uint8)
    tracemalloc.start()
    assert sum(b.num_rows for b in decontam._found([batch], [8], bits, decontam.Lexicon())) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 5 * decontam.TEXT_BYTES and peak < 120e6
    bits[:] = 255
    t = decontam.Templates(texts, decontam.Lexicon())
    found = sum(b.num_rows for b in decontam._found([batch], [8], bits, decontam.Lexicon()))
    assert found == sum(len(at) for at, *_ in t.windows(8)) > 0
