"""Line dedup, suffix dedup and SimHash against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash

from palimpsest.llm import linededup, simhash, suffixdedup
from palimpsest.llm.components import UnionFind, connected


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    for n, m in ((1, 0), (30, 20), (200, 150), (200, 400)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(0, 0)]
        edges += [(i, i + 1) for i in range(0, min(n, 40) - 1)]
        uf = UnionFind(n + 1)
        for a, b in edges:
            uf.union(a, b)
        df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
        want = {x: uf.find(x) for e in edges for x in e if e[0] != e[1]}
        for most in (1_000_000, 60):
            assert {r["node"]: r["root"] for r in connected(df, most=most).collect()} == want


def brute_lines(rows):
    first = {}
    for i, t, *_ in rows:
        for p, line in enumerate((t or "").split("\n")):
            key = linededup.normal(line)
            if key:
                first[key] = min(first.get(key, (1 << 62, 0)), (i, p))
    names = list(first)
    sets = [linededup.shingles(x) for x in names]
    uf = UnionFind(len(names))
    for i in range(len(names)):
        for j in range(i):
            if linededup.jaccard(sets[i], sets[j]) >= linededup.SIMILARITY:
                uf.union(i, j)
    best = {}
    for k, x in enumerate(names):
        r = uf.find(k)
        best[r] = min(best.get(r, (1 << 62, 0)), first[x])
    out = {i: [] for i, *_ in rows}
    for i, p in best.values():
        out[i].append(p)
    return {i: sorted(p) for i, p in out.items()}


def test_line_dedup(docs, rows):
    got = {r["doc_id"]: (r["n_lines"], r["kept"]) for r in linededup.decisions(docs).collect()}
    want = brute_lines(rows)
    assert got == {i: ((t or "").count("\n") + 1, want[i]) for i, t, _ in rows}


def test_line_dedup_of_chains(spark):
    """Links between members of a group that both differ from its smallest one, in small units."""
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    texts, line = [], base
    for _ in range(25):
        k = rnd.randrange(110)
        line = line[:k] + rnd.choice("xyz") + line[k + 1 :]
        texts.append(line)
    rnd.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = linededup.distinct_lines(df)
    found = {r["node"]: r["root"] for r in linededup.components(lines, group=4).collect()}
    roots = {r["line"]: found.get(r["id"], r["id"]) for r in lines.collect()}
    uf, sets = UnionFind(len(texts)), [linededup.shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if linededup.jaccard(sets[i], sets[j]) >= linededup.SIMILARITY:
                uf.union(i, j)
    groups = lambda f: sorted(sorted(k for k in range(len(texts)) if f(k) == r) for r in {f(k) for k in range(len(texts))})
    assert groups(lambda k: roots[texts[k]]) == groups(uf.find)


def test_line_dedup_apply(spark, docs, rows, nothing):
    out = linededup.apply(docs)
    assert out.columns == docs.columns
    want = brute_lines(rows)
    for r in out.collect():
        lines = (rows[r["doc_id"]][1] or "").split("\n")
        keep = set(want[r["doc_id"]])
        assert r["text"] == "\n".join(x for p, x in enumerate(lines) if p in keep or not linededup.normal(x))
    assert linededup.apply(nothing).count() == 0 and linededup.decisions(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a\na"), (1, "b\nb"), (1, "b\nb")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.apply(odd).collect()) == [(0, "a\na"), (1, "b"), (1, "b")]


def test_minhash_is_the_plain_minimum():
    line = "a line of more than seven characters"
    codes = [line[i : i + 7] for i in range(len(line) - 6)]
    h, starts = linededup._shingle_hashes([line, "abc", line])
    assert starts.tolist() == [0, len(codes), len(codes) + 1] and (h[: len(codes)] == h[len(codes) + 1 :]).all()
    sig = linededup.signatures([line, "abc", line])
    assert (sig[0] == sig[2]).all() and sig[0, 5] == (h[: len(codes)] * linededup._A[5] + linededup._B[5]).min()


def test_close_pairs():
    rnd = random.Random(1)
    lines = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    lines += [x[: len(x) // 2] + "zz" + x[len(x) // 2 :] for x in lines]
    want = {(i, j) for j in range(len(lines)) for i in range(j) if linededup.jaccard(linededup.shingles(lines[i]), linededup.shingles(lines[j])) >= 0.5}
    assert want and set(zip(*(v.tolist() for v in linededup.close_pairs(lines, 0.5)), strict=True)) == want


@pytest.mark.parametrize("letters", ["ab ", "abcdefgh0123 é日", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))])
def test_shingle_numbers(letters):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    lines += [lines[0], "abc", "abc\0", lines[1][:-1], lines[2] + "x"]
    sets, ids = [linededup.shingles(x) for x in lines], linededup.shingle_ids(lines)
    assert [len(x) for x in ids] == [len(x) for x in sets]
    for i in range(len(lines)):
        for j in range(len(lines)):
            assert linededup.shared(ids[i], ids[j]) == len(sets[i] & sets[j])


def test_slices_of_a_comparison(monkeypatch):
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abc ") for _ in range(40)) for _ in range(30)]
    want = [x.tolist() for x in linededup.close_pairs(lines, 0.01)]
    monkeypatch.setattr(linededup, "SLICE", 100)
    assert want[0] and [x.tolist() for x in linededup.close_pairs(lines, 0.01)] == want


@pytest.mark.parametrize("many", [1, 1000])
def test_line_dedup_of_a_template(spark, many):
    """A large group of lines that share half of what they are: only the near ones among them are joined."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    shape = [word() for _ in range(14)]
    texts = []
    for _ in range(150):
        texts.append(" ".join(x + " " + word()[: 1 + i % 3] + word()[:5] for i, x in enumerate(shape)))
    for i in range(0, 40, 2):
        texts[i + 1] = texts[i][:60] + "zz" + texts[i][60:]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lines = linededup.distinct_lines(df)
    found = {r["node"]: r["root"] for r in linededup.components(lines, group=8, many=many).collect()}
    place = {r["id"]: r["doc_id"] for r in lines.collect()}
    want = {i: k for k, own in enumerate(brute_groups(texts)) for i in own}
    got = {}
    for i, d in place.items():
        got.setdefault(found.get(i, i), []).append(d)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == k) for k in set(want.values()))
    assert len(got) == 130


def brute_groups(texts):
    uf, sets = UnionFind(len(texts)), [linededup.shingles(linededup.normal(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if linededup.jaccard(sets[i], sets[j]) >= linededup.SIMILARITY:
                uf.union(i, j)
    out = {}
    for i in range(len(texts)):
        out.setdefault(uf.find(i), []).append(i)
    return list(out.values())


def brute_spans(rows, length=suffixdedup.LENGTH):
    data = [(i, (t or "").encode()) for i, t, *_ in rows if i is not None]
    first = {}
    for i, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out)


def test_suffix_dedup(docs, rows):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffixdedup.dedup(docs).collect())
    assert got == brute_spans(rows)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_of_repetitive_texts(spark, seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("ab") for _ in range(rnd.choice([49, 50, 51, 70, 200]))) for _ in range(6)] + ["a" * 300, "ab" * 90]
    rows = [(rnd.randrange(15), "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 4)))) for _ in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffixdedup.dedup(df).collect())
    assert got == brute_spans(rows)


def test_suffix_dedup_edges(spark, nothing):
    assert suffixdedup.dedup(nothing).count() == 0
    long = "word " * 40
    rows = [(None, long), (3, long), (3, long), (2, long), (5, None), (6, "")]
    got = sorted(((r["doc_id"] or -1), r["n_bytes"], r["n_removed"]) for r in suffixdedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(-1, 200, 0), (2, 200, 0), (3, 200, 200), (3, 200, 200), (5, 0, 0), (6, 0, 0)]


@pytest.mark.parametrize("hot", [0, 5])
def test_suffix_dedup_of_frequent_grams(spark, docs, rows, hot):
    """Strings around k-grams that occur often are dealt by their own bytes, with the same result."""
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    get = lambda df, **kw: sorted(tuple(r) for r in suffixdedup.dedup(df, keep_bytes=False, **kw).select(*columns).collect())
    assert get(docs, hot=hot) == get(docs)
    rnd = random.Random(9)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line, block = "=" * 70, some(33)
    texts = [some(60) + rnd.choice([line, line[:30], block, "-" * 16]) + some(20) + rnd.choice([line, block + some(9)]) for _ in range(60)]
    texts += texts[3:5] + [texts[7][20:90]]
    own = [(i, t) for i, t in enumerate(texts)]
    want = [(i, n, gone, spans, sha) for i, n, gone, spans, sha, _ in sorted(brute_spans(own))]
    assert get(spark.createDataFrame(own, "doc_id bigint, text string"), hot=hot) == want and any(x[2] for x in want)


def test_suffix_dedup_of_texts_over_a_step(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(suffixdedup, "STEP", 300)
    data = rnd.randbytes(1000).replace(b"\xff", b"a")
    payload = suffixdedup._pack(np.array([7, 8]), np.array([len(data), 40]), np.frombuffer(data + bytes(40), np.uint8))
    starts = set()
    for ids, buf, off, place in suffixdedup._steps(payload):
        for k in range(len(ids)):
            part = buf[off[k] : off[k + 1]].tobytes()
            assert part == (data + bytes(40))[place[k] : place[k] + len(part)]
            if ids[k] == 7:
                own = range(int(place[k]), int(place[k]) + len(part) - suffixdedup.LENGTH + 1)
                assert not starts & set(own)
                starts |= set(own)
    assert starts == set(range(len(data) - suffixdedup.LENGTH + 1))


def test_window_minima_in_parts(spark):
    rng = np.random.default_rng(1)
    contexts = rng.integers(0, 2, (400, suffixdedup.WIDTH)).astype(np.uint8)
    contexts[:, 34:50] = contexts[rng.integers(0, 20, 400), 34:50]
    contexts[200:] = contexts[rng.integers(0, 200, 200)]
    for i in range(400):
        contexts[i, : rng.integers(0, 20)] = suffixdedup.PAD
    docs = rng.integers(0, 50, 400)
    whole = suffixdedup.window_minima(contexts, docs)
    parts = suffixdedup.window_minima_by_gram(contexts, docs, 30)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    windows = {}
    for i, o, _ in zip(*whole, strict=True):
        w = (o, contexts[i, o : o + 50].tobytes(), contexts[i, 34:50].tobytes())
        windows[w] = min(windows.get(w, 99), docs[i])
    assert all(windows[o, contexts[i, o : o + 50].tobytes(), contexts[i, 34:50].tobytes()] == d for i, o, d in zip(*whole, strict=True))


def test_deep_shallow_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (3000, 50)).astype(np.uint8)
    rows[1000:, :30] = rows[0, :30]
    rows[2500:] = rows[:500]
    order = suffixdedup.deep_shallow_order(rows)
    strings = [rows[i].tobytes() for i in order]
    assert strings == sorted(strings) and sorted(order.tolist()) == list(range(3000))
    lcp = suffixdedup.common_prefixes(rows, order)
    for k in range(1, 3000, 37):
        a, b = strings[k - 1], strings[k]
        assert lcp[k] == next((j for j in range(50) if a[j] != b[j]), 50)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("group", [4, 4096])
def test_simhash(docs, rows, group):
    found = simhash.near_duplicates(docs.select("doc_id", "text", "fp", "root", "component_id"), group)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.digest(found).collect()}
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    uf = UnionFind(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                uf.union(i, j)
    assert got == {i: (f"{fps[i]:016x}", uf.find(i)) for i in range(len(fps))}


def test_simhash_links_close_fingerprints(spark):
    rnd = random.Random(9)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        f = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [struct.unpack("<q", struct.pack("<Q", f))[0] for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    for group in (3, 4096):
        uf, at = UnionFind(len(fps)), {s: i for i, s in enumerate(signed)}
        for r in simhash.links(df, group).collect():
            assert (fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() <= 3
            uf.union(at[r["a"]], at[r["b"]])
        want = UnionFind(len(fps))
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    want.union(i, j)
        assert [uf.find(i) for i in range(len(fps))] == [want.find(i) for i in range(len(fps))]


def test_simhash_edges(spark, nothing, monkeypatch):
    assert simhash.near_duplicates(nothing).count() == 0
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, None), (1, " ")]
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (4, 4), (4, 4)]
    text = " ".join(f"w{i}" for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "TEXT_STEP", 37)
    monkeypatch.setattr(simhash, "COUNT_STEP", 5)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_suffix_dedup_counts_contexts_once_per_unit():
    import numpy as np

    text = b"A passage that many documents share, of a little more than fifty bytes. "
    many = b"".join(b"%04d before the words of one separator ==================== and %04d after, all unlike" % (i, i) for i in range(300))
    texts = [text] * 400 + [many]
    block = suffixdedup._pack(np.arange(len(texts)), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    [out] = suffixdedup._ask_grams(1)([suffixdedup._batch([(0, suffixdedup.BLOCK, block)])])
    _, grams, several, times = suffixdedup._unpack(out["payload"][0].as_py(), "<i8", "<u8", "?", "<u4")
    runs = suffixdedup.Runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    own = np.isin(grams, runs.gram)
    assert own.any() and several[own].all() and (times[own] == 1).all()
    assert times.max() > 100


def test_suffix_dedup_answers_of_equal_contexts():
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(97, 100, (40, suffixdedup.WIDTH)).astype(np.uint8)
    base[:, suffixdedup.SPAN - 1 : suffixdedup.SPAN - 1 + suffixdedup.GRAM] = 120
    asked = []
    for unit in range(5):
        pick = rng.permutation(40)[:30]
        names = pick.astype(np.uint64) % np.uint64(37)  # some names stand for two contexts
        asked.append([np.array([unit]), names, rng.integers(0, 1000, 30), rng.random(30) < 0.2, base[pick].ravel()])
    docs, several = np.concatenate([a[2] for a in asked]), np.concatenate([a[3] for a in asked])
    row, offset, least = suffixdedup.window_minima(np.concatenate([a[4] for a in asked]).reshape(-1, suffixdedup.WIDTH), docs)
    want = sorted((int(r) // 30, int(asked[r // 30][1][r % 30]), int(o), int(x)) for r, o, x in zip(row, offset, least) if several[r] or x < docs[r])
    got = []
    for unit, _, payload in suffixdedup._answer_runs(asked):
        for name, o, size, x in zip(*suffixdedup._unpack(payload, "<u8", "u1", "u1", "<i8")):
            got += [(unit, int(name), int(o) + i, int(x)) for i in range(size)]
    assert sorted(got) == want and want


def test_suffix_dedup_sorts_only_what_needs_it(monkeypatch):
    """Blind tries get rows that share a long prefix; contexts alone around their k-gram are not sorted."""
    rng = np.random.default_rng(4)
    blind, tried = suffixdedup._Blind, []
    monkeypatch.setattr(suffixdedup, "_Blind", lambda strings: tried.append(len(strings)) or blind(strings))
    deep = 8 * suffixdedup.SHALLOW
    rows = rng.integers(0, 4, (1000, 50)).astype(np.uint8)
    rows[900:, :deep] = rows[:100, :deep]
    rows[990:] = rows[:10]
    strings = [rows[i].tobytes() for i in suffixdedup.deep_shallow_order(rows)]
    assert strings == sorted(r.tobytes() for r in rows) and sorted(tried) == [2] * 80 + [3] * 10
    for few in (rows[:0], rows[:1], rows[:30, :5], np.repeat(rows[:2], 40, axis=0)):
        order = suffixdedup.deep_shallow_order(few)
        assert sorted(order.tolist()) == list(range(len(few)))
        assert [few[i].tobytes() for i in order] == sorted(r.tobytes() for r in few)

    sort, asked = suffixdedup.deep_shallow_order, []
    monkeypatch.setattr(suffixdedup, "deep_shallow_order", lambda rows: asked.append(len(rows)) or sort(rows))
    contexts = rng.integers(0, 4, (200, suffixdedup.WIDTH)).astype(np.uint8)
    contexts[:50, 34:50] = contexts[50:100, 34:50]
    docs = rng.integers(0, 1000, 200)
    got = suffixdedup.window_minima_by_gram(contexts, docs)
    assert asked == [100, 100]
    assert all((x == y).all() for x, y in zip(got, suffixdedup.window_minima(contexts, docs), strict=True))


@pytest.mark.parametrize("piece", [1, 40, 1 << 15])
def test_suffix_dedup_anchors_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    buf = np.random.default_rng(6).integers(97, 99, 300).astype(np.uint8)
    gram, place = suffixdedup._minimizers(buf)
    own = {}
    for i, h in enumerate(gram.tolist()):
        assert own.setdefault(buf[i : i + suffixdedup.GRAM].tobytes(), h) == h
    assert len(set(own.values())) == len(own) and len(gram) == 300 - suffixdedup.GRAM + 1
    rank = gram >> np.uint64(suffixdedup.PLACE_BITS)
    assert place.tolist() == [s + int(rank[s : s + suffixdedup.SPAN].argmin()) for s in range(300 - suffixdedup.LENGTH + 1)]
    runs = suffixdedup.Runs(buf, np.array([0, 120, 300]))
    weights = [pow(suffixdedup._MUL, i, 1 << 64) for i in range(300)]
    sums = [sum(int(suffixdedup._BYTE[b]) * w for b, w in zip(buf[:i].tolist(), weights)) % (1 << 64) for i in range(301)]
    assert runs.prefix.tolist() == sums


def test_suffix_dedup_merges_contexts_by_sorting(monkeypatch):
    """A unit's contexts are cut out once over all of its steps, without a table that is hashed anew at each step."""
    monkeypatch.setattr(np, "union1d", None)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(40)]
    texts += texts[:25]
    block = suffixdedup._pack(np.arange(len(texts)), np.array([len(t) for t in texts]), np.frombuffer("".join(texts).encode(), np.uint8))
    rows = [(0, suffixdedup.BLOCK, block)]
    [grams] = suffixdedup._ask_grams(1)([suffixdedup._batch(rows)])
    [told] = suffixdedup._answer_grams(suffixdedup.HOT)([grams])
    rows = [tuple(r.values()) for r in told.to_pylist()] + rows
    out = []
    for step in (1 << 21, 1000):
        monkeypatch.setattr(suffixdedup, "STEP", step)
        [asked] = suffixdedup._ask_contexts(1)([suffixdedup._batch(rows)])
        out.append([x.tolist() for x in suffixdedup._unpack(asked["payload"][0].as_py(), "<i8", "<u8", "<i8", "?", "u1")])
    assert len(set(out[0][1])) == len(out[0][1]) and [sorted(x) for x in out[0][:4]] == [sorted(x) for x in out[1][:4]]
    assert min(out[0][2]) == 0 and max(out[0][2]) == 24 and all(out[0][3])


def test_suffix_dedup_asks_only_for_what_may_repeat(spark):
    """K-grams that stand in many documents, before and behind other bytes each time, make no requests for contexts."""
    rnd = random.Random(11)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    grams = [some(24) for _ in range(20)]
    texts = ["".join(some(20) + rnd.choice(grams) for _ in range(10)) for _ in range(60)]

    def asked(texts):
        block = suffixdedup._pack(np.arange(len(texts)), np.array([len(t) for t in texts]), np.frombuffer("".join(texts).encode(), np.uint8))
        [grams] = suffixdedup._ask_grams(1)([suffixdedup._batch([(0, suffixdedup.BLOCK, block)])])
        told = [r for batch in suffixdedup._answer_grams(suffixdedup.HOT)([grams]) for r in batch.to_pylist()]
        rows = [tuple(r.values()) for r in told] + [(0, suffixdedup.BLOCK, block)]
        return sum(len(suffixdedup._unpack(x, "<i8", "<u8", "<i8", "?", "u1")[1]) for batch in suffixdedup._ask_contexts(1)([suffixdedup._batch(rows)]) for x in batch["payload"].to_pylist())

    assert asked(texts) == 0
    assert asked([*texts, texts[3][40:100]]) > 0
    passages = ["".join(some(rnd.randrange(25)) + rnd.choice(grams) + some(2) for _ in range(8)) for _ in range(30)]
    texts += passages + [p[i : i + rnd.choice([49, 50, 51, 80])] for p in passages for i in (0, 9, 31)]
    own = list(enumerate(texts))
    want = [(i, n, gone, spans, sha) for i, n, gone, spans, sha, _ in sorted(brute_spans(own))]
    got = suffixdedup.dedup(spark.createDataFrame(own, "doc_id bigint, text string"), keep_bytes=False)
    assert sorted(tuple(r)[:5] for r in got.collect()) == want and any(x[2] for x in want)


@pytest.mark.parametrize("hot", [5, suffixdedup.HOT])
def test_suffix_dedup_in_rounds(docs, hot, monkeypatch):
    """Requests for contexts come in rounds, each of a part of the k-grams, where they would take too much disk at once."""
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    get = lambda **kw: sorted(tuple(r) for r in suffixdedup.dedup(docs, keep_bytes=False, hot=hot, **kw).select(*columns).collect())
    sizes, save = [], suffixdedup.common.save
    monkeypatch.setattr(suffixdedup.common, "save", lambda df, name: sizes.append((name, save(df, name).count())) or save(df, name))
    want = get(rounds=1)
    assert get(rounds=3) == want and any(x[2] for x in want)
    assert [name for name, _ in sizes] == ["shared", "least", "shared", "least", "least", "least"] and all(n for _, n in sizes)
    shared = docs.sparkSession.createDataFrame([(0, suffixdedup.KEYS, bytes(100 << 20))], suffixdedup._ROWS)
    assert suffixdedup._rounds(shared, 400 << 20) == 3 and suffixdedup._rounds(shared, 2 << 30) == 1
