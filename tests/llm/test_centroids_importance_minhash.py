"""op11, op12 and op13 against brute force and on the cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from loginloom.llm import centroids, importance, minhash

VECTORS = "vec_id long, embedding array<double>, cluster string"
DOCS = "doc_id long, text string, node string, rank int"


# ---- op11 ------------------------------------------------------------------------------------------------------------


def clustered(rows, k, rounds, d):
    """The contract, vector by vector, in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = Counter()
    for _, n, dist in out:
        inertia[n] += dist
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, n, dist, inertia[n], sum(inertia.values()), sha[n]) for i, n, dist in out]


def test_search_equals_measuring_all():
    rng = np.random.default_rng(1)
    for spread, k in ((1, 8), (3, 40), (5_000, 16), (1 << 27, 5)):
        x = rng.integers(-spread, spread + 1, (3_000, 6))
        c = np.concatenate([rng.integers(-spread, spread + 1, (k - 1, 6)), x[:1]])
        distance = ((x[:, None, :] - c[None]) ** 2).sum(2)
        number, best, measured = centroids.nearest(x, c)
        assert (number == distance.argmin(1)).all() and (best == distance.min(1)).all()  # argmin takes the smaller number
        assert measured < len(x) * k


def test_clusters_equal_brute_force_in_every_case(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(i % 3, 0.4) for _ in range(5)], "x") for i in range(120)]
    rows += [(200 + i, [0.25] * 5, None) for i in range(70)]  # a third of all vectors are one
    rows += [(7, [9.0] * 5, "x"), (7, [9.0] * 5, "x"), (None, [1.0] * 5, "x")]
    rows += [(300, None, "x"), (301, [1.0] * 4, "x"), (302, [1.0, None, 1.0, 1.0, 1.0], "x"), (303, [float("nan")] * 5, "x"), (304, [float("inf")] * 5, "x"), (305, [], "x")]
    got = [tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(5), k=8, rounds=4, dimensions=5).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(clustered(rows, 8, 4, 5), key=key)
    assert len(got) == 193 and {r[0] for r in got if r[0] is None or r[0] >= 300} == {None}


def test_few_vectors_equal_vectors_and_none(spark):
    same = [(i, [0.5, -0.5], "x") for i in range(9)]  # equal centroids: all go to number 0, the others stay
    got = centroids.cluster(spark.createDataFrame(same, VECTORS), k=8, rounds=3, dimensions=2).collect()
    assert {(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got} == {(0, 0, 0, 0)} and len(got) == 9
    two = [tuple(r) for r in centroids.cluster(spark.createDataFrame(same[:1] + [(50, [3.0, 1.0], "x")], VECTORS), k=8, rounds=3, dimensions=2).collect()]
    assert sorted(r[2] for r in two) == [0, 0] and {r[1] for r in two} == {0, 1}
    for rows in ([], [(1, None, "x")], [(None, [1.0, 2.0], "x")]):
        assert centroids.cluster(spark.createDataFrame(rows, VECTORS), k=8, rounds=2, dimensions=2).collect() == []
    far = centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0], "x"), (2, [-1e300, 0.0], "x")], VECTORS), k=1, rounds=1, dimensions=2).collect()
    assert {r.distance for r in far} == {1 << 54}  # saturated, around the mean 0


# ---- op12 ------------------------------------------------------------------------------------------------------------


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    have = Counter(bucket(f) for r in docs for f in features_of(r[1]))
    want = Counter(bucket(f) for t in target for f in features_of(t))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1.0) * (s + 10_000.0) / ((have[b] + 1.0) * (t + 10_000.0))))
    out = []
    for doc_id, text, *_ in docs:
        fs = features_of(text)
        weight, score = sum(gain(bucket(f)) for f in fs), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words_of(text)), len(fs), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = place
    return out


def _key(r):
    return tuple((x is None, x or 0) for x in r)


def test_resampling_equals_brute_force_in_every_case(spark):
    rnd = random.Random(5)
    some = ["Über", "naïve", "the", "THE", "x1", "a-b", "№7", "O'Neil", "tab\tbed", "汉字", "end.\n", "0"]
    docs = [(i, " ".join(rnd.choices(some, k=rnd.randint(0, 60))), "n", i) for i in range(150)]
    docs += [(500 + i, docs[3][1] + " the the", "n", 0) for i in range(80)]  # a third of all rows are one text
    docs += [(900, None, "n", 1), (901, "", "n", 1), (902, " ... ", "n", 1), (None, "the " * 30, "n", 1), (903, "the naïve " * 20_000, "n", 1), (904, "ab" * 100_000 + " the", "n", 1)]
    docs += [(905, "x1 the " * 15, "n", 1)] * 2  # a repeated row
    target = ["the naïve O'Neil writes naïve 汉字", None, "", "the naïve " * 9]
    d = spark.createDataFrame(docs, DOCS).repartition(7)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in importance.resample(d, b, percent=20).collect()]
    assert sorted(got, key=_key) == sorted(map(tuple, resampled(docs, target, 20, 20)), key=_key)
    assert importance.resample(d.limit(0), b).collect() == []
    none = {r.doc_id: r.weight for r in importance.resample(d, b.limit(0)).collect()}
    assert none[900] == 0 and none[903] < 0  # counts of no target text are 0


def test_features_of_a_chunk_in_runs(monkeypatch):
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("aB0 -éЖ", k=rnd.randint(0, 90))) for _ in range(60)] + ["", "a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for most in (2, 5, 300_000):
        monkeypatch.setattr(importance, "WORDS", most)
        got = Counter((int(d), int(b)) for doc, bucket in importance.features(raw, at, 10_000) for d, b in zip(doc, bucket))
        assert got == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features_of(t))


def test_crcs_of_all_lengths():
    raw = np.random.default_rng(7).integers(0, 256, 1_000_000, np.uint8)
    start = np.array([0, 3, 9, 0, 77, 1, 5, 8, 0] + [11] * 40)
    length = np.array([0, 1, 255, 256, 257, 511, 512, 70_003, 1_000_000] + [13] * 40)
    assert importance.crcs(raw, start, length).tolist() == [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(start, length)]


# ---- op13 ------------------------------------------------------------------------------------------------------------


def near_components(docs):
    """Exact sets, every pair, least reachable doc_id."""
    sets = []
    for doc_id, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d[0], len(s), least.get(find(i)) if s else d[0], d[0] == (least.get(find(i)) if s else d[0])) for i, (d, s) in enumerate(zip(docs, sets))]


def edited(rnd, words, share):
    out = list(words)
    for k in rnd.sample(range(len(out)), int(len(out) * share)):
        out[k] = f"e{rnd.randint(0, 10**6)}"
    return out


def test_near_copies_of_a_hot_group_and_of_all_cases(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    base = rnd.choices(vocab, k=120)
    docs = [(i, " ".join(edited(rnd, base, rnd.choice((0.0, 0.01, 0.02, 0.03, 0.05)))), "n", 0) for i in range(150)]  # near and less near copies of one text
    passage = rnd.choices(vocab, k=60)
    docs += [(1_000 + i, " ".join(rnd.choices(vocab, k=rnd.randint(20, 90)) + passage), "n", 0) for i in range(120)]  # a passage in common is not enough
    for g in range(12):
        text = rnd.choices(vocab, k=rnd.randint(30, 200))
        docs += [(2_000 + 10 * g + i, " ".join(edited(rnd, text, 0.02 * i)).upper(), "n", 0) for i in range(4)]
    docs += [(3_000, None, "n", 1), (3_001, "", "n", 1), (3_002, " \t\n", "n", 1), (3_003, "", "n", 1), (None, "a b", "n", 1), (3_004, "A  b", "n", 1), (3_005, "one", "n", 1), (3_006, "one", "n", 1), (3_006, "one", "n", 1)]
    docs += [(3_007, " ".join(rnd.choices(vocab, k=60_000)), "n", 1), (3_008, "z" * 300_000, "n", 1), (None, None, "n", 1)]
    half, other = "p" * 65_536, "q" * 65_536
    docs += [(3_010, half + other, "n", 1), (3_011, other + half, "n", 1)]  # one word each, of equal halves
    got = [tuple(r) for r in minhash.classes(spark.createDataFrame(docs, DOCS).repartition(6)).collect()]
    want = [r if r[0] is not None or r[2] is not None else (*r[:3], True) for r in near_components(docs)]
    want = [(a, n, c, a == c) for a, n, c, _ in want]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert len({c for a, _, c, _ in got if a is not None and a < 150}) < 150 and {c for a, _, c, _ in got if a in (3_010, 3_011)} == {3_010, 3_011}
    assert minhash.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_posterior_bound_is_that_of_the_beta_distribution():
    least = minhash.least_matches(0.8, 1e-4)
    rng = np.random.default_rng(9)
    for n in (32, 96):
        m = int(least[n])
        reach = lambda m: (rng.beta(m + 1, n - m + 1, 2_000_000) >= 0.8).mean()
        assert reach(m) >= 0.6e-4 and reach(m - 1) <= 1.6e-4
    assert least[0] == 0 and (np.diff(least) >= 0).all()


def test_batches_drop_no_more_than_the_miss_probability():
    rng = np.random.default_rng(10)
    x = rng.integers(0, 60_000, (20_000, minhash.HASHES)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < 0.8, x, x + 1).astype(np.uint16)  # signatures of pairs right at the threshold
    kept = minhash.goes_on(x, y, minhash.least_matches(0.8, 1e-3))
    assert len(kept) >= 0.985 * len(x)
    far = np.where(rng.random(x.shape) < 0.3, x, x + 1).astype(np.uint16)
    assert len(minhash.goes_on(x, far, minhash.least_matches(0.8))) == 0


def test_candidates_of_the_bands(spark):
    """Pairs just above the threshold meet in a band."""
    rnd, met, n = random.Random(11), 0, 300
    with np.errstate(over="ignore"):
        for _ in range(n):
            a = [rnd.getrandbits(60) for _ in range(180)]
            b = a[:160] + [rnd.getrandbits(60) for _ in range(20)]  # 160 of 200
            keys = minhash.band_keys(minhash.signatures([np.sort(np.array(x, np.uint64)) for x in (a, b)]))
            met += bool((keys[0] == keys[1]).any())
    assert met >= n - 1
