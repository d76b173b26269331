"""Each operator against a brute-force version, and on odd tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenpress.llm import decontam, langid, packing, quality, quality_rules, repeats, secret_scan, simhash, substring, suffix, warc
from tokenpress.llm.common import table, word_bounds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, th string, _row int, found string, fp int, g int, w int, m int"


def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def frame(spark, rows):
    """Documents with columns whose names the operators use within."""
    return spark.createDataFrame([(i, t, lang, src, None, "x", "y", 1, "z", 2, 3, 4, 5) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared, other = text(70), text(120)
    rows = [(1, text(100) + " " + shared + " " + text(20), "en", "a"), (2, shared + "\t" + text(30), "en", "a"), (3, None, None, None), (4, "", "fr", "a"), (5, " \n\t ", "fr", None),
            (6, other, "de", "b"), (7, other, "de", "b"), (None, other + " end", "de", "b"), (8, "x " * 900, "en", "c"), (9, "a" * 2000, "en", "c"), (10, "é😀 " * 300, None, "c"),
            (11, text(4000), "en", "d"), (12, "one two", "en", "d"), (12, "one two", "en", "d"), (13, "ONE Two", "en", "d"), (14, text(60) + "\n" + text(60) + "\x85" + text(10), "es", "d")]
    return rows, frame(spark, rows)


def every(df):
    return [tuple(r) for r in df.collect()]


OPERATORS = {
    "outliers": lambda d, s: quality_rules.outliers(d), "words": lambda d, s: substring.drop_repeated_windows(d), "bytes": lambda d, s: suffix.drop_repeated_bytes(d),
    "simhash": lambda d, s: simhash.near_duplicates(d), "language": lambda d, s: langid.identify(d), "quality": lambda d, s: quality.scored(d, s.createDataFrame([], "doc_id long, quality int")),
    "packing": lambda d, s: packing.pack(d, path()), "secrets": lambda d, s: secret_scan.digests(secret_scan.scan(d)),
    "leaks": lambda d, s: decontam.contaminated(d, s.createDataFrame([(1, None), (None, "one two")], "item_id long, text string")),
    "redact": lambda d, s: secret_scan.redact(d), "clean": lambda d, s: decontam.clean(d, s.createDataFrame([], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert every(OPERATORS[name](frame(spark, []), spark)) == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_back(spark, odd, name):
    rows, d = odd
    got = OPERATORS[name](d, spark).collect()
    if name == "leaks":
        assert sorted((r.doc_id, r.item_id) for r in got) == [(12, None), (12, None), (13, None)]
    elif name != "packing":
        assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)


def brute_words(rows, k):
    first = {}
    key = lambda i: (1 << 63) if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - k + 1):
            x = tuple(w[p : p + k])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        c = [0] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < key(i):
                c[p : p + k] = [1] * k
        out.append((i, len(w), sum(c), hashlib.sha256(b" ".join(x for x, y in zip(w, c) if not y)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, k):
    count = Counter(x[p : p + k] for x in {(i, t): (t or "").encode() for i, t in rows}.values() for p in range(len(x) - k + 1))
    out = []
    for i, t in rows:
        x = (t or "").encode()
        c = bytearray(len(x))
        for p in range(len(x) - k + 1):
            if count[x[p : p + k]] > 1:
                c[p : p + k] = b"\1" * k
        out.append((i, len(x), sum(c), len([s for s in bytes(c).split(b"\0") if s]), hashlib.sha256(bytes(a for a, b in zip(x, c) if not b)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_windows(spark, odd, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(repeats, "HOT", 1)
    rows, d = odd
    for k in (50, 12):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_repeated_windows(d, k).collect()]
        assert sorted(got, key=str) == brute_words([r[:2] for r in rows], k)


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(spark, odd, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(repeats, "HOT", 1)
    rows, d = odd
    for k in (400, 150):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.drop_repeated_bytes(d, k).collect()]
        assert sorted(got, key=str) == brute_bytes([r[:2] for r in rows], k)


def suspects(unit, texts):
    """Share of the regions whose minimiser is found elsewhere too."""
    mini = repeats.regions(unit, texts)[3]
    count = Counter(mini.tolist())
    return sum(count[m] > 1 for m in mini.tolist()) / len(mini)


def test_common_short_grams_make_no_candidates_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "and", "in", "to", "is", "an", "by"], k=400)).encode() for _ in range(60)]
    grams = Counter(tuple(w[i : i + 4]) for w in (t.split() for t in texts) for i in range(397))
    assert sum(n for n in grams.values() if n > 1) > 0.9 * sum(grams.values())
    assert suspects(repeats.Words(50), texts) < 0.01


def bucket(texts):
    """Regions of one minimiser, as a bucket's task gets them; holders have growing ids."""
    return [(7, b"%d" % i, i, 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("alike", [False, True])
def test_windows_of_a_bucket_by_words(alike, monkeypatch):
    rng = random.Random(4)
    text = lambda n: rng.choices(["aa", "b", "ccc", "d"], k=n)
    shared = text(30)
    texts = [text(i) + shared + text(9) for i in range(5)] + [text(40)]
    if alike:  # equal hashes decide nothing
        monkeypatch.setattr(substring, "run_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    out = substring._flag(12)(bucket([" ".join(t).encode() for t in texts]))
    got = {(int(fp), at + i) for fp, at, run in zip(out["fp"], out["at"], out["run"]) for i in range(run)}
    windows = [(tuple(t[p : p + 12]), i, p) for i, t in enumerate(texts) for p in range(len(t) - 11)]
    assert got == {(i, p) for w, i, p in windows if min(j for v, j, _ in windows if v == w) < i} and got


def test_common_short_grams_make_no_candidates_of_bytes():
    rng = random.Random(6)
    phrases = [bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=48)) for _ in range(64)]
    texts = [b"".join(rng.choices(phrases, k=25)) for _ in range(40)]
    assert suspects(repeats.Bytes(400), texts) < 0.05


@pytest.mark.parametrize("alike", [False, True])
def test_windows_of_a_bucket_by_bytes(alike, monkeypatch):
    rng = random.Random(7)
    text = lambda n: bytes(rng.choices(b"abc", k=n))
    shared, k = text(150), 100
    texts = [text(10 * i) + shared + text(40) for i in range(4)] + [text(300), text(20) + b"x" * 130]
    ordered = []
    sort = suffix.equal_suffixes
    monkeypatch.setattr(suffix, "equal_suffixes", lambda t, starts, depth: ordered.append(len(starts)) or sort(t, starts, depth))
    if alike:  # equal hashes decide nothing
        monkeypatch.setattr(suffix, "run_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    out = suffix._flag(k)(bucket(texts))
    got = {(int(fp), at + i) for fp, at, run in zip(out["fp"], out["at"], out["run"]) for i in range(run)}
    windows = [(t[p : p + k], i, p) for i, t in enumerate(texts) for p in range(len(t) - k + 1)]
    count = Counter(w for w, _, _ in windows)
    assert got == {(i, p) for w, i, p in windows if count[w] > 1} and got
    assert ordered == [len(windows) if alike else len(got)]


def test_repeated_text_is_returned(spark, odd):
    rows, d = odd
    for out in (substring.drop_repeated_windows(d, keep_text=True), suffix.drop_repeated_bytes(d, keep_text=True)):
        assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out.collect())


def test_equal_suffixes():
    rng = np.random.default_rng(1)
    for size, letters, depth in ((900, 2, 70), (3000, 3, 400), (500, 1, 100), (700, 2, 20)):
        text = rng.integers(97, 97 + letters, size).astype(np.uint8)
        text[size // 2 : size // 2 + size // 3] = text[: size // 3]
        starts = np.arange(size - depth + 1)
        cls = suffix.equal_suffixes(np.r_[text, np.zeros(depth + 64, np.uint8)], starts, depth)
        raw = text.tobytes()
        groups = defaultdict(set)
        for p in starts:
            groups[raw[p : p + depth]].add(int(cls[p]))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_outlier_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in quality_rules.outliers(d).collect()}
    for r in d.collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text) if x]
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = [0] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = [1] * 8
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), sum(mark))
        assert g.base_failed == (len(w) < 20 or 100 * sum(mark) > 30 * len(w)) and not (g.base_failed and g.kept)


def numpy_mcd(x):
    """The estimate of robust_estimates by plain NumPy: mean and covariance with its floor."""
    q = quality_rules
    floor = np.diag(np.square(q.FLOOR))
    grid = lambda v: np.floor(v * 64 + 0.5) / 64
    m = np.median(grid(x), 0)
    sd = np.maximum(1.4826 * np.median(grid(np.abs(x - m)), 0), 1e-3)
    z = (x - m) / sd
    u = z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]
    dist = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    found = []
    for y in (None, u, np.tanh(z)):
        c = np.eye(5) if y is None else y.T @ y
        d = np.sqrt(np.diag(c))
        c = np.divide(c, np.outer(d, d), out=np.zeros((5, 5)), where=np.outer(d, d) > 0)
        np.fill_diagonal(c, 1)
        mean, s = m, c * np.outer(sd, sd) + floor
        for _ in range(q.STEPS):
            bins = np.floor(np.log2(np.maximum(dist(mean, s), 1e-6)) * q.BINS)
            inner = x[bins <= np.sort(bins)[int(np.ceil(len(x) * q.SHARE)) - 1]]
            mean, s = inner.mean(0), np.cov(inner.T, bias=True) / q.SHRUNK[int(len(inner) * 100 / len(x) + 0.5)] + floor
        found.append((np.linalg.slogdet(s)[1], mean, s))
    _, mean, s = min(found, key=lambda f: f[0])
    inner = x[dist(mean, s) <= q.chi2_quantile(0.975, 5)]
    mean, s = inner.mean(0), np.cov(inner.T, bias=True) / q.shrunk(0.975) + floor
    return mean, s, dist(mean, s)


def test_robust_estimate(spark):
    """One group with a fifth of outliers: estimates as by concentration steps in NumPy, and the outliers go."""
    from tokenpress.llm.common import Scratch

    rng = np.random.default_rng(2)
    good = rng.multivariate_normal([5, 1.7, 0.1, 0, 0], np.diag([0.6, 0.01, 0.01, 0.01, 0.01]) + 0.004, 800)
    bad = rng.normal([9, 3, 2, 1, 1], 0.1, (200, 5))
    x = np.vstack([good, bad])
    d = spark.createDataFrame([("a", *map(float, r)) for r in x], ["g", *quality_rules.DIMS])
    est = quality_rules.robust_estimates(d, Scratch(spark, "test")).first()
    m, s, final = numpy_mcd(x)
    assert np.allclose(est.m, m, atol=1e-6)
    low = np.zeros((5, 5))
    low[np.tril_indices(5)] = est.w
    assert np.allclose(low, np.linalg.inv(np.linalg.cholesky(s)), atol=1e-5)
    assert (final[800:] > quality_rules.CUT).all() and (final[:800] <= quality_rules.CUT).mean() > 0.98
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_outlier_verdicts(spark):
    """Every row's verdict by NumPy: large groups by themselves, small ones by all rows of their language, or of the table. Each
    statistic can reject by itself."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    lines = lambda: "\n".join(text(6) for _ in range(30))
    rows = [(i, text(rng.randint(40, 400)), "en", ("a", "b")[i % 2]) for i in range(160)] + [(200 + i, text(rng.randint(40, 400)), "en", "rare") for i in range(5)]
    rows += [(300 + i, lines(), None, "few") for i in range(20)]
    again = text(30)
    rows += [(400, again + " " + text(150) + " " + again, "en", "a"), (401, text(100) + " #$%&" * 40, "en", "rare"), (402, "\n".join([lines(), *["same old line here"] * 9]), "en", "b"), (403, text(9000), None, "few"), (404, "w" * 3000 + " " + text(40), "en", "a")]
    d = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules.outliers(d).collect()}
    stats = {r.doc_id: r for r in quality_rules.transformed(quality_rules.statistics(d)).collect() if not r.base_failed}
    x = {i: [r[c] for c in quality_rules.DIMS] for i, r in stats.items()}
    groups = {("en", "a"): ["a"], ("en", "b"): ["b"], ("en", "rare"): ["a", "b", "rare"], (None, "few"): ["a", "b", "rare", "few"]}
    for (lang, source), members in groups.items():
        ids = [i for i, r in stats.items() if r.source in members]
        dist = dict(zip(ids, numpy_mcd(np.array([x[i] for i in ids]))[2]))
        for i, r in stats.items():
            if r.source == source:
                assert abs(got[i].distance - dist[i]) < 1e-4 * (1 + dist[i]) and got[i].kept == (dist[i] <= quality_rules.CUT), i
    assert not any(got[i].kept for i in (400, 401, 402, 403, 404)) and np.mean([r.kept for r in got.values()]) > 0.9
    assert {i: r.kept for i, r in got.items()} == {r.doc_id: r.kept for r in quality_rules.outliers(d.repartition(7, F.rand(3))).collect()}


def brute_components(prints, ids, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 63)
    for i, k in enumerate(ids):
        low[find(i)] = min(low[find(i)], k)
    return {k: low[find(i)] for i, k in enumerate(ids)}


@pytest.mark.parametrize("cell", [1 << 13, 2])
def test_simhash(spark, sf_dir, cell, monkeypatch):
    import xxhash

    monkeypatch.setattr(simhash, "CELL", cell)
    d = table(spark, sf_dir, "documents")
    near = d.filter("doc_id % 3 = 0").select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit(" more words")).alias("text"))
    d = d.select("doc_id", "text").unionByName(near)
    rows = [(r.doc_id, r.text) for r in d.collect()]

    def fp(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in rows]
    want = brute_components(prints, [i for i, _ in rows], 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for (i, _), p in zip(rows, prints)}
    assert len(set(want.values())) < len(want)


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    y[::2] = x[::2] ^ (np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64))
    two = lambda v: ((v[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(int)
    a, b = two(simhash.embed(x)), two(simhash.embed(y))
    assert (np.abs(a - b).sum(1) == simhash.manhattan(simhash.embed(x), simhash.embed(y))).all()
    assert (simhash.manhattan(simhash.embed(x), simhash.embed(y)) <= np.bitwise_count(x ^ y)).all()


def test_components(spark):
    from tokenpress.llm.common import Scratch
    from tokenpress.llm.components import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(200), 100 + rng.randrange(200)) for _ in range(120)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, -7), (7000, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want


def test_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lang = {r.doc_id: r.lang for r in d.collect()}
    got = langid.identify(d).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
    other = d.withColumn("lang", F.when(langid.remainder() == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(other).collect()} == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_language_by_itself(spark, sf_dir):
    """Scores don't depend on what else is in a batch, on the order, or on partitions."""
    d = table(spark, sf_dir, "documents")
    model = langid.fit(d)
    texts = ["no", "a", "", "É", "x.", ".", " ", "the man and", "der die das", "ab\n", *[r.text for r in d.limit(60).collect()]]
    alone = [(a[0], float(b[0])) for a, b in (model.predict([t]) for t in texts)]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(texts))
        langs, scores = model.predict([texts[k] for k in order])
        assert [alone[k] for k in order] == list(zip(langs, scores.tolist()))
    one = {r.doc_id: tuple(r) for r in langid.identify(d.coalesce(1)).collect()}
    assert one == {r.doc_id: tuple(r) for r in langid.identify(d.orderBy(F.desc("doc_id")).repartition(7)).collect()}


def test_rare_language_is_learnt(spark, sf_dir, monkeypatch):
    """Of a language with few rows all are in the sample, however small it is against the others."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(50_000 + i, "ξένος λόγος πάντα ρεῖ " * 3, "el") for i in range(6)], d.schema)
    model = langid.fit(d.unionByName(rare), 60, 20)
    assert "el" in model.languages and model.predict(["πάντα ρεῖ λόγος"])[0] == ["el"]
    assert langid.shares({"a": 3, "b": 100, "c": 1000}, 103) == {"a": 3, "b": 50, "c": 50}
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert len(langid.fit(d.unionByName(rare)).languages) == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_order_and_partitions_do_not_matter(spark, sf_dir, odd, name):
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", "text", "lang", "source").unionByName(odd[1].select("doc_id", "text", "lang", "source"))
    runs = [OPERATORS[name](x, spark).collect() for x in (d.coalesce(1), d.repartition(7, F.rand(1)))]
    if name == "packing":  # sequences may be others, pieces not
        runs = [[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows] for rows in runs]
    exact = [sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows) for rows in runs]
    assert exact[0] == exact[1]


def test_und(spark, odd):
    rows, d = odd
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)


def test_ftrl_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        y = k % 3
        cols = np.unique(np.r_[rng.integers(100 * y, 100 * y + 20, 6), rng.integers(1000, 1400, 6)])
        rows.append((cols, np.full(len(cols), 1.0), y))
    w, b = langid.follow_the_leader(rows, 3)
    z = np.array([w[c].sum(0) + b for c, _, _ in rows])
    y = np.array([r[2] for r in rows])
    assert (z.argmax(1) == y).mean() > 0.98 and (w != 0).mean() < 0.05
    t = langid.calibrated(z * 5, y)
    nll = lambda s: -np.log(langid.softmax(z * 5 / s)[np.arange(len(y)), y]).mean()
    assert nll(t) <= nll(1.0) + 0.02


def test_quality(spark, sf_dir):
    big = re.sub(r"sf0\.001$", "sf0.01", sf_dir)  # the smallest tables have too few labels
    d, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = {r.doc_id: r for r in quality.scored(d, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == q for g, q in held]) >= 0.95
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 for g in got.values())
    changed = labels.withColumn("quality", F.when(langid.remainder() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.scored(d, changed).collect()}
    assert all(abs(again[k] - g.score) < 1e-9 for k, g in got.items())


def test_non_negative_risk():
    """Positives and a mixture with 30 % of them: about as many pass."""
    rng = np.random.default_rng(1)
    p = rng.normal(1.5, 1, (2000, 4))
    u = np.vstack([rng.normal(1.5, 1, (900, 4)), rng.normal(-1.5, 1, (2100, 4))])
    w, b = quality.non_negative(p, u, 0.3)
    right = np.r_[u[:900] @ w + b > 0, u[900:] @ w + b <= 0]
    assert right.mean() > 0.97
    assert abs(quality.mixture_prior(p, u) - 0.3) < 0.1


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"one two two\ntwo", "É!! Ü!! É!! Ü!!".encode(), b"\n\n", b"a" * 5000]
    together = quality.features(texts)
    assert all(np.allclose(quality.features([t])[0], f, atol=1e-6) for t, f in zip(texts, together)) and np.isfinite(together).all()


def test_encoder_matches_tokenizer():
    enc = packing.Encoder(path())
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\r\n", "\t", "'s", "'re", "'", "a", "B", "é", "1", "23", "!", "...", "中", " ", "𝒳", "<|endoftext|>", "\x1c", "\x85", "🎉", "_", "'ll", "'d", "́", "٣", "½", "\U0010ffff"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "\n\n a"]
    for t, ids in zip(texts, enc.ids(texts)):
        assert ids.tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, packing.END], t


def test_packing(spark, odd, sf_dir):
    from zlib import crc32

    enc = packing.Encoder(path())
    for d in (odd[1], table(spark, sf_dir, "documents")):
        rows = packing.pack(d, path(), keep_ids=True).collect()
        bins, docs = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(bytes(r.ids), "<u4")
            assert len(ids) == r.length and crc32(bytes(r.ids)) == r.ids_crc32
            bins[r.sequence_id].append((r.offset, r.length))
            docs[r.doc_id].append((r.piece, r.start, ids))
        for b in bins.values():
            assert sorted(b)[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(sorted(b), sorted(b)[1:])) and sum(n for _, n in b) <= 1024
        for r in d.collect():
            if r.doc_id == 12:
                continue
            ps = sorted(docs[r.doc_id], key=lambda p: p[0])
            ids = np.concatenate([p[2] for p in ps])
            assert ids.tolist() == [*enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END]
            assert [p[0] for p in ps] == list(range(len(ps))) and all(len(p[2]) == 1024 for p in ps[1:])


def test_swaps_only_help():
    rng = random.Random(4)
    for sizes in ([rng.randint(200, 700) for _ in range(900)], [rng.randint(250, 440) for _ in range(900)], [rng.choice([341, 342, 512, 300, 700, 683, 205]) for _ in range(900)], [], [1024], [5]):
        first = packing.best_fit(sizes)
        best = packing.improve(sizes, first)
        assert sorted(i for b in best for i in b) == list(range(len(sizes))) and len(best) <= len(first)
        assert all(sum(sizes[i] for i in b) <= 1024 for b in best)
        if len(sizes) == 900:  # best fit leaves bins that swaps empty
            assert len(best) < len(first)
        square = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        assert square(best) >= square(first)


def test_absorbers():
    rng = random.Random(2)
    bins = [[rng.randint(1, 30) for _ in range(rng.randint(1, 4))] for _ in range(12)]
    free = [max(1, 100 - sum(b)) for b in bins]
    ways = packing.absorbers(np.array([y for b in bins for y in b]), np.array([f for b, f in zip(bins, free) for _ in b]), np.array(free), 100)
    for f in range(101):
        for w in range(101):
            assert ways[f, w] == sum(y < w <= y + g for b, g in zip(bins, free) if g <= f for y in [0, *b])


def test_packing_in_rounds(spark, monkeypatch):
    """Many blocks, of rows without ids and equal in text too: blocks are even, pieces come back once, and bins with room meet again."""
    rng = random.Random(6)
    rows = [(None, "a b", "en", "a")] * 600 + [(i, "w " * rng.randint(150, 300), "en", "a") for i in range(600)] + [(9_000, "x " * 5000, "en", "a")]
    d = frame(spark, rows)
    whole = packing.pack(d, path()).collect()
    sizes, seen = [], packing.arrow_map_all

    def spied(df, *rest):
        sizes.append([r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect()])
        return seen(df, *rest)

    monkeypatch.setattr(packing, "arrow_map_all", spied)
    parts = packing.pack(d, path(), block=60).collect()
    assert len(sizes) > 1 and len(sizes[0]) >= 20 and max(sizes[0]) < 120
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, parts)) == sorted(map(key, whole))
    used = []
    for packed in (whole, parts):
        bins = defaultdict(list)
        for r in packed:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(n for _, n in b) <= 1024
        used.append(len(bins))
    assert used[1] <= used[0] * 1.03


def test_secrets(spark):
    live, copied = "AKIA" + "Z9" * 10, "password = hunter2hunter2"
    rows = [(i, f"é😀 {copied} x", "en", f"s{i % 4}") for i in range(8)] + [(20, f"key {live} and API_key: \"abc.def+9\" secret:token:abcdefgh", "en", "s9"), (21, "deadbeef" * 4 + " token=ab", "en", "s9"), (22, None, None, None),
            (23, "x Qw9aZ8bY7cX6dW5eV4fU3gT2hS1iR0jQ y", "en", "s1")]
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(frame(spark, rows))).collect()}

    def base(t):
        pats = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
        out = [(m.start(), j, f"{k}:{m.start()}:{m.end()}") for j, (k, p, ok) in enumerate(pats) for m in re.finditer(p, t or "") if ok(m)]
        return [x for *_, x in sorted(out)]

    for i, t, *_ in rows:
        b = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest() and set(b) <= set(filter(None, got[i].spans.split(",")))
        assert got[i].n_assign == sum(x.startswith("assign") for x in b)
    assert (got[0].n_examples, got[0].n_live) == (1, 0) and got[20].n_live == 2 and got[23].spans.startswith("pair:2:")
    out = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and live not in out[20] and out[20].startswith("key [REDACTED] and ") and out[22] is None


def test_secrets_of_many_repositories(spark):
    """A placeholder all over one owner is an example for both; a value in as many documents as may be is live."""
    most = secret_scan.MOST_REPOSITORIES
    pair, live = "Qw9aZ8bY7cX6dW5eV4fU3gT2hS1iR0jQ", "token=abc123def456"
    rows = [(i, f"x password=example99 y {pair} z", "en", "s") for i in range(most + 1)] + [(1000 + i, live, "en", "s") for i in range(most)] + [(1000, live, "en", "s")]
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(frame(spark, rows))).collect()}
    assert (got[0].n_examples, got[0].n_live) == (1, 0) and "pair" not in got[0].spans and got[1000].n_live == 1
    out = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and out[1000] == secret_scan.MASK


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_contamination(spark, sf_dir, most, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", most)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (5, 0.8, most))
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontam.contaminated(d, b).collect()}
    items = {r.item_id: decontam.shingles(r.text.encode(), 5) for r in b.collect()}
    want = set()
    for r in d.collect():
        own = decontam.shingles(r.text.encode(), 5)
        want |= {(r.doc_id, i, len(s & own), len(s)) for i, s in items.items() if len(s & own) >= 0.8 * len(s)}
    assert got == want and want
    left = {r.doc_id for r in decontam.clean(d, b).collect()}
    assert left == {r.doc_id for r in d.collect()} - {x[0] for x in want}


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/é b", "<p>one</p>", "x"), (2, None, "<p>one</p>", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", "long " * 100_000, "x"), (None, "u", "<p>one</p>", "x"), (7, "u", "z", "x"), (7, "u", "z", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, capture_id string")
    got = sorted(map(tuple, warc.round_trip(pages, f"file://{tmp_path}/w").collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        first = min(r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None)
        again = i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    files = spark.createDataFrame([(str(p),) for p in (tmp_path / "w").iterdir()], "file string")
    nested = warc.assemble(warc.read(files)).collect()
    assert all(c.response and c.request and c.metadata for c in nested) and {bytes(c.response.payload) for c in nested if c.response.type == "response"} == {(r[2] or "").encode() for r in rows}
    empty = spark.createDataFrame([], pages.schema)
    assert warc.round_trip(empty).collect() == []


def test_warc_of_others(spark, tmp_path):
    """A response that names its request, several metadata records, repeated headers, and records whose capture isn't there."""
    import gzip

    r = lambda kind, i, block=b"a: b\r\n", **more: warc.record(kind, f"<{i}>", "u", "application/warc-fields", block, **more)
    raw = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m3>\r\nWARC-Concurrent-To: <q1>\r\nWARC-Concurrent-To: <p2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [f["warc-concurrent-to"] for f, _ in warc.parse(raw)] == ["<q1> <p2>"]
    parts = [r("request", "q1"), r("response", "p1", WARC_Concurrent_To="<q1>"), r("metadata", "m1", WARC_Concurrent_To="<p1>"), r("metadata", "m2", WARC_Concurrent_To="<q1>"), gzip.compress(raw),
             r("response", "p2"), r("request", "q2", WARC_Concurrent_To="<p2>"), r("request", "q2", WARC_Concurrent_To="<p2>"), r("request", "q3", WARC_Concurrent_To="<p2>"),
             r("request", "q4", WARC_Concurrent_To="<gone>"), r("metadata", "m4", WARC_Concurrent_To="<q4>"), r("metadata", "m5", WARC_Concurrent_To="<q5>"), r("request", "q5"), r("resource", "p3")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    records = warc.read(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "file string"))
    got = {c.capture_id: (c.response and c.response.record_id, [x.record_id for x in c.request], [x.record_id for x in c.metadata]) for c in warc.assemble(records).collect()}
    assert got == {
        "<p1>": ("<p1>", ["<q1>"], ["<m1>", "<m2>"]), "<p2>": ("<p2>", ["<q2>", "<q3>"], ["<m3>"]), "<p3>": ("<p3>", [], []),
        "<gone>": (None, ["<q4>"], ["<m4>"]), "<q5>": (None, ["<q5>"], ["<m5>"]),
    }


def test_warc_parsing():
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nX: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [(f.get("x"), b) for f, b in warc.parse(raw)] == [("a b", b"abc"), (None, b"")]
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))
    assert warc._unchunked(b"3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n") == b"abcde"


def test_word_bounds():
    buf = np.frombuffer("\x0b a  é\x1fb\n".encode(), np.uint8)
    a, b = word_bounds(buf)
    assert [buf[i:j].tobytes().decode() for i, j in zip(a, b)] == ["a", "é\x1fb"]
