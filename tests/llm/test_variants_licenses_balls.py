"""Spelling variants, license scans and ball k-means against plain versions, on dense and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import ball_kmeans, licenses, spelling


# --- spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_by_hand(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 6 and n >= 5})


def variants_by_hand(rows) -> dict:
    n = words_by_hand(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variant_rows(df) -> dict:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_dense_words(spark):
    rng = random.Random(1)
    rows = []
    base = ["aaaaaa", "abcdef", "éléphant", "ÿÀ×÷éé", "letter", "lettre"]
    for k in range(400):
        words = []
        for _ in range(40):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "É", "e"])
            words.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        rows.append((k, " ".join(words)))
    rows += [(None, "letter letter"), (7, None), (8, ""), (9, "Letter," * 3), (9, "Letter," * 3), (10, "x" * 300), (11, "x" * 301), *[(k, "y" * 300) for k in range(6)]]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    got = variant_rows(spelling.variants(df))
    assert got == variants_by_hand(rows)
    assert sum(v[3] > 3 for v in got.values()) > 20 and any(v[1] != v[0] and v[0] for v in got.values())


def test_roots_follow_long_chains(spark):
    pairs = [(f"w{k:03d}", f"w{k + 1:03d}" if k < 99 else None) for k in range(100)]
    got = spelling.roots(spark.createDataFrame(pairs, "word string, form string")).collect()
    assert {(r.word, r.root) for r in got} == {(f"w{k:03d}", "w099") for k in range(100)}


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


# --- license scans


def pairs_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [f"{a} {b}" for a, b in zip(w, w[1:])]


def scan_by_hand(text, phrases, templates, containment):
    w, pairs = pairs_by_hand(text)
    starts, base = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    best, labels = 0.0, set()
    for template, label in templates:
        t = set(pairs_by_hand(template)[1])
        size = 1
        while size < len(pairs_by_hand(template)[1]):
            size *= 2
        for b in range(0, max(1, len(pairs)), size):
            c = len(t & set(pairs[b : b + 2 * size])) / len(t)
            if c >= containment - 1e-9:
                best, labels = max(best, c), labels | {label}
    score = 1.0 if starts else best
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scanned(df):
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((str((r.doc_id, *[r[c] for c in cols])) for r in df.collect()))


def license_rows():
    rng = random.Random(2)
    rows = [(None, "Under the MIT License"), (None, None), (1, ""), (1, "cc by nc cc by nc"), (1, "cc by nc cc by nc"), (2, "The MIT; licence"), (3, "x" * 5000)]
    for k in range(200):
        t = rng.choice(licenses.TEMPLATES)[0].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            t[rng.randrange(len(t))] = rng.choice(["the", "Über", "license", "mit"])
        filler = lambda: [rng.choice("the of license mit under software and a 2 0".split()) for _ in range(rng.randrange(70))]
        rows.append((10 + k, " ".join(filler() + t + filler()).title() if k % 2 else "-".join(filler() + t + filler())))
    return rows


@pytest.mark.parametrize("containment", [0.5, 0.85, 1.0])
def test_scan_finds_every_block(spark, containment):
    rows = license_rows()
    df = spark.createDataFrame([(i, t, "h", 3) for i, t in rows], "doc_id long, text string, h string, template int")
    got = scanned(licenses.scan(df, containment=containment))
    want = sorted(str((i, *scan_by_hand(t, licenses.PHRASES, licenses.TEMPLATES, containment))) for i, t in rows)
    assert got == want
    assert any("isc" in x for x in got)


def test_scan_of_nothing_and_bounds(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(empty, templates=[("word", "x")])
    with pytest.raises(ValueError):
        licenses.scan(empty, templates=[("two words", "x")] * (licenses.MOST_TEMPLATES + 1))


# --- ball k-means


def lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < 65536 for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = np.array([v for _, v in order[:k]], object)
    x = np.array([v for _, v in kept], object)
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        to = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
        if r < rounds:
            c = np.array([[int(s) // int((to == j).sum()) for s in x[to == j].sum(axis=0)] if (to == j).any() else list(c[j]) for j in range(len(c))], object)
    best = [int(d[i, j]) for i, j in enumerate(to)]
    own = [sum(b for b, t in zip(best, to) if t == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return sorted(str((i, int(j), b, own[j], sum(best), sha[j])) for (i, _), j, b in zip(kept, to, best))


def vectors(n, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    out = [(int(i), [float(x) for x in centres[i % 5] + rng.normal(size=64) * spread]) for i in range(n)]
    out += [(i, list(v)) for i, v in out[:20]]  # repeated rows
    nan, inf = float("nan"), float("inf")
    out += [(None, [0.0] * 64), (None, [0.5] * 64), (n + 1, None), (n + 2, []), (n + 3, [1.0] * 63), (n + 4, [nan] + [1.0] * 63), (n + 5, [inf] * 64), (n + 6, [None] + [0.0] * 63), (n + 7, [1e30] * 64)]
    return out


def clustered(df):
    return sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in df.collect())


@pytest.mark.parametrize("spread", [0.001, 0.05, 3.0])
def test_balls_give_lloyds_clusters(spark, spread):
    rows = vectors(300, spread=spread)
    df = spark.createDataFrame([(i, v, i, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster long, home int")
    want = lloyd([(i, None if v is None or any(x is not None and not math.isfinite(x) for x in v) else v) for i, v in rows])
    assert clustered(ball_kmeans.clusters(df.repartition(5))) == want


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3 - 1) / 1024] * 64) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clustered(ball_kmeans.clusters(df)) == lloyd(rows)


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert clustered(ball_kmeans.clusters(spark.createDataFrame(rows, kind))) == lloyd(rows)
    assert ball_kmeans.clusters(spark.createDataFrame([], kind)).count() == 0


def test_core_is_compared_with_nothing():
    c = [[0, 0], [100, 0], [1000, 0]]
    near = ball_kmeans.neighbours(c, [60, 60, 60])
    assert [[j for j, _ in n] for n in near] == [[1], [0], []]
    v = np.array([[1, 0], [49, 0], [50, 0], [51, 0]], np.int64)
    to, d, own = ball_kmeans.nearest(v, np.zeros(4, np.int32), np.array(c), near)
    assert to.tolist() == [0, 0, 0, 1] and d.tolist() == [1, 2401, 2500, 2401] and own.tolist() == [1, 2401, 2500, 2601]


# --- archives that end early


def test_a_stream_cut_at_a_record_is_an_error():
    import gzip
    import io
    import zlib

    from quantloom.llm import warc

    one = [warc.page_record(k, f"http://x/{k}", b"p" * 500, "0" * 64, None) for k in range(3)]
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    head = z.compress(one[0] + one[1]) + z.flush(zlib.Z_FULL_FLUSH)
    whole = head + z.compress(one[2]) + z.flush()
    read = lambda data: len(list(warc.records(warc.inflated(io.BytesIO(data)))))
    assert read(whole) == 3 and read(b"".join(map(gzip.compress, one))) == 3 and read(b"") == 0
    for cut in (head, whole[:-1], whole[:-8], gzip.compress(one[0]) + head):
        with pytest.raises(ValueError):
            read(cut)
