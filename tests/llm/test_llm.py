"""The training-data operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import differences
from quantloom.llm import bpe, components, ctw, divergence, epsilon_grid, fuzzy_lines, near_copies, packing, queries, simhash, substring, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
#: Clashing column names stand beside the ones that operators read.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, line int, h1 long, h long, n int, fp long, at int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, 7, 7, 7, 7, 7, 7, 7) for i, t, lang in rows], SCHEMA)


def odd(spark):
    a = "One two three four five six. Seven eight nine ten eleven twelve! The end of all that is here now.\nA second line of some words."
    return frame(spark, [(1, a, "en"), (1, a, "en"), (2, a, None), (3, None, "en"), (4, "", "xx"), (5, " \n\t ", "de"), (6, LONG, "en"), (None, a, "en"), (7, "word " * 60, "fr"), (8, "é😀 \x00 x", "es")])


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def groups(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


# --- components ------------------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(150)] + [(7, 7)]
    df = spark.createDataFrame(edges + edges[:10] + [(None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    want = groups([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert got.keys() == want.keys()
    assert len({(got[n], want[n]) for n in want}) == len(set(want.values())) == len(set(got.values()))
    assert components.connected_components(df.limit(0)).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------------------------


def sequential_ctw(text, depth):
    """log2 probability of a text under an untrained tree that learns as it goes, bit by bit."""
    counts, total = {}, 0.0
    data = b"\0" * depth + text + b"\0"

    def weighted(path, node):
        """log probability of all bits seen at a node below the context ``path`` (newest byte first)."""
        n0, n1 = counts.get((path, node), (0, 0))
        if not n0 + n1:
            return 0.0
        kt = float(ctw.log_kt(np.array([n0]), np.array([n1]))[0])
        if len(path) == depth:
            return kt
        below = sum(weighted(path + (b,), node) for b in range(256) if (path + (b,), node) in counts)
        return np.logaddexp(kt, below) - math.log(2)

    for i in range(depth, len(data)):
        ctx = tuple(reversed(data[i - depth : i]))
        node = 1
        for k in range(7, -1, -1):
            bit = data[i] >> k & 1
            for d in range(depth + 1):
                n = counts.get((ctx[:d], node), (0, 0))
                counts[ctx[:d], node] = (n[0] + (1 - bit), n[1] + bit)
            node = node * 2 + bit
    for node in range(1, 256):
        total += weighted((), node)
    return total / math.log(2)


def test_ctw_weights_equal_those_of_the_definition():
    text, depth = b"abracadabra abracadabra", 2
    codes, counts = np.unique(ctw.grams(text, depth), return_counts=True)
    _, lw, _, _ = ctw.Subtree(codes, counts, 0, depth).roots()
    assert lw.sum() / math.log(2) == pytest.approx(sequential_ctw(text, depth), abs=1e-9)


def test_ctw_probabilities_sum_to_one_and_the_parts_agree(spark):
    text = b"the cat sat on the mat and the rat sat on the cat"
    seen, counts = np.unique(ctw.grams(text, 5), return_counts=True)
    ctx = int(seen[20]) >> 8
    every = np.union1d(seen, (ctx << 8) | np.arange(256))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, seen)] = counts
    whole = np.zeros(len(every))
    for _, _, p in ctw.Subtree(every, n, 0).bits():
        whole += np.log10(p)
    assert (10 ** whole[every >> 8 == ctx]).sum() == pytest.approx(1, abs=1e-9)
    df = spark.createDataFrame(list(zip(every.tolist(), n.tolist())), "gram long, count long")
    got = {r.gram: r.logp for r in ctw.gram_scores(df).collect()}
    assert np.allclose([got[g] for g in every.tolist()], whole, atol=1e-9)


def test_lookup_tables():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    values = rng.random(len(keys))
    at = rng.integers(0, len(keys), 20_000)
    assert (ctw.Lookup(keys, values)(keys[at]) == values[at]).all()
    with pytest.raises(KeyError):
        ctw.Lookup(keys, values)(np.array([1 << 50]))


def test_ctw_base_score_and_odd_rows(spark):
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet").limit(60)):
        rows = df.select("doc_id", "text").collect()
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        words = lambda t: [*(t or "").encode().lower().split(), b""]
        c = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
        n, v = sum(c.values()), len(c)
        want = sorted((-1 if r.doc_id is None else r.doc_id, held(r.doc_id), len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r.text)), 4)) for r in rows)
        out = ctw.score(df, block_bytes=3000).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
        assert all(r.score < 0 and r.bits_per_byte > 0 for r in out)
    assert ctw.score(odd(spark).limit(0)).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, wide = "x" * 150, "é" * 60
    rows = [(3, "u\n1", big), (1, "a", big), (2, None, None), (5, "b", wide), (None, "c", big), (4, "d", wide), (6, "e", "s"), (7, "f", "s"), (1, "a", big), (9, "z", "\r\n\r\nWARC/1.1\r\n" * 20000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first long")
    out = warc.read_archives(warc.normalise_archives(warc.write_monolithic(warc.with_revisits(pages)))).collect()
    assert len(out) == len(rows)
    of = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out}
    assert of == {(3, "revisit", 1, 150), (1, "response", None, 150), (2, "response", None, 0), (5, "revisit", 4, 120), (None, "response", None, 150), (4, "response", None, 120), (6, "response", None, 1), (7, "response", None, 1), (9, "response", None, 280000)}
    assert {r.payload_digest for r in out if r.page_id in (1, 3)} == {hashlib.sha256(big.encode()).hexdigest()}
    assert next(r.uri for r in out if r.page_id == 3) == "u%0A1"
    assert warc.read_archives(warc.normalise_archives(warc.write_monolithic(warc.with_revisits(pages.limit(0))))).count() == 0


def test_normaliser_writes_members_that_stand_alone():
    body = [warc.page_record(i, f"u{i}", b"p" * i * 70000, hashlib.sha256(b"p" * i * 70000).hexdigest(), None) for i in range(5)]
    for whole in (zlib.compressobj(6, zlib.DEFLATED, 31), None):
        if whole:
            source = io.BytesIO(whole.compress(b"".join(body)) + whole.flush())
        else:  # several members, cut anywhere
            import gzip

            joined = b"".join(body)
            source = io.BytesIO(gzip.compress(joined[:1000]) + gzip.compress(joined[1000:]))
        target = io.BytesIO()
        index = list(warc.normalise(source, target))
        data = target.getvalue()
        for i, line in enumerate(index):
            ((headers, block),) = warc.records(iter([zlib.decompress(data[line["offset"] : line["offset"] + line["length"]], 31)]))
            assert headers["WARC-Record-ID"] == f"<urn:page:{i}>" and warc.payload_of(block) == (i * 70000, b"p" * i * 70000)
    with pytest.raises(ValueError):
        list(warc.records(iter([body[1][:-9]])))


# --- 3 ---------------------------------------------------------------------------------------------------------------


def base_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = list(zip(w, w[1:], w[2:]))
    c = Counter(win)
    covered = {p for k, z in enumerate(win) if c[z] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_divergence_base_rules_and_odd_rows(spark):
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        want = sorted((-1 if r.doc_id is None else r.doc_id, *base_rules(r.text)) for r in df.select("doc_id", "text").collect())
        out = divergence.judged(df).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
        for r in out:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert divergence.judged(odd(spark).limit(0)).count() == 0


def test_jensen_shannon_distance(spark):
    df = spark.createDataFrame([([1.0, 3.0, 0.0], [2.0, 0.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "p array<double>, q array<double>")
    got = [r.d for r in df.select(divergence.distance(F.col("p"), F.col("q")).alias("d")).collect()]
    p, q = np.array([0.25, 0.75, 0]), np.array([0.5, 0, 0.5])
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert got[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and got[1] is None


def divergence_by_hand(rows):
    """doc_id -> verdict, by plain loops."""
    m = divergence
    every = sorted({w for v in m.COMMON.values() for w in v})
    lists = {**m.COMMON, m.OTHER: every}
    data = {}
    for i, lang, x in rows:
        lang = lang if lang in m.COMMON else m.OTHER
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        n = [sum(c in m.WHITE for c in x), sum(c in m.SYMBOLS for c in x), sum(c in m.STOPS for c in x), sum(c in m.DIGITS for c in x), len(re.findall(r"[A-ZÀ-ÖØ-Þ]", x))]
        counts = Counter(words)
        hist = [counts[w] for w in lists[lang]]
        data[i] = (lang, len(words), np.array([*n, len(x) - sum(n)], float), np.array([*hist, len(words) - sum(hist)], float))

    def jsd(p, q):
        if not p.sum() or not q.sum():
            return None
        p, q = p / p.sum(), q / q.sum()
        h = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, q if a is p else p) if x)
        return math.sqrt(max(0.0, (h(p) + h(q)) / 2))

    def sums(ids):
        out = {}
        for i in ids:
            lang, _, c, w = data[i]
            a = out.setdefault(lang, [np.zeros_like(c), np.zeros_like(w)])
            a[0] += c
            a[1] += w
        return out

    first = sums(data)
    near = [i for i, (lang, n, c, w) in data.items() if n >= m.REFINE_WORDS and jsd(c, first[lang][0]) <= m.REFINE_CHARS and jsd(w, first[lang][1]) <= m.REFINE]
    refs = first | sums(near)
    out = {}
    for (i, _, x), (lang, n, c, w) in zip(rows, data.values()):
        failed = n < 50 or 100 * base_rules(x)[4] > 50 * n
        odd_chars = c.sum() >= m.MIN_CHARS and jsd(c, refs[lang][0]) > m.CHAR_LIMIT + m.CHAR_NOISE / math.sqrt(c.sum())
        odd_words = n >= m.MIN_WORDS and jsd(w, refs[lang][1]) > m.WORD_LIMIT + m.WORD_NOISE / math.sqrt(n)
        out[i] = not (failed or odd_chars or odd_words)
    return out


def test_divergence_verdicts_equal_plain_loops(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = divergence_by_hand([(r.doc_id, r.lang, r.text) for r in df.collect()])
    assert {r.doc_id: r.kept for r in divergence.judged(df).collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_divergence_rejects_junk_and_keeps_prose(spark):
    j = divergence.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97
    assert n.get((0, False), 0) / (n.get((0, False), 0) + n.get((0, True), 0)) > 0.9


# --- 4 ---------------------------------------------------------------------------------------------------------------


def spans_by_hand(rows):
    """(doc_id, text) -> text without the sentences that a later occurrence covers."""
    seen, out = set(), {}
    for i, x in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], 0)):
        parts, words = substring.sentences(x or "")
        gone = set()
        for a in range(len(parts)):
            b = a + substring.MIN_SENTENCES
            while b <= len(parts) and sum(map(len, words[a:b])) < substring.MIN_WORDS:
                b += 1
            if not words[a] or b > len(parts):
                continue
            span = tuple(w for ws in words[a:b] for w in ws)
            gone |= set(range(a, b)) if span in seen else set()
            seen.add(span)
        out[i, x] = None if x is None else "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def test_substring_equals_brute_force(spark):
    rows = documents()
    want = spans_by_hand(rows)
    got = substring.op4_sentence_spans(spark, SF).collect()
    assert len(got) == len(rows) and all(r.text == want[r.doc_id, dict(rows)[r.doc_id]] for r in got)
    assert any(r.removed for r in got) and all(bool(r.removed) == bool(r.repeats_of) for r in got)
    for r in got:
        x = dict(rows)[r.doc_id]
        cut = "".join(x[a:b] for a, b in zip([0, *(s.end for s in r.removed)], [*(s.begin for s in r.removed), len(x)]))
        assert cut == r.text


def test_sentences_are_lossless_and_cut_alike():
    rng = random.Random(3)
    for _ in range(200):
        x = "".join(rng.choice(["a", "Bc ", "d, ", ". ", "!\n", "\n\n", "é ", "; ", "  ", "word " * 30]) for _ in range(rng.randrange(30)))
        assert "".join(substring.sentences(x)[0]) == x
    passage = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa. Lambda mu nu xi omicron. Pi rho sigma tau upsilon. Phi chi psi omega. "
    a, b = substring.sentences("one two three " + passage)[0], substring.sentences("Other words here. " + passage + "More.")[0]
    assert a[1:5] == b[2:6]


def test_substring_odd_rows(spark):
    out = substring.remove_repeats(odd(spark))
    rows = out.collect()
    assert len(rows) == 10 and out.columns[:-2] == odd(spark).columns
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert texts[1][0] == texts[1][1] and texts[3] == [None] and texts[4] == [""] and texts[2][0] != texts[None][0]
    assert substring.remove_repeats(odd(spark).limit(0)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cid long, size long")


def links_by_hand(rows, t):
    ok = lambda e, label: label is not None and bool(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
    f = lambda e: np.array(e, np.float32).astype(float)
    good = [k for k, (_, e, label) in enumerate(rows) if ok(e, label)]
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and f(rows[a][1]) @ f(rows[b][1]) / math.sqrt((f(rows[a][1]) @ f(rows[a][1])) * (f(rows[b][1]) @ f(rows[b][1]))) >= t]
    n = Counter(x for p in pairs for x in p)
    root = groups(pairs, range(len(rows)))
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], n[k], least[root[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("block", [16, 2048])
def test_epsilon_grid_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[rng.integers(12)] + rng.normal(scale=0.15, size=8)).astype(np.float32).tolist(), int(rng.integers(2))) for k in range(300)]
    rows += [(300 + k, rows[3][1], rows[3][2]) for k in range(20)] + [(400, [2 * x for x in rows[5][1]], rows[5][2])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in epsilon_grid.ego_join(vectors(spark, rows), block=block).collect())
    assert got == links_by_hand(rows, 0.98)


def test_epsilon_grid_odd_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 1), (2, e, 1), (3, e, 2), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [math.nan, 1.0, 1.0], 1), (8, e, None), (9, [], 1), (10, [1.0, 2.0], 1), (11, [math.inf, 1.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsilon_grid.ego_join(vectors(spark, rows)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False)} | {k: (0, k, True) for k in range(3, 12)}
    assert epsilon_grid.ego_join(vectors(spark, rows).limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_packing_holds_every_id_once(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet").repartition(5)):
        rows = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in rows)
        pieces = packing.pack(df).collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u2")
            assert len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
            by_seq[p.sequence_id].append(p)
            by_doc[p.doc_id, p.sequence_id * 1024 + p.offset - p.start].append((p.start, ids, p.doc_tokens))
        got = Counter()
        for (doc, _), parts in by_doc.items():
            parts.sort(key=lambda x: x[0])
            ids = np.concatenate([x for _, x, _ in parts])
            assert [s for s, _, _ in parts] == np.cumsum([0, *(len(x) for _, x, _ in parts)])[:-1].tolist() and len(ids) == parts[0][2]
            got[doc, tuple(ids.tolist())] += 1
        assert got == want
        full = sorted(by_seq)
        assert full == list(range(len(full)))
        for k in full:
            at = 0
            for p in sorted(by_seq[k], key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at == 1024 or k == full[-1]
    assert packing.pack(odd(spark).limit(0)).count() == 0


def test_encoder_equals_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for x in ["", " ", "a<|endoftext|>b", "x" * 5000, " " * 3000 + "y", "é😀\x00\n\n\t z", "don't I'LL 123456", "日本語 " * 50]:
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids


# --- 7 ---------------------------------------------------------------------------------------------------------------


def distance_at_most(a, b, k, prefix):
    d = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        d.append([i] + [0] * len(b))
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return min(d[len(a)] if prefix else d[len(a)][-1:]) <= k


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = [("".join(rng.choice("abc") for _ in range(rng.randrange(5, 12))), rng.random() < 0.4, rng.random()) for _ in range(12)]
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        base = rng.choice(terms)[0]
        word = list(base)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
        word = "".join(word)
        want = any(distance_at_most(t, word, toxicity.edits(len(t)), s) for t, s, _ in trie_terms(trie))
        assert (trie.walk(word) is not None) == want
        if want and len(word) >= 4 and any(distance_at_most(t, word, toxicity.edits(len(t)), False) for t, s, _ in trie_terms(trie) if not s):
            assert trie.match(word) is not None  # the probes lose no near word


def trie_terms(trie):
    return [(t, False, w) for t, w in trie.exact.items()] + [(t, True, w) for t, w in trie.stem.items()]


def test_toxicity_learns_words_stems_and_misspellings(spark):
    rng = random.Random(4)
    plain = ["tree", "river", "stone", "cloud", "meadow", "window", "garden", "paper"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(20)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(20)] = rng.choice(["snarkel", "grumbol", "zwick" + rng.choice("abcdef")])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs += [(900, "a tree and a snarkle"), (901, "grumbool river"), (902, "zwickk"), (903, None), (904, ""), (None, "snarkel")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r["__score"] for r in toxicity.scored(d, l).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(600)) and got[901] >= 0.5 and got[902] >= 0.5
    assert got[903] == got[904] < 0.5 and all(0 <= s <= 1 for s in got.values())
    assert set(r["__score"] for r in toxicity.scored(d, l.limit(0)).collect()) == {0.0}
    assert toxicity.scored(odd(spark), l).count() == 10 and toxicity.scored(d.limit(0), l).count() == 0


def test_quotation_weighs_less_than_abuse():
    trie = toxicity.Trie([("snarkel", False, 5.0)])
    abuse, quote = toxicity.features("you are a snarkel today", trie), toxicity.features('he said "snarkel" was the word', trie)
    assert abuse[4] > quote[4] > 0 and quote[5] > abuse[5]


def test_contractions_are_no_quotation():
    trie = toxicity.Trie([("snarkel", False, 5.0)])
    plain = toxicity.features("you do act like a snarkel", trie)
    assert (toxicity.features("you don't act like a snarkel", trie) == plain).all()
    assert (toxicity.features("it\u2019s you, don\u2019t act like a snarkel", trie)[4] == plain[4]) and plain[4] == 6.25
    assert toxicity.features("they 'act like a snarkel'", trie)[4] < 5 > toxicity.features("he wrote: \u201cthat is a snarkel thing\u201d", trie)[4]


def test_toxicity_carries_clashing_columns_and_samples_by_hash(spark):
    texts = ["a plain river stone", "you snarkel of a person"]
    rows = [(i, texts[i % 2] + f" n{i}", "en") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2, "clash") for i in range(200)], "doc_id long, quality int, toxic int, text string")
    out = toxicity.scored(frame(spark, rows), labels)
    assert out.columns == [*frame(spark, rows).columns, "__score"]
    assert all((r["__score"] >= 0.5) == bool(r.doc_id % 2) for r in out.collect())
    some = toxicity.learning_rows(frame(spark, rows), labels, 60).select("doc_id").collect()
    assert 30 < len(some) < 90


# --- 8 ---------------------------------------------------------------------------------------------------------------


def merged(symbols, rank):
    s = list(symbols)
    while len(s) > 1:
        k = min(range(len(s) - 1), key=lambda i: (rank.get((s[i], s[i + 1]), 1 << 30), i))
        if (s[k], s[k + 1]) not in rank:
            break
        s[k : k + 2] = [s[k] + s[k + 1]]
    return s


def test_streamed_merges_equal_whole_ones():
    rng = random.Random(7)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if (a, b) not in merges and a + b not in tokens and len(a + b) < 9:
                merges.append((a, b))
                tokens.append(a + b)
        m = bpe.Merger({t: k for k, t in enumerate(tokens)}, merges, "")
        rank = {p: k for k, p in enumerate(merges)}
        m.window = m.ahead + rng.randrange(4, 20)
        for _ in range(8):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(200)))
            want = merged(text, rank)
            ids = [m.vocab[c] for c in text]
            assert [m.tokens[i] for i in m.stream(iter(ids))] == want == [m.tokens[i] for i in m.merge(ids.copy())]
            assert [m.tokens[i] for i in m._merge_long(ids.copy())] == want if text else True


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    m = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    hard = ["", "  ", " ΑΣ ΣΑΣ é İstanbul ǅ", "a" * 20000, "ab" * 9000, "".join(rng.choice("etaoinshr") for _ in range(30000)), "!?" * 7000, "<|endoftext|>x<|startoftext|> y", "x\x1cy\x1fz \x85 q w​z", "'s'tis don't I'LL 123", "日本語テキスト" * 50, "é" * 5000]
    for x in hard:
        e = t.encode(x, add_special_tokens=False).ids
        assert m.encode(x) == e
        d = bpe.Decoder(m.merger.tokens | {i: s for s, i in m.special.items()})
        assert d.feed(e[:3]) + d.feed(e[3:]) == t.decode(e, skip_special_tokens=False)
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = Counter()
        for r in rows:
            e = t.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(e), sha(" ".join(map(str, e))), sha(t.decode(e, skip_special_tokens=False))] += 1
        assert Counter(tuple(r) for r in bpe.round_trip(df).collect()) == want
    assert bpe.round_trip(odd(spark).limit(0)).count() == 0


def test_long_runs_leave_in_batches():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    m = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    for x in ("".join(rng.choice("etaoin") for _ in range(400_000)), "é" * 150_000 + "!?" * 100_000 + "12ab" * 60_000, "a" * bpe.FEED * 3):
        want = t.encode(x, add_special_tokens=False).ids
        groups = list(m.pieces(x))
        assert [i for g in groups for ids, _ in g for i in ids] == want and max(len(ids) for g in groups for ids, _ in g) <= bpe.FEED
        d = bpe.Decoder(m.names)
        assert "".join([d.feed(ids) for g in groups for ids, _ in g]) == t.decode(want, skip_special_tokens=False)


def test_text_decoder_holds_back_unfinished_characters():
    m = bpe.transducer(public_tokenizers.path("word_bpe_49k.json"))
    ids = m.encode("naïve 😀 日本 café")
    d = bpe.TextDecoder(m.merger.tokens, m.suffix)
    assert "".join([d.feed([i]) for i in ids] + [d.feed([], final=True)]).split() == "naïve 😀 日本 café".split()


# --- 9 ---------------------------------------------------------------------------------------------------------------


def normal_line(x):
    plain = regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", x.lower()).strip(" ")
    return regex.sub(r"\p{Nd}", "0", plain) if regex.search(r"\p{L}", x) else plain


def near_lines(a, b):
    """Edit similarity in words, alone."""
    a, b = a.split(" "), b.split(" ")
    most = int(max(len(a), len(b)) * (1 - fuzzy_lines.SIMILARITY) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def lines_by_hand(rows):
    """doc_id -> numbers of the lines to remove, where every pair of similar lines is linked."""
    occ = defaultdict(list)
    for i, x in sorted({(i, x) for i, x in rows if x is not None}, key=lambda r: (r[0] is not None, r[0])):
        for k, line in enumerate(x.split("\n")):
            n = normal_line(line)
            if len(n) >= fuzzy_lines.MIN_CHARS or len(n.split(" ")) >= fuzzy_lines.MIN_WORDS:
                occ[n].append((i, k))
    names = list(occ)
    bags = [set(n.split(" ")) for n in names]
    many = [len(n.split(" ")) >= fuzzy_lines.MIN_WORDS for n in names]
    # Lines without a third of their words in common aren't measured: all changes of these tests are to whole words.
    links = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if many[i] and many[j] and 3 * len(bags[i] & bags[j]) >= max(len(bags[i]), len(bags[j])) and near_lines(names[i], names[j])]
    root, gone = groups(links, range(len(names))), defaultdict(set)
    members = defaultdict(list)
    for k, n in enumerate(names):
        members[root[k]] += occ[n]
    for v in members.values():
        for i, k in sorted(v, key=lambda o: (o[0] is not None, o))[1:]:
            gone[i].add(k)
    return gone


def test_fuzzy_lines_equal_brute_force(spark):
    """The corpus' own near lines, and a crowd of near copies of a few, against edit similarity alone."""
    rows = documents()
    rng = random.Random(9)
    base = [x for _, x in rows if 300 < len(x) < 1500][:6]
    for k in range(60):
        words = base[k % 6].split(" ")
        words[rng.randrange(len(words))] = "zz"
        rows.append((5000 + k, " ".join(words)))
    gone = lines_by_hand(rows)
    got = fuzzy_lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: set(r["__gone"] or ()) for r in got} == {i: gone[i] for i, _ in rows}
    assert all(r.text == "\n".join(x for k, x in enumerate(dict(rows)[r.doc_id].split("\n")) if k not in gone[r.doc_id]) for r in got)


@pytest.mark.parametrize("length, changed, least", [(8, 1, 0.8), (16, 2, 0.85), (40, 4, 0.95), (320, 20, 0.95)])
def test_near_lines_are_found_at_any_length(spark, length, changed, least):
    """Recall against edit similarity of 0.8: pairs of lines in which words are replaced, far from any other pair."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, n = [], 60
    for k in range(n):
        while True:
            a = [word() for _ in range(length)]
            b = a.copy()
            for at in rng.sample(range(length), changed):
                b[at] = word()
            if near_lines(" ".join(a), " ".join(b)):
                break
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = fuzzy_lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("__gone is not null").select("doc_id").collect()
    assert all(r.doc_id % 2 for r in got) and len(got) >= least * n


def test_lines_of_a_crowded_key_in_different_groups_are_linked(spark):
    rng = random.Random(6)
    common = [f"w{k}" for k in range(24)]
    rows = []
    for g in range(12):  # groups of lines that share a passage, so that keys are crowded with different groups
        own = ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(24)]
        for k in range(4):
            words = common + own
            words[24 + rng.randrange(24)] = f"c{k}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = fuzzy_lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("__gone is null").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 48, 4))


def test_fuzzy_lines_odd_rows(spark):
    out = fuzzy_lines.remove_lines(odd(spark))
    rows = out.collect()
    assert len(rows) == 10 and out.columns[:-1] == odd(spark).columns
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert texts[1] == ["", ""] and texts[2] == [""] and len(texts[None][0]) > 50  # the null id ranks first
    assert texts[3] == [None] and texts[4] == [""] and texts[6] == [LONG]
    assert fuzzy_lines.remove_lines(odd(spark).limit(0)).count() == 0


def test_lines_that_differ_in_digits_quotes_or_spaces_are_equal(spark, tmp_path):
    import corpus_pipeline

    same = ["Publié le 3 mai 2021 – page 7 d’un «bon» livre", "Publié le 9 mai 2034 — page 8 d'un \u00a0“bon” livre…"]
    short = ["Subscribe now!", "二零二一年的第一场雪比往常来得更晚一些。"]
    rows = [(1, same[0], 0), (2, same[1], 0), *((3 + k, x, 0) for k, x in enumerate(short * 2)), (7, "1 2 3 4 5 6", 0), (8, "2 3 4 5 6 7", 0), (9, "Yes.", 0), (10, "Yes.", 0), (11, "मैं ने कहा कि वह", 0), (12, "मैं ने कहा की वह", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    folder = f"{tmp_path}/t"
    docs.write.parquet(f"{folder}/documents.parquet")
    got = queries.QUERIES["op9_fuzzy_lines"](spark, folder).collect()
    assert sorted(r.doc_id for r in got if r.removed_lines) == [2, 5, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, SF).collect() if r.text == "") == [2, 5, 6]


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_fingerprint_by_hand():
    for text in ("", "One", "one two", "A b c", "the cat sat on the mat the cat sat on the"):
        w = text.lower().split()
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def crowd(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64).view(np.uint64)
    near = base[rng.integers(0, 6, n // 2)].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    return np.unique(np.concatenate([near, rng.integers(0, 1 << 63, n - len(near), dtype=np.int64).view(np.uint64)]))


@pytest.mark.parametrize("leaf", [4, 40, 1 << 15])
def test_trie_join_connects_what_brute_force_connects(spark, leaf):
    fps = crowd(400, leaf)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))], range(len(fps)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in simhash.trie_join(df, 2, leaf).collect()]
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert all(near[at[u], at[v]] or want[at[u]] == want[at[v]] for u, v in links)
    assert groups([(at[u], at[v]) for u, v in links], range(len(fps))) == want


def test_simhash_groups_and_odd_rows(spark):
    rows = documents()
    got = {r.doc_id: r for r in simhash.op10_simhash_trie(spark, SF).collect()}
    fps = np.array([simhash.fingerprint(x) for _, x in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    root = groups([(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))], range(len(rows)))
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == f"{fps[k]:016x}" and got[i].component_id == rows[root[k]][0]
    out = {(r.doc_id, r.component_id) for r in simhash.near_groups(odd(spark)).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3)} <= out
    kept = simhash.keep_one(odd(spark)).collect()
    assert sorted(r.doc_id is None and -1 or r.doc_id for r in kept) == [-1, 3, 6, 7, 8]
    assert simhash.near_groups(odd(spark).limit(0)).count() == simhash.keep_one(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("budget", [3, 5])
def test_trie_join_descends_for_wider_budgets(spark, budget):
    fps = np.unique(np.random.default_rng(budget).integers(0, 1 << 63, 120, dtype=np.int64)).view(np.uint64)
    near = fps ^ np.uint64(sum(1 << (63 - b) for b in range(budget)))  # all of it in the leading bits
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([fps, near]).view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in simhash.trie_join(df, budget, 4).collect()]
    root = groups(links, [r.fp for r in df.collect()])
    assert all(root[int(a)] == root[int(b)] for a, b in zip(fps.view(np.int64), near.view(np.int64)))


def near_by_hand(rows):
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root, least = groups([(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if like(sets[a], sets[b])], range(len(rows))), {}
    for k, r in root.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(least.values())


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng, rows = np.random.default_rng(7), []
    for n in (0, 1, 60, 64, 65, 300, 1024, 1025, 5000):
        a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        for gone, new in ((0, 0), (n // 20, n // 20), (n // 10, 0), (0, n // 4), (n // 2, n // 2)):
            b = np.unique(np.concatenate([a[gone:], rng.integers(-(1 << 63), (1 << 63) - 1, new)]))
            rows.append((near_copies.sketch(a).tolist(), near_copies.sketch(b).tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, d long").withColumn("bits", near_copies.bits_apart("a", "b"))
    got = [(r.bits, r.d) for r in df.collect()]
    assert all(bits <= d for bits, d in got) and all(bits == 0 for bits, d in got if d == 0)
    assert sum(bits for bits, _ in got) > sum(d for _, d in got) / 5


@pytest.mark.parametrize("common, most", [(1, 1 << 19), (1, 8), (32, 1 << 19)])
def test_near_dedup_equals_brute_force_jaccard(spark, common, most):
    rng, rows = random.Random(common + most), documents()
    base = [x for _, x in rows if len(x.split()) > 100][:5]
    for k in range(100):  # near copies on either side of the limit
        words = base[k % 5].split()
        for _ in range(rng.randrange(1, 2 + len(words) // 25)):
            words[rng.randrange(len(words))] = f"zz{rng.randrange(99)}"
        rows.append((5000 + k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(60))  # a common passage is no near copy
    rows += [(6000 + k, " ".join([*(f"u{k}x{j}" for j in range(30)), passage])) for k in range(40)]
    rows += [(7000, "a b"), (7001, "A  b"), (7002, "a c"), (7003, ""), (7004, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_hand(rows)
    assert sorted(r.doc_id for r in near_copies.keep_one(df, common, most).collect()) == want
    if common == 32:
        assert sorted(r.doc_id for r in pipeline_near_dedup(spark, df)) == want


def pipeline_near_dedup(spark, docs):
    import corpus_pipeline

    return corpus_pipeline.near_dedup(spark, docs, SF).collect()


def test_near_dedup_odd_rows(spark):
    kept = near_copies.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id is None and -1 or r.doc_id for r in kept.collect()) == [-1, 3, 6, 7, 8]
    assert near_copies.keep_one(odd(spark).limit(0)).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == names and docs.count() <= before
        if name in ("line_dedup", "substring_dedup"):
            assert docs.count() == before and docs.where("n_chars <> char_length(text)").count() == 0
    left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items()}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r.doc_id: r.n for r in got} == want == {r.doc_id: r.d for r in got}


def test_pipeline_takes_odd_rows(spark):
    import corpus_pipeline

    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
