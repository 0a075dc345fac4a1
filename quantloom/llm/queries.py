"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .ball_kmeans import op13_ball_kmeans
from .bpe import op8_streaming_bpe
from .ctw import op1_ctw
from .divergence import op3_divergence
from .epsilon_grid import op5_epsilon_grid
from .fuzzy_lines import op9_fuzzy_lines
from .licenses import CONTAINMENT, PHRASES, TEMPLATES, op12_license_join
from .packing import op6_concat_cut
from .simhash import op10_simhash_trie
from .spelling import op11_symmetric_delete
from .substring import op4_sentence_spans
from .toxicity import op7_lexicon_automata
from .warc import op2_warc


def _kmeans_sql(rounds: int) -> str:
    """Lloyd's rounds, every vector against every centroid, one pair of expressions a round."""
    parts = [
        """v AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), v) - 1 AS c, v AS m FROM v QUALIFY c < 8)",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
            SELECT rn, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT rn, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY rn)""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (
            SELECT c{r}.c, coalesce(f.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS m FROM (
                    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)
                GROUP BY c) f ON f.c = c{r}.c)""")
    return "WITH " + ", ".join(parts) + f"""
        SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(m, 'string_agg', ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (rn) JOIN c{rounds} c ON c.c = a.c"""


def _license_sql() -> str:
    """Every block's tokens against every template's, counted without any filter."""
    values = lambda rows: ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(rows))
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    return f"""
        WITH w AS MATERIALIZED (
            SELECT row_number() OVER () AS rn, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
            FROM documents),
        t AS (SELECT t.*, string_split(text, ' ') AS tw FROM (VALUES {values(TEMPLATES)}) t(template, text, label)),
        tt AS (
            SELECT template, label, list_distinct({pairs.format('tw')}) AS tokens, (2 ** ceil(log2(len(tw) - 1)))::INT AS class FROM t),
        tx AS (SELECT template, label, class, len(tokens) AS size, ceil({CONTAINMENT} * len(tokens) - 1e-9) AS need, unnest(tokens) AS token FROM tt),
        spots AS MATERIALIZED (
            SELECT rn, i - 1 AS pos, token FROM (SELECT rn, unnest({pairs.format('words')}) AS token, unnest(range(1, len(words))) AS i FROM w)
            WHERE token IN (SELECT token FROM tx)),
        hits AS (
            SELECT rn, template, label, count(DISTINCT token) / any_value(size) AS c FROM (
                SELECT rn, template, label, size, need, token, unnest([pos // class, pos // class - 1]) AS block FROM spots JOIN tx USING (token))
            GROUP BY rn, template, label, block HAVING count(DISTINCT token) >= any_value(need)),
        own AS (SELECT rn, list(DISTINCT label) AS labels, max(c) AS best FROM hits GROUP BY rn),
        p AS (SELECT p.*, string_split(phrase, ' ') AS pw FROM (VALUES {values(PHRASES)}) p(k, phrase, label)),
        places AS (SELECT rn, label, i - 1 AS start FROM (SELECT rn, words, unnest(range(1, len(words) + 1)) AS i FROM w) x, p WHERE words[i] = pw[1] AND words[i : i + len(pw) - 1] = pw),
        base AS (SELECT rn, count(*) AS n, min(start) AS a, max(start) AS b, list(DISTINCT label) AS labels FROM places GROUP BY rn)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
               array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
               (CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END)::DOUBLE AS score
        FROM w LEFT JOIN base USING (rn) LEFT JOIN own USING (rn)
    """


QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_warc": op2_warc,
    "op3_divergence": op3_divergence,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_epsilon_grid": op5_epsilon_grid,
    "op6_concat_cut": op6_concat_cut,
    "op7_lexicon_automata": op7_lexicon_automata,
    "op8_streaming_bpe": op8_streaming_bpe,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_symmetric_delete": op11_symmetric_delete,
    "op12_license_join": op12_license_join,
    "op13_ball_kmeans": op13_ball_kmeans,
}

ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op5_epsilon_grid": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
        reach AS (
            SELECT vec_id AS u, vec_id AS w FROM embeddings
            UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links,
               c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN (SELECT u, min(w) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id
    """,
    # The checksum byte by byte over its table of 256 values; near words by the edit distance of all pairs, letters first
    # mapped to one byte each, since the function counts bytes.
    "op11_symmetric_delete": """
        WITH RECURSIVE crc AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(i))),
        letters AS (
            SELECT (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(192, 256) r(i)) AS many,
                   (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(33, 97) r(i)) AS one),
        runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
                lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, crc),
        words AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        plain AS (SELECT word, n, length(word) AS size, translate(word, many, one) AS p FROM words, letters),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM plain a JOIN plain b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word
            WHERE levenshtein(a.p, b.p) = 1),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word
        JOIN formed e ON e.word = k.root AND e.form IS NULL
    """,
    "op13_ball_kmeans": _kmeans_sql(10),
    "op12_license_join": _license_sql(),
}
