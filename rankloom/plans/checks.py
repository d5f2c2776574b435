"""SQL that computes each query of the catalog on its own, for comparison.

The statements are written for DuckDB over the plain tables. They take the direct way
(whole prefix arrays, all query-document pairs, a recursive query for the beam search) and
share no method with the Spark jobs they check.
"""

from __future__ import annotations

from rankloom.functions.fixed import GENERATORS, INPUT_CAP, K_VALUES, MAX_LENGTH, NUM_BEAMS, TEMPLATES
from rankloom.operators.beam import QUERY_BONUS, SMOOTHING
from rankloom.operators.generation import EXTRA_TOKENS, MIN_MARGIN
from rankloom.operators.lexical import B, K1, TIE_BREAKER
from rankloom.plans.experiments import MODEL_IDS
from rankloom.plans.catalog import DEPTH, NEST_ROWS, REQUESTS, TOP, VECTOR_DIM


def _text(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n")) + ")"


_NQ = _text(dict((t[0], t[3]) for t in TEMPLATES)["nq"])
_K_ROWS = ", ".join(f"({k})" for k in K_VALUES)
_TEMPLATE_ROWS = ", ".join(f"({_text(a)}, {_text(b)}, {_text(c)}, {_text(d)})" for a, b, c, d in TEMPLATES)


def _space_tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(lower({column}), '\s+'), lambda t: t <> '')"


def _word_tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _spaced(column: str) -> str:
    return rf"' ' || trim(regexp_replace({column}, '\s+', ' ', 'g')) || ' '"


def _encoded(source: str, key: str) -> str:
    """Token ids of a text table, in order; unknown tokens are 2."""
    return f"""
        SELECT s.{key}, coalesce(e.ids, []) AS ids
        FROM {source} s LEFT JOIN (
            SELECT {key}, list(coalesce(v.token_id, 2) ORDER BY pos) AS ids
            FROM (SELECT {key}, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos
                  FROM (SELECT {key}, {_space_tokens("text")} AS toks FROM {source}))
            LEFT JOIN vocab v USING (token) GROUP BY {key}) e USING ({key})"""


def _edges(source: str) -> str:
    return f"""
        SELECT d AS depth, tokens[1:d] AS p, CASE WHEN d > 0 THEN tokens[d] END AS prev,
               CASE WHEN d < len(tokens) THEN tokens[d + 1] ELSE -1 END AS token,
               count(*) AS n_seq, count(DISTINCT tokens) AS n_paths, bool_or(d = len(tokens) - 1) AS ends
        FROM (SELECT tokens, unnest(range(0, len(tokens) + 1)) AS d FROM {source}) GROUP BY ALL"""


def _postings(corpus: str) -> str:
    def field(name: str) -> str:
        return f"""
            SELECT corpus_id, '{name}' AS field, dl, unnest(toks) AS term
            FROM (SELECT corpus_id, {_word_tokens(name)} AS toks, len({_word_tokens(name)}) AS dl FROM {corpus})"""

    return f"SELECT corpus_id, field, term, dl, count(*) AS tf FROM ({field('title')} UNION ALL {field('text')}) GROUP BY ALL"


def _bm25(postings: str, queries: str) -> str:
    """All scored pairs, ranked."""
    return f"""
        SELECT query_id, corpus_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id DESC) AS rank
        FROM (
            SELECT query_id, corpus_id,
                   round(max(fs) + {TIE_BREAKER} * (sum(fs) - max(fs)), 9) AS score
            FROM (
                SELECT query_id, corpus_id, p.field,
                       sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
                           * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * dl / avg_len))) AS fs
                FROM (SELECT query_id, term, count(*) AS qtf
                      FROM (SELECT query_id, unnest({_word_tokens("text")}) AS term FROM {queries}) GROUP BY ALL) q
                JOIN {postings} p USING (term)
                JOIN (SELECT field, term, count(*)::DOUBLE AS df FROM {postings} GROUP BY ALL) USING (field, term)
                JOIN (SELECT field, count(*)::DOUBLE AS n_docs, avg(dl) AS avg_len
                      FROM (SELECT DISTINCT field, corpus_id, dl FROM {postings}) GROUP BY field) s ON s.field = p.field
                GROUP BY ALL)
            GROUP BY ALL)
        WHERE query_id <> corpus_id"""


def _per_query(run: str, qrels: str, grade: str) -> str:
    """All metrics of queries that are in the run and judged."""
    return f"""
        WITH r AS (SELECT query_id, corpus_id,
                          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id DESC) AS rank
                   FROM {run} WHERE query_id <> corpus_id),
             rel AS (SELECT query_id, corpus_id, {grade} AS g FROM {qrels} WHERE {grade} > 0),
             hit AS (SELECT query_id, rank, g, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth
                     FROM r JOIN rel USING (query_id, corpus_id)),
             ideal AS (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS rank FROM rel),
             q AS (SELECT query_id, count(*) AS n_rel FROM rel WHERE query_id IN (SELECT query_id FROM r) GROUP BY ALL),
             ks(k) AS (VALUES {_K_ROWS})
        SELECT q.query_id, ks.k::BIGINT AS k,
               coalesce((SELECT sum(g / log2(rank + 1)) FROM hit h WHERE h.query_id = q.query_id AND h.rank <= ks.k), 0)
                 / (SELECT sum(g / log2(rank + 1)) FROM ideal i WHERE i.query_id = q.query_id AND i.rank <= ks.k) AS ndcg,
               coalesce((SELECT sum(nth / rank) FROM hit h WHERE h.query_id = q.query_id AND h.rank <= ks.k), 0) / n_rel AS ap,
               (SELECT count(*) FROM hit h WHERE h.query_id = q.query_id AND h.rank <= ks.k) / n_rel AS recall,
               (SELECT count(*) FROM hit h WHERE h.query_id = q.query_id AND h.rank <= ks.k) / ks.k AS prec
        FROM q CROSS JOIN ks"""


def _report(per_query: str) -> str:
    parts = [
        f"SELECT '{name}' AS metric, k, round(avg({column}), 5) AS value FROM {per_query} GROUP BY k"
        for name, column in (("NDCG", "ndcg"), ("MAP", "ap"), ("Recall", "recall"), ("P", "prec"))
    ]
    return " UNION ALL ".join(parts)


def _vector(source: str, key: str) -> str:
    """Non-zero components of the hashed text vectors."""
    return f"""
        SELECT id, i, ((c / sqrt(sum(c * c) OVER (PARTITION BY id)))::FLOAT)::DOUBLE AS value
        FROM (SELECT {key} AS id, ('0x' || left(md5(term), 8))::BIGINT % {VECTOR_DIM} AS i, count(*) AS c
              FROM (SELECT {key}, unnest({_word_tokens("text")}) AS term FROM {source}) GROUP BY ALL)"""


def _cosine(queries: str, corpus: str, query_ids: str, corpus_ids: str, own_length: bool) -> str:
    length = "sqrt(sum(value * value) OVER (PARTITION BY id))" if own_length else "1"
    return f"""
        SELECT query_id, corpus_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id DESC) AS rank
        FROM (SELECT a.query_id, b.corpus_id, round(coalesce(s, 0), 9) AS score
              FROM {query_ids} a CROSS JOIN {corpus_ids} b
              LEFT JOIN (SELECT x.id AS query_id, y.id AS corpus_id, sum(x.value * y.value) AS s
                         FROM (SELECT id, i, value / {length} AS value FROM {queries}) x
                         JOIN (SELECT id, i, value / {length} AS value FROM {corpus}) y USING (i) GROUP BY ALL) m
              ON m.query_id = a.query_id AND m.corpus_id = b.corpus_id)"""


def _bigrams(edges: str) -> str:
    return f"""
        SELECT prev, token, ln((n + {SMOOTHING}) / (sum(n) OVER (PARTITION BY prev)
                            + {SMOOTHING} * (SELECT count(DISTINCT token) FROM {edges} WHERE depth > 0 AND token >= 0))) AS logp
        FROM (SELECT prev, token, sum(n_seq)::DOUBLE AS n FROM {edges} WHERE depth > 0 AND token >= 0 GROUP BY ALL)"""


def _pass_walk(edges: str, bigrams: str) -> str:
    """Steps of a search through complete sequences; the marker -1 is one where others go on."""
    return f"""
        SELECT e.p, e.token, f.f IS NULL AS ends, b.logp
        FROM {edges} e JOIN {bigrams} b USING (prev, token)
        LEFT JOIN (SELECT DISTINCT p AS f FROM {edges} WHERE token >= 0) f ON f.f = list_append(e.p, e.token)
        UNION ALL
        SELECT e.p, -1, true, ln({SMOOTHING} / (n_prev + {SMOOTHING} * (SELECT count(DISTINCT token) FROM {edges} WHERE depth > 0 AND token >= 0)))
        FROM {edges} e JOIN (SELECT DISTINCT p FROM {edges} WHERE token >= 0) USING (p)
        JOIN (SELECT prev, sum(n_seq)::DOUBLE AS n_prev FROM {edges} WHERE depth > 0 AND token >= 0 GROUP BY prev) USING (prev)
        WHERE e.token = -1"""


_BONUS_STEP = f"w.logp + CASE WHEN list_contains(s.ids, w.token) THEN {QUERY_BONUS} ELSE 0 END"
_PREFIX_STEP = "-(((list_sum(s.tokens) + 7 * w.token) % 101) + 1)::DOUBLE / 101 + CASE WHEN list_contains(s.ids, w.token) THEN 0.5 ELSE 0 END"


def _search(name: str, asked: str, walk: str, steps: int, step: str = _BONUS_STEP) -> str:
    """Plain beam search, one step at a time (recursive)."""
    return f"""
        SELECT 0 AS step, query_id, ids, [0]::BIGINT[] AS tokens, 0.0::DOUBLE AS total, false AS ends FROM {asked}
        UNION ALL
        SELECT step, query_id, ids, tokens, total, ends FROM (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY round(total / greatest(len(tokens) - 1, 1), 9) DESC, tokens) AS place
            FROM (
                SELECT s.step + 1 AS step, s.query_id, s.ids,
                       CASE WHEN s.ends THEN s.tokens ELSE list_append(s.tokens, w.token) END AS tokens,
                       CASE WHEN s.ends THEN s.total ELSE s.total + {step} END AS total,
                       s.ends OR w.ends AS ends
                FROM {name} s LEFT JOIN {walk} w ON w.p = CASE WHEN s.ends THEN NULL ELSE s.tokens END
                WHERE s.step < {steps} AND (s.ends OR w.token IS NOT NULL)))
        WHERE place <= {NUM_BEAMS}"""


def _beams(search: str, steps: int) -> str:
    return f"""
        SELECT query_id, tokens, total / greatest(len(tokens) - 1, 1) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(total / greatest(len(tokens) - 1, 1), 9) DESC, tokens) AS rank
        FROM {search} WHERE step = {steps}"""


def _filled(run: str) -> str:
    return f"""
        SELECT q.query_id, d.corpus_id, coalesce(r.score, 0) AS score
        FROM (SELECT DISTINCT query_id FROM qrels) q CROSS JOIN docs d
        LEFT JOIN {run} r ON r.query_id = q.query_id AND r.corpus_id = d.corpus_id"""


# name -> body; each may use the names before it.
_PARTS: dict[str, str] = {
    "docs": "SELECT doc_id, 'd' || doc_id AS corpus_id, text, split_part(text, chr(10), 1) AS title FROM documents",
    "asked": "SELECT item_id, 'q' || item_id AS query_id, text FROM benchmark",
    "qrels": f"""
        SELECT query_id, corpus_id, 1 AS one, 1 + coalesce(quality, 0) AS relevance,
               row_number() OVER (PARTITION BY query_id ORDER BY d.doc_id) AS ord
        FROM (SELECT doc_id, corpus_id, {_spaced("text")} AS t FROM docs) d
        JOIN (SELECT query_id, {_spaced("text")} AS t FROM asked) q ON contains(d.t, q.t)
        LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "turns": "SELECT *, conv_id || '-' || turn AS turn_id FROM conversations",
    "users": "SELECT 'u' || turn_id AS query_id, conv_id, turn, text FROM turns WHERE role = 'user'",
    "replies": "SELECT 'a' || turn_id AS corpus_id, conv_id, turn, text, '' AS title FROM turns WHERE role = 'assistant'",
    "pairs": """
        SELECT query_id, corpus_id, u.text AS query, r.text AS gt
        FROM users u JOIN replies r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1""",
    "vocab": f"""
        SELECT token, n, df, row_number() OVER (ORDER BY n DESC, token) + 2 AS token_id
        FROM (SELECT token, count(*) AS n, count(DISTINCT corpus_id) AS df
              FROM (SELECT corpus_id, unnest({_space_tokens("text")}) AS token FROM docs) GROUP BY token)""",
    "enc": _encoded("docs", "corpus_id"),
    "asked_enc": _encoded("asked", "query_id"),
    "reply_enc": _encoded("replies", "corpus_id"),
    "seqs": f"SELECT corpus_id, [0] || ids[1:{MAX_LENGTH - 1}] || [1] AS tokens FROM enc",
    "asked_seqs": f"SELECT query_id, [0] || ids[1:{MAX_LENGTH - 1}] || [1] AS tokens FROM asked_enc",
    "reply_seqs": f"SELECT corpus_id, [0] || ids[1:{MAX_LENGTH - 1}] || [1] AS tokens FROM reply_enc",
    "titles": "SELECT 't' || corpus_id AS corpus_id, title AS text FROM docs",
    "title_enc": _encoded("titles", "corpus_id"),
    "plain_seqs": f"""SELECT corpus_id, [0] || ids[1:{MAX_LENGTH}] AS tokens FROM enc
        UNION ALL SELECT corpus_id, [0] || ids[1:{MAX_LENGTH}] FROM title_enc""",
    "edges": _edges("seqs"),
    "both_seqs": "SELECT tokens FROM seqs UNION ALL SELECT tokens FROM reply_seqs",
    "both_edges": _edges("both_seqs"),
    "bare_replies": f"SELECT corpus_id, ids[1:{MAX_LENGTH - 1}] || [1] AS tokens FROM reply_enc",
    "reply_edges": _edges("bare_replies"),
    "probes": """
        SELECT corpus_id || '/0' AS probe_id, tokens AS p FROM seqs
        UNION ALL SELECT corpus_id || '/1', tokens[1:len(tokens) - 1] FROM seqs
        UNION ALL SELECT corpus_id || '/2', tokens[1:len(tokens) // 2] FROM seqs
        UNION ALL SELECT query_id, tokens FROM asked_seqs""",
    "allowed": "SELECT probe_id, token FROM probes LEFT JOIN edges USING (p)",
    "bigrams": _bigrams("edges"),
    "walk": "SELECT p, token, ends, logp FROM edges JOIN bigrams USING (prev, token)",
    "search": _search("search", "asked_enc", "walk", MAX_LENGTH + 1),
    "beams": _beams("search", MAX_LENGTH + 1),
    "beam_run": "SELECT query_id, corpus_id, max(exp(score)) AS score FROM beams JOIN seqs USING (tokens) GROUP BY ALL",
    "prefix_search": _search("prefix_search", "asked_enc", "walk", MAX_LENGTH + 1, _PREFIX_STEP),
    "prefix_beams": _beams("prefix_search", MAX_LENGTH + 1),
    "plain_edges": _edges("plain_seqs"),
    "plain_bigrams": _bigrams("plain_edges"),
    "plain_walk": _pass_walk("plain_edges", "plain_bigrams"),
    "plain_search": _search("plain_search", "asked_enc", "plain_walk", MAX_LENGTH + 1),
    "plain_beams": _beams("plain_search", MAX_LENGTH + 1),
    "ending_search": _search("ending_search", "asked_enc", "plain_walk", MAX_LENGTH + 1, "CASE WHEN w.token = -1 THEN 0 ELSE w.logp END"),
    "ending_beams": _beams("ending_search", MAX_LENGTH + 1),
    "prompted": f"SELECT query_id, replace({_NQ}, '[QUERY]', text) AS text FROM asked WHERE query_id IN (SELECT query_id FROM qrels)",
    "prompt_all": _encoded("prompted", "query_id"),
    "prompt_enc": f"SELECT query_id, ids[1:{INPUT_CAP - 1}] AS ids FROM prompt_all",
    "prompt_search": _search("prompt_search", "prompt_enc", "walk", MAX_LENGTH + 1),
    "prompt_beams": _beams("prompt_search", MAX_LENGTH + 1),
    "prompt_run": "SELECT query_id, corpus_id, max(exp(score)) AS score FROM prompt_beams JOIN seqs USING (tokens) GROUP BY ALL",
    "filled_run": _filled("prompt_run"),
    "beam_metrics": _per_query("filled_run", "qrels", "one"),
    "chunk_seqs": f"""
        SELECT corpus_id, [0] || capped[c * {MAX_LENGTH} + 1:(c + 1) * {MAX_LENGTH}] AS tokens
        FROM (SELECT corpus_id, capped, unnest(range(0, len(capped) // {MAX_LENGTH})) AS c
              FROM (SELECT corpus_id, ids[1:{INPUT_CAP - 1}] || [1] AS capped FROM enc))""",
    "chunk_edges": _edges("chunk_seqs"),
    "chunk_bigrams": _bigrams("chunk_edges"),
    "chunk_walk": "SELECT p, token, ends, logp FROM chunk_edges JOIN chunk_bigrams USING (prev, token)",
    "chunk_search": _search("chunk_search", "prompt_enc", "chunk_walk", MAX_LENGTH + 1),
    "chunk_beams": _beams("chunk_search", MAX_LENGTH + 1),
    "chunk_run": "SELECT query_id, corpus_id, max(exp(score)) AS score FROM chunk_beams JOIN chunk_seqs USING (tokens) GROUP BY ALL",
    "chunk_filled": _filled("chunk_run"),
    "chunk_metrics": _per_query("chunk_filled", "qrels", "one"),
    "short_enc": f"SELECT query_id, ids[1:{MODEL_IDS - MAX_LENGTH - 1}] AS ids FROM prompt_all",
    "whole_walk": _pass_walk("edges", "bigrams"),
    "whole_search": _search("whole_search", "short_enc", "whole_walk", MAX_LENGTH),
    "whole_beams": _beams("whole_search", MAX_LENGTH),
    "whole_docs": """
        SELECT query_id, corpus_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
        FROM whole_beams JOIN (SELECT tokens, 'd' || min(corpus_id[2:]::BIGINT) AS corpus_id FROM seqs GROUP BY tokens) USING (tokens)""",
    "postings": _postings("docs"),
    "ranked": _bm25("postings", "asked"),
    "run": "SELECT * FROM ranked WHERE rank <= 1000",
    "top": f"SELECT * FROM ranked WHERE rank <= {TOP}",
    "metrics": _per_query("run", "qrels", "relevance"),
    "reply_postings": _postings("replies"),
    "expanded": "SELECT query_id, query || gt AS text FROM pairs",
    "reply_ranked": _bm25("reply_postings", "expanded"),
    "reply_run": "SELECT * FROM reply_ranked WHERE rank <= 1000",
    "reply_qrels": "SELECT query_id, corpus_id, 1 AS one FROM pairs",
    "reply_metrics": _per_query("reply_run", "reply_qrels", "one"),
    "flags": """
        SELECT t.query_id, t.corpus_id, t.rank, (q.ord IS NOT NULL)::BIGINT AS hit_any, (coalesce(q.ord, 0) = 1)::BIGINT AS hit_first
        FROM top t LEFT JOIN qrels q USING (query_id, corpus_id)""",
    "lists": f"""
        SELECT query_id, (list(hit_any ORDER BY rank) || list_value({", ".join("0" for _ in range(TOP))}))[1:{TOP}] AS p,
               any_value(n_judged) AS n_judged
        FROM flags JOIN (SELECT query_id, count(*) AS n_judged FROM qrels GROUP BY ALL) USING (query_id) GROUP BY query_id""",
    "places": f"SELECT query_id, n_judged, unnest(p) AS p, unnest(range(1, {TOP + 1})) AS i FROM lists",
    "cuts": f"SELECT * FROM (VALUES ('@1', 1), ('@5', 5), ('@10', 10), ('', {TOP})) c(suffix, k)",
    "vectors": "SELECT 'v' || vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings",
    "near": """
        SELECT query_id, corpus_id, label, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id DESC) AS rank
        FROM (SELECT a.id AS query_id, b.id AS corpus_id, b.label, round(list_dot_product(a.e, b.e), 9) AS score
              FROM vectors a JOIN vectors b ON a.id <> b.id)""",
    "neighbours": f"""
        SELECT query_id, i, max(CASE WHEN rank = i + 1 THEN label END) AS p, max(CASE WHEN rank = i THEN label END) AS r
        FROM near JOIN (SELECT unnest(range(1, {TOP + 1})) AS i) ON rank IN (i, i + 1) GROUP BY ALL""",
    "classes": """
        SELECT query_id, label, count(*) FILTER (r = label) AS support, count(*) FILTER (r = label AND p = label) AS tp
        FROM (SELECT query_id, p AS label FROM neighbours UNION SELECT query_id, r FROM neighbours) JOIN neighbours USING (query_id)
        GROUP BY ALL""",
    "weighted_classes": """
        SELECT query_id, label, sum(CASE WHEN r = label THEN 1.0::DOUBLE / i ELSE 0 END) AS support,
               sum(CASE WHEN r = label AND p = label THEN 1.0::DOUBLE / i ELSE 0 END) AS tp
        FROM (SELECT query_id, p AS label FROM neighbours UNION SELECT query_id, r FROM neighbours) JOIN neighbours USING (query_id)
        GROUP BY ALL""",
    "instances": f"""
        SELECT a.query_id, a.i, len(list_intersect(list_distinct([a.r, a.i - 1]), [a.p, b.p])) / len(list_distinct([a.r, a.i - 1])) AS v
        FROM neighbours a JOIN neighbours b ON b.query_id = a.query_id AND b.i = a.i % {TOP} + 1""",
    "doc_vectors": _vector("docs", "corpus_id"),
    "asked_vectors": _vector("asked", "query_id"),
    "reply_vectors": _vector("replies", "corpus_id"),
    "cosine": _cosine("asked_vectors", "doc_vectors", "asked", "docs", True),
    "titled": "SELECT corpus_id, trim(title || ' ' || text) AS text FROM docs",
    "titled_vectors": _vector("titled", "corpus_id"),
    "titled_ranked": _cosine("asked_vectors", "titled_vectors", "asked", "docs", False),
    "titled_run": "SELECT * FROM titled_ranked WHERE rank <= 1000",
    "dense_metrics": _per_query("titled_run", "qrels", "one"),
    "lengths": f"""
        SELECT 'queries' AS part, least(len({_space_tokens("text")}) + 1, {INPUT_CAP}) AS length FROM asked
        UNION ALL SELECT 'prompts', least(len({_space_tokens(f"replace({_NQ}, '[QUERY]', text)")}) + 1, {INPUT_CAP}) FROM asked
        UNION ALL SELECT 'documents', least(len({_space_tokens("text")}) + 1, {INPUT_CAP}) FROM docs""",
    "head": f"""
        SELECT floor(avg(len({_space_tokens("text")}) + 1))::BIGINT AS ave_len
        FROM (SELECT text FROM docs ORDER BY doc_id LIMIT 100)""",
    "prompts": f"SELECT query_id, text, replace({_NQ}, '[QUERY]', text) AS prompt FROM asked",
    "results": f"""
        SELECT query_id, prompt,
               [prompt || ' #0', prompt || ' #1', prompt || ' #2'] AS output, NULL::VARCHAR AS error
        FROM prompts""",
    "assembled": """
        SELECT query_id, corpus_id, a.text AS query, d.text AS gt, output
        FROM results JOIN asked a USING (query_id) JOIN (SELECT * FROM qrels WHERE ord = 1) USING (query_id)
        JOIN docs d USING (corpus_id) WHERE error IS NULL""",
}
_RECURSIVE = {"search", "prefix_search", "plain_search", "prompt_search", "chunk_search", "whole_search", "ending_search"}


def _uses(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b(?!\s*\()", body) is not None


def _sql(select: str) -> str:
    """The statement with the parts it needs, in order."""
    needed: set[str] = set()
    waiting = [select]
    while waiting:
        body = waiting.pop()
        for name, part in _PARTS.items():
            if name not in needed and part is not body and _uses(body, name):
                needed.add(name)
                waiting.append(part)
    if not needed:
        return select
    parts = ",\n".join(f"{name} AS ({_PARTS[name]})" for name in _PARTS if name in needed)
    return f"WITH {'RECURSIVE ' if needed & _RECURSIVE else ''}{parts}\n{select}"


def _ids(column: str) -> str:
    return f"array_to_string({column}, ' ')"


_REQUEST_BUDGET = {
    "chat": ("ave_len + input_len", "NULL::BIGINT"),
    "completion": (f"ave_len + input_len + {EXTRA_TOKENS}", "NULL::BIGINT"),
    "local": (f"ave_len + {EXTRA_TOKENS}", f"ave_len - {MIN_MARGIN}"),
}


def _requests(name: str, stem: str) -> str:
    def lit(value) -> str:
        return "NULL" if value is None else str(value)

    _, _, style, sample, top_k, top_p, n, temperature = next(row for row in GENERATORS if row[0] == name)
    most, least = _REQUEST_BUDGET[style]
    system, template = next((row[2], row[3]) for row in TEMPLATES if row[0] == stem)
    messages = f"'system: ' || {_text(system)} || '|user: ' || prompt" if style == "chat" and system else "NULL"
    error = "'system message missing'" if style == "chat" and not system else "NULL"
    return f"""
        SELECT '{name}' AS generator, '{stem}' AS stem, query_id, {messages} AS messages, {error} AS error, prompt, input_len, '{style}' AS style,
               {most} AS max_tokens, {least} AS min_tokens, {lit(sample)}::BOOLEAN AS do_sample, {lit(top_k)}::BIGINT AS top_k,
               {lit(top_p)}::DOUBLE AS top_p, {lit(n)}::BIGINT AS n_samples, {lit(temperature)}::DOUBLE AS temperature
        FROM (SELECT query_id, prompt, len({_space_tokens("prompt")}) + 1 AS input_len, ave_len
              FROM (SELECT query_id, replace({_text(template)}, '[QUERY]', text) AS prompt FROM asked), head)"""


def _templates(select: str) -> str:
    return f"{select} FROM asked CROSS JOIN (VALUES {_TEMPLATE_ROWS}) t(stem, template_name, sys, template)"


def _one_metric(column: str) -> str:
    return f"SELECT query_id, k, round({column}, 6) AS value FROM metrics"


_EDGE_COLUMNS = "depth, prev, token, n_seq::BIGINT AS n_seq, n_paths::BIGINT AS n_paths, ends"
_RUN_COLUMNS = "query_id, corpus_id, score, rank"
_SAMPLES = "array_to_string(output, '|')"

_APPENDED = """
    SELECT probe_id, e.token FROM all_probes JOIN edges e USING (p) WHERE e.token <> 1
    UNION ALL
    SELECT probe_id, r.token FROM all_probes JOIN edges e USING (p) CROSS JOIN (SELECT token FROM reply_edges WHERE depth = 0) r
    WHERE e.token = 1
    UNION ALL
    SELECT m.probe_id, r.token
    FROM (SELECT probe_id, p[matched + 1:len(p)] AS p
          FROM (SELECT a.probe_id, a.p, max(n.depth) AS matched
                FROM (SELECT probe_id, p, unnest(range(0, len(p) + 1)) AS d FROM all_probes) a
                JOIN (SELECT DISTINCT depth, p FROM edges) n ON n.p = a.p[1:a.d] GROUP BY ALL)
          WHERE matched < len(p)) m
    LEFT JOIN reply_edges r USING (p)"""
_PARTS["more_probes"] = """
    SELECT b.corpus_id || kind, CASE kind WHEN '/end' THEN s.tokens[1:len(s.tokens) - 1]
                                ELSE s.tokens[1:len(s.tokens) - 1] || b.tokens[1:len(b.tokens) // 2] END
    FROM bare_replies b JOIN replies r USING (corpus_id) JOIN seqs s ON s.corpus_id = 'd' || r.conv_id
    CROSS JOIN (VALUES ('/end'), ('/beyond')) k(kind)"""
_PARTS["all_probes"] = "SELECT * FROM probes WHERE NOT ends_with(probe_id, '/1') UNION ALL SELECT * FROM more_probes"
_PARTS["every_probe"] = "SELECT * FROM probes UNION ALL SELECT * FROM more_probes"

_SELECTS: dict[str, str] = {
    "read_corpus": "SELECT corpus_id, title, text FROM docs",
    "read_queries": "SELECT query_id, text FROM asked WHERE query_id IN (SELECT query_id FROM qrels)",
    "read_qrels": "SELECT query_id, corpus_id, one::BIGINT AS relevance, ord FROM qrels",
    "nest_qrels": f"""SELECT query_id, ((ord - 1) // {NEST_ROWS})::BIGINT AS part, string_agg(corpus_id, ' ' ORDER BY ord) AS corpus_ids,
        string_agg(relevance::VARCHAR, ' ' ORDER BY ord) AS relevances FROM qrels GROUP BY ALL""",
    "dataset_counts": """SELECT 'corpus' AS part, count(*) AS n_rows FROM docs UNION ALL SELECT 'queries', count(*) FROM asked
        UNION ALL SELECT 'qrels', count(DISTINCT query_id) FROM qrels""",
    "read_generations": "SELECT query_id, corpus_id, query, gt, gt AS output FROM pairs",
    "write_generations": """SELECT count(*) AS n_rows, count(DISTINCT query_id) AS n_queries, count(*) AS n_texts,
        sum(length(gt))::BIGINT AS n_chars FROM pairs""",
    "read_embeddings": "SELECT id, i, round(value, 6) AS value FROM reply_vectors",
    "write_prefix_index": """SELECT depth, count(*) AS n_edges, sum(n_seq)::BIGINT AS n_seq, sum(n_paths)::BIGINT AS n_paths
        FROM edges GROUP BY depth""",
    "read_prefix_index": f"SELECT {_EDGE_COLUMNS} FROM edges",
    "write_metrics": f"SELECT metric || '@' || k AS name, value FROM ({_report('metrics')})",
    "experiment_layout": f"""SELECT query_id, corpus_id, rank, 'documents' AS task, 'flan3b' AS generator, 'bm25' AS retriever,
        'nq' AS template, 'none' AS method, '{NUM_BEAMS}' AS num_beams, '{MAX_LENGTH}' AS max_length, 'false' AS chunk_corpus FROM top""",
    "render_prompt": "SELECT query_id, prompt FROM prompts",
    "render_prompt_grid": _templates("SELECT query_id, stem, template_name, replace(template, '[QUERY]', text) AS prompt"),
    "chat_messages": _templates("""SELECT query_id, stem, sys AS system,
        CASE WHEN sys IS NOT NULL THEN replace(template, '[QUERY]', text) END AS user,
        CASE WHEN sys IS NULL THEN 'system message missing' END AS error"""),
    "expand_query": """SELECT 'syn' AS method, query_id, gt AS text FROM pairs
        UNION ALL SELECT 'syn_q', query_id, gt || query FROM pairs
        UNION ALL SELECT 'q_syn', query_id, query || gt FROM pairs
        UNION ALL SELECT 'none', query_id, text FROM users""",
    "limit_queries": """SELECT query_id, text FROM users
        WHERE query_id IN (SELECT query_id FROM (SELECT DISTINCT query_id FROM pairs) ORDER BY query_id LIMIT 100)""",
    "first_positive": "SELECT query_id, corpus_id, text AS gt FROM qrels JOIN docs USING (corpus_id) WHERE ord = 1",
    "hit_flags": "SELECT query_id, corpus_id, rank, hit_any, hit_first FROM flags",
    "judged_queries": "SELECT query_id, text FROM asked WHERE query_id IN (SELECT query_id FROM qrels)",
    "build_vocab": "SELECT token, token_id, n, df FROM vocab",
    "encode_tokens": f"SELECT corpus_id, {_ids('ids')} AS tokens FROM enc",
    "truncate_tokens": f"SELECT corpus_id, {_ids(f'ids[1:{MAX_LENGTH - 1}] || [1]')} AS tokens FROM enc",
    "chunk_tokens": f"""SELECT corpus_id, c AS chunk, {_ids(f'capped[c * {MAX_LENGTH} + 1:(c + 1) * {MAX_LENGTH}]')} AS tokens
        FROM (SELECT corpus_id, capped, unnest(range(0, len(capped) // {MAX_LENGTH})) AS c
              FROM (SELECT corpus_id, ids[1:{INPUT_CAP - 1}] || [1] AS capped FROM enc))""",
    "unchunkable_docs": f"SELECT corpus_id, len(ids) + 1 AS n_tokens FROM enc WHERE len(ids) + 1 < {MAX_LENGTH}",
    "frame_sequences": f"SELECT corpus_id, {_ids('tokens')} AS tokens FROM seqs",
    "cut_at_pad": f"SELECT corpus_id, {MAX_LENGTH + 2}::BIGINT AS n_padded, {_ids('tokens')} AS tokens FROM seqs",
    "token_length_stats": """SELECT part, count(*) AS n_rows, round(avg(length), 6) AS mean, round(median(length), 6) AS median,
        round(stddev_pop(length), 6) AS std FROM lengths GROUP BY part""",
    "token_length_histogram": """
        SELECT bin, round(lo + (hi - lo) * bin / 20, 6) AS left_edge, round(lo + (hi - lo) * (bin + 1) / 20, 6) AS right_edge,
               (SELECT count(*) FROM lengths l WHERE l.part = 'documents'
                AND least(floor((l.length - lo) * 20 / (hi - lo)), 19) = bin) AS n
        FROM (SELECT min(length)::DOUBLE AS lo, max(length)::DOUBLE AS hi FROM lengths WHERE part = 'documents'),
             (SELECT unnest(range(0, 20)) AS bin)""",
    "head_mean_length": "SELECT ave_len FROM head",
    "generation_requests": " UNION ALL ".join(_requests(name, stem) for name, stem in REQUESTS),
    "run_generation": f"SELECT query_id, {_SAMPLES} AS output, error FROM results",
    "assemble_generations": f"SELECT query_id, corpus_id, query, gt, {_SAMPLES} AS output FROM assembled",
    "explode_samples": "SELECT query_id, unnest(range(0, len(output))) AS sample, unnest(output) AS text FROM assembled",
    "build_prefix_index": f"SELECT {_EDGE_COLUMNS} FROM edges",
    "next_tokens": "SELECT probe_id, token FROM allowed",
    "next_tokens_policy": """
        SELECT 'pass' AS policy, probe_id, CASE WHEN n = 1 AND stop THEN NULL ELSE token END AS token
        FROM allowed JOIN (SELECT probe_id, count(token) AS n, coalesce(bool_or(token = -1), false) AS stop FROM allowed GROUP BY ALL) USING (probe_id)
        UNION ALL
        SELECT DISTINCT 'stop', probe_id, CASE WHEN stop THEN 0 ELSE token END
        FROM allowed JOIN (SELECT probe_id, coalesce(bool_or(token = -1), false) AS stop FROM allowed GROUP BY ALL) USING (probe_id)""",
    "sequence_documents": """
        SELECT 'all' AS which, sequence_id, corpus_id
        FROM (SELECT min(corpus_id[2:]::BIGINT) OVER (PARTITION BY tokens) AS sequence_id, corpus_id FROM seqs)
        UNION ALL SELECT 'first', min(corpus_id[2:]::BIGINT), 'd' || min(corpus_id[2:]::BIGINT) FROM seqs GROUP BY tokens""",
    "add_sequences": f"SELECT {_EDGE_COLUMNS} FROM both_edges",
    "enumerate_sequences": f"SELECT DISTINCT corpus_id, {_ids('tokens')} AS tokens FROM seqs",
    "index_length": "SELECT count(*) AS n_inserts, count(DISTINCT (tokens, corpus_id)) AS n_paths FROM seqs",
    "append_index": _APPENDED,
    "count_appended": f"""SELECT probe_id, count(token) AS n_tokens,
            probe_id IN (SELECT probe_id FROM every_probe JOIN edges USING (p) WHERE token = 1) AS begins
        FROM ({_APPENDED.replace('all_probes', 'every_probe')}) GROUP BY probe_id""",
    "unmatched_beams": f"""SELECT query_id, rank, {_ids('tokens')} AS tokens, round(score, 6) AS score
        FROM ending_beams WHERE tokens NOT IN (SELECT tokens FROM plain_seqs)""",
    "shared_sequences": """SELECT min(corpus_id) AS first_corpus_id, count(*) AS n_docs FROM seqs GROUP BY tokens HAVING count(*) > 1""",
    "shadowed_documents": """SELECT corpus_id FROM plain_seqs a WHERE EXISTS (SELECT 1 FROM plain_seqs b
        WHERE len(b.tokens) < len(a.tokens) AND a.tokens[1:len(b.tokens)] = b.tokens)""",
    "prefix_fanout": """SELECT depth, count(*) AS n_prefixes, sum(f)::BIGINT AS n_edges, max(f) AS max_fanout
        FROM (SELECT depth, p, count(*) AS f FROM edges GROUP BY ALL) GROUP BY depth""",
    "zero_fill": """SELECT query_id, corpus_id, score, rank FROM (
            SELECT q.query_id, d.corpus_id, coalesce(t.score, 0) AS score,
                   row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(t.score, 0) DESC, d.corpus_id DESC) AS rank
            FROM asked q CROSS JOIN docs d LEFT JOIN top t ON t.query_id = q.query_id AND t.corpus_id = d.corpus_id)
        WHERE score > 0 OR (query_id, corpus_id) IN (SELECT (query_id, corpus_id) FROM qrels)""",
    "bm25_index": "SELECT corpus_id, field, term, dl, tf FROM postings",
    "bm25_search": f"SELECT {_RUN_COLUMNS} FROM run WHERE rank <= {DEPTH}",
    "bm25_block_search": f"SELECT {_RUN_COLUMNS} FROM run WHERE rank <= {DEPTH}",
    "bm25_block_top": f"SELECT {_RUN_COLUMNS} FROM run WHERE rank <= {TOP}",
    "dense_search_dot": f"SELECT {_RUN_COLUMNS} FROM near WHERE rank <= {DEPTH}",
    "dense_search_cosine": f"SELECT {_RUN_COLUMNS} FROM cosine WHERE rank <= {DEPTH}",
    "dense_search_blocked": f"SELECT {_RUN_COLUMNS} FROM near WHERE rank <= {DEPTH}",
    "encode_vectors": "SELECT id, i, round(value, 6) AS value FROM doc_vectors",
    "constrained_beam_search": f"SELECT query_id, rank, {_ids('tokens')} AS tokens, round(score, 6) AS score FROM beams",
    "pass_beam_search": f"SELECT query_id, rank, {_ids('tokens')} AS tokens, round(score, 6) AS score FROM plain_beams",
    "prefix_scored_search": f"SELECT query_id, rank, {_ids('tokens')} AS tokens, round(score, 6) AS score FROM prefix_beams",
    "beams_to_run": "SELECT query_id, corpus_id, round(score, 6) AS score FROM beam_run",
    "unmatched_sequences": """SELECT corpus_id, len(tokens) AS n_tokens
        FROM (SELECT corpus_id, tokens FROM seqs UNION ALL SELECT query_id, tokens FROM asked_seqs)
        WHERE tokens NOT IN (SELECT tokens FROM seqs)""",
    "drop_self_matches": f"SELECT query_id, corpus_id, score FROM near WHERE rank <= {TOP}",
    "rank_run": """SELECT query_id, corpus_id, floor(score * 2) / 2 AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 2) DESC, corpus_id DESC) AS rank FROM run""",
    "ndcg_at_k": _one_metric("ndcg"),
    "map_at_k": _one_metric("ap"),
    "recall_at_k": _one_metric("recall"),
    "precision_at_k": _one_metric("prec"),
    "metric_report": _report("metrics"),
    "list_ndcg": """
        SELECT 'nDCG' || suffix AS metric, round(avg(dcg / ideal), 6) AS value
        FROM (SELECT suffix, query_id, sum(p / log2(i + 1)) AS dcg, sum(CASE WHEN i <= n_judged THEN 1 / log2(i + 1) ELSE 0 END) AS ideal
              FROM places JOIN cuts ON i <= k GROUP BY ALL) GROUP BY suffix""",
    "query_ndcg": """
        SELECT query_id, round(sum(CASE WHEN i <= 5 THEN p / log2(i + 1) ELSE 0 END)
               / sum(CASE WHEN i <= least(n_judged, 5) THEN 1 / log2(i + 1) ELSE 0 END), 6) AS value FROM places GROUP BY query_id""",
    "list_recall": """
        SELECT 'recall' || suffix AS metric, round(avg(tp / n), 6) AS value
        FROM (SELECT suffix, query_id, count(*) FILTER (i <= n_judged AND p = 1) AS tp, count(*) FILTER (i <= n_judged) AS n
              FROM places JOIN cuts ON i <= k GROUP BY ALL) GROUP BY suffix""",
    "list_recall_weighted": f"""
        SELECT 'recall@{TOP}' AS metric, round(avg(tp / n), 6) AS value
        FROM (SELECT query_id, sum(CASE WHEN i <= n_judged AND p = 1 THEN 1.0::DOUBLE / i ELSE 0 END) AS tp,
                     sum(CASE WHEN i <= n_judged THEN 1.0::DOUBLE / i ELSE 0 END) AS n FROM places GROUP BY query_id)""",
    "list_recall_multiclass": f"""
        SELECT 'micro' AS average, 'recall@{TOP}' AS metric, round(avg(v), 6) AS value
        FROM (SELECT query_id, sum(tp) / sum(support) AS v FROM classes GROUP BY query_id)
        UNION ALL SELECT 'weighted', 'recall@{TOP}', round(avg(v), 6)
        FROM (SELECT query_id, sum(CASE WHEN support > 0 THEN support * (tp / support) ELSE 0 END) / sum(support) AS v FROM classes GROUP BY query_id)
        UNION ALL SELECT 'macro', 'recall@{TOP}', round(avg(v), 6)
        FROM (SELECT query_id, avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS v FROM classes GROUP BY query_id)
        UNION ALL SELECT 'none', 'recall@{TOP}[' || l || ']', round(coalesce(sum(tp / support), 0) / (SELECT count(*) FROM vectors), 6)
        FROM (SELECT unnest(range(0, 10)) AS l) LEFT JOIN (SELECT * FROM classes WHERE support > 0) ON label = l GROUP BY l""",
    "list_recall_multiclass_weighted": f"""
        SELECT 'micro' AS average, 'recall@{TOP}' AS metric, round(avg(v), 6) AS value
        FROM (SELECT query_id, sum(tp) / sum(support) AS v FROM weighted_classes GROUP BY query_id)
        UNION ALL SELECT 'weighted', 'recall@{TOP}', round(avg(v), 6)
        FROM (SELECT query_id, sum(CASE WHEN support > 0 THEN support * (tp / support) ELSE 0 END) / sum(support) AS v FROM weighted_classes GROUP BY query_id)
        UNION ALL SELECT 'macro', 'recall@{TOP}', round(avg(v), 6)
        FROM (SELECT query_id, avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS v FROM weighted_classes GROUP BY query_id)""",
    "list_recall_samples": f"""
        SELECT 'none' AS weights, 'recall@{TOP}' AS metric, round(avg(m), 6) AS value FROM (SELECT query_id, avg(v) AS m FROM instances GROUP BY query_id)
        UNION ALL SELECT 'position', 'recall@{TOP}', round(avg(m), 6)
        FROM (SELECT query_id, sum(v / i) / sum(1.0::DOUBLE / i) AS m FROM instances GROUP BY query_id)""",
    "lexical_experiment": _report("reply_metrics"),
    "dense_experiment": _report("dense_metrics"),
    "constrained_experiment": _report("beam_metrics"),
    "chunked_experiment": _report("chunk_metrics"),
    "first_document_experiment": """
        SELECT 'nDCG@' || k AS metric, round(avg(coalesce((SELECT sum(1 / log2(w.place + 1)) FROM whole_docs w
                   WHERE w.query_id = q.query_id AND w.corpus_id = q.corpus_id AND w.place <= k), 0)), 6) AS value
        FROM (SELECT query_id, corpus_id FROM qrels WHERE ord = 1) q CROSS JOIN (VALUES (1), (5), (10)) ks(k) GROUP BY k
        UNION ALL SELECT 'errors', count(*)::DOUBLE FROM whole_beams WHERE tokens NOT IN (SELECT tokens FROM seqs)""",
    "generation_experiment": """
        SELECT query_id, corpus_id, len(output) AS n_texts, NULL::VARCHAR AS error FROM assembled
        UNION ALL SELECT query_id, NULL, 0, error FROM results
        WHERE error IS NOT NULL AND query_id IN (SELECT query_id FROM qrels)""",
}

ORACLE_SQL: dict[str, str] = {name: _sql(select) for name, select in _SELECTS.items()}
