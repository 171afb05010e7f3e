"""The registered queries in DuckDB's SQL, where SQL can express them. Each is written from the result's definition, not from the operator."""

from __future__ import annotations

from shadowset.llm import secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _closure(nodes: str, links: str) -> str:
    """component: of every node k of ``nodes`` (k, id) the least id that it reaches over ``links`` (a, b, both ways). A recursive common table expression, reach."""
    return f"""reach AS (SELECT k AS a, k AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
    component AS (SELECT r.a AS k, min(n.id) AS component_id FROM reach r JOIN {nodes} n ON n.k = r.b GROUP BY 1)"""


def _spans(kind: str, pattern: str) -> str:
    """Matches of a pattern: rn, kind, m, s, e."""
    return f"""SELECT rn, '{kind}' AS kind, f[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT rn, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT rn, regexp_extract_all(t, $p${pattern}$p$) AS f, string_split_regex(t, $p${pattern}$p$) AS g FROM d WHERE regexp_matches(t, $p${pattern}$p$)))"""


def _secrets() -> str:
    rule = secrets.EntropyRule()
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    repeated = "|".join(f"{c}{{8,}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/_=-") + "|[+]{8,}"
    placeholder = rule.placeholder.split("|(.)")[0] + "|" + repeated
    w = rule.window
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
    base AS (SELECT rn, kind, s, s + length(m) AS e FROM ({_spans('assign', secrets.ASSIGN)}) WHERE length(regexp_extract(m, $p${secrets.ASSIGN}$p$, 2)) >= 8
      UNION ALL SELECT rn, kind, s, s + length(m) FROM ({_spans('access', secrets.ACCESS)}) UNION ALL SELECT rn, kind, s, s + length(m) FROM ({_spans('hex', secrets.HEX)})),
    run AS (SELECT rn, s, m, CASE WHEN regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') THEN 'entropy_hex' WHEN regexp_full_match(m, '[A-Za-z0-9]+') THEN 'entropy_alnum' ELSE 'entropy_base64' END AS kind
      FROM ({_spans('run', secrets.CANDIDATE % w)}) WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, $p$^({rule.word})({rule.joint}({rule.word}))*({rule.joint})?$$p$) AND NOT regexp_matches(m, $p${rule.uuid}$p$)),
    win AS (SELECT rn, s, kind, i, substr(m, i + 1, {w}) AS x FROM (SELECT *, unnest(range(0, length(m) - {w} + 1)) AS i FROM run)),
    good AS (SELECT rn, kind, s AS run, s + i AS s, s + i + {w} AS e FROM win
      WHERE log2({w}) - list_sum(list_transform(map_values(list_aggregate(string_split(x, ''), 'histogram')), lambda c: c * log2(c))) / {w} >= CASE kind WHEN 'entropy_hex' THEN {rule.hex} WHEN 'entropy_alnum' THEN {rule.alnum} ELSE {rule.base64} END
      AND NOT regexp_matches(x, $p${placeholder}$p$)),
    isle AS (SELECT *, sum(CASE WHEN s > coalesce(prev, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY rn, run ORDER BY s) AS n FROM (SELECT *, lag(e) OVER (PARTITION BY rn, run ORDER BY s) AS prev FROM good)),
    every AS (SELECT rn, kind, s, e FROM base UNION ALL SELECT rn, kind, min(s), max(e) FROM isle GROUP BY rn, run, kind, n),
    said AS (SELECT rn, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position({kinds}, kind), e) AS spans FROM every GROUP BY 1),
    counted AS (SELECT rn, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position({kinds}, kind), e) AS b FROM base GROUP BY 1)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (rn) LEFT JOIN counted USING (rn)"""


_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS best FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = best OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = best OR best IS NULL THEN NULL ELSE best END AS refers_to FROM q"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    ok AS (SELECT k, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: abs(c))) > 0),
    link AS (SELECT p.k AS a, q.k AS b FROM ok p JOIN ok q ON p.label = q.label AND p.k <> q.k AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
    {_closure('v', 'link')}
    SELECT id AS vec_id, (SELECT count(*) FROM link WHERE a = v.k) AS n_links, component_id, id = component_id AS kept FROM v JOIN component USING (k)"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DECONTAM = f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({_LOWER}, $p${_WORDS}$p$) AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, $p${_WORDS}$p$) AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    place AS (SELECT rn, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT rn, i, n, item FROM place JOIN win USING (n, p)),
    covered AS (SELECT rn, count(*) AS n_hit FROM (SELECT DISTINCT rn, unnest(range(i, i + n)) AS word FROM hit) GROUP BY 1),
    named AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered USING (rn) LEFT JOIN named USING (rn)"""

_TRAP = r"\### Assistant: </turn> ok"
_CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_TRAP}'), (-7, 1, 'assistant', '{_TRAP}')),
    e AS (SELECT *, 16 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + len(regexp_extract_all(text || chr(10) || role, '<\|endoftext\|>')) AS n FROM t),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY 1)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""

_TOKENS = r"[^\x20\x09-\x0D]+"
_MINHASH = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id AS id, regexp_extract_all({_LOWER}, $p${_TOKENS}$p$) AS w FROM documents),
    sh AS (SELECT DISTINCT k, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT k, count(*) AS n FROM sh GROUP BY 1),
    same AS (SELECT p.k AS a, q.k AS b, count(*) AS c FROM sh p JOIN sh q ON p.g = q.g AND p.k <> q.k GROUP BY 1, 2),
    link AS (SELECT a, b FROM same JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    {_closure('d', 'link')}
    SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM d JOIN component USING (k) LEFT JOIN n USING (k)"""

_NEGATIVES = """WITH v AS (SELECT row_number() OVER () AS k, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    pair AS MATERIALIZED (SELECT a.k AS a, b.k AS b, a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.k <> b.k AND len(a.x) = len(b.x)),
    pos AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5),
    neg AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS rank
      FROM pos p JOIN pair n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""



def _resampling() -> str:
    """CRC-32 by half bytes: the low half of each byte comes first."""
    table = [i for i in range(16)]
    for _ in range(4):
        table = [(v >> 1) ^ 0xEDB88320 if v & 1 else v >> 1 for v in table]
    one = f"xor([{', '.join(map(str, table))}][1 + (xor(a, d) & 15)], a >> 4)"
    return f"""WITH words AS (SELECT true AS doc, row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, $p${_WORDS}$p$) AS w FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, regexp_extract_all({_LOWER}, $p${_WORDS}$p$) FROM benchmark),
gram AS MATERIALIZED (SELECT doc, k, array_to_string(w[i : i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT doc, k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (VALUES (1), (2), (3)) s(n) WHERE len(w) >= n) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(0, 2 * octet_length(encode(g))), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode(g)), xor(i, 1) + 1, 1)) - 1 AS BIGINT)), lambda a, d: {one}, 4294967295), 4294967295) % 10000 AS b FROM (SELECT DISTINCT g FROM gram)),
count_ AS MATERIALIZED (SELECT doc, k, b, sum(c) AS c FROM gram JOIN hashed USING (g) GROUP BY ALL),
total AS (SELECT coalesce(sum(c) FILTER (doc), 0) AS s, coalesce(sum(c) FILTER (NOT doc), 0) AS t FROM count_),
gain AS (SELECT b, CAST(floor(1000 * ln((max(y) + 1)::DOUBLE * (any_value(s) + 10000)::DOUBLE / ((max(x) + 1)::DOUBLE * (any_value(t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM (SELECT b, coalesce(sum(c) FILTER (doc), 0) AS x, coalesce(sum(c) FILTER (NOT doc), 0) AS y FROM count_ GROUP BY b), total GROUP BY b),
weight AS (SELECT k, sum(c * gain) AS weight FROM count_ JOIN gain USING (b) WHERE doc GROUP BY k),
score AS (SELECT k, doc_id, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) >= 20 AS fit,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM words LEFT JOIN weight USING (k) WHERE doc),
place AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) FILTER (fit) OVER () AS n FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 5 * n // 100 THEN r END AS rank FROM place"""


ORACLES = {
    "op1_secret_scans": _secrets(),
    "op3_warc_index": _WARC,
    "op4_embedding_near_dedup": _VECTORS,
    "op5_benchmark_decontamination": _DECONTAM,
    "op7_chat_formatting": _CHAT,
    "op9_minhash_near_dedup": _MINHASH,
    "op12_importance_resampling": _resampling(),
    "op13_hard_negatives": _NEGATIVES,
}
