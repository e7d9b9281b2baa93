"""DuckDB SQL for the registered queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def near_dedup_sql(source: str, width: int, percent: int, where: str = "") -> str:
    """CTEs up to ``classes(doc_id, n_shingles, component_id)`` over ``source(doc_id, text)``."""
    return f"""
worded AS (SELECT doc_id, {_WORDS} AS ws FROM {source}),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) END) AS s
  FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingled a JOIN shingled b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS v, doc_id AS r FROM worded UNION SELECT v, b FROM reached JOIN both_ways ON r = a),
classes AS (SELECT v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reached LEFT JOIN sizes ON v = doc_id GROUP BY v)"""


# The expressions of the secret rules, and how long a whole match or its second group is at least.
_NAMES = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_LEAD = f"""{_NAMES}["'']?\\x20*[:=]\\x20*["'']?"""
SECRET_SQL = [
    ("assign", f"{_LEAD}[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_LEAD}', '')) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("signed", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "length(regexp_extract(m, '[^.]*$')) >= 16"),
]


def _secret_spans(place: int, kind: str, pattern: str, holds: str) -> str:
    """Spans of one rule: the texts between its matches and the matches themselves, added up."""
    return f"""SELECT r, '{kind}' AS kind, {place} AS place, s, s + length(m) AS e FROM (
  SELECT r, m, sum(length(gap)) OVER (PARTITION BY r ORDER BY i) + sum(length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s FROM (
    SELECT r, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, unnest(gaps[1:len(ms)]) AS gap FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM numbered)))
  WHERE {holds}"""


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TURN_HEAD = "CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 10 + length(role) + 7 END"

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": f"""WITH RECURSIVE {near_dedup_sql('documents', 4, 80)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM classes""",
    "op2_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '(### (?:System|User|Assistant|Role):|</turn>)', '\\1_', 'g') AS marked,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum({_TURN_HEAD} + length(marked) + 8) AS BIGINT) AS formatted_chars,
  bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AND (NOT last OR role = 'assistant')) AS accepted
FROM escaped GROUP BY conv_id""",
    "op5_threshold_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_secret_scan": f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_secret_spans(k, *rule) for k, rule in enumerate(SECRET_SQL))})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place), '') AS spans
FROM numbered LEFT JOIN spans USING (r) GROUP BY r, doc_id""",
    "op12_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k))),
counts AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, ws, f, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scored AS (SELECT c.lang, c.k, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ') JOIN totals t ON t.lang = c.lang),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covers AS (SELECT lang, array_to_string(unnest([ws[1:k - 1], ws[2:]]), ' ') AS phrase, f FROM counts WHERE k > 2),
kept AS (SELECT * FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM covers v WHERE v.lang = c.lang AND v.phrase = c.phrase AND v.f >= c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op13_ranked_search": f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
full_docs AS (SELECT r, doc_id, len(ws) AS n FROM numbered WHERE len(ws) > 0),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM full_docs),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM numbered) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tfs, stats GROUP BY t, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark WHERE item_id IS NOT NULL),
scored AS (SELECT item_id, r, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN full_docs d USING (r), stats GROUP BY item_id, r, d.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
