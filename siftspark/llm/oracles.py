"""DuckDB SQL for those pN_ queries that plain SQL can answer on whole tables."""

from siftspark.llm.leaks import NUMBERS, UNITS

_TRIM = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')".format


def _name(column: str, lead: str) -> str:
    return _TRIM(f"regexp_replace(lower({_TRIM(column)}), '{lead}', '')")


_NOW = "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY {at} DESC) AS rn FROM {table} WHERE id IS NOT NULL)"
_SCORED = f"""
f AS (SELECT id, {_name('subreddit', '^/?r/')} AS subreddit, pain_score FROM {_NOW.format(at='filtered_at', table='filtered_posts')} WHERE rn = 1),
p AS (SELECT id, lower({_TRIM('source')}) AS source FROM {_NOW.format(at='collected_at', table='posts')} WHERE rn = 1),
scored AS (SELECT f.id, p.source, f.subreddit, f.pain_score, k.keep_permille FROM f JOIN p USING (id) JOIN keep_targets k ON k.source = p.source
  WHERE f.subreddit <> '' AND f.pain_score BETWEEN 0 AND 1),
n AS (SELECT source, subreddit, count(*) AS n, (count(*) * max(keep_permille) + 999) // 1000 AS target FROM scored GROUP BY 1, 2),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY source, subreddit ORDER BY pain_score DESC, id) AS r FROM scored s),
cutoff AS (SELECT source, subreddit, n.n, n.target, min(pain_score) AS cutoff FROM ranked JOIN n USING (source, subreddit) WHERE r <= target GROUP BY 1, 2, 3, 4)"""
_AUTHORS = f"""
a AS (SELECT id, {_name('author', '^u/')} AS author, pain_score FROM {_NOW.format(at='filtered_at', table='filtered_posts')} WHERE rn = 1),
placed AS (SELECT id AS post_id, author, row_number() OVER (PARTITION BY author ORDER BY pain_score DESC, id) AS position
  FROM a WHERE author NOT IN ('', '[deleted]') AND pain_score BETWEEN 0 AND 1)"""

_VECTORS = """v AS (SELECT pain_event_id AS id, CAST(embedding_vector AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY pain_event_id ORDER BY created_at DESC) AS rn FROM pain_embeddings)
  WHERE rn = 1 AND pain_event_id IS NOT NULL AND embedding_vector IS NOT NULL AND len(embedding_vector) = 64
  AND len(list_filter(embedding_vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding_vector, lambda x: x <> 0)) > 0)"""
_EDGES = "e AS MATERIALIZED (SELECT * FROM (SELECT p.id AS a, q.id AS b, round(list_cosine_similarity(p.v, q.v), 12) AS c FROM v p JOIN v q ON p.id <> q.id) WHERE c >= 0.85)"
_RUNS = "SELECT id, array_to_string(list_slice(w, k, k + 12), ' ') AS w FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS k FROM (SELECT {key} AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table}) WHERE len(w) >= 13)"
_WINDOWS = f"dw AS ({_RUNS.format(key='doc_id', text='text', table='documents')}), iw AS ({_RUNS.format(key='item_id', text='passage', table='eval_items')})"

_LISTED = lambda values: "['" + "', '".join(sorted(values)) + "']"
_TEMPLATE = f"CASE WHEN regexp_matches(x, '^[0-9]') OR list_contains({_LISTED(NUMBERS)}, x) THEN '<number>' WHEN list_contains({_LISTED(UNITS)}, x) THEN '<unit>' WHEN list_contains(ns, x) THEN '<name>' ELSE x END"
_TEXTS = "SELECT id, w, [{t} for x in w] AS t FROM (SELECT DISTINCT {key} AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table} WHERE {key} IS NOT NULL), (SELECT coalesce(list(n), []) AS ns FROM names) WHERE len(w) >= 13"
_CUT = "SELECT id, k, list_slice(w, k, k + 12) AS w, list_slice(t, k, k + 12) AS t, array_to_string(list_slice(t, k, k + 12), ' ') AS h FROM (SELECT id, w, t, unnest(range(1, len(w) - 11)) AS k FROM ({}))"
_LEAKS = f"""tok AS (SELECT list_filter(regexp_split_to_array(passage, '\s+'), lambda v: v <> '') AS t, passage FROM eval_items WHERE passage IS NOT NULL),
pre AS (SELECT t[k] AS before, t[k + 1] AS word FROM (SELECT t, unnest(range(1, len(t))) AS k FROM tok)),
names AS (SELECT DISTINCT lower(regexp_extract(word, '^[^A-Za-z0-9]*([A-Z][A-Za-z]*)', 1)) AS n FROM pre WHERE regexp_matches(word, '^[^A-Za-z0-9]*[A-Z]') AND NOT regexp_matches(before, '[.!?:"'']$')
  AND lower(regexp_extract(word, '^[^A-Za-z0-9]*([A-Z][A-Za-z]*)', 1)) NOT IN (SELECT unnest(regexp_extract_all(passage, '[A-Za-z]+')) FROM tok)),
dw AS ({_CUT.format(_TEXTS.format(t=_TEMPLATE, key='doc_id', text='text', table='documents'))}), iw AS ({_CUT.format(_TEXTS.format(t=_TEMPLATE, key='item_id', text='passage', table='eval_items'))}),
met AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.k - i.k AS shift, i.k, d.w AS d, i.w AS i, i.t AS t FROM dw d JOIN iw i ON i.h = d.h),
run AS (SELECT doc_id, item_id, shift, count(*) AS n, count(*) FILTER (WHERE d = i) AS same FROM met GROUP BY ALL),
val AS (SELECT DISTINCT doc_id, item_id, shift, i[j] AS own, d[j] AS other FROM (SELECT *, unnest(range(1, 14)) AS j FROM met) WHERE t[j] IN ('<number>', '<unit>', '<name>')),
fit AS (SELECT doc_id, item_id, shift, count(*) = count(DISTINCT own) AND count(*) = count(DISTINCT other) AS fits, count(*) FILTER (WHERE own <> other) AS changed FROM val GROUP BY ALL)
SELECT doc_id, item_id, CAST(sum(same) AS BIGINT) AS exact, CAST(sum(CASE WHEN coalesce(fits, true) THEN n - same ELSE 0 END) AS BIGINT) AS altered, max(CASE WHEN fits THEN changed ELSE 0 END) AS changed
FROM run LEFT JOIN fit USING (doc_id, item_id, shift) GROUP BY ALL HAVING sum(same) > 0 OR sum(CASE WHEN coalesce(fits, true) THEN n - same ELSE 0 END) > 0"""

SQL: dict[str, str] = {
    "p9_leaks": f"WITH {_LEAKS}",
    "p5_cutoffs": f"WITH {_SCORED} SELECT c.source, c.subreddit, c.n, c.target, c.cutoff, count(*) AS kept FROM cutoff c JOIN scored s ON s.source = c.source AND s.subreddit = c.subreddit AND s.pain_score >= c.cutoff GROUP BY ALL",
    "p5_found": f"WITH {_SCORED} SELECT id AS post_id FROM scored JOIN cutoff USING (source, subreddit) WHERE pain_score >= cutoff",
    "p6_found": f"WITH {_AUTHORS} SELECT post_id FROM placed WHERE position > 5",
    "p6_kept": f"WITH {_AUTHORS} SELECT post_id, author, position FROM placed WHERE position <= 5",
    "p1_found": f"WITH RECURSIVE {_VECTORS}, {_EDGES}, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS event_a, b AS event_b FROM reach WHERE a < b",
    "p4_found": f"WITH {_VECTORS}, {_EDGES}, top AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM e) WHERE r <= 5) SELECT DISTINCT least(a, b) AS event_a, greatest(a, b) AS event_b FROM top",
    "p4_neighbours": f"WITH {_VECTORS}, {_EDGES} SELECT * FROM (SELECT a AS event_id, b AS neighbour, round(c, 6) AS cosine, CAST(row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS INT) AS place FROM e) WHERE place <= 5",
    "p9_found": f"WITH {_WINDOWS} SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM dw d JOIN iw i ON i.w = d.w",
    "v07_dbscan": f"WITH RECURSIVE {_VECTORS}, {_EDGES}, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS event_id, least(a, min(b)) AS label FROM reach GROUP BY a",
    "v08_vector_clusters": f"WITH RECURSIVE {_VECTORS}, {_EDGES}, reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT label, count(*) AS size FROM (SELECT a, least(a, min(b)) AS label FROM reach GROUP BY a) GROUP BY 1",
}
