"""DuckDB SQL for the queries of this subpackage that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW same AS (PARTITION BY norm)
"""

OP3 = """
WITH t AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), r AS (
  SELECT page_id, payload, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS kept FROM t
)
SELECT page_id,
       CAST(n AS BIGINT) AS payload_bytes,
       sha1(payload) AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM r
"""

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id
GROUP BY r.doc_id
"""


def quality_sql() -> str:
    """The quality rules with their EM steps unrolled: a row of parameters per
    step, from the vote patterns and the row before."""
    from . import quality as q

    m = len(q.RULES)
    classes = range(m + 1)
    votes = ", ".join(f"CASE WHEN n_words > 0 AND ({r.bad}) THEN -1 WHEN n_words > 0 AND ({r.good}) THEN 1 ELSE 0 END AS v{j}" for j, r in enumerate(q.RULES))
    names = ", ".join(f"v{j}" for j in range(m))
    begin = q.start()
    first = ", ".join([f"CAST({p!r} AS DOUBLE) AS p{k}" for k, p in enumerate(begin.priors)] + [f"CAST({r!r} AS DOUBLE) AS r{k}_{j}" for k in classes for j, r in enumerate(begin.rates[k])])
    weights = ", ".join(f"p{k} * " + " * ".join(f"CASE v{j} WHEN 1 THEN r{k}_{j} WHEN -1 THEN 1 - r{k}_{j} ELSE 1 END" for j in range(m)) + f" AS w{k}" for k in classes)
    total = " + ".join(f"w{k}" for k in classes)
    steps = [f"f0 AS (SELECT {first})"]
    for i in range(q.ITERATIONS):
        mass = ", ".join(f"n * w{k} / ({total}) AS m{k}" for k in classes)
        prior = [f"(sum(m{k}) + 1) / ({' + '.join(f'sum(m{c})' for c in classes)} + {m + 1}) AS p{k}" for k in classes]
        rate = []
        for k in classes:
            for j in range(m):
                plus, minus = (f"sum(CASE WHEN v{j} = {v} THEN m{k} ELSE 0 END)" for v in (1, -1))
                r = f"({plus} + 1) / ({plus} + {minus} + 2)"
                rate.append((f"greatest({r}, {1 - q.MAX_FALSE!r})" if k == 0 else r) + f" AS r{k}_{j}")
        steps.append(f"f{i + 1} AS MATERIALIZED (SELECT {', '.join(prior + rate)} FROM (SELECT *, {mass} FROM (SELECT *, {weights} FROM patterns, f{i}) a) b)")
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({q.WINDOW}) AS o(k) GROUP BY doc_id
), features AS (
  SELECT w.doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '{q.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         len(list_distinct(ws)) AS n_distinct,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), voted AS MATERIALIZED (
  SELECT *, {votes} FROM features
), patterns AS MATERIALIZED (
  SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL
), {", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(w0 / ({total}), 6) AS p_good, NOT base_failed AND w0 / ({total}) >= {q.THRESHOLD} AS kept
FROM (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words AS base_failed, {weights}
  FROM voted, f{q.ITERATIONS}
) x
"""
