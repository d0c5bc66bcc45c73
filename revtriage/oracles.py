"""DuckDB SQL oracles for the registered queries.

Each string re-states a query's semantics in plain SQL over the driver's
views (``documents``, ``labels``, ...), built from the same parameters
(vocabularies, label maps, seeds) the Spark side uses, so a change of
parameter changes both sides.  Written independently of the Spark plans:
CASE chains instead of sorted struct arrays, window row numbers instead of
bucketed ranks, plain joins instead of partial aggregates.
"""

from __future__ import annotations

from . import config
from .plans import catalog as C
from .sources import tables as S

WS = r"[\t\n\x{0B}\f\r\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_u(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rtrim_u(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '', 'g')"


def trim_cut(x: str, n: int = config.MAX_TEXT_LENGTH) -> str:
    return f"substring({trim_u(x)}, 1, {n})"


def model_clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[[:punct:]]', '', 'g'), "
        r"'[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def rule_clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, 'nan')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def case_map(x: str, mapping: dict) -> str:
    if not mapping:
        return "CAST(NULL AS VARCHAR)"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} END)"


def normalize_label(x: str, synonyms: dict) -> str:
    return case_map(f"lower({trim_u(f'CAST({x} AS VARCHAR)')})", synonyms)


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def display_name(x: str, display: dict) -> str:
    return f"coalesce({case_map(x, display)}, {initcap(f'replace({x}, {q(chr(95))}, {q(chr(32))})')})"


def any_contains(norm: str, phrases) -> str:
    if not phrases:
        return "FALSE"
    return "(" + " OR ".join(f"contains({norm}, {q(p)})" for p in phrases) + ")"


def score_sql(norm: str, words: str, phrases, tokens, pw=2, tw=1) -> str:
    ph = " + ".join(f"CAST(contains({norm}, {q(p)}) AS INTEGER)" for p in phrases) or "0"
    tk = " + ".join(f"CAST(list_contains({words}, {q(t)}) AS INTEGER)" for t in tokens) or "0"
    return f"({pw} * ({ph}) + {tw} * ({tk}))"


def relabel_sql(source: str, cols: str, ruleset=S.TEST_RULES, text_col: str = "text") -> str:
    """SELECT {cols}, suggested_label, rule_score, review_status FROM source."""
    labels = ruleset.labels
    scores = ",\n".join(
        f"{score_sql('norm', 'words', r.phrases, r.tokens, ruleset.phrase_weight, ruleset.token_weight)} AS s{i}"
        for i, r in enumerate(ruleset.rules)
    )
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(labels))) + ")"
    top_label = "CASE " + " ".join(f"WHEN s{i} = top THEN {q(l)}" for i, l in enumerate(labels)) + " END"
    second = "greatest(" + ", ".join(f"CASE WHEN top_label <> {q(l)} THEN s{i} ELSE -1 END" for i, l in enumerate(labels)) + ")"
    praise = any_contains("norm", ruleset.positive_phrases)
    if ruleset.praise_exempt_label is not None:
        praise = f"({praise} AND top_label <> {q(ruleset.praise_exempt_label)})"
    own = "CASE " + " ".join(f"WHEN top_label = {q(r.label)} THEN {any_contains('norm', r.exclude_phrases)}" for r in ruleset.rules) + " ELSE FALSE END"
    status = (
        f"CASE WHEN top < {ruleset.min_score} THEN 'too_weak' "
        f"WHEN top < second + {ruleset.min_margin} THEN 'ambiguous_overlap' "
        f"WHEN ({praise} OR ({own})) THEN 'positive_or_resolved' "
        "ELSE 'high_confidence_rule_match' END"
    )
    return f"""
SELECT {cols}, CASE WHEN status = 'high_confidence_rule_match' THEN top_label END AS suggested_label,
       CAST(top AS INTEGER) AS rule_score, status AS review_status
FROM (
  SELECT *, {status} AS status FROM (
    SELECT *, {second} AS second FROM (
      SELECT *, {top_label} AS top_label FROM (
        SELECT *, {top} AS top FROM (
          SELECT *, {scores} FROM (
            SELECT *, list_distinct(string_split(norm, ' ')) AS words FROM (
              SELECT *, {rule_clean(text_col)} AS norm FROM {source}
            ) a0
          ) a1
        ) a2
      ) a3
    ) a4
  ) a5
) a6"""


REVIEWS = "(SELECT doc_id AS review_id, text, source AS app_id, CAST(1 + (doc_id % 5) AS INTEGER) AS rating, lang FROM documents)"
LABELLED_DOCS = (
    "(SELECT d.doc_id, d.text, ' Q' || CAST(l.quality AS VARCHAR) || ' T' || CAST(l.toxic AS VARCHAR) AS category "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def loader_sql(source: str, labels, label_col: str, text_col: str, exclude: str | None = None) -> dict:
    """CTE bodies of the dataset loader over ``source``: staged, cleaned, data."""
    staged = (
        f"SELECT {label_col} AS label_raw, {text_col} AS text_raw, {normalize_label(label_col, labels.synonyms)} AS label, "
        f"{trim_u(text_col)} AS text FROM {source}"
    )
    valid = "SELECT DISTINCT label, text FROM staged WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL AND label IS NOT NULL AND text <> ''"
    cleaned = f"SELECT label, text, {model_clean('text')} AS clean_text FROM valid"
    if exclude:
        marked = f"SELECT c.*, (c.clean_text IN (SELECT clean_text FROM {exclude} WHERE clean_text IS NOT NULL)) AS overlap FROM cleaned c"
    else:
        marked = "SELECT c.*, FALSE AS overlap FROM cleaned c"
    return {"staged": staged, "valid": valid, "cleaned": cleaned, "marked": marked}


def with_prefix(prefix: str, ctes: dict) -> str:
    return ",\n".join(f"{prefix}{k} AS ({v.replace('FROM staged', f'FROM {prefix}staged').replace('FROM valid', f'FROM {prefix}valid').replace('FROM cleaned c', f'FROM {prefix}cleaned c')})" for k, v in ctes.items())


def class_master_sql() -> str:
    return (
        f"(SELECT doc_id AS review_id, {trim_u('text')} AS text, {trim_u('category')} AS label FROM {LABELLED_DOCS} ld "
        f"WHERE category IS NOT NULL AND text IS NOT NULL AND {trim_u('text')} <> '')"
    )


def alloc_sql(counts: str, draws: str, out: str) -> str:
    """Largest remainder allocation over a class table with columns label, n, {draws}."""
    return f"""
SELECT *, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS {out} FROM (
  SELECT *, row_number() OVER (ORDER BY rem DESC, label) AS rk, {draws} - sum(fl) OVER () AS need FROM (
    SELECT *, (n * {draws}) // sum(n) OVER () AS fl, (n * {draws}) % sum(n) OVER () AS rem FROM {counts}
  ) x
) y"""


def split_sql(test_fraction: float = C.SPLIT_TEST_FRACTION, seed: int = config.RANDOM_SEED) -> str:
    """WITH-able CTEs ending in ``split``(review_id, text, label, dataset_role)."""
    return f"""
master AS {class_master_sql()},
cnt AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM master GROUP BY label),
tot AS (SELECT *, CAST(ceil(sum(n) OVER () * {test_fraction}) AS BIGINT) AS n_test_all, sum(n) OVER () AS n_all FROM cnt),
tr AS ({alloc_sql("(SELECT label, n, n_test_all, n_all - n_test_all AS n_train_all FROM tot)", "n_train_all", "n_train")}),
te AS ({alloc_sql("(SELECT label, n - n_train AS n, n_test_all, n_train FROM tr)", "n_test_all", "n_test")}),
quota AS (SELECT label, n_train, n_test FROM te),
ranked AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.label ORDER BY md5('{seed}|' || CAST(m.review_id AS VARCHAR)), m.review_id) AS rk
  FROM master m),
split AS (
  SELECT r.review_id, r.text, r.label,
         CASE WHEN r.rk <= qt.n_train THEN 'training' ELSE 'testing_manual' END AS dataset_role
  FROM ranked r JOIN quota qt ON r.label = qt.label)"""


def training_ctes(seed: int = config.RANDOM_SEED) -> str:
    """CTEs: split, te_* (held-out loader), tr_* (training loader with overlap flag)."""
    te = loader_sql("(SELECT * FROM split WHERE dataset_role = 'testing_manual')", S.CLASS_LABELS, "label", "text")
    te_data = "SELECT label, text, clean_text FROM te_marked WHERE clean_text <> '' AND NOT overlap"
    tr = loader_sql("(SELECT * FROM split WHERE dataset_role = 'training')", S.CLASS_LABELS, "label", "text", exclude="te_data")
    tr_data = "SELECT label, text, clean_text FROM tr_marked WHERE clean_text <> '' AND NOT overlap"
    return (
        "WITH " + split_sql(seed=seed) + ",\n" + with_prefix("te_", te) + f",\nte_data AS ({te_data}),\n"
        + with_prefix("tr_", tr) + f",\ntr_data AS ({tr_data})"
    )


def labelled_loader_ctes() -> str:
    ctes = loader_sql(LABELLED_DOCS, S.CLASS_LABELS, "category", "text")
    return "WITH " + with_prefix("", ctes) + ",\ndata AS (SELECT label, text, clean_text FROM marked WHERE clean_text <> '' AND NOT overlap)"


def balance_sql(source: str, seed: int = config.RANDOM_SEED) -> str:
    return f"""
SELECT label, text, clean_text FROM (
  SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || text), text) AS rk,
         min(cnt) OVER () AS quota
  FROM (SELECT *, count(*) OVER (PARTITION BY label) AS cnt FROM {source}) s
) x WHERE rk <= quota"""


def label_map_text(labels, counts_cte: str, value: str = "n") -> str:
    parts = " || ',' || ".join(
        f"'{l}:' || CAST(coalesce((SELECT {value} FROM {counts_cte} WHERE label = {q(l)}), 0) AS VARCHAR)" for l in labels
    )
    return parts


def landed_sql() -> str:
    """Landed reviews with their dates."""
    return (
        f"(SELECT r.review_id, r.text, r.app_id, r.rating, CAST(e.ts AS TIMESTAMP) AS review_date, "
        f"CAST(r.review_id % 7 AS INTEGER) AS thumbs_up_count, r.lang FROM {REVIEWS} r LEFT JOIN events e ON r.review_id = e.event_id)"
    )


def oracle_sql() -> dict[str, str]:
    L = S.TEST_RULES
    rules_rev = relabel_sql(f"(SELECT review_id, text FROM {REVIEWS})", "review_id")
    out: dict[str, str] = {}
    out["p1_trim_cut"] = f"SELECT doc_id, {trim_cut('text')} AS text FROM documents"
    out["x1_model_clean"] = f"SELECT doc_id, {model_clean('text')} AS clean_text FROM documents"
    norm = rule_clean("text")
    out["x2_rule_clean"] = (
        f"SELECT doc_id, norm_text, CAST(CASE WHEN norm_text = '' THEN 0 ELSE len(list_distinct(string_split(norm_text, ' '))) END AS BIGINT) AS n_tokens "
        f"FROM (SELECT doc_id, {norm} AS norm_text FROM documents) x"
    )
    out["x7_weak_label"] = f"SELECT review_id, suggested_label, rule_score, review_status FROM ({rules_rev}) r"
    out["x7_status_counts"] = f"SELECT review_status, suggested_label, count(*) AS n FROM ({rules_rev}) r GROUP BY ALL"
    default_rev = relabel_sql(f"(SELECT review_id, text FROM {REVIEWS})", "review_id", config.DEFAULT_RULESET)
    out["x7_default_rules"] = f"SELECT review_id, suggested_label, rule_score, review_status FROM ({default_rev}) r"
    routed = f"SELECT CASE WHEN suggested_label IS NOT NULL THEN 'relabelled' ELSE 'manual_review' END AS route, * FROM ({rules_rev}) r"
    out["k8_relabel_report"] = (
        f"WITH r AS ({routed}) SELECT route, CASE WHEN suggested_label IS NOT NULL THEN suggested_label ELSE review_status END AS value, count(*) AS n FROM r GROUP BY ALL "
        "UNION ALL SELECT 'rows', 'read', count(*) FROM r UNION ALL SELECT 'rows', 'kept', count(*) FILTER (WHERE route = 'relabelled') FROM r"
    )
    out["k2_routes"] = (
        "SELECT review_id, route, coalesce(suggested_label, '') AS label, "
        f"CASE WHEN route = 'relabelled' THEN '{config.RULE_LABEL_METHOD}' ELSE '' END AS label_method, review_status FROM ({routed}) x"
    )
    out["p8_display_name"] = (
        f"SELECT review_id, {display_name('suggested_label', S.TEST_RULE_LABELS.display)} AS display_label FROM ({rules_rev}) r"
    )
    out["x3_label_normalise"] = (
        f"SELECT {normalize_label('category', S.CLASS_LABELS.synonyms)} AS label, count(*) AS n FROM {LABELLED_DOCS} ld GROUP BY ALL"
    )
    v = S.TEST_CANDIDATE_VOCAB
    phr = "[" + ", ".join(q(p) for p in v.phrases) + "]"
    tok = "[" + ", ".join(q(t) for t in v.tokens) + "]"
    out["x10_candidates"] = f"""
SELECT review_id, '' AS label, text, rating, security_score, matched_terms, '' AS label_notes,
       '{config.CANDIDATE_LABEL_STATUS}' AS label_status FROM (
  SELECT review_id, text, rating,
         CAST({score_sql('norm', 'words', v.phrases, v.tokens, v.phrase_weight, v.token_weight)} AS INTEGER) AS security_score,
         array_to_string(list_sort(list_distinct(list_concat(
             list_filter({phr}, lambda p: contains(norm, p)),
             list_filter({tok}, lambda t: list_contains(words, t))))), ', ') AS matched_terms
  FROM (SELECT *, list_distinct(string_split(norm, ' ')) AS words FROM (
        SELECT review_id, text, rating, {norm} AS norm FROM {REVIEWS}) a) b
) c
WHERE security_score >= {config.CANDIDATE_MIN_SCORE}
  AND coalesce(TRY_CAST(rating AS DOUBLE), {config.CANDIDATE_MAX_RATING}) <= {config.CANDIDATE_MAX_RATING}"""
    out["i5_top_candidates"] = out["x10_candidates"] + f"""
ORDER BY security_score DESC, TRY_CAST(rating AS DOUBLE) ASC NULLS LAST, review_id
LIMIT {C.CANDIDATE_TOP}"""
    query = r"regexp_extract(url, '\?([^#]*)', 1)"
    val = f"regexp_extract({query}, '(?:^|&)ref=([^&]+)', 1)"
    app = f"CASE WHEN contains({trim_u('url')}, 'example') THEN coalesce({trim_u(f'url_decode(replace({val}, {q(chr(43))}, {q(chr(32))}))')}, '') ELSE {trim_u('url')} END"
    out["x11_app_id"] = (
        f"SELECT page_id, app_id, (app_id <> '' AND NOT contains(app_id, ' ') AND contains(app_id, '.')) AS is_valid "
        f"FROM (SELECT page_id, {app} AS app_id FROM pages) x"
    )
    flat = f"replace({trim_u('text')}, chr(10), ' ')"
    out["p10_row_caption"] = f"""
SELECT doc_id, 'Row ' || CAST(rn AS VARCHAR) || ' | ' || disp || ' | ' ||
       CASE WHEN length(flat) > {config.CAPTION_PREVIEW_CHARS}
            THEN {rtrim_u(f'substring(flat, 1, {config.CAPTION_PREVIEW_CHARS})')} || '...' ELSE flat END AS caption
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, {display_name('lang', S.LANG_LABELS.display)} AS disp,
             {flat} AS flat FROM documents) x"""

    # -- dataset loader
    LD = labelled_loader_ctes()
    out["s4_load_dataset"] = LD + "\nSELECT label, text, clean_text FROM data"
    out["p9_dataset_preview"] = LD + f"\nSELECT {display_name('label', S.CLASS_LABELS.display)} AS label, text FROM data"
    out["m19_mode_figures"] = LD + """,
cnt AS (SELECT label, count(*) AS n FROM data GROUP BY label)
SELECT label, n AS rows_before, (SELECT min(n) FROM cnt) AS rows_after, (SELECT min(n) FROM cnt) AS rows_selected, true AS mode_differs FROM cnt"""
    names = S.CLASS_LABELS.names
    out["a4_funnel"] = LD + f""",
pre AS (SELECT count(*) AS original_rows,
   count(*) FILTER (WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL) AS rows_after_null_drop,
   count(*) FILTER (WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL AND label IS NOT NULL) AS rows_after_label_clean,
   count(*) FILTER (WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL AND label IS NOT NULL AND text <> '') AS rows_after_text_clean
   FROM staged),
post AS (SELECT count(*) AS rows_after_dedup, count(*) FILTER (WHERE clean_text <> '') AS before_overlap,
   count(*) FILTER (WHERE clean_text <> '' AND NOT overlap) AS final_rows FROM marked),
lc AS (SELECT label, count(*) AS n FROM data GROUP BY label),
mm AS (SELECT min(n) AS mn, max(n) AS mx, count(*) AS k FROM lc),
bc AS (SELECT label, (SELECT mn FROM mm) AS n FROM lc)
SELECT CAST(original_rows AS BIGINT) AS original_rows, CAST(rows_after_null_drop AS BIGINT) AS rows_after_null_drop,
  CAST(rows_after_label_clean AS BIGINT) AS rows_after_label_clean, CAST(rows_after_text_clean AS BIGINT) AS rows_after_text_clean,
  CAST(rows_after_dedup AS BIGINT) AS rows_after_dedup, CAST(final_rows AS BIGINT) AS final_rows,
  CAST((SELECT mn * k FROM mm) AS BIGINT) AS balanced_rows,
  CAST(rows_after_text_clean - rows_after_dedup AS BIGINT) AS duplicates_removed,
  CAST(before_overlap - final_rows AS BIGINT) AS overlap_rows_removed,
  CAST((SELECT mn FROM mm) AS BIGINT) AS minority_count, CAST((SELECT mx FROM mm) AS BIGINT) AS majority_count,
  round((SELECT mx FROM mm) / (SELECT mn FROM mm), 2) AS imbalance_ratio, TRUE AS applied_balancing,
  {label_map_text(names, 'lc')} AS label_counts_before_balance,
  {label_map_text(names, 'bc')} AS label_counts
FROM pre, post"""
    dim = "(VALUES " + ", ".join(f"({q(l)}, {i})" for i, l in enumerate(names)) + ") AS dim(label, label_order)"
    out["v_validation"] = LD + f""",
lc AS (SELECT label, count(*) AS n FROM data GROUP BY label),
j AS (SELECT coalesce(lc.label, dim.label) AS label, lc.n, dim.label_order FROM lc FULL JOIN {dim} ON lc.label = dim.label),
a AS (SELECT coalesce(sum(n), 0) AS all_rows,
             coalesce(string_agg(CASE WHEN n IS NULL THEN label END, ', ' ORDER BY label_order), '') AS missing,
             coalesce(min(n), 0) AS min_n FROM j)
SELECT 'min_rows' AS "check", all_rows >= {config.MIN_DATASET_ROWS} AS ok, 'rows=' || CAST(all_rows AS VARCHAR) AS detail FROM a
UNION ALL SELECT 'all_labels_present', missing = '', missing FROM a
UNION ALL SELECT 'min_rows_per_class', min_n >= 2, 'min=' || CAST(min_n AS VARCHAR) FROM a"""
    out["a2_label_counts"] = LD + f""",
lc AS (SELECT label, count(*) AS n FROM data GROUP BY label)
SELECT dim.label, dim.label_order, CAST(coalesce(lc.n, 0) AS BIGINT) AS n FROM {dim} LEFT JOIN lc ON lc.label = dim.label"""
    out["a3_class_balance"] = LD + """,
lc AS (SELECT label, count(*) AS n FROM data GROUP BY label)
SELECT min(n) AS minority_count, max(n) AS majority_count,
       CASE WHEN min(n) > 0 THEN round_even(max(n) / min(n), 2) ELSE 0.0 END AS imbalance_ratio FROM lc"""

    # -- split / ids
    out["i1_review_id"] = (
        f"SELECT '{config.REVIEW_ID_PREFIX}' || printf('%05d', row_number() OVER (ORDER BY review_id)) AS review_id, "
        f"review_id AS doc_id, label FROM {class_master_sql()} m"
    )
    out["i9_quotas"] = "WITH " + split_sql() + "\nSELECT label, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test FROM quota"
    out["i9_stratified_split"] = "WITH " + split_sql() + "\nSELECT review_id, label, dataset_role FROM split"
    out["a7_split_summary"] = "WITH " + split_sql() + "\nSELECT dataset_role, label, count(*) AS n FROM split GROUP BY ROLLUP (dataset_role, label)"
    TR = training_ctes()
    out["j1_decontaminate"] = TR + "\nSELECT label, text, clean_text FROM tr_data"
    out["j1_overlap_summary"] = TR + """
SELECT CAST(count(*) FILTER (WHERE clean_text <> '' AND NOT overlap) AS BIGINT) AS final_rows,
       CAST(count(*) FILTER (WHERE clean_text <> '' AND overlap) AS BIGINT) AS overlap_rows_removed,
       CAST(count(*) AS BIGINT) AS rows_after_dedup FROM tr_marked"""
    out["i8_balance"] = TR + "\n" + balance_sql("tr_data")
    out["i10_folds"] = TR + f"""
SELECT label, text, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{config.RANDOM_SEED}|' || text), text) - 1) % {C.FOLDS} AS INTEGER) AS fold
FROM tr_data"""
    out["d2_keep_first"] = (
        f"SELECT review_id, app_id FROM (SELECT review_id, app_id, row_number() OVER (PARTITION BY app_id, text ORDER BY review_id) AS rk "
        f"FROM {REVIEWS} r) x WHERE rk = 1"
    )
    out["a1_count_by_app"] = f"SELECT app_id, count(*) AS n FROM {REVIEWS} r GROUP BY app_id"

    # -- merge
    labels_in = ", ".join(q(l) for l in L.labels)
    cand = f"""
cand_src AS ({relabel_sql(f"(SELECT review_id, text FROM {REVIEWS})", "review_id, text")}),
cand_kept AS (SELECT review_id, text, suggested_label AS label FROM cand_src WHERE suggested_label IS NOT NULL),
cand_clean AS (SELECT review_id, {trim_u("coalesce(text, '')")} AS text, {trim_u("coalesce(label, '')")} AS label FROM cand_kept),
cand AS (SELECT review_id, text, label FROM (
   SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY review_id) AS rk FROM cand_clean
   WHERE text <> '' AND label IN ({labels_in})) x WHERE rk = 1),
base_src AS ({relabel_sql("(SELECT review_id, text FROM split WHERE dataset_role = 'training')", "review_id, text")}),
base AS (SELECT review_id, text, suggested_label AS label, '{config.RULE_LABEL_METHOD}' AS label_method FROM base_src WHERE suggested_label IS NOT NULL),
base_keys AS (SELECT DISTINCT {trim_u("coalesce(text, '')")} AS text, {trim_u("coalesce(label, '')")} AS label FROM base),
new AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base_keys b WHERE b.text = c.text AND b.label = c.label))"""
    out["j2_new_pairs"] = "WITH " + split_sql() + "," + cand + "\nSELECT review_id, label FROM new"
    out["d4_merge"] = "WITH " + split_sql() + "," + cand + f"""
SELECT review_id, label, label_method FROM (
  SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY src, review_id) AS rk FROM (
    SELECT review_id, text, label, label_method, 0 AS src FROM base
    UNION ALL SELECT review_id, text, label, '{config.RULE_LABEL_METHOD}', 1 FROM new) u) x WHERE rk = 1"""
    merged = out["d4_merge"].split("\nSELECT", 1)[1]
    out["k4_versioned_merge"] = "WITH " + split_sql() + "," + cand + f"""
SELECT 1 AS version, review_id, label, label_method FROM base
UNION ALL SELECT 2, review_id, label, label_method FROM (SELECT {merged}) m"""
    out["d4_merge_nothing_new"] = "WITH " + split_sql() + "," + cand + "\nSELECT review_id, label, label_method FROM base"
    out["a8_added_by_label"] = "WITH " + split_sql() + "," + cand + "\nSELECT label, count(*) AS n FROM new GROUP BY label"

    # -- ingest
    landed = landed_sql()
    apps = "(SELECT n_name AS app_name, 'src' || CAST(n_nationkey AS VARCHAR) AS app_id FROM nation)"
    ltext = trim_u("coalesce(l.text, '')")
    raw = (
        f"(SELECT l.review_id, {ltext} AS text, a.app_name, l.app_id, '{config.STORE_SOURCE}' AS store_source, "
        f"l.rating, l.review_date FROM {landed} l JOIN {apps} a ON l.app_id = a.app_id)"
    )
    raw_kept = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, text ORDER BY review_id) AS rk FROM {raw} x WHERE text <> '') y WHERE rk = 1)"
    out["s6_raw_reviews"] = f"SELECT review_id, app_name, app_id, store_source, rating FROM {raw_kept} r"
    out["p4_label_ready"] = (
        f"SELECT '' AS label, app_name, app_id, store_source, rating, review_id, '' AS label_notes, '' AS assigned_to, "
        f"'{config.UNLABELED_STATUS}' AS label_status FROM {raw_kept} r"
    )
    out["s7_newest_per_user"] = (
        f"SELECT event_id, user_id, ts FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rk "
        f"FROM events) x WHERE rk <= {C.NEWEST_PER_USER}"
    )
    out["s2_csv_roundtrip"] = "SELECT doc_id, text, lang, source FROM documents"
    out["t2_stream_dedup"] = """
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events) e
WHERE before IS NULL OR ts - before >= INTERVAL 2 DAY"""
    out["k8_term_report"] = f"SELECT term, count(*) AS n FROM (SELECT unnest(string_split(matched_terms, ', ')) AS term FROM ({out['x10_candidates']}) c) t WHERE term <> '' GROUP BY term"
    out["s9_stack_inputs"] = "SELECT doc_id, text, lang FROM documents"
    return out
