"""DuckDB SQL oracles of the modeling queries (TF-IDF, Naive Bayes,
metrics, triage, explanations), built from the same parameters."""

from __future__ import annotations

from . import config
from .config import TfidfParams
from .models.tfidf import stop_words_of
from .oracles import display_name, landed_sql, model_clean, q, trim_u, with_prefix
from .plans import modeling_catalog as MC
from .sources import tables as S


def lang_master_sql() -> str:
    return (
        f"(SELECT doc_id AS review_id, {trim_u('text')} AS text, lang AS label FROM documents "
        f"WHERE lang IS NOT NULL AND text IS NOT NULL AND {trim_u('text')} <> '')"
    )


def alloc(counts: str, draws: str, out: str) -> str:
    return f"""
SELECT *, fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS {out} FROM (
  SELECT *, row_number() OVER (ORDER BY rem DESC, label) AS rk, {draws} - sum(fl) OVER () AS need FROM (
    SELECT *, (n * {draws}) // sum(n) OVER () AS fl, (n * {draws}) % sum(n) OVER () AS rem FROM {counts}
  ) x
) y"""


def loader(source: str, labels, exclude: str | None = None) -> dict:
    staged = (
        f"SELECT review_id, label AS label_raw, text AS text_raw, "
        f"{'(CASE lower(' + trim_u('CAST(label AS VARCHAR)') + ') ' + ' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in labels.synonyms.items()) + ' END)'} AS label, "
        f"{trim_u('text')} AS text FROM {source}"
    )
    valid = (
        "SELECT review_id, label, text FROM (SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY review_id) AS rk0 "
        "FROM staged WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL AND label IS NOT NULL AND text <> '') v WHERE rk0 = 1"
    )
    cleaned = f"SELECT review_id, label, text, {model_clean('text')} AS clean_text FROM valid"
    if exclude:
        marked = f"SELECT c.*, (c.clean_text IN (SELECT clean_text FROM {exclude} WHERE clean_text IS NOT NULL)) AS overlap FROM cleaned c"
    else:
        marked = "SELECT c.*, FALSE AS overlap FROM cleaned c"
    return {"staged": staged, "valid": valid, "cleaned": cleaned, "marked": marked}


def lang_ctes(seed: int = config.RANDOM_SEED, frac: float = MC.SPLIT_TEST_FRACTION) -> str:
    te = loader("(SELECT * FROM split WHERE dataset_role = 'testing_manual')", S.LANG_LABELS)
    tr = loader("(SELECT * FROM split WHERE dataset_role = 'training')", S.LANG_LABELS, exclude="te_data")
    return f"""WITH
master AS {lang_master_sql()},
cnt AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM master GROUP BY label),
tot AS (SELECT *, CAST(ceil(sum(n) OVER () * {frac}) AS BIGINT) AS n_test_all, sum(n) OVER () AS n_all FROM cnt),
tr AS ({alloc("(SELECT label, n, n_test_all, n_all - n_test_all AS n_train_all FROM tot)", "n_train_all", "n_train")}),
quota AS (SELECT label, n_train FROM tr),
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.label ORDER BY md5('{seed}|' || CAST(m.review_id AS VARCHAR)), m.review_id) AS rk FROM master m),
split AS (SELECT r.review_id, r.text, r.label, CASE WHEN r.rk <= qt.n_train THEN 'training' ELSE 'testing_manual' END AS dataset_role
          FROM ranked r JOIN quota qt ON r.label = qt.label),
{with_prefix("te_", te)},
te_data AS (SELECT review_id, label, text, clean_text FROM te_marked WHERE clean_text <> '' AND NOT overlap),
{with_prefix("tr_", tr)},
tr_unbal AS (SELECT review_id, label, text, clean_text FROM tr_marked WHERE clean_text <> '' AND NOT overlap),
tr_data AS (SELECT review_id, label, text, clean_text FROM (
   SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || text), text) AS rkb, min(cnt) OVER () AS quota
   FROM (SELECT *, count(*) OVER (PARTITION BY label) AS cnt FROM tr_unbal) s) b WHERE rkb <= quota)"""


def stop_list(params: TfidfParams) -> str:
    return "[" + ", ".join(q(w) for w in stop_words_of(params)) + "]"


def tf_cte(docs: str, id_col: str, params: TfidfParams) -> str:
    if params.analyzer == "char":
        n = params.char_n
        kept = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g'))"
        grams = f"list_transform(range(1, length(k) - {n} + 2), lambda i: substring(k, i, {n}))"
        return (
            f"SELECT {id_col}, term, count(*) AS tf FROM (SELECT {id_col}, unnest({grams}) AS term FROM "
            f"(SELECT {id_col}, {kept} AS k FROM {docs}) a) b GROUP BY {id_col}, term"
        )
    words = f"list_filter(string_split(clean_text, ' '), lambda w: length(w) >= 2 AND NOT list_contains({stop_list(params)}, w))"
    grams = ["words"]
    for n in range(2, params.ngram_max + 1):
        grams.append(
            f"CASE WHEN len(words) >= {n} THEN list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n - 1}], ' ')) ELSE [] END"
        )
    terms = grams[0]
    for g in grams[1:]:
        terms = f"list_concat({terms}, {g})"
    return (
        f"SELECT {id_col}, term, count(*) AS tf FROM (SELECT {id_col}, unnest({terms}) AS term FROM "
        f"(SELECT {id_col}, {words} AS words FROM {docs}) a) b GROUP BY {id_col}, term"
    )


def vocab_cte(prefix: str, fit_docs: str, id_col: str, params: TfidfParams) -> str:
    lo = f"{params.min_df} * (SELECT count(*) FROM {fit_docs})" if isinstance(params.min_df, float) else f"{params.min_df}"
    hi = f"{params.max_df} * (SELECT count(*) FROM {fit_docs})" if isinstance(params.max_df, float) else f"{params.max_df}"
    return f"""{prefix}ftf AS ({tf_cte(fit_docs, id_col, params)}),
{prefix}vocab AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM {fit_docs})) / (1.0 + df)) + 1.0 AS idf FROM (
   SELECT term, count(*) AS df FROM {prefix}ftf GROUP BY term) d WHERE df >= {lo} AND df <= {hi})"""


def weights_cte(name: str, prefix: str, docs: str, id_col: str, params: TfidfParams) -> str:
    tfw = "(1.0 + ln(t.tf))" if params.sublinear_tf else "CAST(t.tf AS DOUBLE)"
    return f"""{name}_tf AS ({tf_cte(docs, id_col, params)}),
{name} AS (SELECT {id_col}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS weight FROM (
   SELECT t.{id_col}, t.term, {tfw} * v.idf AS w FROM {name}_tf t JOIN {prefix}vocab v ON t.term = v.term) x)"""


def nb_ctes(alpha: float = config.NB_ALPHA, fit_prior: bool = True, params: TfidfParams = MC.NB_PARAMS) -> str:
    """CTEs after lang_ctes: nb_vocab, trw, sums, params, tew, pred (review_id, prediction, confidence)."""
    prior = "ln(c.nc / (SELECT sum(nc) FROM nb_cls))" if fit_prior else "-ln((SELECT count(*) FROM nb_cls))"
    return f""",
{vocab_cte("nb_", "tr_data", "review_id", params)},
{weights_cte("trw", "nb_", "tr_data", "review_id", params)},
nb_sums AS (SELECT d.label, w.term, sum(w.weight) AS s FROM trw w JOIN tr_data d ON w.review_id = d.review_id GROUP BY d.label, w.term),
nb_cls AS (SELECT label, count(*) AS nc FROM tr_data GROUP BY label),
nb_par AS (SELECT c.label, {prior} AS prior,
   ln({alpha}) - ln(t.S + {alpha} * (SELECT count(*) FROM nb_vocab)) AS base
   FROM nb_cls c JOIN (SELECT label, sum(s) AS S FROM nb_sums GROUP BY label) t ON c.label = t.label)"""


def nb_score_ctes(name: str, docs: str, alpha: float = config.NB_ALPHA, params: TfidfParams = MC.NB_PARAMS) -> str:
    """CTEs scoring ``docs`` (review_id, clean_text): {name}_pred(review_id, prediction, confidence)."""
    return f""",
{weights_cte(name + "_w", "nb_", docs, "review_id", params)},
{name}_sx AS (SELECT review_id, sum(weight) AS sx FROM {name}_w GROUP BY review_id),
{name}_seen AS (SELECT w.review_id, s.label, sum(w.weight * (ln(s.s + {alpha}) - ln({alpha}))) AS sv
   FROM {name}_w w JOIN nb_sums s ON w.term = s.term GROUP BY w.review_id, s.label),
{name}_jll AS (SELECT d.review_id, p.label, p.prior + p.base * coalesce(x.sx, 0.0) + coalesce(v.sv, 0.0) AS j
   FROM (SELECT review_id FROM {docs}) d CROSS JOIN nb_par p
   LEFT JOIN {name}_sx x ON x.review_id = d.review_id
   LEFT JOIN {name}_seen v ON v.review_id = d.review_id AND v.label = p.label),
{name}_rk AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY j DESC, label) AS rk,
   max(j) OVER (PARTITION BY review_id) AS mx FROM {name}_jll),
{name}_pred AS (SELECT review_id, max(CASE WHEN rk = 1 THEN label END) AS prediction, 1.0 / sum(exp(j - mx)) AS confidence
   FROM {name}_rk GROUP BY review_id)"""


def nb_folds_sql(cap: int, settings: list[TfidfParams], alphas: list[float], priors: list[bool], seed: int = config.RANDOM_SEED) -> str:
    """Naive Bayes over folds: lang_ctes and, at the end, nf_mean (sid, alpha, fit_prior, accuracy, precision, recall, f1, folds)."""
    most = max(p.ngram_max for p in settings)
    (max_df,) = {p.max_df for p in settings}
    values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows) + ")"
    st = values([(i, p.ngram_max, p.min_df, p.sublinear_tf) for i, p in enumerate(settings)])
    return lang_ctes() + f""",
nf_k AS (SELECT least({cap}, min(n)) AS k FROM (SELECT count(*) AS n FROM tr_data GROUP BY label) c),
nf AS (SELECT review_id, label, clean_text, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || text), text) - 1) % (SELECT k FROM nf_k) AS INTEGER) AS fold FROM tr_data),
nf_st AS (SELECT * FROM {st} AS t(sid, ngram, min_df, sublinear)),
nf_a AS (SELECT CAST(alpha AS DOUBLE) AS alpha FROM {values([(a,) for a in alphas])} AS t(alpha)),
nf_p AS (SELECT * FROM {values([(p,) for p in priors])} AS t(fit_prior)),
nf_tf AS ({tf_cte("nf", "review_id", TfidfParams(ngram_max=most))}),
nf_m AS (SELECT DISTINCT fold AS f FROM nf),
nf_n AS (SELECT m.f, count(*) AS n FROM nf_m m JOIN nf d ON d.fold <> m.f GROUP BY m.f),
nf_df AS (SELECT m.f, t.term, count(*) AS df FROM nf_m m JOIN nf d ON d.fold <> m.f JOIN nf_tf t ON t.review_id = d.review_id GROUP BY m.f, t.term),
nf_voc AS (SELECT s.sid, s.sublinear, d.f, d.term, ln((1.0 + n.n) / (1.0 + d.df)) + 1.0 AS idf FROM nf_df d JOIN nf_n n ON n.f = d.f
   JOIN nf_st s ON (s.ngram > 1 OR strpos(d.term, ' ') = 0) AND d.df >= s.min_df WHERE d.df <= {max_df} * n.n),
nf_w AS (SELECT sid, f, review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY sid, f, review_id)) AS x FROM (
   SELECT v.sid, v.f, t.review_id, t.term, CASE WHEN v.sublinear THEN 1.0 + ln(t.tf) ELSE CAST(t.tf AS DOUBLE) END * v.idf AS w
   FROM nf_tf t JOIN nf_voc v ON v.term = t.term) y),
nf_s AS (SELECT w.sid, w.f, d.label, w.term, sum(w.x) AS s FROM nf_w w JOIN nf d ON d.review_id = w.review_id WHERE d.fold <> w.f GROUP BY w.sid, w.f, d.label, w.term),
nf_cls AS (SELECT m.f, d.label, count(*) AS nc, sum(count(*)) OVER (PARTITION BY m.f) AS n, count(*) OVER (PARTITION BY m.f) AS classes FROM nf_m m JOIN nf d ON d.fold <> m.f GROUP BY m.f, d.label),
nf_tot AS (SELECT t.sid, t.f, t.label, t.total, v.terms FROM (SELECT sid, f, label, sum(s) AS total FROM nf_s GROUP BY sid, f, label) t
   JOIN (SELECT sid, f, count(*) AS terms FROM nf_voc GROUP BY sid, f) v ON v.sid = t.sid AND v.f = t.f),
nf_own AS (SELECT w.* FROM nf_w w JOIN nf d ON d.review_id = w.review_id AND d.fold = w.f),
nf_sx AS (SELECT sid, review_id, sum(x) AS sx FROM nf_own GROUP BY sid, review_id),
nf_sv AS (SELECT w.sid, w.review_id, s.label, a.alpha, sum(w.x * (ln(s.s + a.alpha) - ln(a.alpha))) AS sv
   FROM nf_own w JOIN nf_s s ON s.sid = w.sid AND s.f = w.f AND s.term = w.term CROSS JOIN nf_a a GROUP BY w.sid, w.review_id, s.label, a.alpha),
nf_j AS (SELECT t.sid, a.alpha, p.fit_prior, d.review_id, d.fold, d.label AS actual, c.label,
   CASE WHEN p.fit_prior THEN ln(c.nc / c.n) ELSE -ln(c.classes) END
   + (ln(a.alpha) - ln(t.total + a.alpha * t.terms)) * coalesce(x.sx, 0.0) + coalesce(v.sv, 0.0) AS j
   FROM nf d JOIN nf_cls c ON c.f = d.fold JOIN nf_tot t ON t.f = d.fold AND t.label = c.label CROSS JOIN nf_a a CROSS JOIN nf_p p
   LEFT JOIN nf_sx x ON x.sid = t.sid AND x.review_id = d.review_id
   LEFT JOIN nf_sv v ON v.sid = t.sid AND v.review_id = d.review_id AND v.label = c.label AND v.alpha = a.alpha),
nf_pred AS (SELECT sid, alpha, fit_prior, fold, actual, label AS predicted FROM nf_j
   QUALIFY row_number() OVER (PARTITION BY sid, alpha, fit_prior, review_id ORDER BY j DESC, label) = 1),
nf_c AS (SELECT sid, alpha, fit_prior, fold, actual, predicted, count(*) AS n FROM nf_pred GROUP BY ALL),
nf_l AS (SELECT sid, alpha, fit_prior, fold, label, sum(tp) AS tp, sum(na) AS na, sum(np) AS np FROM (
   SELECT sid, alpha, fit_prior, fold, actual AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, n AS na, 0 AS np FROM nf_c
   UNION ALL SELECT sid, alpha, fit_prior, fold, predicted, 0, 0, n FROM nf_c) u GROUP BY ALL),
nf_f AS (SELECT sid, alpha, fit_prior, fold, sum(tp) / sum(na) AS accuracy, avg(CASE WHEN np > 0 THEN tp / np ELSE 0.0 END) AS precision,
   avg(CASE WHEN na > 0 THEN tp / na ELSE 0.0 END) AS recall, avg(2.0 * tp / (na + np)) AS f1 FROM nf_l GROUP BY sid, alpha, fit_prior, fold),
nf_mean AS (SELECT sid, alpha, fit_prior, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS folds
   FROM nf_f GROUP BY sid, alpha, fit_prior)"""


def disp(x: str) -> str:
    return display_name(x, S.LANG_LABELS.display)


def metrics_ctes(scored: str) -> str:
    """per-label counts from a table (label, prediction)."""
    return f""",
conf AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM {scored} GROUP BY ALL),
per AS (SELECT label, sum(tp) AS tp, sum(na) AS n_actual, sum(np) AS n_predicted FROM (
   SELECT actual AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, n AS na, 0 AS np FROM conf
   UNION ALL SELECT predicted, 0, 0, n FROM conf) u GROUP BY label),
rat AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0.0 END AS precision,
   CASE WHEN n_actual > 0 THEN tp / n_actual ELSE 0.0 END AS recall,
   CASE WHEN n_actual + n_predicted > 0 THEN 2.0 * tp / (n_actual + n_predicted) ELSE 0.0 END AS f1 FROM per)"""


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    P = TfidfParams()
    docs = f"(SELECT doc_id, {model_clean(trim_u('text'))} AS clean_text FROM documents)"
    base = f"WITH d AS {docs},\n{vocab_cte('m_', 'd', 'doc_id', P)},\n{weights_cte('mw', 'm_', 'd', 'doc_id', P)}"
    out["m1_tfidf_long"] = base + f"\nSELECT doc_id, term, {r6('weight', 'weight')} FROM mw"
    out["m10_top_terms"] = base + """
SELECT doc_id, string_agg(term, ', ' ORDER BY rk) AS top_terms FROM (
  SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rk FROM mw) x
WHERE rk <= 5 GROUP BY doc_id"""
    L = lang_ctes() + nb_ctes()
    T = L + nb_score_ctes("te", "te_data")
    out["m3_nb_predict"] = T + f"\nSELECT d.review_id, d.label, p.prediction, {r6('p.confidence', 'confidence')} FROM te_data d JOIN te_pred p ON d.review_id = p.review_id"
    scored = "(SELECT d.label, p.prediction FROM te_data d JOIN te_pred p ON d.review_id = p.review_id)"
    M = T + metrics_ctes(scored)
    summary = f"""
SELECT CAST(sum(n_actual) AS BIGINT) AS rows, CAST(sum(tp) AS BIGINT) AS correct, {r6('sum(tp) / sum(n_actual)', 'accuracy')},
  {r6('avg(precision)', 'precision')}, {r6('avg(recall)', 'recall')}, {r6('avg(f1)', 'f1')} FROM rat"""
    out["k6_saved_model_scores"] = out["m3_nb_predict"]
    cv = ", ".join(r6(c, f"cv_{c}") for c in ("accuracy", "precision", "recall", "f1"))
    out["m14_nb_cv"] = nb_folds_sql(5, [MC.NB_PARAMS], [config.NB_ALPHA], [True]) + f"\nSELECT {cv}, folds FROM nf_mean"
    grid = config.NB_GRID
    settings = [TfidfParams(ngram_max=n, min_df=m, sublinear_tf=s) for m in grid["min_df"] for n in grid["ngram_max"] for s in grid["sublinear_tf"]]
    ordered = "alpha, fit_prior DESC, min_df, ngram_max, sublinear_tf"  # the grid's own order
    out["m8_nb_grid"] = nb_folds_sql(3, settings, grid["alpha"], grid["fit_prior"]) + f"""
SELECT CAST(row_number() OVER (ORDER BY {ordered}) - 1 AS INTEGER) AS point, alpha, fit_prior, min_df, ngram_max, sublinear_tf, {r6('f1', 'mean_f1')},
  row_number() OVER (ORDER BY round(f1, 9) DESC, {ordered}) = 1 AS best
FROM (SELECT m.*, s.min_df, s.ngram AS ngram_max, s.sublinear AS sublinear_tf FROM nf_mean m JOIN nf_st s ON s.sid = m.sid) x"""
    solved = ", ".join(f"({q(m)})" for m in ("Logistic Regression", "SVM"))
    out["m5_optimality"] = f"SELECT m.model, l.label, TRUE AS converged FROM (VALUES {solved}) AS m(model), (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL) l"
    named = ", ".join(f"({q(m)})" for m in ("Naive Bayes", "SVM", "Logistic Regression"))
    out["k6_bundle_scores"] = lang_ctes() + f"\nSELECT m.model, count(*) AS rows, count(*) AS equal_rows FROM (VALUES {named}) AS m(model), te_data GROUP BY m.model"
    out["m11_metrics"] = M + summary
    out["a6_holdout_summary"] = M + summary
    names = S.LANG_LABELS.names
    dim = "(VALUES " + ", ".join(f"({q(l)}, {i})" for i, l in enumerate(names)) + ") AS dim(label, label_order)"
    out["m12_per_class"] = M + f"""
SELECT dim.label_order, {disp('dim.label')} AS category, {r6('coalesce(r.precision, 0.0)', 'precision')},
  {r6('coalesce(r.recall, 0.0)', 'recall')}, {r6('coalesce(r.f1, 0.0)', 'f1')}, CAST(coalesce(r.n_actual, 0) AS BIGINT) AS support
FROM {dim} LEFT JOIN rat r ON r.label = dim.label"""
    cols = ", ".join(f"CAST(coalesce(sum(CASE WHEN c.predicted = {q(l)} THEN c.n END), 0) AS BIGINT) AS p_{l}" for l in names)
    out["m13_confusion"] = M + f"""
SELECT dim.label_order, dim.label AS actual, {cols} FROM {dim} LEFT JOIN conf c ON c.actual = dim.label GROUP BY dim.label_order, dim.label"""
    out["m9b_holdout_eval"] = T + f"""
SELECT row_number() OVER (ORDER BY d.review_id) AS test_row, d.review_id, {disp('d.label')} AS actual_label,
  {disp('p.prediction')} AS predicted_label, {r6('p.confidence', 'confidence')},
  {disp('d.label')} = {disp('p.prediction')} AS correct
FROM te_data d JOIN te_pred p ON d.review_id = p.review_id"""
    held = f"({out['m9b_holdout_eval']}) h"
    out["f6_category_rows"] = f"SELECT test_row, review_id, actual_label, correct FROM {held} WHERE actual_label = {q(S.LANG_LABELS.display.get('fr', 'Fr'))}"
    out["f7_incorrect_rows"] = f"SELECT test_row, review_id, actual_label, predicted_label FROM {held} WHERE NOT correct"
    shown = ", ".join(f"printf('%.2f%%', {c} * 100) AS {c}" for c in ("accuracy", "precision", "recall", "f1"))
    out["m18_metric_percents"] = f"SELECT rows, {shown} FROM ({out['m11_metrics']}) m"
    up = f"""(SELECT row_number() OVER (ORDER BY conv_id, turn) AS review_id, text, {model_clean('text')} AS clean_text FROM (
   SELECT conv_id, turn, {trim_u("coalesce(text, '')")} AS text FROM conversations) a
   WHERE text <> '' AND {model_clean('text')} <> '')"""
    U = L + ",\nup AS " + up + nb_score_ctes("up", "up")
    out["m9c_upload_scoring"] = U + f"\nSELECT review_id AS file_row, {disp('prediction')} AS predicted_label, {r6('confidence', 'confidence')} FROM up_pred"
    out["m9c_label_counts"] = U + f"\nSELECT {disp('prediction')} AS predicted_label, count(*) AS n FROM up_pred GROUP BY ALL"
    live = f"(SELECT doc_id AS review_id, CAST(1 + (doc_id % 5) AS INTEGER) AS rating, text, {model_clean('text')} AS clean_text FROM documents)"
    V = L + ",\nlive AS " + live + ",\nneeds AS (SELECT * FROM live WHERE rating <= 3)" + nb_score_ctes("lv", "needs")
    triage = f"""
SELECT l.review_id, l.rating,
  CASE WHEN l.rating <= 3 THEN '{config.SENTIMENT_NEEDS_REVIEW}' ELSE '{config.SENTIMENT_POSITIVE}' END AS sentiment,
  CASE WHEN l.rating <= 3 THEN '{config.ACTION_FOLLOW_UP}' ELSE '{config.ACTION_UNCHANGED}' END AS action,
  CASE WHEN l.rating <= 3 THEN {disp('p.prediction')} ELSE '' END AS predicted_issue,
  {r6('CASE WHEN l.rating <= 3 THEN p.confidence END', 'confidence')}
FROM live l LEFT JOIN lv_pred p ON l.review_id = p.review_id"""
    out["m9a_triage"] = V + triage
    # The streaming triage writes the same rows as the batch triage.
    out["t1_stream_triage"] = out["m9a_triage"]
    out["a5_triage_summary"] = V + f""",
t AS ({triage})
SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = '{config.SENTIMENT_NEEDS_REVIEW}') AS needs_review,
  count(*) FILTER (WHERE sentiment = '{config.SENTIMENT_POSITIVE}') AS positive FROM t"""
    out["m10_explain"] = T + f""",
ex_top AS (SELECT review_id, string_agg(term, ', ' ORDER BY rk) AS top_terms FROM (
   SELECT review_id, term, row_number() OVER (PARTITION BY review_id ORDER BY round(weight, 9) DESC, term) AS rk FROM te_w) x
   WHERE rk <= 5 GROUP BY review_id)
SELECT d.review_id, {disp('p.prediction')} AS label, {r6('p.confidence', 'confidence')}, coalesce(t.top_terms, '') AS top_terms,
  CASE p.prediction {" ".join(f"WHEN {q(c)} THEN {q(r)}" for c, r in MC.LANG_REASONS.items())} ELSE {q(config.DEFAULT_REASON)} END AS label_reason
FROM te_data d JOIN te_pred p ON d.review_id = p.review_id LEFT JOIN ex_top t ON t.review_id = d.review_id"""
    names_txt_pre = " || ',' || ".join(
        f"'{l}:' || CAST(coalesce((SELECT count(*) FROM tr_unbal WHERE label = {q(l)}), 0) AS VARCHAR)" for l in names
    )
    names_txt_bal = " || ',' || ".join(
        f"'{l}:' || CAST(coalesce((SELECT count(*) FROM tr_data WHERE label = {q(l)}), 0) AS VARCHAR)" for l in names
    )
    from .models.language import PROFILE_PARAMS

    P1 = lang_ctes() + nb_ctes(alpha=0.5, fit_prior=False, params=PROFILE_PARAMS) + nb_score_ctes("l1", "te_data", 0.5, PROFILE_PARAMS)
    letters = r"trim(regexp_replace(lower(coalesce(d.text, '')), '[^\p{L}]+', ' ', 'g'))"
    out["l1_language_predict"] = P1 + f"""
SELECT d.review_id, d.label, CASE WHEN {letters} <> '' THEN p.prediction END AS detected_lang,
  coalesce({letters} <> '' AND p.prediction = 'en', FALSE) AS is_english
FROM te_data d JOIN l1_pred p ON d.review_id = p.review_id"""
    live_rows = f"""(SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id, text ORDER BY review_date DESC NULLS LAST) AS rk2 FROM (
    SELECT review_id, review_date, rating, {trim_u("coalesce(text, '')")} AS text, thumbs_up_count AS thumbs_up FROM (
      SELECT *, row_number() OVER (ORDER BY review_date DESC NULLS LAST, review_id) AS rk FROM {landed_sql()} l WHERE app_id = '{MC.S8_APP}'
    ) a WHERE rk <= {MC.S8_COUNT}) b WHERE text <> '') c WHERE rk2 = 1)"""
    out["s8_live_ingest"] = lang_ctes() + nb_ctes(alpha=0.5, fit_prior=False, params=PROFILE_PARAMS) + ",\nlive8 AS " + live_rows + nb_score_ctes("l8", "live8", 0.5, PROFILE_PARAMS) + f"""
SELECT d.review_id, d.rating, d.thumbs_up FROM live8 d JOIN l8_pred p ON d.review_id = p.review_id
WHERE {letters} <> '' AND p.prediction = 'en'"""
    out["k7_result_export"] = f"SELECT test_row, review_id, predicted_label, confidence FROM ({out['m9b_holdout_eval']}) h"
    out["m15a_prepare_summary"] = lang_ctes() + f""",
pre AS (SELECT count(*) AS o, count(*) FILTER (WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL) AS a,
   count(*) FILTER (WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL AND label IS NOT NULL) AS b,
   count(*) FILTER (WHERE label_raw IS NOT NULL AND text_raw IS NOT NULL AND label IS NOT NULL AND text <> '') AS c FROM tr_staged),
post AS (SELECT count(*) AS dd, count(*) FILTER (WHERE clean_text <> '') AS bo,
   count(*) FILTER (WHERE clean_text <> '' AND NOT overlap) AS fin FROM tr_marked),
lc AS (SELECT label, count(*) AS n FROM tr_unbal GROUP BY label),
mm AS (SELECT min(n) AS mn, max(n) AS mx, count(*) AS k FROM lc)
SELECT CAST(o AS BIGINT) AS original_rows, CAST(a AS BIGINT) AS rows_after_null_drop, CAST(b AS BIGINT) AS rows_after_label_clean,
  CAST(c AS BIGINT) AS rows_after_text_clean, CAST(dd AS BIGINT) AS rows_after_dedup, CAST(fin AS BIGINT) AS final_rows,
  CAST((SELECT mn * k FROM mm) AS BIGINT) AS balanced_rows, CAST(c - dd AS BIGINT) AS duplicates_removed,
  CAST(bo - fin AS BIGINT) AS overlap_rows_removed, CAST((SELECT mn FROM mm) AS BIGINT) AS minority_count,
  CAST((SELECT mx FROM mm) AS BIGINT) AS majority_count, round((SELECT mx FROM mm) / (SELECT mn FROM mm), 2) AS imbalance_ratio,
  TRUE AS applied_balancing, {names_txt_pre} AS label_counts_before_balance, {names_txt_bal} AS label_counts,
  CAST((SELECT count(*) FROM te_data) AS BIGINT) AS testing_rows
FROM pre, post"""
    return out
