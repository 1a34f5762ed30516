"""Independent DuckDB SQL for each registered key (the correctness oracle).

The views documents, labels, pages, conversations, embeddings, benchmark
are expected to exist.  Shared rules (tokenizer, stop words, stemmer, keyed
draws) are rendered from the same rule text as the Spark jobs; the
relational work (joins, aggregates, windows) is written here as SQL.
"""

from __future__ import annotations

import re

from ..functions import constants as K
from ..functions import text as TX
from ..functions.dialect import DUCK as D
from ..functions.dialect import keyed_bucket, keyed_unit
from ..functions.porter import stem_array_sql
from ..operators.eda import CUT, GRID, POISSON_16

ORACLE: dict[str, str] = {}


def sql(key):
    def deco(fn):
        ORACLE[key] = fn()
        return fn
    return deco


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------ shared CTEs
ALL_REVIEWS = ("all_reviews AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS label "
               "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
REVIEWS = ("reviews AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality AS label "
           "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
SREVIEWS = (f"sreviews AS (SELECT *, CASE WHEN {keyed_bucket(D, K.SHUFFLE_SEED, 'doc_id', K.TEST_BUCKETS)} = 0 "
            f"THEN 'test' ELSE 'train' END AS split FROM reviews)")
RAWTOK = (f"rawtok AS (SELECT doc_id, label, split, unnest(range(len(arr))) AS pos, unnest(arr) AS raw "
          f"FROM (SELECT doc_id, label, split, {TX.kept_tokens_sql(D, 'text')} AS arr FROM sreviews))")
def stem_table(words_sql: str) -> str:
    """(o, stem) for a query with one column w, stemming each distinct word
    once through the list form of the rules."""
    q = f"SELECT w AS o, [w] AS __stem FROM ({words_sql})"
    for i, e in enumerate(stem_array_sql(D, "__stem")):
        q = f"SELECT o, {e} AS __stem FROM ({q}) q{i}"
    return f"SELECT o, __stem[1] AS stem FROM ({q})"


STEMS = f"stems AS ({stem_table('SELECT DISTINCT raw AS w FROM rawtok')})"
TOK = "tok AS (SELECT r.doc_id, r.label, r.split, r.pos, s.stem AS token FROM rawtok r JOIN stems s ON r.raw = s.o)"
CORPUS = ("corpus AS (SELECT r.doc_id, r.label, r.split, "
          "coalesce(t.processed_text, '') AS processed_text, coalesce(t.token_count, 0)::BIGINT AS token_count "
          "FROM sreviews r LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS processed_text, "
          "count(*) AS token_count FROM tok GROUP BY doc_id) t ON r.doc_id = t.doc_id)")
TOKBASE = [REVIEWS, SREVIEWS, RAWTOK, STEMS, TOK]
WORDLEN = f"wl AS (SELECT doc_id, {TX.word_count_sql(D, 'text')} AS length FROM reviews)"
NB_FREQS = ("freqs AS (SELECT token, count(*) FILTER (WHERE label = 1)::BIGINT AS n_pos, "
            "count(*) FILTER (WHERE label = 0)::BIGINT AS n_neg FROM tok WHERE split = 'train' GROUP BY token)")
NB_MODEL = ("model AS (SELECT token, n_pos, n_neg, "
            "ln((n_pos + 1) / (t.tot_pos + t.vsize)) - ln((n_neg + 1) / (t.tot_neg + t.vsize)) AS loglikelihood, "
            "ln(dd.docs_pos) - ln(dd.docs_neg) AS logprior FROM freqs, "
            "(SELECT sum(n_pos) AS tot_pos, sum(n_neg) AS tot_neg, count(*) AS vsize FROM freqs) t, "
            "(SELECT count(*) FILTER (WHERE label = 1) AS docs_pos, count(*) FILTER (WHERE label = 0) AS docs_neg "
            "FROM sreviews WHERE split = 'train') dd)")
NB_SCORES = ("scores AS (SELECT r.doc_id, r.label, (SELECT max(logprior) FROM model) + coalesce(s.s, 0) AS score, "
             "CAST((SELECT max(logprior) FROM model) + coalesce(s.s, 0) > 0 AS INTEGER) AS prediction "
             "FROM sreviews r LEFT JOIN (SELECT t.doc_id, sum(m.loglikelihood) AS s FROM tok t JOIN model m "
             "ON t.token = m.token WHERE t.split = 'test' GROUP BY t.doc_id) s ON r.doc_id = s.doc_id "
             "WHERE r.split = 'test')")
NB = TOKBASE + [NB_FREQS, NB_MODEL, NB_SCORES]
CELLS = ("cells AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS n00, "
         "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS n01, "
         "count(*) FILTER (WHERE label = 1 AND prediction = 0) AS n10, "
         "count(*) FILTER (WHERE label = 1 AND prediction = 1) AS n11 FROM scores)")


def ratio(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) * 1.0e0 / ({b}) ELSE 0.0e0 END"


# ---------------------------------------------------------------- 2.1
@sql("scan_reviews")
def _():
    return with_(REVIEWS) + "SELECT doc_id, text, lang, source, label FROM reviews"


@sql("list_splits")
def _():
    return with_(REVIEWS, SREVIEWS) + "SELECT split, count(*) AS n_rows FROM sreviews GROUP BY split"


@sql("select_split")
def _():
    return with_(REVIEWS, SREVIEWS) + "SELECT doc_id, label, split FROM sreviews WHERE split = 'test'"


@sql("concat_splits")
def _():
    return with_(REVIEWS, SREVIEWS) + ("SELECT doc_id, label, split FROM sreviews WHERE split = 'train' "
                                       "UNION ALL SELECT doc_id, label, split FROM sreviews WHERE split = 'test'")


@sql("assign_row_id")
def _():
    return with_(REVIEWS) + "SELECT doc_id, label, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_id FROM reviews"


@sql("preview_rows")
def _():
    return with_(REVIEWS) + "SELECT doc_id, text, label FROM reviews ORDER BY doc_id LIMIT 5"


@sql("sample_n")
def _():
    return with_(REVIEWS) + (f"SELECT doc_id, label FROM reviews ORDER BY {keyed_unit(D, K.SEARCH_SEED, 'doc_id')}, doc_id "
                             f"LIMIT {K.SAMPLE_N}")


@sql("load_documents")
def _():
    meta = ("'doc_id=' || doc_id || ';index=' || doc_id || ';label=' || label || ';lang=' || coalesce(lang, '') "
            "|| ';source=' || coalesce(source, '')")
    return with_(REVIEWS) + f"SELECT doc_id, text AS content, {meta} AS metadata_text FROM reviews"


# ---------------------------------------------------------------- 2.2
@sql("missing_counts")
def _():
    cols = ["doc_id", "text", "lang", "source", "label"]
    return with_(ALL_REVIEWS) + "SELECT " + ", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_missing_{c}" for c in cols) + " FROM all_reviews"


@sql("handle_missing")
def _():
    return with_(ALL_REVIEWS) + "SELECT doc_id, label, coalesce(text, '') AS text FROM all_reviews WHERE label IS NOT NULL"


@sql("encode_label")
def _():
    return with_(REVIEWS) + ("SELECT doc_id, verdict, CAST(upper(verdict) = 'POSITIVE' AS INTEGER) AS label_id FROM "
                             "(SELECT doc_id, CASE WHEN label = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict FROM reviews)")


@sql("filter_by_label")
def _():
    return with_(REVIEWS) + "SELECT doc_id, label FROM reviews WHERE label = 0"


@sql("word_count")
def _():
    return with_(REVIEWS, WORDLEN) + "SELECT doc_id, length FROM wl"


@sql("token_count")
def _():
    return with_(*TOKBASE, CORPUS) + "SELECT doc_id, token_count FROM corpus"


# ---------------------------------------------------------------- 2.3
@sql("strip_urls")
def _():
    return f"SELECT page_id, {D.rx_replace("concat_ws(' ', url, html)", K.URL_PATTERN, '')} AS text FROM pages"


@sql("strip_hash_sign")
def _():
    return f"SELECT doc_id, {D.rx_replace('text', K.HASH_SIGN_PATTERN, '')} AS text FROM documents"


@sql("strip_numbers")
def _():
    return f"SELECT doc_id, {D.rx_replace('text', K.NUMBER_PATTERN, '')} AS text FROM documents"


@sql("tokenize")
def _():
    return (f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS token_text "
            f"FROM (SELECT doc_id, {TX.tokenize_sql(D, 'text')} AS t FROM documents)")


RAW_ALL = (f"raw_all AS (SELECT doc_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token "
           f"FROM (SELECT doc_id, {TX.tokenize_sql(D, 'text')} AS t FROM documents))")


@sql("explode_tokens")
def _():
    return with_(RAW_ALL) + "SELECT doc_id, pos, token FROM raw_all"


@sql("remove_stopwords")
def _():
    return with_(RAW_ALL) + f"SELECT doc_id, pos, token FROM raw_all WHERE token NOT IN {TX.stopword_list_sql(D)}"


@sql("remove_punctuation")
def _():
    return with_(RAW_ALL) + (f"SELECT doc_id, pos, token FROM raw_all WHERE token NOT IN {TX.stopword_list_sql(D)} "
                             f"AND NOT contains({D.lit(K.PUNCTUATION)}, token)")


@sql("stem_vocabulary")
def _():
    inner = f"SELECT DISTINCT unnest({TX.kept_tokens_sql(D, 'text')}) AS w FROM documents"
    return f"SELECT o AS word, stem FROM ({stem_table(inner)})"


@sql("processed_text")
def _():
    return with_(*TOKBASE, CORPUS) + "SELECT doc_id, processed_text FROM corpus"


@sql("preprocess_corpus")
def _():
    return with_(*TOKBASE, CORPUS) + "SELECT doc_id, label, processed_text, token_count FROM corpus"


@sql("vocabulary")
def _():
    return with_(*TOKBASE) + ("SELECT token, count(*)::BIGINT AS term_freq, count(DISTINCT doc_id)::BIGINT AS doc_freq "
                              "FROM tok GROUP BY token")


# ---------------------------------------------------------------- 2.4
def _describe(src: str, col: str) -> str:
    return (f"SELECT count({col})::BIGINT AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std, "
            f"min({col})::DOUBLE AS min, round(quantile_cont({col}, 0.25), 6) AS q25, "
            f"round(quantile_cont({col}, 0.5), 6) AS q50, round(quantile_cont({col}, 0.75), 6) AS q75, "
            f"max({col})::DOUBLE AS max FROM {src}")


def _histogram(src: str, col: str, bins: int = 100) -> str:
    return (f"SELECT g.bin, round(s.lo + g.bin * (s.hi - s.lo) / {bins}, 6) AS bin_lo, "
            f"round(s.lo + (g.bin + 1) * (s.hi - s.lo) / {bins}, 6) AS bin_hi, coalesce(c.n, 0)::BIGINT AS n "
            f"FROM (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {src}) s "
            f"CROSS JOIN (SELECT unnest(range({bins}))::INTEGER AS bin) g "
            f"LEFT JOIN (SELECT CASE WHEN s2.hi = s2.lo THEN 0 ELSE least(floor(({col} - s2.lo) * {bins} / (s2.hi - s2.lo)), {bins - 1}) END::INTEGER AS bin, "
            f"count(*) AS n FROM {src}, (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {src}) s2 "
            f"WHERE {col} IS NOT NULL GROUP BY 1) c ON g.bin = c.bin")


@sql("describe_length")
def _():
    return with_(REVIEWS, WORDLEN) + _describe("wl", "length")


@sql("describe_token_count")
def _():
    return with_(*TOKBASE, CORPUS) + _describe("corpus", "token_count")


@sql("histogram_length")
def _():
    return with_(REVIEWS, WORDLEN) + _histogram("wl", "length")


@sql("histogram_token_count")
def _():
    return with_(*TOKBASE, CORPUS) + _histogram("corpus", "token_count")


@sql("label_distribution")
def _():
    return with_(REVIEWS) + "SELECT label, count(*) AS n_rows FROM reviews GROUP BY label ORDER BY label"


@sql("sort_by_label")
def _():
    return with_(REVIEWS) + "SELECT label, count(*) AS n_rows FROM reviews GROUP BY label ORDER BY label"


# ---------------------------------------------------------------- 2.6
def _draw(seed, key="doc_id"):
    return D.hex8(f"concat('{seed}:', CAST({key} AS VARCHAR))")


@sql("shuffle_rows")
def _():
    return with_(REVIEWS) + f"SELECT doc_id, label, {_draw(K.SHUFFLE_SEED)} AS shuffle_key FROM reviews"


@sql("train_test_split")
def _():
    return with_(REVIEWS, SREVIEWS) + "SELECT doc_id, label, split FROM sreviews"


@sql("stratified_folds")
def _():
    return with_(REVIEWS, SREVIEWS) + (
        f"SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {_draw('fold' + str(K.SHUFFLE_SEED))}, doc_id) - 1) % {K.N_FOLDS})::INTEGER AS fold "
        f"FROM sreviews WHERE split = 'train'")


@sql("stratified_holdout")
def _():
    d = D.hex8("concat('holdout', CAST(seed AS VARCHAR), ':', CAST(doc_id AS VARCHAR))")
    return with_(REVIEWS, SREVIEWS) + (
        f"SELECT seed, doc_id, label, CASE WHEN (row_number() OVER (PARTITION BY seed, label ORDER BY {d}, doc_id) - 1) % 5 = 0 "
        f"THEN 'validation' ELSE 'fit' END AS role FROM (SELECT s.seed::INTEGER AS seed, r.doc_id, r.label FROM sreviews r "
        f"CROSS JOIN (SELECT unnest(range({K.N_FOLDS})) AS seed) s WHERE r.split = 'train')")


# ---------------------------------------------------------------- NB
@sql("token_label_freqs")
def _():
    return with_(*TOKBASE, NB_FREQS) + "SELECT token, n_pos, n_neg FROM freqs"


@sql("token_label_features")
def _():
    return with_(*TOKBASE, NB_FREQS) + (
        "SELECT r.doc_id, r.label, r.split, coalesce(s.p, 0)::DOUBLE AS tlc_pos, coalesce(s.n, 0)::DOUBLE AS tlc_neg "
        "FROM sreviews r LEFT JOIN (SELECT t.doc_id, sum(f.n_pos) AS p, sum(f.n_neg) AS n FROM tok t JOIN freqs f "
        "ON t.token = f.token GROUP BY t.doc_id) s ON r.doc_id = s.doc_id")


@sql("nb_train")
def _():
    return with_(*TOKBASE, NB_FREQS, NB_MODEL) + (
        "SELECT token, n_pos, n_neg, round(loglikelihood, 6) AS loglikelihood, round(logprior, 6) AS logprior FROM model")


@sql("nb_predict")
def _():
    return with_(*NB) + "SELECT doc_id, label, round(score, 6) AS score, prediction FROM scores"


@sql("nb_evaluate")
def _():
    return with_(*NB) + ("SELECT 'naive_bayes' AS model, count(*)::BIGINT AS n, "
                         "round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM scores")


@sql("threshold_prediction")
def _():
    return with_(*NB) + "SELECT doc_id, CAST(score > 0 AS INTEGER) AS prediction FROM scores"


@sql("lookup_default_join")
def _():
    return with_(*TOKBASE, NB_FREQS, NB_MODEL) + (
        "SELECT t.doc_id, t.pos::INTEGER AS pos, t.token, round(coalesce(m.loglikelihood, 0.0e0), 6) AS weight "
        "FROM tok t LEFT JOIN model m ON t.token = m.token WHERE t.split = 'test'")


@sql("align_predictions")
def _():
    return with_(*NB) + "SELECT doc_id, label AS truth, prediction FROM scores"


# ---------------------------------------------------------------- 2.10
@sql("confusion_matrix")
def _():
    return with_(*NB, CELLS) + ("SELECT 0 AS truth, 0 AS prediction, n00 AS n FROM cells UNION ALL SELECT 0, 1, n01 FROM cells "
                                "UNION ALL SELECT 1, 0, n10 FROM cells UNION ALL SELECT 1, 1, n11 FROM cells")


@sql("accuracy")
def _():
    return with_(*NB) + "SELECT count(*)::BIGINT AS n, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM scores"


def _metrics_select():
    return (f"round({ratio('n11', 'n11 + n01')}, 6) AS precision, round({ratio('n11', 'n11 + n10')}, 6) AS recall, "
            f"round({ratio('2 * n11', '2 * n11 + n01 + n10')}, 6) AS f1_score")


@sql("precision_recall_f1")
def _():
    return with_(*NB, CELLS) + f"SELECT {_metrics_select()} FROM cells"


@sql("classification_report")
def _():
    p0, r0, f0 = ratio("n00", "n00 + n10"), ratio("n00", "n00 + n01"), ratio("2 * n00", "2 * n00 + n10 + n01")
    p1, r1, f1 = ratio("n11", "n11 + n01"), ratio("n11", "n11 + n10"), ratio("2 * n11", "2 * n11 + n01 + n10")
    s0, s1, n = "(n00 + n01)", "(n10 + n11)", "(n00 + n01 + n10 + n11)"
    acc = ratio("n00 + n11", n)

    def w(a, b):
        return ratio(f"({a}) * {s0} + ({b}) * {s1}", n)

    def row(name, p, r, f, sup):
        return f"SELECT '{name}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1_score, ({sup})::BIGINT AS support FROM cells"
    return with_(*NB, CELLS) + " UNION ALL ".join([
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1), row("accuracy", acc, acc, acc, n),
        row("macro avg", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f0}) + ({f1})) / 2", n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n)])


@sql("evaluate_model")
def _():
    return with_(*NB, CELLS) + (f"SELECT 'naive_bayes' AS model, round({ratio('n00 + n11', 'n00 + n01 + n10 + n11')}, 6) AS accuracy, "
                                f"round({ratio('2 * n11', '2 * n11 + n01 + n10')}, 6) AS f1_score FROM cells")


@sql("error_rows")
def _():
    return with_(*NB) + "SELECT doc_id, label, prediction FROM scores WHERE label <> prediction"


# ---------------------------------------------------------------- 2.9 lexicon
LEXICON = ("lexicon AS (SELECT token, round(greatest(-4.0e0, least(4.0e0, loglikelihood)), 3) AS valence "
           f"FROM model WHERE n_pos + n_neg >= {K.LEXICON_MIN_COUNT})")


def _amp(t="text"):
    ex = f"(length(coalesce({t}, '')) - length(replace(coalesce({t}, ''), '!', '')))"
    qm = f"(length(coalesce({t}, '')) - length(replace(coalesce({t}, ''), '?', '')))"
    return (f"(least({ex}, 4) * {K.EXCLAMATION_STEP} + CASE WHEN {qm} > 3 THEN {K.QUESTION_MAX} "
            f"WHEN {qm} > 1 THEN {qm} * {K.QUESTION_STEP} ELSE 0.0e0 END)")


NT = "n't"     # ends contracted negations


def _in(xs):
    return "(" + ", ".join(D.lit(x) for x in xs) + ")"


STEPS = " + ".join(
    f"coalesce(CASE WHEN p{i} IN {_in(K.BOOSTERS_UP)} THEN {K.BOOST_INCREMENT} "
    f"WHEN p{i} IN {_in(K.BOOSTERS_DOWN)} OR coalesce((p{i + 1} || ' ' || p{i}) IN {_in(K.BOOSTERS_DOWN)}, false) THEN {K.BOOST_DECREMENT} END "
    f"+ CASE WHEN c{i} THEN {K.CAPS_INCREMENT} ELSE 0.0e0 END, 0.0e0) * {damp}" for i, damp in zip((1, 2, 3), K.DISTANCE_DAMPING))


def _valences_sql() -> list[str]:
    """val: every raw word's valence in context, by list indexing."""
    def before(name, i, none):
        return f"CASE WHEN pos >= {i} THEN {name}[pos - {i - 1}] ELSE {none} END"
    caps = "(regexp_matches(x, '\\p{Lu}') AND NOT regexp_matches(x, '\\p{Ll}'))"
    lists = (f"wl0 AS (SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS l, list_transform(w, lambda x: {caps}) AS c "
             f"FROM (SELECT doc_id, {TX.raw_words_sql(D, 'text')} AS w FROM sreviews))")
    mixed = "(list_contains(c, true) AND list_contains(c, false))"
    at = (f"wat AS (SELECT doc_id, unnest(range(len(w))) AS pos, w, l, c, {mixed} AS mixed, list_position(l, '{K.CONTRAST_WORD}') - 1 AS fb FROM wl0)")
    each = ("wctx AS (SELECT doc_id, pos, w[pos + 1] AS word, l[pos + 1] AS low, mixed AND c[pos + 1] AS caps, fb, "
            + ", ".join(f"{before('l', i, 'NULL')} AS p{i}" for i in (1, 2, 3, 4)) + ", "
            + ", ".join(f"mixed AND {before('c', i, 'false')} AS c{i}" for i in (1, 2, 3)) + " FROM wat)")
    wstem = f"wstem AS ({stem_table('SELECT DISTINCT low AS w FROM wctx')})"
    v0 = "wv AS (SELECT r.*, coalesce(x.valence, 0.0e0) AS v0, sign(coalesce(x.valence, 0.0e0)) AS sg FROM wctx r JOIN wstem s ON r.low = s.o LEFT JOIN lexicon x ON s.stem = x.token)"
    negs = " + ".join(f"coalesce(CAST((p{i} IN {_in(K.NEGATIONS)} OR contains(p{i}, {D.lit(NT)})) AS INTEGER), 0)" for i in (1, 2, 3))
    v = (f"(v0 + sg * CASE WHEN caps THEN {K.CAPS_INCREMENT} ELSE 0.0e0 END + sg * ({STEPS})) * pow({K.NEGATION_SCALAR}, {negs}) "
         f"* CASE WHEN fb < 0 THEN 1.0e0 WHEN pos < fb THEN {K.BUT_BEFORE} WHEN pos > fb THEN {K.BUT_AFTER} ELSE 1.0e0 END")
    return [lists, at, each, wstem, v0, f"val AS (SELECT doc_id, pos, word, round({v}, 6) AS valence FROM wv)"]


VAL = _valences_sql()
VSUM = ("vsum AS (SELECT r.doc_id, r.label, r.split, r.text, s.vs, s.ps, s.ns, s.nu, coalesce(s.n, 0) AS n, "
        f"{_amp('r.text')} AS amp FROM sreviews r LEFT JOIN (SELECT doc_id, sum(valence) AS vs, "
        "sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0.0e0 END) AS ps, "
        "sum(CASE WHEN valence < 0 THEN valence - 1 ELSE 0.0e0 END) AS ns, "
        "count(*) FILTER (WHERE valence = 0) AS nu, count(*) AS n FROM val GROUP BY doc_id) s "
        "ON r.doc_id = s.doc_id)")
VADJ = ("vadj AS (SELECT *, CASE WHEN vs > 0 THEN vs + amp WHEN vs < 0 THEN vs - amp ELSE vs END AS s2, "
        "CASE WHEN ps > -ns THEN ps + amp ELSE ps END AS p2, CASE WHEN ps < -ns THEN ns - amp ELSE ns END AS n2 FROM vsum)")
VADER = ("vader AS (SELECT doc_id, label, split, text, "
         "CASE WHEN n > 0 THEN round(abs(n2 / (p2 - n2 + nu)), 3) ELSE 0.0e0 END AS neg, "
         "CASE WHEN n > 0 THEN round(abs(nu / (p2 - n2 + nu)), 3) ELSE 0.0e0 END AS neu, "
         "CASE WHEN n > 0 THEN round(abs(p2 / (p2 - n2 + nu)), 3) ELSE 0.0e0 END AS pos, "
         f"CASE WHEN n > 0 THEN round(s2 / sqrt(s2 * s2 + {K.VALENCE_ALPHA}), 4) ELSE 0.0e0 END AS compound FROM vadj)")
ROBERTA = ("roberta AS (SELECT doc_id, label, "
           "exp(-score - greatest(-score, 0.0e0, score)) / (exp(-score - greatest(-score, 0.0e0, score)) + exp(0.0e0 - greatest(-score, 0.0e0, score)) + exp(score - greatest(-score, 0.0e0, score))) AS roberta_neg, "
           "exp(0.0e0 - greatest(-score, 0.0e0, score)) / (exp(-score - greatest(-score, 0.0e0, score)) + exp(0.0e0 - greatest(-score, 0.0e0, score)) + exp(score - greatest(-score, 0.0e0, score))) AS roberta_neu, "
           "exp(score - greatest(-score, 0.0e0, score)) / (exp(-score - greatest(-score, 0.0e0, score)) + exp(0.0e0 - greatest(-score, 0.0e0, score)) + exp(score - greatest(-score, 0.0e0, score))) AS roberta_pos "
           "FROM scores)")
LEX = NB + [LEXICON, *VAL, VSUM, VADJ, VADER]


@sql("induce_lexicon")
def _():
    return with_(*TOKBASE, NB_FREQS, NB_MODEL, LEXICON) + "SELECT token, valence FROM lexicon"


@sql("lexicon_score")
def _():
    return with_(*LEX) + "SELECT doc_id, label, neg, neu, pos, compound FROM vader"


@sql("lexicon_predict")
def _():
    return with_(*LEX) + "SELECT doc_id, label, compound, CAST(compound > 0 AS INTEGER) AS prediction FROM vader"


@sql("lexicon_context")
def _():
    return with_(*TOKBASE, NB_FREQS, NB_MODEL, LEXICON, *VAL) + (
        "SELECT doc_id, pos::INTEGER AS pos, word, valence FROM val WHERE valence <> 0")


def _phrases_sql() -> list[str]:
    """phrases: idioms and induced sequences; uval: units in context, matches by a recursive walk."""
    lengths = ", ".join(f"({n})" for n in K.PHRASE_WORDS)
    idioms = ", ".join(f"({D.lit(p)}, {v}::DOUBLE)" for p, v in K.IDIOMS.items())
    grams = (f"grams AS (SELECT a.doc_id, a.pos, t.n, array_to_string(a.l[a.pos + 1:a.pos + t.n], ' ') AS phrase "
             f"FROM wat a, (VALUES {lengths}) t(n) WHERE a.pos + t.n <= len(a.l))")
    counts = ("gcount AS (SELECT g.n, g.phrase, count(*) FILTER (WHERE r.label = 1) AS n_pos, count(*) FILTER (WHERE r.label = 0) AS n_neg "
              "FROM grams g JOIN sreviews r ON g.doc_id = r.doc_id WHERE r.split = 'train' AND r.label IN (0, 1) GROUP BY g.n, g.phrase)")
    total = "gtotal AS (SELECT n, sum(n_pos) AS t_pos, sum(n_neg) AS t_neg, count(*) AS kinds FROM gcount GROUP BY n)"
    odds = "ln((n_pos + 1.0e0) / (t_pos + kinds)) - ln((n_neg + 1.0e0) / (t_neg + kinds))"
    phrases = (f"phrases AS (SELECT phrase, round(greatest(-4.0e0, least(4.0e0, {odds})), 3) AS valence FROM gcount JOIN gtotal USING (n) "
               f"WHERE n_pos + n_neg >= {K.LEXICON_MIN_COUNT} AND phrase NOT IN {_in(K.IDIOMS)} UNION ALL SELECT * FROM (VALUES {idioms}) i(phrase, valence))")
    at = "gat AS MATERIALIZED (SELECT doc_id, pos, max(n) AS n, arg_max(valence, n) AS valence FROM grams JOIN phrases USING (phrase) GROUP BY doc_id, pos)"
    step = "gstep AS MATERIALIZED (SELECT a.doc_id, a.pos, b.pos AS nxt FROM (SELECT *, pos + n AS e FROM gat) a ASOF JOIN gat b ON a.doc_id = b.doc_id AND a.e <= b.pos)"
    walk = ("walk AS (SELECT doc_id, min(pos) AS pos FROM gat GROUP BY doc_id UNION ALL "
            "SELECT s.doc_id, s.nxt FROM walk w JOIN gstep s ON w.doc_id = s.doc_id AND w.pos = s.pos)")
    spans = "spans AS (SELECT g.* FROM gat g JOIN walk w ON g.doc_id = w.doc_id AND g.pos = w.pos)"
    inside = "inside AS (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM spans)"
    known = "known AS (SELECT DISTINCT s.o AS low FROM wstem s JOIN lexicon x ON s.stem = x.token)"
    units = ("units AS (SELECT v.*, 1 AS n FROM wv v ANTI JOIN inside i ON v.doc_id = i.doc_id AND v.pos = i.pos UNION ALL BY NAME "
             "SELECT v.* EXCLUDE (v0, sg, word), s.valence AS v0, 0.0e0 AS sg, s.n, array_to_string(a.l[a.pos + 1:a.pos + s.n], ' ') AS word "
             "FROM wv v JOIN spans s ON v.doc_id = s.doc_id AND v.pos = s.pos JOIN wat a ON a.doc_id = s.doc_id AND a.pos = s.pos)")
    first = (f"CASE WHEN u.n = 1 AND u.low = 'no' AND k.low IS NOT NULL THEN 0.0e0 ELSE u.v0 END * CASE WHEN coalesce(p1 = 'no', false) "
             f"OR coalesce(p2 = 'no', false) OR coalesce(p3 = 'no' AND p1 IN ('or', 'nor'), false) THEN {K.NEGATION_SCALAR} ELSE 1.0e0 END")
    base = (f"ubase AS (SELECT u.* EXCLUDE (v0, sg), {first} AS v0 FROM units u JOIN wat a ON u.doc_id = a.doc_id AND u.pos = a.pos "
            "LEFT JOIN known k ON k.low = a.l[a.pos + 2])")
    signed = "usign AS (SELECT *, sign(v0) AS sg FROM ubase)"
    neg = {i: f"coalesce(p{i} IN {_in(K.NEGATIONS)} OR contains(p{i}, {D.lit(NT)}), false)" for i in (1, 2, 3)}
    so = {i: f"coalesce(p{i} IN ('so', 'this'), false)" for i in (1, 2)}
    turn = K.NEGATION_SCALAR
    factor = (f"CASE WHEN {neg[1]} THEN {turn} ELSE 1.0e0 END "
              f"* CASE WHEN coalesce(p2 = 'never', false) AND {so[1]} THEN {K.NEVER_SO} WHEN {neg[2]} THEN {turn} ELSE 1.0e0 END "
              f"* CASE WHEN coalesce(p3 = 'never', false) AND ({so[1]} OR {so[2]}) THEN {K.NEVER_SO_FAR} WHEN {neg[3]} THEN {turn} ELSE 1.0e0 END "
              f"* CASE WHEN coalesce(p1 = 'least', false) AND NOT coalesce(p2 IN {_in(K.LEAST_AFTER)}, false) THEN {turn} ELSE 1.0e0 END")
    v = (f"(v0 + sg * CASE WHEN caps THEN {K.CAPS_INCREMENT} ELSE 0.0e0 END + sg * ({STEPS})) * {factor} "
         f"* CASE WHEN fb < 0 THEN 1.0e0 WHEN pos < fb THEN {K.BUT_BEFORE} WHEN pos > fb THEN {K.BUT_AFTER} ELSE 1.0e0 END")
    return [grams, counts, total, phrases, at, step, walk, spans, inside, known, units, base, signed,
            f"uval AS (SELECT doc_id, pos, word, n, round({v}, 6) AS valence FROM usign)"]


PHRASES = [*TOKBASE, NB_FREQS, NB_MODEL, LEXICON, *VAL, *_phrases_sql()]


def with_recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@sql("induce_phrases")
def _():
    return with_recursive(*PHRASES) + "SELECT phrase, valence FROM phrases"


@sql("lexicon_phrases")
def _():
    return with_recursive(*PHRASES) + "SELECT doc_id, pos::INTEGER AS pos, word, n::INTEGER AS n, valence FROM uval WHERE valence <> 0"


@sql("lexicon_phrase_score")
def _():
    return with_recursive(*PHRASES, VSUM.replace("FROM val ", "FROM uval "), VADJ, VADER) + "SELECT doc_id, label, neg, neu, pos, compound FROM vader"


@sql("prefix_columns")
def _():
    return with_(*LEX) + ("SELECT doc_id, neg AS vader_neg, neu AS vader_neu, pos AS vader_pos, "
                          "compound AS vader_compound FROM vader")


def _mean_ci(metrics):
    """Means of columns of vader by label with Poisson bootstrap intervals, weights from md5."""
    weight = " + ".join(f"(x >= {t})::INT" for t in POISSON_16)
    long = " UNION ALL ".join(f"SELECT doc_id, label, '{m}' AS metric, {m} AS value FROM vader" for m in metrics)
    return [f"long AS ({long})",
            "draw AS (SELECT doc_id, r, ('0x' || substr(md5(concat('boot:', doc_id, ':', r // 8)), 4 * (r % 8) + 1, 4))::BIGINT AS x FROM (SELECT DISTINCT doc_id FROM vader), range(1000) t(r))",
            f"weight AS (SELECT doc_id, r, {weight} AS w FROM draw)",
            "replicate AS (SELECT label, metric, r, sum(w * value) / nullif(sum(w), 0) AS mean FROM long JOIN weight USING (doc_id) GROUP BY label, metric, r)",
            "ci AS (SELECT label, metric, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM replicate GROUP BY label, metric)",
            "mean_ci AS (SELECT l.label, l.metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value)::BIGINT AS n, "
            "round(any_value(c.lo), 6) AS ci_low, round(any_value(c.hi), 6) AS ci_high FROM long l JOIN ci c ON l.label = c.label AND l.metric = c.metric GROUP BY l.label, l.metric)"]


@sql("score_mean_by_label")
def _():
    return with_(*LEX, *_mean_ci(["compound"])) + "SELECT label, mean, std, n, ci_low, ci_high FROM mean_ci"


@sql("subscore_mean_by_label")
def _():
    return with_(*LEX, *_mean_ci(["pos", "neu", "neg"])) + "SELECT * FROM mean_ci"


@sql("score_density")
def _():
    cols = [f"{a}_{b}" for a in ("vader", "roberta") for b in ("neg", "neu", "pos")]
    src = ("SELECT v.label, v.neg AS vader_neg, v.neu AS vader_neu, v.pos AS vader_pos, r.roberta_neg, r.roberta_neu, "
           "r.roberta_pos FROM vader v JOIN roberta r ON v.doc_id = r.doc_id")
    long = " UNION ALL ".join(f"SELECT label, '{c}' AS metric, {c} AS value FROM dsrc" for c in cols)
    return with_(*LEX, ROBERTA, f"dsrc AS ({src})", f"dlong AS ({long})",
                 "dstat AS (SELECT label, metric, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS width, min(value) AS lo, max(value) AS hi FROM dlong "
                 "GROUP BY label, metric HAVING stddev_samp(value) > 0.0001)",
                 f"dgrid AS (SELECT *, lo - {CUT} * width AS start, (hi - lo + {2 * CUT} * width) / {GRID - 1} AS step FROM dstat)",
                 "dplace AS (SELECT g.label, g.metric, (l.value - g.start) / g.step AS p FROM dlong l JOIN dgrid g ON l.label = g.label AND l.metric = g.metric)",
                 "dmass AS (SELECT label, metric, point, sum(w) AS w FROM (SELECT label, metric, floor(p) AS point, floor(p) + 1 - p AS w FROM dplace "
                 "UNION ALL SELECT label, metric, floor(p) + 1, p - floor(p) FROM dplace) GROUP BY label, metric, point)") + (
        "SELECT g.label, g.metric, t.i::INTEGER AS point, round(g.start + t.i * g.step, 6) AS x, "
        "round(sum(m.w * exp(-0.5 * pow((t.i - m.point) * g.step / g.width, 2))) / (g.n * g.width * sqrt(2 * pi())), 4) AS density "
        f"FROM dgrid g JOIN dmass m ON g.label = m.label AND g.metric = m.metric, range({GRID}) t(i) GROUP BY g.label, g.metric, g.n, g.width, g.start, g.step, t.i")


@sql("score_pair_grid")
def _():
    cols = ["vader_neg", "vader_neu", "vader_pos", "roberta_neg", "roberta_neu", "roberta_pos"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    src = ("(SELECT v.label, v.neg AS vader_neg, v.neu AS vader_neu, v.pos AS vader_pos, r.roberta_neg, r.roberta_neu, "
           "r.roberta_pos FROM vader v JOIN roberta r ON v.doc_id = r.doc_id)")
    corrs = " UNION ALL ".join(f"SELECT label, '{a}' AS var_x, '{b}' AS var_y, round(corr({a}, {b}), 6) AS corr FROM pgsrc GROUP BY label"
                               for a, b in pairs)

    def cell(c):
        return f"least(floor({c} * 10), 9)::INTEGER"
    cells_ = " UNION ALL ".join(
        f"SELECT label, '{a}' AS var_x, '{b}' AS var_y, {cell(a)} AS bin_x, {cell(b)} AS bin_y, count(*)::BIGINT AS n FROM pgsrc GROUP BY ALL"
        for i, a in enumerate(cols) for b in cols[i:])
    return with_(*LEX, ROBERTA, f"pgsrc AS (SELECT * FROM {src})", f"pgcorr AS ({corrs})", f"pgcell AS ({cells_})") + (
        "SELECT c.label, c.var_x, c.var_y, c.bin_x, c.bin_y, c.n, r.corr FROM pgcell c LEFT JOIN pgcorr r "
        "ON c.label = r.label AND c.var_x = r.var_x AND c.var_y = r.var_y")


@sql("join_scores_left")
def _():
    return with_(*LEX) + ("SELECT v.doc_id, v.compound, r.label, r.split FROM vader v LEFT JOIN sreviews r "
                          "ON v.doc_id = r.doc_id")


@sql("join_scores_right")
def _():
    return with_(*LEX) + ("SELECT r.doc_id, v.compound, r.label FROM vader v RIGHT JOIN "
                          "(SELECT doc_id, label FROM sreviews WHERE split = 'test') r ON v.doc_id = r.doc_id")


@sql("combine_two_scorers")
def _():
    return with_(*LEX, ROBERTA) + (
        "SELECT v.doc_id, v.neg AS vader_neg, v.neu AS vader_neu, v.pos AS vader_pos, v.compound AS vader_compound, "
        "round(r.roberta_neg, 6) AS roberta_neg, round(r.roberta_neu, 6) AS roberta_neu, round(r.roberta_pos, 6) AS roberta_pos "
        "FROM vader v JOIN roberta r ON v.doc_id = r.doc_id")


@sql("most_confident_wrong")
def _():
    bothsc = ("bothsc AS (SELECT v.doc_id, v.label, v.text, v.pos AS vader_pos, v.neg AS vader_neg, r.roberta_pos, r.roberta_neg "
            "FROM vader v JOIN roberta r ON v.doc_id = r.doc_id)")
    forms = [("vader_pos_label0", "vader_pos", 0), ("roberta_pos_label0", "roberta_pos", 0),
             ("vader_neg_label1", "vader_neg", 1), ("roberta_neg_label1", "roberta_neg", 1)]
    parts = [f"(SELECT '{n}' AS form, doc_id, round({c}, 6) AS score, text FROM bothsc WHERE label = {lab} "
             f"ORDER BY {c} DESC, doc_id LIMIT 1)" for n, c, lab in forms]
    return with_(*LEX, ROBERTA, bothsc) + " UNION ALL ".join(parts)


@sql("truncate_input")
def _():
    return with_(*TOKBASE) + (
        "SELECT r.doc_id, coalesce(t.n, 0)::BIGINT AS n_tokens, coalesce(t.s, '') AS input_text FROM sreviews r LEFT JOIN "
        f"(SELECT doc_id, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS s FROM tok WHERE pos < {K.TRUNCATE_TOKENS} "
        "GROUP BY doc_id) t ON r.doc_id = t.doc_id")


@sql("softmax_scores")
def _():
    return with_(*NB, ROBERTA) + ("SELECT doc_id, round(roberta_neg, 6) AS roberta_neg, round(roberta_neu, 6) AS roberta_neu, "
                                  "round(roberta_pos, 6) AS roberta_pos FROM roberta")


@sql("log_odds_compound")
def _():
    return with_(*NB) + "SELECT doc_id, round(score - (-score), 6) AS roberta_compound FROM scores"


@sql("argmax_class")
def _():
    return with_(*NB) + ("SELECT doc_id, (CASE WHEN -score >= greatest(0.0e0, score) THEN 0 WHEN 0.0e0 >= score THEN 1 "
                         "ELSE 2 END)::INTEGER AS predicted_class FROM scores")


BATCH = NB + [
    f"bw AS (SELECT raw, count(*) AS n FROM rawtok WHERE split = 'train' GROUP BY raw ORDER BY n DESC, raw LIMIT {K.BATCH_WORDS})",
    "bweights AS (SELECT b.raw AS word, m.loglikelihood AS w FROM bw b JOIN stems s ON b.raw = s.o JOIN model m ON s.stem = m.token)",
    f"bwords AS (SELECT doc_id, label, regexp_extract_all(lower(coalesce(text, '')), {D.lit(TX.WORD_PATTERN)})[1:{K.TRUNCATE_TOKENS}] AS l FROM reviews)",
    "bsum AS (SELECT t.doc_id, sum(x.w) AS w FROM (SELECT doc_id, unnest(l) AS word FROM bwords) t JOIN bweights x ON t.word = x.word GROUP BY t.doc_id)",
    f"bs AS (SELECT r.doc_id, r.label, {K.BATCH_SCALE} * coalesce(b.w, 0.0e0) / sqrt(greatest(len(r.l), 1)) AS s FROM bwords r LEFT JOIN bsum b ON r.doc_id = b.doc_id)",
    "bz AS (SELECT doc_id, label, s, exp(-s - abs(s)) AS en, exp(-abs(s)) AS eu, exp(s - abs(s)) AS ep FROM bs)",
    "batch AS (SELECT doc_id, label, en / (en + eu + ep) AS neg, eu / (en + eu + ep) AS neu, ep / (en + eu + ep) AS pos, 2 * s AS compound FROM bz)"]
BATCH_COLUMNS = ", ".join(f"round({k}, 6) AS roberta_{k}" for k in ("neg", "neu", "pos", "compound"))


@sql("batch_score")
def _():
    return with_(*BATCH) + f"SELECT doc_id, label, {BATCH_COLUMNS} FROM batch"


@sql("batch_score_safe")
def _():
    return with_(*BATCH) + f"SELECT doc_id, {BATCH_COLUMNS}, CAST(NULL AS VARCHAR) AS error FROM batch"


@sql("pipeline_label")
def _():
    return with_(*BATCH) + ("SELECT doc_id, label, CASE WHEN pos / (pos + neg) > 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict, "
                            "round(greatest(pos / (pos + neg), 1 - pos / (pos + neg)), 6) AS confidence FROM batch")


def _board_sql():
    def ev(name, src, pred):
        return (f"SELECT '{name}' AS model, round({ratio(f'count(*) FILTER (WHERE label = {pred})', 'count(*)')}, 6) AS accuracy, "
                f"round({ratio(f'2 * count(*) FILTER (WHERE label = 1 AND {pred} = 1)', f'count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE {pred} = 1)')}, 6) AS f1_score FROM {src}")
    return ("board AS (" + " UNION ALL ".join([
        ev("naive_bayes", "scores", "prediction"),
        ev("lexicon", "(SELECT * FROM vader WHERE split = 'test')", "CAST(compound > 0 AS INTEGER)"),
        ev("log_odds", "roberta", "CAST(roberta_pos > roberta_neg AS INTEGER)"),
        ev("multinomial_nb", "(SELECT *, CAST(score > 0 AS INTEGER) AS prediction FROM t1_mscores)", "prediction"),
        ev("multinomial_nb_grid", "t2_best", "prediction"), ev("multinomial_nb_logspace", "t3_best", "prediction")]) + ")")


def _board_ctes() -> list[str]:
    return [*LEX, ROBERTA, FOLDS, MTF, *_named("t1", _mnb_sql(TEST_DOCS, [1.0], K.TFIDF_MAX_FEATURES)),
            *_refit_sql("t2", K.MNB_ALPHA_GRID), *_refit_sql("t3", _log_alphas()), _board_sql()]


# ---------------------------------------------------------------- 2.11 retrieval
def _chunks_sql(src: str, name: str = "chunks", carry: str = "") -> str:
    n = f"CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - {K.CHUNK_OVERLAP}) / {K.CHUNK_SIZE - K.CHUNK_OVERLAP}))::INTEGER END"
    stride = K.CHUNK_SIZE - K.CHUNK_OVERLAP
    cc = f"{carry}, " if carry else ""
    return (f"{name} AS (SELECT doc_id, {cc}chunk_no::INTEGER AS chunk_no, (chunk_no * {stride})::INTEGER AS start, "
            f"substring(text, chunk_no * {stride} + 1, {K.CHUNK_SIZE}) AS text FROM "
            f"(SELECT doc_id, {cc}text, unnest(range({n})) AS chunk_no FROM {src}))")


def _embed_sql(src: str, key_cols: str, name: str = "emb", dims: int = K.EMBED_DIMS) -> list[str]:
    """(key_cols..., embedding) for every row of src (text column 'text')."""
    k = [x.strip() for x in key_cols.split(",")]
    on = " AND ".join(f"e.{x} = s.{x}" for x in k)
    ks = ", ".join(f"s.{x}" for x in k)
    return [
        f"{name}_w AS (SELECT {key_cols}, unnest(regexp_extract_all(lower(coalesce(text, '')), {D.lit(TX.WORD_PATTERN)})) AS w FROM {src})",
        f"{name}_c AS (SELECT {key_cols}, ({D.hex8('w')} % {dims})::INTEGER AS b, "
        f"sum(CASE WHEN {D.hex8(chr(39) + 's:' + chr(39) + ' || w')} % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v "
        f"FROM {name}_w GROUP BY ALL)",
        f"{name}_n AS (SELECT {key_cols}, sqrt(sum(v * v)) AS n FROM {name}_c GROUP BY ALL)",
        f"{name} AS (SELECT {ks}, list(coalesce(e.v, 0.0e0) / CASE WHEN nn.n > 0 THEN nn.n ELSE 1.0e0 END ORDER BY g.b) AS embedding "
        f"FROM {src} s CROSS JOIN (SELECT unnest(range({dims}))::INTEGER AS b) g "
        f"LEFT JOIN {name}_c e ON {on} AND e.b = g.b "
        f"LEFT JOIN {name}_n nn ON {on.replace('e.', 'nn.')} GROUP BY {ks})",
    ]


def _cos(a, b):
    return (f"CASE WHEN list_inner_product({a}, {a}) > 0 AND list_inner_product({b}, {b}) > 0 THEN "
            f"list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})) ELSE 0.0e0 END")


RCHUNKS = _chunks_sql("reviews", "rchunks", "label")


@sql("chunk_documents")
def _():
    return with_(_chunks_sql("documents")) + "SELECT doc_id, chunk_no, start, text FROM chunks"


@sql("embed_chunks")
def _():
    return with_(REVIEWS, RCHUNKS, *_embed_sql("rchunks", "doc_id, chunk_no")) + (
        "SELECT doc_id, chunk_no, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM emb")


@sql("write_vector_table")
def _():
    return with_(REVIEWS, RCHUNKS) + (
        f"SELECT doc_id, chunk_no, ({D.hex8('CAST(doc_id AS VARCHAR)')} % 8)::INTEGER AS bucket, "
        f"{K.EMBED_DIMS}::BIGINT AS dims FROM rchunks")


@sql("upsert_vector_store")
def _():
    return with_(REVIEWS, RCHUNKS, SREVIEWS) + (
        "SELECT r.doc_id, r.chunk_no, (CASE s.split WHEN 'train' THEN 1 ELSE 2 END)::BIGINT AS version, sha256(r.text) AS content "
        "FROM rchunks r JOIN sreviews s ON r.doc_id = s.doc_id")


EMB = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@sql("retrieve_top_k")
def _():
    return (f"SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id, "
            f"{_cos('q.v', 'c.v')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos('q.v', 'c.v')} DESC, "
            f"c.vec_id) AS rank FROM (SELECT * FROM {EMB} WHERE vec_id % 20 = 0) q JOIN {EMB} c ON q.vec_id <> c.vec_id) WHERE rank <= {K.TOP_K}")


def _index_sql() -> list[str]:
    """cellof: every vector's distance rank to the labels' normalised mean vectors."""
    return [
        f"uvec AS (SELECT vec_id, label, CASE WHEN list_inner_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END AS u FROM {EMB})",
        "cmean AS (SELECT label AS cell, i, avg(x) AS x FROM (SELECT label, unnest(range(len(u))) AS i, unnest(u) AS x FROM uvec WHERE label IS NOT NULL) GROUP BY ALL)",
        "cvec AS (SELECT cell, list(x ORDER BY i) AS m FROM cmean GROUP BY cell)",
        "cent AS (SELECT cell, CASE WHEN list_inner_product(m, m) > 0 THEN list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) ELSE m END AS m FROM cvec)",
        "cellof AS (SELECT vec_id, u, cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(u, m) DESC, cell) AS r FROM uvec CROSS JOIN cent)",
    ]


@sql("build_vector_index")
def _():
    return with_(*_index_sql()) + "SELECT vec_id, cell::INTEGER AS cell, len(u)::BIGINT AS dims FROM cellof WHERE r = 1"


@sql("retrieve_top_k_approx")
def _():
    from ..operators.retrieval import PROBES
    near = (f"near AS (SELECT q.vec_id AS query_id, c.vec_id, {_cos('q.u', 'c.u')} AS score FROM cellof q JOIN cellof c "
            f"ON q.cell = c.cell AND c.r = 1 AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.r <= {PROBES})")
    few = (f"few AS (SELECT vec_id FROM uvec WHERE vec_id % 20 = 0 AND vec_id NOT IN "
           f"(SELECT query_id FROM near GROUP BY query_id HAVING count(*) >= {K.TOP_K}))")
    cand = (f"cand AS (SELECT * FROM near WHERE query_id NOT IN (SELECT vec_id FROM few) UNION ALL SELECT q.vec_id, c.vec_id, {_cos('q.u', 'c.u')} "
            f"FROM uvec q JOIN uvec c ON q.vec_id <> c.vec_id WHERE q.vec_id IN (SELECT vec_id FROM few))")
    return with_(*_index_sql(), near, few, cand) + (
        f"SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cand) WHERE rank <= {K.TOP_K}")


HISTORY = ("hist AS (SELECT conv_id, turn, role, text, coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) "
           "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history, "
           "(count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS n_prev "
           "FROM conversations)")


@sql("stream_history")
@sql("chat_history")
def _():
    return with_(HISTORY) + "SELECT conv_id, turn, history, n_prev FROM hist"


def _prompt_sql(ctx_col, hist_col, q_col):
    from ..operators.retrieval import PROMPT_TEMPLATE
    head, rest = PROMPT_TEMPLATE.split("{context}")
    mid1, rest = rest.split("{history}")
    mid2, tail = rest.split("{question}")
    return f"{D.lit(head)} || {ctx_col} || {D.lit(mid1)} || {hist_col} || {D.lit(mid2)} || {q_col} || {D.lit(tail)}"


def _rag_sql(questions_cte: str, q_key: str, out_cols: str) -> str:
    from ..operators.retrieval import CONTEXT_SEPARATOR
    hits = (f"hits AS (SELECT * FROM (SELECT q.{q_key} AS qk, c.doc_id, c.chunk_no, c.text, row_number() OVER "
            f"(PARTITION BY q.{q_key} ORDER BY {_cos('q.embedding', 'c.embedding')} DESC, c.doc_id, c.chunk_no) AS rank "
            f"FROM qemb q CROSS JOIN (SELECT e.doc_id, e.chunk_no, e.embedding, r.text FROM emb e JOIN rchunks r "
            f"ON e.doc_id = r.doc_id AND e.chunk_no = r.chunk_no) c) WHERE rank <= {K.TOP_K})")
    ctxs = (f"ctxs AS (SELECT qk, string_agg(text, {D.lit(CONTEXT_SEPARATOR)} ORDER BY rank) AS context "
            f"FROM hits GROUP BY qk)")
    return with_(REVIEWS, RCHUNKS, *_embed_sql("rchunks", "doc_id, chunk_no"), HISTORY, questions_cte,
                 *_embed_sql("qs", q_key, "qemb"), hits, ctxs) + (
        f"SELECT {out_cols}, {_prompt_sql('coalesce(x.context, ' + chr(39) * 2 + ')', 'coalesce(qs.history, ' + chr(39) * 2 + ')', 'qs.question')} AS prompt "
        f"FROM qs LEFT JOIN ctxs x ON qs.{q_key} = x.qk")


@sql("assemble_prompts")
def _():
    qs = ("qs AS (SELECT conv_id || ':' || turn AS query_id, conv_id, turn, text AS question, text, history "
          "FROM hist WHERE role = 'user')")
    return _rag_sql(qs, "query_id", "qs.conv_id, qs.turn")


@sql("batch_ask")
def _():
    qs = "qs AS (SELECT item_id, text AS question, text, '' AS history FROM benchmark)"
    return _rag_sql(qs, "item_id", "qs.item_id")


# ---------------------------------------------------------------- features
MTF = "mtf AS (SELECT doc_id, token AS term, count(*)::DOUBLE AS tf FROM tok WHERE length(token) >= 2 GROUP BY ALL)"


def _tfidf_sql(k):
    vocab = ("SELECT term, count(*) AS df, sum(tf) AS cf FROM mtf t JOIN sreviews r ON t.doc_id = r.doc_id "
             "WHERE r.split = 'train' GROUP BY term")
    if k:
        vocab = f"SELECT * FROM ({vocab}) ORDER BY cf DESC, term LIMIT {k}"
    return with_(*TOKBASE, MTF, f"voc AS ({vocab})",
                 "idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM voc, "
                 "(SELECT count(*) AS n FROM sreviews WHERE split = 'train') nn)") + (
        "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM "
        "(SELECT t.doc_id, t.term, t.tf * i.idf AS w FROM mtf t JOIN idf i ON t.term = i.term)")


@sql("tfidf_top_k")
def _():
    return _tfidf_sql(K.TFIDF_MAX_FEATURES)


@sql("tfidf_full")
def _():
    return _tfidf_sql(None)


@sql("standard_scale")
def _():
    feats = ("feats AS (SELECT r.doc_id, r.split, coalesce(s.p, 0)::DOUBLE AS tlc_pos, coalesce(s.n, 0)::DOUBLE AS tlc_neg "
             "FROM sreviews r LEFT JOIN (SELECT t.doc_id, sum(f.n_pos) AS p, sum(f.n_neg) AS n FROM tok t JOIN freqs f "
             "ON t.token = f.token GROUP BY t.doc_id) s ON r.doc_id = s.doc_id)")
    st = ("st AS (SELECT avg(tlc_pos) AS mp, stddev_pop(tlc_pos) AS sp, avg(tlc_neg) AS mn, stddev_pop(tlc_neg) AS sn "
          "FROM feats WHERE split = 'train')")
    return with_(*TOKBASE, NB_FREQS, feats, st) + (
        "SELECT doc_id, split, round(CASE WHEN sp > 0 THEN (tlc_pos - mp) / sp ELSE 0.0e0 END, 6) AS z_tlc_pos, "
        "round(CASE WHEN sn > 0 THEN (tlc_neg - mn) / sn ELSE 0.0e0 END, 6) AS z_tlc_neg FROM feats, st")


@sql("select_features_chi2")
def _():
    dt = ("dt AS (SELECT DISTINCT doc_id, label, token AS term FROM tok WHERE split = 'train' AND length(token) >= 2)")
    tot = "tot AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 1)::DOUBLE AS n1 FROM sreviews WHERE split = 'train')"
    per = ("per AS (SELECT term, count(*) FILTER (WHERE label = 1)::DOUBLE AS a, count(*) FILTER (WHERE label = 0)::DOUBLE AS b "
           "FROM dt GROUP BY term)")
    chi = ("chi AS (SELECT term, round(CASE WHEN (a + b) * ((n1 - a) + (n - n1 - b)) * (a + (n1 - a)) * (b + (n - n1 - b)) > 0 "
           "THEN n * (a * (n - n1 - b) - b * (n1 - a)) * (a * (n - n1 - b) - b * (n1 - a)) / "
           "((a + b) * ((n1 - a) + (n - n1 - b)) * (a + (n1 - a)) * (b + (n - n1 - b))) ELSE 0.0e0 END, 9) AS chi2 FROM per, tot)")
    return with_(*TOKBASE, dt, tot, per, chi) + (
        f"SELECT term, round(chi2, 6) AS chi2, rank::INTEGER AS rank FROM (SELECT term, chi2, row_number() OVER "
        f"(ORDER BY chi2 DESC, term) AS rank FROM chi) WHERE rank <= 500")


def _mnb_sql(docs_cte: str, alphas, k) -> list[str]:
    alist = "[" + ", ".join(repr(float(a)) + "::DOUBLE" for a in alphas) + "]"
    stats = "mstats AS (SELECT g, term, count(*) AS df, sum(tf) AS cf FROM mrows WHERE role = 'fit' GROUP BY g, term)"
    if k:
        vocab = (f"mvocab AS (SELECT g, term, df, cf FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cf DESC, term) AS r "
                 f"FROM mstats) WHERE r <= {k})")
    else:
        vocab = "mvocab AS (SELECT g, term, df, cf FROM mstats)"
    return [
        docs_cte, MTF,
        "mrows AS (SELECT d.g, d.doc_id, d.label, d.role, t.term, t.tf FROM mdocs d JOIN mtf t ON d.doc_id = t.doc_id)",
        "nfit AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE label = 1) AS d1, count(*) FILTER (WHERE label = 0) AS d0 "
        "FROM mdocs WHERE role = 'fit' GROUP BY g)",
        stats, vocab,
        "midf AS (SELECT s.g, s.term, ln((n.n + 1) / (s.df + 1)) + 1 AS idf FROM mvocab s JOIN nfit n ON s.g = n.g)",
        "mw AS (SELECT r.g, r.doc_id, r.label, r.role, r.term, r.tf * i.idf AS w FROM mrows r JOIN midf i ON r.g = i.g AND r.term = i.term)",
        "mx AS (SELECT g, doc_id, label, role, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, doc_id)) AS x FROM mw)",
        "mfc AS (SELECT g, term, sum(CASE WHEN label = 1 THEN x ELSE 0.0e0 END) AS fc1, sum(CASE WHEN label = 0 THEN x ELSE 0.0e0 END) AS fc0 "
        "FROM mx WHERE role = 'fit' GROUP BY g, term)",
        "mtot AS (SELECT g, sum(fc1) AS t1, sum(fc0) AS t0, count(*) AS v FROM mfc GROUP BY g)",
        f"malpha AS (SELECT unnest({alist}) AS alpha)",
        "mdelta AS (SELECT f.g, f.term, a.alpha, ln((f.fc1 + a.alpha) / (t.t1 + a.alpha * t.v)) - ln((f.fc0 + a.alpha) / (t.t0 + a.alpha * t.v)) AS delta "
        "FROM mfc f JOIN mtot t ON f.g = t.g CROSS JOIN malpha a)",
        "msum AS (SELECT x.g, d.alpha, x.doc_id, sum(x.x * d.delta) AS s FROM mx x JOIN mdelta d ON x.g = d.g AND x.term = d.term "
        "WHERE x.role = 'val' GROUP BY ALL)",
        "mscores AS (SELECT d.g, a.alpha, d.doc_id, d.label, ln(n.d1) - ln(n.d0) + coalesce(s.s, 0.0e0) AS score FROM mdocs d "
        "JOIN nfit n ON d.g = n.g CROSS JOIN malpha a LEFT JOIN msum s ON s.g = d.g AND s.alpha = a.alpha AND s.doc_id = d.doc_id "
        "WHERE d.role = 'val')",
    ]


FOLDS = (f"folds AS (SELECT doc_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {D.hex8(chr(39) + 'fold' + str(K.SHUFFLE_SEED) + ':' + chr(39) + ' || CAST(doc_id AS VARCHAR)')}, doc_id) - 1) "
         f"% {K.N_FOLDS})::INTEGER AS fold FROM sreviews WHERE split = 'train')")
CV_DOCS = ("mdocs AS (SELECT g.g, f.doc_id, f.label, CASE WHEN g.g = f.fold THEN 'val' ELSE 'fit' END AS role FROM folds f "
           f"CROSS JOIN (SELECT unnest(range({K.N_FOLDS}))::INTEGER AS g) g)")


@sql("mnb_train_eval")
def _():
    docs = "mdocs AS (SELECT 0 AS g, doc_id, label, CASE WHEN split = 'train' THEN 'fit' ELSE 'val' END AS role FROM sreviews)"
    return with_(*TOKBASE, *_mnb_sql(docs, [1.0], K.TFIDF_MAX_FEATURES)) + (
        "SELECT doc_id, label, round(score, 6) AS score, CAST(score > 0 AS INTEGER) AS prediction FROM mscores")


TEST_DOCS = "mdocs AS (SELECT 0 AS g, doc_id, label, CASE WHEN split = 'train' THEN 'fit' ELSE 'val' END AS role FROM sreviews)"
MNB_NAMES = r"\b(mdocs|mrows|nfit|mstats|mvocab|midf|mw|mx|mfc|mtot|malpha|mdelta|msum|mscores|macc|mmean)\b"


def _named(prefix: str, ctes: list[str]) -> list[str]:
    """The same tables under names of their own, without the shared term counts."""
    return [re.sub(MNB_NAMES, prefix + r"_\1", c) for c in ctes if c != MTF]


def _log_alphas():
    from ..operators.selection import log_spaced
    return log_spaced(K.MNB_ALPHA_LOW, K.MNB_ALPHA_HIGH, K.MNB_LOG_DRAWS)


MEAN = ["macc AS (SELECT g, alpha, avg(CAST(label = CAST(score > 0 AS INTEGER) AS DOUBLE)) AS acc FROM mscores GROUP BY g, alpha)",
        "mmean AS (SELECT alpha, round(avg(acc), 9) AS mean_accuracy FROM macc GROUP BY alpha)"]


def _refit_sql(prefix: str, alphas) -> list[str]:
    """{prefix}_best: test scores of the best alpha of the search, fitted on all training rows."""
    return [*_named(prefix + "c", [*_mnb_sql(CV_DOCS, alphas, None), *MEAN]), *_named(prefix, _mnb_sql(TEST_DOCS, sorted(set(alphas)), None)),
            f"{prefix}_best AS (SELECT m.alpha, m.mean_accuracy, s.doc_id, s.label, CAST(s.score > 0 AS INTEGER) AS prediction FROM {prefix}_mscores s "
            f"JOIN (SELECT * FROM {prefix}c_mmean ORDER BY mean_accuracy DESC, alpha LIMIT 1) m ON s.alpha = m.alpha)"]


def _cv_sql(alphas):
    return with_(*TOKBASE, FOLDS, *_mnb_sql(CV_DOCS, alphas, None),
                 "macc AS (SELECT g, alpha, avg(CAST(label = CAST(score > 0 AS INTEGER) AS DOUBLE)) AS acc FROM mscores GROUP BY g, alpha)",
                 "mmean AS (SELECT alpha, round(avg(acc), 9) AS mean_accuracy FROM macc GROUP BY alpha)")


@sql("mnb_grid_search")
def _():
    return _cv_sql(K.MNB_ALPHA_GRID) + (
        "SELECT round(alpha, 6) AS alpha, round(mean_accuracy, 6) AS mean_accuracy, "
        "CAST(row_number() OVER (ORDER BY mean_accuracy DESC, alpha) = 1 AS INTEGER) AS best FROM mmean")


@sql("mnb_logspace_search")
def _():
    from ..operators.selection import log_spaced
    return _cv_sql(log_spaced(K.MNB_ALPHA_LOW, K.MNB_ALPHA_HIGH, K.MNB_LOG_DRAWS)) + (
        "SELECT round(alpha, 6) AS alpha, round(mean_accuracy, 6) AS mean_accuracy, "
        "CAST(row_number() OVER (ORDER BY mean_accuracy DESC, alpha) = 1 AS INTEGER) AS best FROM mmean")


@sql("best_candidate")
def _():
    return with_(*TOKBASE, FOLDS, MTF, *_refit_sql("t2", K.MNB_ALPHA_GRID)) + (
        "SELECT round(alpha, 6) AS alpha, round(mean_accuracy, 6) AS mean_accuracy, "
        "round(avg(CAST(label = prediction AS DOUBLE)), 6) AS test_accuracy, "
        f"round({ratio('2 * count(*) FILTER (WHERE label = 1 AND prediction = 1)', 'count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE prediction = 1)')}, 6) AS test_f1 "
        "FROM t2_best GROUP BY alpha, mean_accuracy")


@sql("model_board")
def _():
    return with_(*_board_ctes()) + "SELECT model, accuracy, f1_score FROM board ORDER BY f1_score, model"


@sql("melt_board")
def _():
    return with_(*_board_ctes()) + (
        "SELECT model, 'accuracy' AS Metric, accuracy AS Score FROM board UNION ALL "
        "SELECT model, 'f1_score', f1_score FROM board")


@sql("candidate_table")
def _():
    def u(p):
        return keyed_unit(D, K.SEARCH_SEED, f"concat(CAST(candidate_id AS VARCHAR), ':{p}')")
    cand = (f"cand AS (SELECT candidate_id, {K.SVM_C_LOW} + {u('C')} * ({K.SVM_C_HIGH} - {K.SVM_C_LOW}) AS C, "
            f"{K.SVM_GAMMA_LOW} + {u('gamma')} * ({K.SVM_GAMMA_HIGH} - {K.SVM_GAMMA_LOW}) AS gamma, "
            f"(['linear', 'rbf'])[CAST(floor({u('kernel')} * 2) AS INTEGER) + 1] AS kernel "
            f"FROM (SELECT unnest(range({K.SVM_DRAWS}))::BIGINT AS candidate_id))")
    sizes = ("sizes AS (SELECT fold, ((SELECT count(*) FROM folds) - count(*))::BIGINT AS n_fit, count(*)::BIGINT AS n_val "
             "FROM folds GROUP BY fold)")
    return with_(REVIEWS, SREVIEWS, FOLDS, cand, sizes) + (
        "SELECT candidate_id, round(C, 6) AS C, round(gamma, 6) AS gamma, kernel, fold, n_fit, n_val FROM cand CROSS JOIN sizes")


# ---------------------------------------------------------------- 2.13 streaming
ORACLE["stream_score"] = ORACLE["nb_predict"]


@sql("stream_retrieve")
def _():
    qs = "qs AS (SELECT item_id, text AS question, text, '' AS history FROM benchmark)"
    hits = (f"hits AS (SELECT * FROM (SELECT q.item_id, c.doc_id, c.chunk_no, {_cos('q.embedding', 'c.embedding')} AS score, "
            f"row_number() OVER (PARTITION BY q.item_id ORDER BY {_cos('q.embedding', 'c.embedding')} DESC, c.doc_id, c.chunk_no) AS rank "
            f"FROM qemb q CROSS JOIN emb c) WHERE rank <= {K.TOP_K})")
    return with_(REVIEWS, RCHUNKS, *_embed_sql("rchunks", "doc_id, chunk_no"), qs, *_embed_sql("qs", "item_id", "qemb"),
                 hits) + "SELECT item_id, rank::INTEGER AS rank, doc_id, chunk_no, round(score, 6) AS score FROM hits"
