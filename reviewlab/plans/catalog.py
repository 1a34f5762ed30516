"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

Each query reads the given tables (or what Spark derives from them) in
full; computed columns carry the same names as in the matching oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.dialect import SPARK
from ..operators import bayes as NB
from ..operators import eda as E
from ..operators import evaluation as EV
from ..operators import splits as SP
from ..operators import text as TXT
from ..session import written
from ..sources import tables as S
from .context import Ctx, r6

REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    return Ctx(spark, sf_dir)


# ---------------------------------------------------------------- 2.1 sources
@query
def q_scan_reviews(spark, sf):
    c = ctx(spark, sf)
    return c.reviews.select("doc_id", "text", "lang", "source", "label")


@query
def q_list_splits(spark, sf):
    return S.list_splits(ctx(spark, sf).reviews)


@query
def q_select_split(spark, sf):
    return ctx(spark, sf).split("test").select("doc_id", "label", "split")


@query
def q_concat_splits(spark, sf):
    c = ctx(spark, sf)
    return S.concat_splits(c.split("train"), c.split("test")).select("doc_id", "label", "split")


@query
def q_assign_row_id(spark, sf):
    return S.assign_row_id(ctx(spark, sf).reviews.select("doc_id", "label"), "doc_id", "row_id")


@query
def q_preview_rows(spark, sf):
    return S.preview_rows(ctx(spark, sf).reviews.select("doc_id", "text", "label"), 5)


@query
def q_sample_n(spark, sf):
    return S.sample_n(ctx(spark, sf).reviews.select("doc_id", "label"), K.SAMPLE_N, K.SEARCH_SEED)


def _meta_text(m):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


@query
def q_load_documents(spark, sf):
    c = ctx(spark, sf)
    docs = S.load_documents(c.reviews.withColumn("index", F.col("doc_id")), "text", "doc_id")
    return docs.select("doc_id", "content", _meta_text(F.col("metadata")).alias("metadata_text"))


# ------------------------------------------------- 2.2 projections, missing
@query
def q_missing_counts(spark, sf):
    return E.missing_counts(ctx(spark, sf).all_reviews, ["doc_id", "text", "lang", "source", "label"])


@query
def q_handle_missing(spark, sf):
    return E.handle_missing(ctx(spark, sf).all_reviews).select("doc_id", "label", "text")


@query
def q_encode_label(spark, sf):
    c = ctx(spark, sf)
    verdict = c.reviews.select("doc_id", F.when(F.col("label") == 1, "POSITIVE").otherwise("NEGATIVE").alias("verdict"))
    return E.encode_label(verdict, "verdict", "POSITIVE", "label_id").select("doc_id", "verdict", "label_id")


@query
def q_filter_by_label(spark, sf):
    return E.filter_by_label(ctx(spark, sf).reviews, 0).select("doc_id", "label")


@query
def q_word_count(spark, sf):
    return TXT.word_count(ctx(spark, sf).reviews, "text", "length").select("doc_id", "length")


@query
def q_token_count(spark, sf):
    return ctx(spark, sf).corpus.select("doc_id", "token_count")


# ------------------------------------------------------- 2.3 preprocessing
@query
def q_strip_urls(spark, sf):
    pages = ctx(spark, sf).table("pages")
    t = F.concat_ws(" ", F.col("url"), F.col("html"))
    return pages.select("page_id", F.regexp_replace(t, K.URL_PATTERN, "").alias("text"))


@query
def q_strip_hash_sign(spark, sf):
    d = ctx(spark, sf).table("documents")
    return TXT.strip_hash_sign(d).select("doc_id", "text")


@query
def q_strip_numbers(spark, sf):
    d = ctx(spark, sf).table("documents")
    return TXT.strip_numbers(d).select("doc_id", "text")


@query
def q_tokenize(spark, sf):
    d = TXT.tokenize(ctx(spark, sf).table("documents"), "text", "tokens")
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("token_text"))


@query
def q_explode_tokens(spark, sf):
    d = TXT.tokenize(ctx(spark, sf).table("documents"), "text", "tokens")
    return TXT.explode_tokens(d, "tokens", ("doc_id",))


@query
def q_remove_stopwords(spark, sf):
    d = TXT.tokenize(ctx(spark, sf).table("documents"), "text", "tokens")
    return TXT.remove_stopwords(TXT.explode_tokens(d, "tokens", ("doc_id",)))


@query
def q_remove_punctuation(spark, sf):
    d = TXT.tokenize(ctx(spark, sf).table("documents"), "text", "tokens")
    return TXT.remove_punctuation(TXT.remove_stopwords(TXT.explode_tokens(d, "tokens", ("doc_id",))))


@query
def q_stem_vocabulary(spark, sf):
    long = TXT.kept_tokens(ctx(spark, sf).table("documents"), "text", ("doc_id",))
    return TXT.stem_vocabulary(long, "raw")


@query
def q_processed_text(spark, sf):
    return ctx(spark, sf).corpus.select("doc_id", "processed_text")


@query
def q_preprocess_corpus(spark, sf):
    return ctx(spark, sf).corpus.select("doc_id", "label", "processed_text", "token_count")


@query
def q_vocabulary(spark, sf):
    return TXT.vocabulary(ctx(spark, sf).tokens, "token")


# ------------------------------------------------------------------ 2.4 EDA
@query
def q_describe_length(spark, sf):
    return E.describe(TXT.word_count(ctx(spark, sf).reviews, "text", "length"), "length")


@query
def q_describe_token_count(spark, sf):
    return E.describe(ctx(spark, sf).corpus, "token_count")


@query
def q_histogram_length(spark, sf):
    return E.histogram(TXT.word_count(ctx(spark, sf).reviews, "text", "length"), "length", 100)


@query
def q_histogram_token_count(spark, sf):
    return E.histogram(ctx(spark, sf).corpus, "token_count", 100)


@query
def q_label_distribution(spark, sf):
    return E.label_distribution(ctx(spark, sf).reviews, "label")


@query
def q_sort_by_label(spark, sf):
    return E.label_distribution(ctx(spark, sf).reviews, "label").orderBy("label")


# ------------------------------------------------------ 2.6 shuffle, splits
@query
def q_shuffle_rows(spark, sf):
    return SP.shuffle_rows(ctx(spark, sf).reviews.select("doc_id", "label"))


@query
def q_train_test_split(spark, sf):
    return ctx(spark, sf).sreviews.select("doc_id", "label", "split")


@query
def q_stratified_folds(spark, sf):
    return SP.stratified_folds(ctx(spark, sf).split("train").select("doc_id", "label")).select("doc_id", "label", "fold")


@query
def q_stratified_holdout(spark, sf):
    return SP.stratified_holdout(ctx(spark, sf).split("train").select("doc_id", "label")) \
        .select("seed", "doc_id", "label", "role")


# ------------------------------------------------------ 2.7 / 2.8 Naive Bayes
def _nb_model(c: Ctx) -> DataFrame:
    return NB.nb_train(c.split("train"), c.split_tokens("train"))


def _prior(c: Ctx) -> DataFrame:
    return NB.nb_prior(c.split("train"))


def _nb_scores(c: Ctx) -> DataFrame:
    test = c.split("test").select("doc_id", "label")
    return NB.nb_predict(test, c.split_tokens("test"), _nb_model(c), prior=_prior(c))


@query
def q_token_label_freqs(spark, sf):
    c = ctx(spark, sf)
    return NB.token_label_freqs(c.split_tokens("train"))


@query
def q_token_label_features(spark, sf):
    c = ctx(spark, sf)
    freqs = NB.token_label_freqs(c.split_tokens("train"))
    return NB.token_label_features(c.sreviews.select("doc_id", "label", "split"), c.tokens, freqs) \
        .select("doc_id", "label", "split", "tlc_pos", "tlc_neg")


@query
def q_nb_train(spark, sf):
    m = _nb_model(ctx(spark, sf))
    return m.select("token", "n_pos", "n_neg", r6("loglikelihood").alias("loglikelihood"), r6("logprior").alias("logprior"))


@query
def q_nb_predict(spark, sf):
    s = _nb_scores(ctx(spark, sf))
    return s.select("doc_id", "label", r6("score").alias("score"), "prediction")


@query
def q_nb_evaluate(spark, sf):
    return EV.accuracy(_nb_scores(ctx(spark, sf))).select(F.lit("naive_bayes").alias("model"), "n", "accuracy")


@query
def q_threshold_prediction(spark, sf):
    s = _nb_scores(ctx(spark, sf))
    return s.select("doc_id", (F.col("score") > 0).cast("int").alias("prediction"))


@query
def q_lookup_default_join(spark, sf):
    c = ctx(spark, sf)
    m = _nb_model(c).select("token", "loglikelihood")
    t = c.split_tokens("test").select("doc_id", "pos", "token")
    return (t.join(m, "token", "left")
            .select("doc_id", "pos", "token", r6(F.coalesce(F.col("loglikelihood"), F.lit(0.0))).alias("weight")))


@query
def q_align_predictions(spark, sf):
    c = ctx(spark, sf)
    s = _nb_scores(c).select("doc_id", "prediction")
    truth = c.split("test").select("doc_id", F.col("label").alias("truth"))
    return truth.join(s, "doc_id").select("doc_id", "truth", "prediction")


# ------------------------------------------------------------ 2.10 evaluation
@query
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(_nb_scores(ctx(spark, sf)))


@query
def q_accuracy(spark, sf):
    return EV.accuracy(_nb_scores(ctx(spark, sf)))


@query
def q_precision_recall_f1(spark, sf):
    return EV.metrics(_nb_scores(ctx(spark, sf))).select("precision", "recall", "f1_score")


@query
def q_classification_report(spark, sf):
    return EV.classification_report(_nb_scores(ctx(spark, sf)))


@query
def q_evaluate_model(spark, sf):
    return EV.evaluate_model(_nb_scores(ctx(spark, sf)), "naive_bayes")


@query
def q_error_rows(spark, sf):
    return EV.error_rows(_nb_scores(ctx(spark, sf))).select("doc_id", "label", "prediction")


# ------------------------------------------------------- 2.9 lexicon scoring
from ..operators import inference as INF  # noqa: E402
from ..operators import lexicon as LX  # noqa: E402
from ..operators import padded as PAD  # noqa: E402
from ..operators import phrases as PH  # noqa: E402

def _lexicon(c: Ctx) -> DataFrame:
    return LX.induce_lexicon(_nb_model(c))


def _valences(c: Ctx, reviews: DataFrame | None = None) -> DataFrame:
    words = LX.raw_words(c.sreviews if reviews is None else reviews)
    stems = TXT.stem_vocabulary(words, "low")
    return LX.context_valences(words, stems, _lexicon(c))


def _vader(c: Ctx) -> DataFrame:
    """Lexicon scores of all reviews: (doc_id, label, split, text, neg, neu, pos, compound)."""
    docs = c.sreviews.select("doc_id", "label", "split", "text")
    return LX.lexicon_score(docs, _valences(c))


def _vader_test(c: Ctx) -> DataFrame:
    """The test reviews' scores; a review's score depends on no other review's words."""
    docs = c.split("test").select("doc_id", "label", "split", "text")
    return LX.lexicon_score(docs, _valences(c, docs))


def _roberta(c: Ctx) -> DataFrame:
    """Three-class scores from logits [-s, 0, s] of the Naive Bayes score s."""
    s = _nb_scores(c)
    p = INF.softmax(F.array(-F.col("score"), F.lit(0.0), F.col("score")))
    return s.select("doc_id", "label", p[0].alias("roberta_neg"), p[1].alias("roberta_neu"), p[2].alias("roberta_pos"))


@query
def q_induce_lexicon(spark, sf):
    return _lexicon(ctx(spark, sf))


@query
def q_lexicon_score(spark, sf):
    return _vader(ctx(spark, sf)).select("doc_id", "label", "neg", "neu", "pos", "compound")


@query
def q_lexicon_predict(spark, sf):
    v = _vader(ctx(spark, sf))
    return v.select("doc_id", "label", "compound", (F.col("compound") > 0).cast("int").alias("prediction"))


@query
def q_lexicon_context(spark, sf):
    v = _valences(ctx(spark, sf))
    return v.where(F.col("valence") != 0)


def _phrases(c: Ctx) -> DataFrame:
    """The published idioms, and phrases of the training reviews that aren't among them."""
    texts = c.split("train").select("doc_id", "text").join(c.split("train").select("doc_id", "label"), "doc_id")
    runs = LX.raw_words(texts, ahead=max(K.PHRASE_WORDS), carry=("label",))
    idioms = c.spark.createDataFrame(list(K.IDIOMS.items()), "phrase string, valence double")
    return PH.induce_phrases(runs).where(~F.col("phrase").isin(*K.IDIOMS)).unionByName(idioms)


def _phrase_valences(c: Ctx) -> DataFrame:
    stems = TXT.stem_vocabulary(LX.raw_words(c.sreviews), "low")
    return PH.phrase_valences(c.sreviews, stems, _lexicon(c), _phrases(c))


@query
def q_induce_phrases(spark, sf):
    return _phrases(ctx(spark, sf))


@query
def q_lexicon_phrases(spark, sf):
    return _phrase_valences(ctx(spark, sf)).where(F.col("valence") != 0)


@query
def q_lexicon_phrase_score(spark, sf):
    c = ctx(spark, sf)
    docs = c.sreviews.select("doc_id", "label", "text")
    return LX.lexicon_score(docs, _phrase_valences(c)).select("doc_id", "label", "neg", "neu", "pos", "compound")


@query
def q_prefix_columns(spark, sf):
    v = _vader(ctx(spark, sf))
    return v.select("doc_id", *[F.col(k).alias("vader_" + k) for k in ("neg", "neu", "pos", "compound")])


@query
def q_score_mean_by_label(spark, sf):
    return E.mean_by_label(_vader(ctx(spark, sf)), "compound")


@query
def q_subscore_mean_by_label(spark, sf):
    return E.submean_by_label(_vader(ctx(spark, sf)), ["pos", "neu", "neg"])


@query
def q_score_pair_grid(spark, sf):
    c = ctx(spark, sf)
    v = _vader(c).select("doc_id", "label", *[F.col(k).alias("vader_" + k) for k in ("neg", "neu", "pos")])
    both = v.join(_roberta(c).drop("label"), "doc_id")
    return E.pair_grid(both, ["vader_neg", "vader_neu", "vader_pos", "roberta_neg", "roberta_neu", "roberta_pos"])


@query
def q_score_density(spark, sf):
    c = ctx(spark, sf)
    v = _vader(c).select("doc_id", "label", *[F.col(k).alias("vader_" + k) for k in ("neg", "neu", "pos")])
    both = v.join(_roberta(c).drop("label"), "doc_id")
    return E.density_curves(both, ["vader_neg", "vader_neu", "vader_pos", "roberta_neg", "roberta_neu", "roberta_pos"])


@query
def q_join_scores_left(spark, sf):
    c = ctx(spark, sf)
    return _vader(c).select("doc_id", "compound").join(c.sreviews.select("doc_id", "label", "split"), "doc_id", "left")


@query
def q_join_scores_right(spark, sf):
    c = ctx(spark, sf)
    return (_vader(c).select("doc_id", "compound")
            .join(c.split("test").select("doc_id", "label"), "doc_id", "right"))


@query
def q_combine_two_scorers(spark, sf):
    c = ctx(spark, sf)
    v = _vader(c).select("doc_id", *[F.col(k).alias("vader_" + k) for k in ("neg", "neu", "pos", "compound")])
    r = _roberta(c).drop("label")
    return v.join(r, "doc_id").select("doc_id", "vader_neg", "vader_neu", "vader_pos", "vader_compound",
                                      r6("roberta_neg").alias("roberta_neg"), r6("roberta_neu").alias("roberta_neu"),
                                      r6("roberta_pos").alias("roberta_pos"))


@query
def q_most_confident_wrong(spark, sf):
    c = ctx(spark, sf)
    v = _vader(c).select("doc_id", "label", "text", F.col("pos").alias("vader_pos"), F.col("neg").alias("vader_neg"))
    both = v.join(_roberta(c).drop("label"), "doc_id")
    forms = [("vader_pos_label0", "vader_pos", 0), ("roberta_pos_label0", "roberta_pos", 0),
             ("vader_neg_label1", "vader_neg", 1), ("roberta_neg_label1", "roberta_neg", 1)]
    out = None
    for name, col, lab in forms:
        one = EV.most_confident_wrong(both, col, lab).select(F.lit(name).alias("form"), "doc_id",
                                                            r6(col).alias("score"), "text")
        out = one if out is None else out.unionByName(one)
    return out


@query
def q_truncate_input(spark, sf):
    cp = ctx(spark, sf).corpus
    t = INF.truncate_tokens(F.col("tokens"), K.TRUNCATE_TOKENS)
    return cp.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("input_text"))


@query
def q_softmax_scores(spark, sf):
    r = _roberta(ctx(spark, sf))
    return r.select("doc_id", *[r6(k).alias(k) for k in ("roberta_neg", "roberta_neu", "roberta_pos")])


@query
def q_log_odds_compound(spark, sf):
    s = _nb_scores(ctx(spark, sf))
    logits = F.array(-F.col("score"), F.lit(0.0), F.col("score"))
    return s.select("doc_id", r6(INF.log_odds_from_logits(logits, 2, 0)).alias("roberta_compound"))


@query
def q_argmax_class(spark, sf):
    s = _nb_scores(ctx(spark, sf))
    logits = F.array(-F.col("score"), F.lit(0.0), F.col("score"))
    return s.select("doc_id", INF.argmax(logits).cast("int").alias("predicted_class"))


def _word_model(c: Ctx):
    """Default batch model: the Naive Bayes weights of the BATCH_WORDS most frequent words of the
    training reviews, collected as a vocabulary of that size at most."""
    raw = TXT.kept_tokens(c.split("train"), "text", ("doc_id",))
    top = written(raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "raw").limit(K.BATCH_WORDS), "batch-words")
    stems = TXT.stem_vocabulary(top, "raw")
    rows = stems.join(_nb_model(c), stems["stem"] == F.col("token")).select("word", "loglikelihood").limit(K.BATCH_WORDS).collect()
    return INF.weighted_words_factory({r[0]: r[1] for r in rows})


def _rounded_scores(df: DataFrame) -> list:
    return [r6(f"roberta_{k}").alias(f"roberta_{k}") for k in ("neg", "neu", "pos", "compound")]


@query
def q_batch_score(spark, sf):
    c = ctx(spark, sf)
    s = INF.batch_score(c.reviews.select("doc_id", "label", "text"), _word_model(c))
    return s.select("doc_id", "label", *_rounded_scores(s))


@query
def q_batch_score_safe(spark, sf):
    c = ctx(spark, sf)
    s = INF.batch_score_safe(c.reviews.select("doc_id", "text"), _word_model(c))
    return s.select("doc_id", *_rounded_scores(s), "error")


@query
def q_pipeline_label(spark, sf):
    c = ctx(spark, sf)
    v = INF.pipeline_label(c.reviews.select("doc_id", "label", "text"), _word_model(c))
    return v.select("doc_id", "label", "verdict", r6("confidence").alias("confidence"))


def _subword_scores(c: Ctx) -> DataFrame:
    """All reviews scored in padded batches by the weights of the training reviews' subwords, which
    reach the driver as one number per id of the vocabulary file at most."""
    import public_tokenizers
    encoder = PAD.subword_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    # every text is encoded once, for the weights and for the scores
    ids = written(PAD.subword_table(c.sreviews, encoder, carry=("label", "split")), "subwords")
    weights = {r[0]: r[1] for r in PAD.subword_weights(ids.where(F.col("split") == "train")).collect()}
    return PAD.batch_score_padded(ids, PAD.weighted_subwords_factory(weights), None)


@query
def q_batch_score_padded(spark, sf):
    c = ctx(spark, sf)
    s = _subword_scores(c)
    return s.select("doc_id", *_rounded_scores(s), "n_tokens").join(c.reviews.select("doc_id", "label"), "doc_id")


@query
def q_batch_padding(spark, sf):
    s = written(_subword_scores(ctx(spark, sf)), "padded-scores")
    return PAD.padding_report(s, S.assign_row_id(s.select("doc_id", "n_tokens")))


def _board(c: Ctx) -> DataFrame:
    """One computed row per model, all scored on the test reviews."""
    nb = EV.evaluate_model(_nb_scores(c), "naive_bayes")
    lex = EV.evaluate_model(_vader_test(c).withColumn("prediction", (F.col("compound") > 0).cast("int")), "lexicon")
    rob = EV.evaluate_model(_roberta(c).withColumn("prediction", (F.col("roberta_pos") > F.col("roberta_neg")).cast("int")),
                            "log_odds")
    mnb = EV.evaluate_model(_mnb_test_scores(c), "multinomial_nb")
    grid, log = K.MNB_ALPHA_GRID, SEL.log_spaced(K.MNB_ALPHA_LOW, K.MNB_ALPHA_HIGH, K.MNB_LOG_DRAWS)
    # both searches and their refits in one pass over the folds and one over the test reviews
    means = written(_cv(c, sorted({*grid, *log})).drop("best"), "cv-means")
    scores = written(_mnb_test_scores(c, sorted({*grid, *log}), None), "refit-scores")
    best = EV.evaluate_model(_best_scores(c, grid, means, scores), "multinomial_nb_grid")
    logspace = EV.evaluate_model(_best_scores(c, log, means, scores), "multinomial_nb_logspace")
    return EV.model_board(nb, lex, rob, mnb, best, logspace)


@query
def q_model_board(spark, sf):
    return _board(ctx(spark, sf))


@query
def q_melt_board(spark, sf):
    return EV.melt_board(_board(ctx(spark, sf)))


# --------------------------------------------------------------- 2.11 retrieval
from ..operators import retrieval as RT  # noqa: E402
from ..operators import vector_index as VI  # noqa: E402
from ..sources import vector_store as VS  # noqa: E402
from ..session import scratch_path  # noqa: E402


def _chunks(c: Ctx) -> DataFrame:
    """Fixed-stride chunks of every review, label carried as metadata."""
    return RT.chunk_documents(c.reviews.select("doc_id", "label", "text"), "doc_id", "text", carry=("label",))


def _chunk_vectors(c: Ctx) -> DataFrame:
    """Chunk vectors, written: top-k scans them and joins the texts back."""
    return written(RT.embed(_chunks(c), "text", "embedding"), "chunk-vectors")


def _round_vec(col):
    return F.transform(F.col(col), lambda x: F.round(x, 6))


@query
def q_chunk_documents(spark, sf):
    docs = ctx(spark, sf).table("documents").select("doc_id", "text")
    return RT.chunk_documents(docs, "doc_id", "text")


@query
def q_chunk_documents_recursive(spark, sf):
    docs = ctx(spark, sf).table("documents")
    return RT.chunk_documents_recursive(docs, "doc_id", "text", carry=("lang", "source"))


@query
def q_embed_chunks(spark, sf):
    v = _chunk_vectors(ctx(spark, sf))
    return v.select("doc_id", "chunk_no", _round_vec("embedding").alias("embedding"))


@query
def q_write_vector_table(spark, sf):
    c = ctx(spark, sf)
    v = _chunk_vectors(c).withColumn("bucket", F.expr(SPARK.hex8("CAST(doc_id AS STRING)") + " % 8").cast("int"))
    back = S.write_vector_table(v, scratch_path(spark, "vectors"), "bucket")
    return back.select("doc_id", "chunk_no", "bucket", F.size("embedding").cast("bigint").alias("dims"))


@query
def q_upsert_vector_store(spark, sf):
    """The training reviews' chunks, then those of all: the second run embeds the new ones only."""
    c = ctx(spark, sf)
    chunks = _chunks(c).join(c.sreviews.select("doc_id", "split"), "doc_id").select("doc_id", "chunk_no", "text", "split")
    store = VS.VectorStore(spark, scratch_path(spark, "vector-store"))
    store.upsert(chunks.where("split = 'train'").drop("split"), RT.embed)
    store.upsert(chunks.drop("split"), RT.embed)
    store.compact()
    return store.snapshot().select("doc_id", "chunk_no", F.col(VS.VERSION).alias("version"), F.col(VS.CONTENT).alias("content"))


def _questions(e: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return e.where(F.col("vec_id") % 20 == 0)


@query
def q_build_vector_index(spark, sf):
    index, _ = RT.build_index(ctx(spark, sf).table("embeddings"), scratch_path(spark, "vector-index"))
    return index.select("vec_id", F.col("cell").cast("int").alias("cell"), F.size("embedding").cast("bigint").alias("dims"))


@query
def q_retrieve_top_k(spark, sf):
    e = ctx(spark, sf).table("embeddings")
    r = RT.top_k_self(e, _questions(e))
    return r.select("query_id", "rank", "vec_id", r6("score").alias("score"))


@query
def q_retrieve_top_k_approx(spark, sf):
    e = ctx(spark, sf).table("embeddings")
    index, cells = RT.build_index(e, scratch_path(spark, "vector-index"))
    r = RT.top_k_approx(_questions(e).select(F.col("vec_id").alias("query_id"), "embedding"), index, cells)
    return r.select("query_id", "rank", "vec_id", r6("score").alias("score"))


@query
def q_retrieve_top_k_trained(spark, sf):
    e = ctx(spark, sf).table("embeddings")
    index = VI.build(e)
    r = VI.search(_questions(e).select(F.col("vec_id").alias("query_id"), "embedding"), index)
    return r.select("query_id", "rank", "vec_id", r6("score").alias("score"))


@query
def q_chat_history(spark, sf):
    return RT.chat_history(ctx(spark, sf).table("conversations")).select("conv_id", "turn", "history", "n_prev")


def _user_questions(c: Ctx) -> DataFrame:
    h = RT.chat_history(c.table("conversations"), role="user")
    return written(h.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "conv_id", "turn",
                            F.col("text").alias("question"), "history"), "questions")


@query
def q_assemble_prompts(spark, sf):
    c = ctx(spark, sf)
    qs = _user_questions(c)
    chunks = _chunk_vectors(c)
    hits = RT.top_k(RT.embed(qs.select("query_id", "question"), "question"),
                    chunks, K.TOP_K, "query_id", ("doc_id", "chunk_no"))
    p = RT.assemble_prompts(qs, hits, chunks, "query_id")
    return p.join(qs.select("query_id", "conv_id", "turn"), "query_id").select("conv_id", "turn", "prompt")


@query
def q_batch_ask(spark, sf):
    c = ctx(spark, sf)
    qs = c.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"),
                                     F.lit("").alias("history"))
    chunks = _chunk_vectors(c)
    hits = RT.top_k(RT.embed(qs.select("query_id", "question"), "question"),
                    chunks, K.TOP_K, "query_id", ("doc_id", "chunk_no"))
    return RT.assemble_prompts(qs, hits, chunks, "query_id").select(F.col("query_id").alias("item_id"), "prompt")


# ------------------------------------------------- 2.7 / 2.8 features, searches
from ..operators import features as FE  # noqa: E402
from ..operators import selection as SEL  # noqa: E402

CHI2_K = 500


def _train_tf(c: Ctx) -> DataFrame:
    return FE.term_counts(c.split_tokens("train"))


def _term_counts(c: Ctx) -> DataFrame:
    """(doc_id, split, term, tf) of all reviews, counted once for the fit and the transform; a doc_id has one split."""
    return written(FE.term_counts(c.tokens, ("doc_id", "split")), "term-counts")


@query
def q_tfidf_top_k(spark, sf):
    c = ctx(spark, sf)
    tf = _term_counts(c)
    idf = FE.tfidf_fit(c.split("train"), tf.where(F.col("split") == "train"), K.TFIDF_MAX_FEATURES)
    x = FE.tfidf_transform(tf.drop("split"), idf, bounded=True)
    return x.select("doc_id", "term", r6("tfidf").alias("tfidf"))


@query
def q_tfidf_full(spark, sf):
    c = ctx(spark, sf)
    tf = _term_counts(c)
    idf = FE.tfidf_fit(c.split("train"), tf.where(F.col("split") == "train"), None)
    x = FE.tfidf_transform(tf.drop("split"), idf, bounded=False)
    return x.select("doc_id", "term", r6("tfidf").alias("tfidf"))


@query
def q_standard_scale(spark, sf):
    c = ctx(spark, sf)
    freqs = NB.token_label_freqs(c.split_tokens("train"))
    feats = NB.token_label_features(c.sreviews.select("doc_id", "label", "split"), c.tokens, freqs)
    z = FE.standard_scale(feats.where(F.col("split") == "train"), feats, ["tlc_pos", "tlc_neg"])
    return z.select("doc_id", "split", r6("z_tlc_pos").alias("z_tlc_pos"), r6("z_tlc_neg").alias("z_tlc_neg"))


@query
def q_select_features_chi2(spark, sf):
    c = ctx(spark, sf)
    t = c.split_tokens("train").where(F.length("token") >= 2)
    doc_terms = t.select("doc_id", "label", F.col("token").alias("term")).distinct()
    top = FE.select_top(FE.chi2_scores(doc_terms, c.split("train").select("doc_id", "label")), CHI2_K)
    return top.select("term", r6("chi2").alias("chi2"), F.col("rank").cast("int").alias("rank"))


def _mnb_test_scores(c: Ctx, alphas=(1.0,), top_k: int | None = K.TFIDF_MAX_FEATURES) -> DataFrame:
    """Scores of the test reviews by models fitted on all training reviews."""
    docs = c.sreviews.select(F.lit(0).alias("g"), "doc_id", "label",
                             F.when(F.col("split") == "train", "fit").otherwise("val").alias("role"))
    tf = FE.term_counts(c.tokens)
    return SEL.mnb_scores(docs, tf, list(alphas), top_k)


def _best_scores(c: Ctx, alphas, means: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Test scores of the best candidate of a cross-validated search, refitted on all training
    reviews (every candidate is, in the same plan; the search picks one).  means and scores: those
    of these candidates and others, if they are there already."""
    alphas = sorted({float(a) for a in alphas})
    means = _cv(c, alphas).drop("best") if means is None else means.where(F.col("alpha").isin(alphas))
    best = SEL.best_candidate(means, "mean_accuracy", "alpha").select("alpha", "mean_accuracy")
    scores = _mnb_test_scores(c, alphas, None) if scores is None else scores
    return scores.join(F.broadcast(best), "alpha")  # one row


@query
def q_mnb_train_eval(spark, sf):
    s = _mnb_test_scores(ctx(spark, sf))
    return s.select("doc_id", "label", r6("score").alias("score"), "prediction")


def _cv(c: Ctx, alphas) -> DataFrame:
    folds = SP.stratified_folds(c.split("train").select("doc_id", "label"))
    docs = SEL.fold_roles(folds)
    tf = FE.term_counts(c.split_tokens("train"))
    return SEL.cv_search(SEL.mnb_scores(docs, tf, alphas))


@query
def q_mnb_grid_search(spark, sf):
    r = _cv(ctx(spark, sf), K.MNB_ALPHA_GRID)
    return r.select(r6("alpha").alias("alpha"), r6("mean_accuracy").alias("mean_accuracy"), "best")


@query
def q_mnb_logspace_search(spark, sf):
    alphas = SEL.log_spaced(K.MNB_ALPHA_LOW, K.MNB_ALPHA_HIGH, K.MNB_LOG_DRAWS)
    r = _cv(ctx(spark, sf), alphas)
    return r.select(r6("alpha").alias("alpha"), r6("mean_accuracy").alias("mean_accuracy"), "best")


@query
def q_best_candidate(spark, sf):
    scores = _best_scores(ctx(spark, sf), K.MNB_ALPHA_GRID)
    best = scores.groupBy("alpha", "mean_accuracy").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.sum(F.col("label") * F.col("prediction")).alias("tp"), F.sum(F.col("label") + F.col("prediction")).alias("both"))
    return best.select(r6("alpha").alias("alpha"), r6("mean_accuracy").alias("mean_accuracy"), r6("accuracy").alias("test_accuracy"),
                       F.round(F.when(F.col("both") > 0, 2.0 * F.col("tp") / F.col("both")).otherwise(F.lit(0.0)), 6).alias("test_f1"))


SVM_SPACE = {"C": ("uniform", K.SVM_C_LOW, K.SVM_C_HIGH), "gamma": ("uniform", K.SVM_GAMMA_LOW, K.SVM_GAMMA_HIGH),
             "kernel": ("choice", ["linear", "rbf"])}


@query
def q_candidate_table(spark, sf):
    c = ctx(spark, sf)
    cand = SEL.draw_candidates(spark, K.SVM_DRAWS, SVM_SPACE, K.SEARCH_SEED)
    folds = SP.stratified_folds(c.split("train").select("doc_id", "label"))
    n = folds.agg(F.count(F.lit(1))).scalar()
    # the fold sizes (one entry per fold) arrive as one array value
    sizes = (folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_val"))
             .agg(F.sort_array(F.collect_list(F.struct("fold", "n_val")))).scalar())
    return (cand.withColumn("f", F.explode(sizes))
            .select("candidate_id", r6("C").alias("C"), r6("gamma").alias("gamma"), "kernel", F.col("f.fold").alias("fold"),
                    (n - F.col("f.n_val")).cast("bigint").alias("n_fit"), F.col("f.n_val").cast("bigint").alias("n_val")))


# ------------------------------------------------ 2.8 iterative models (rows-only)
from ..operators import classifiers as CL  # noqa: E402
from ..streaming import jobs as ST  # noqa: E402

def _ml_data(c: Ctx, terms: int = K.TFIDF_MAX_FEATURES):
    """(doc_id, label, split, fold, features) with a top-k TF-IDF vocabulary fit on train."""
    idf = FE.tfidf_fit(c.split("train"), _train_tf(c), terms)
    vec = CL.tfidf_vectors(c.corpus, idf, terms)
    folds = SP.stratified_folds(c.split("train").select("doc_id", "label")).select("doc_id", "fold")
    # iterative fits scan the features many times: write them once
    return written(vec.join(folds, "doc_id", "left").select("doc_id", "label", "split", "fold", "features"), "ml-features")


def _tlc(c: Ctx) -> DataFrame:
    freqs = NB.token_label_freqs(c.split_tokens("train"))
    return written(NB.token_label_features(c.sreviews.select("doc_id", "label", "split"), c.tokens, freqs), "count-features")


@query
def q_lr_train_eval(spark, sf):
    c = ctx(spark, sf)
    f = _tlc(c)
    return CL.lr_train_eval(f.where(F.col("split") == "train"), f.where(F.col("split") == "test"))


@query
def q_lr_grid_search(spark, sf):
    c = ctx(spark, sf)
    f = _tlc(c).where(F.col("split") == "train")
    folds = SP.stratified_folds(c.split("train").select("doc_id", "label")).select("doc_id", "fold")
    return CL.lr_grid_search(written(f.join(folds, "doc_id"), "count-folds"))


def _draws(spark, n, space, seed=K.SEARCH_SEED):
    return SEL.draw_candidates(spark, n, space, seed)


def _svm_draws(spark, kernel: str):
    return [r for r in _draws(spark, K.SVM_DRAWS, SVM_SPACE).orderBy("candidate_id").collect() if r["kernel"] == kernel]


@query
def q_svm_linear_search(spark, sf):
    c = ctx(spark, sf)
    d = _ml_data(c).where(F.col("split") == "train")
    return CL.svm_linear_search(d, [(r["candidate_id"], r["C"]) for r in _svm_draws(spark, "linear")])


@query
def q_svm_rbf_approx(spark, sf):
    c = ctx(spark, sf)
    d = _ml_data(c).where(F.col("split") == "train")
    return CL.svm_rbf_approx(d, [(r["candidate_id"], r["C"], r["gamma"]) for r in _svm_draws(spark, "rbf")])


def _dims(d: DataFrame) -> int:
    """Length of the feature vectors: that of any one."""
    row = d.select("features").first()
    return row[0].size if row else 1


RF_SPACE = {"n_estimators": ("choice", K.RF_TREES), "max_depth": ("choice", K.RF_DEPTHS),
            "min_samples_split": ("choice", K.RF_MIN_SPLIT), "criterion": ("choice", K.RF_CRITERIA)}
GBT_SPACE = {"n_estimators": ("int", *K.GBT_ROUNDS), "max_depth": ("int", *K.GBT_DEPTH),
             "learning_rate": ("uniform", *K.GBT_RATE), "subsample": ("uniform", *K.GBT_SUBSAMPLE),
             "colsample_bytree": ("uniform", *K.GBT_COLSAMPLE), "min_child_weight": ("int", *K.GBT_CHILD_WEIGHT),
             "gamma": ("uniform", *K.GBT_GAMMA)}


@query
def q_rf_random_search(spark, sf):
    c = ctx(spark, sf)
    d = _ml_data(c).where(F.col("split") == "train")
    return CL.rf_random_search(d, _draws(spark, K.RF_DRAWS, RF_SPACE))


@query
def q_gbt_random_search(spark, sf):
    c = ctx(spark, sf)
    d = _ml_data(c).where(F.col("split") == "train")
    return CL.gbt_random_search(d, _draws(spark, K.GBT_DRAWS, GBT_SPACE))


HOLDOUT_SVM_SPACE = {"C": ("loguniform", *K.HOLDOUT_SVM_C), "gamma": ("loguniform", *K.HOLDOUT_SVM_GAMMA),
                     "kernel": ("choice", ["linear", "rbf"])}
HOLDOUT_RF_SPACE = {"n_estimators": ("int", *K.HOLDOUT_RF_TREES), "max_depth": ("int", *K.HOLDOUT_RF_DEPTH),
                    "min_samples_split": ("int", *K.HOLDOUT_RF_MIN_SPLIT), "max_features": ("choice", K.HOLDOUT_RF_FEATURES)}


@query
def q_search_holdout(spark, sf):
    c = ctx(spark, sf)
    d = _ml_data(c).where(F.col("split") == "train").select("doc_id", "label", "features")
    seeds = list(range(K.N_FOLDS))
    hold = SP.stratified_holdout(c.split("train").select("doc_id", "label"), seeds).select("doc_id", "seed", "role")
    dims = _dims(d)

    def svm(C):
        return lambda n: CL.LinearSVC(labelCol="label", featuresCol="features", maxIter=100, tol=CL.SVM_TOL, regParam=1.0 / (C * n))

    def forest(r):
        rf = CL.RandomForestClassifier(labelCol="label", featuresCol="features", seed=K.SEARCH_SEED)
        return lambda n: rf.copy(CL.rf_params(rf, r))

    draws = _draws(spark, K.HOLDOUT_SVM_DRAWS, HOLDOUT_SVM_SPACE).orderBy("candidate_id").collect()
    families = {"svm_linear": (lambda x: x, [(r["candidate_id"], svm(r["C"])) for r in draws if r["kernel"] == "linear"])}
    for r in draws:
        if r["kernel"] == "rbf":
            families[f"svm_rbf_{r['candidate_id']}"] = (
                lambda x, g=r["gamma"]: CL.random_fourier(x, g, dims).select("doc_id", "label", F.col("rff").alias("features")),
                [(r["candidate_id"], svm(r["C"]))])
    trees = [r.asDict() for r in _draws(spark, K.HOLDOUT_RF_DRAWS, HOLDOUT_RF_SPACE).orderBy("candidate_id").collect()]
    families["random_forest"] = (lambda x: x, [(r["candidate_id"], forest(r)) for r in trees])
    found = CL.holdout_search(d, hold, families, seeds)
    return found.withColumn("family", F.regexp_replace("family", "_\\d+$", ""))


# ------------------------------------------------------------- 2.13 streaming
@query
def q_stream_score(spark, sf):
    c = ctx(spark, sf)
    stems = written(TXT.stem_vocabulary(TXT.kept_tokens(c.split("train"), "text", ("doc_id",)), "raw"), "stream-stems")
    out = ST.stream_score(spark, c.split("test").select("doc_id", "label", "text"), _nb_model(c), stems=stems)
    return out.select("doc_id", "label", r6("score").alias("score"), "prediction")


@query
def q_stream_retrieve(spark, sf):
    c = ctx(spark, sf)
    qs = c.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = ST.stream_retrieve(spark, qs, _chunk_vectors(c), K.TOP_K)
    return out.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "chunk_no", r6("score").alias("score"))


@query
def q_stream_history(spark, sf):
    """Two runs over one checkpoint: first the turns before 2, then the rest."""
    turns = ctx(spark, sf).table("conversations").select("conv_id", "turn", "role", "text")
    work = scratch_path(spark, "stream-history")
    turns.where("turn < 2").write.mode("append").parquet(f"{work}/in")
    ST.stream_conversations(spark, f"{work}/in", work)
    turns.where("turn >= 2").write.mode("append").parquet(f"{work}/in")
    out = ST.stream_conversations(spark, f"{work}/in", work)
    return out.select("conv_id", "turn", "history", "n_prev")
