"""Valence-lexicon scoring of whole tables.

A document's token valences are summed and normalised into neg / neu /
pos shares and a compound score, following the rule-based scorer of
Hutto & Gilbert (2014).  The lexicon is an input table (token, valence);
when none is supplied one is induced from labelled data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as TX
from ..functions.dialect import SPARK
from ..session import spread, written


def induce_lexicon(nb_model: DataFrame, clip: float = K.LEXICON_CLIP,
                   min_count: int = K.LEXICON_MIN_COUNT) -> DataFrame:
    """(token, valence): Naive Bayes log-odds, clipped, for frequent tokens."""
    v = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("loglikelihood")))
    return (nb_model.where(F.col("n_pos") + F.col("n_neg") >= min_count)
            .select("token", F.round(v, 3).alias("valence")))


def punctuation_amplifier(text_col: str = "text"):
    """Emphasis from '!' (up to four) and from two or more '?'."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    ex = F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))
    qm = F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))
    ep = F.least(ex, F.lit(4)) * K.EXCLAMATION_STEP
    qa = F.when(qm > 3, F.lit(K.QUESTION_MAX)).when(qm > 1, qm * K.QUESTION_STEP).otherwise(F.lit(0.0))
    return ep + qa


def score_from_valences(docs: DataFrame, valences: DataFrame, keys=("doc_id",), text_col: str = "text") -> DataFrame:
    """docs: keys + text; valences: keys + valence per token occurrence
    (0 for tokens outside the lexicon).  Adds neg, neu, pos, compound."""
    v = F.col("valence")
    sums = valences.groupBy(*keys).agg(
        F.sum(v).alias("__sum"),
        F.sum(F.when(v > 0, v + 1).otherwise(F.lit(0.0))).alias("__pos"),
        F.sum(F.when(v < 0, v - 1).otherwise(F.lit(0.0))).alias("__neg"),
        F.count_if(v == 0).alias("__neu"),
        F.count(F.lit(1)).alias("__n"))
    # the emphasis is taken from the text before the join, which then moves no texts that nobody reads
    d = docs.withColumn("__amp", punctuation_amplifier(text_col)).join(sums, list(keys), "left")
    s = (F.when(F.col("__sum") > 0, F.col("__sum") + F.col("__amp"))
         .when(F.col("__sum") < 0, F.col("__sum") - F.col("__amp")).otherwise(F.col("__sum")))
    compound = s / F.sqrt(s * s + K.VALENCE_ALPHA)
    pos_s = F.when(F.col("__pos") > -F.col("__neg"), F.col("__pos") + F.col("__amp")).otherwise(F.col("__pos"))
    neg_s = F.when(F.col("__pos") < -F.col("__neg"), F.col("__neg") - F.col("__amp")).otherwise(F.col("__neg"))
    total = pos_s - neg_s + F.col("__neu")
    has = F.coalesce(F.col("__n"), F.lit(0)) > 0
    out = d.select(*[c for c in docs.columns],
                   F.when(has, F.round(F.abs(neg_s / total), 3)).otherwise(F.lit(0.0)).alias("neg"),
                   F.when(has, F.round(F.abs(F.col("__neu") / total), 3)).otherwise(F.lit(0.0)).alias("neu"),
                   F.when(has, F.round(F.abs(pos_s / total), 3)).otherwise(F.lit(0.0)).alias("pos"),
                   F.when(has, F.round(compound, 4)).otherwise(F.lit(0.0)).alias("compound"))
    return out


def word_lists(docs: DataFrame, keep=("doc_id",), text_col: str = "text") -> DataFrame:
    """(keep..., w, l, c, first_but): a text's raw words in order, lower-cased, whether each is
    ALL-CAPS in a text that isn't wholly so, and the place of the first contrast word.  Texts are spread over all tasks."""
    words = spread(docs, keep[0], text_col).select(*keep, F.expr(TX.raw_words_sql(SPARK, text_col)).alias("w"))
    lists = words.select(*keep, "w", F.transform("w", lambda x: F.lower(x)).alias("l"), F.transform("w", _caps).alias("c"))
    mixed = F.exists("c", lambda x: x) & ~F.forall("c", lambda x: x)
    return lists.select(*keep, "w", "l", F.when(mixed, F.col("c")).otherwise(F.transform("c", lambda x: F.lit(False))).alias("c"),
                        (F.array_position("l", K.CONTRAST_WORD) - 1).alias("first_but"))


def around() -> list:
    """Columns of the word at place ``pos`` of the lists: low, caps, p1..p4, c1..c3, first_but."""
    return [F.get("l", F.col("pos")).alias("low"), F.get("c", F.col("pos")).alias("caps"),
            *[F.get("l", F.col("pos") - i).alias(f"p{i}") for i in (1, 2, 3, 4)],
            *[F.coalesce(F.get("c", F.col("pos") - i), F.lit(False)).alias(f"c{i}") for i in (1, 2, 3)],
            F.when(F.col("first_but") >= 0, F.col("first_but")).alias("first_but")]


def raw_words(docs: DataFrame, key: str = "doc_id", text_col: str = "text", ahead: int = 0, carry=()) -> DataFrame:
    """(key, pos, word, low, caps, p1..p4, c1..c3, first_but): each raw word with the four
    before it, lower-cased, whether it and the three before are ALL-CAPS in a text
    that isn't wholly so, and the place of the first contrast word.  Row-local: no window.
    With ``ahead`` also run: the lower-cased words from this one on, that many at most; and
    the columns of ``carry`` as they are."""
    lists = word_lists(docs, (key, *carry), text_col)
    # outer, or a filter on the list would take the words again below the shuffle that spreads the texts
    at = lists.select(key, *carry, F.posexplode_outer("w").alias("pos", "word"), "l", "c", "first_but").where("pos is not null")
    return at.select(key, "pos", "word", *around(),
                     *([F.slice("l", F.col("pos") + 1, ahead).alias("run")] if ahead else []), *carry)


def _caps(x):
    """An upper-case letter and no lower-case one."""
    return x.rlike(r"\A[^\p{Ll}\p{Lu}]*+\p{Lu}[^\p{Ll}]*+\z")


def word_valences(stems: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(low, valence) of the words whose stem is in the lexicon, written: the planner sees its
    size, and every reader finds the words stemmed."""
    return written(stems.join(lexicon, stems["stem"] == lexicon["token"]).select(F.col("word").alias("low"), "valence"), "word-valences")


def steps() -> list:
    """a0..a3 of a word: what ALL-CAPS adds, and what the intensifier or dampener one, two and
    three places before it does.  Taken before a join, so that no neighbours pass through it."""
    out = [F.when(F.col("caps"), F.lit(K.CAPS_INCREMENT)).otherwise(F.lit(0.0)).alias("a0")]
    for i in (1, 2, 3):
        one, two = F.col(f"p{i}"), F.concat(F.col(f"p{i + 1}"), F.lit(" "), F.col(f"p{i}"))
        step = (F.when(one.isin(K.BOOSTERS_UP), F.lit(K.BOOST_INCREMENT))
                .when(one.isin(K.BOOSTERS_DOWN) | F.coalesce(two.isin(K.BOOSTERS_DOWN), F.lit(False)), F.lit(K.BOOST_DECREMENT)))
        step = step + F.when(F.col(f"c{i}"), F.lit(K.CAPS_INCREMENT)).otherwise(F.lit(0.0))
        out.append(F.coalesce(step, F.lit(0.0)).alias(f"a{i}"))
    return out


def boosted(v0):
    """v0 raised for ALL-CAPS, raised or lowered by intensifiers and dampeners among the three words before."""
    sign = F.when(v0 > 0, F.lit(1.0)).when(v0 < 0, F.lit(-1.0)).otherwise(F.lit(0.0))
    v = v0 + sign * F.col("a0")
    for i, damp in zip((1, 2, 3), K.DISTANCE_DAMPING):
        v = v + sign * F.col(f"a{i}") * damp
    return v


def negates(i: int):
    """Whether the word i places before is a negation."""
    one = F.col(f"p{i}")
    return F.coalesce(one.isin(K.NEGATIONS) | one.contains("n't"), F.lit(False))


def contrast():
    """Weight by the side of the first "but"."""
    return (F.when(F.col("pos") < F.col("first_but"), F.lit(K.BUT_BEFORE))
            .when(F.col("pos") > F.col("first_but"), F.lit(K.BUT_AFTER)).otherwise(F.lit(1.0)))


def context_valences(words: DataFrame, stems: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, word, valence) of every raw word, 0 for words outside the lexicon.

    words: raw_words; stems: (word, stem) of the lower-cased words; lexicon: (token, valence)
    by stem.  The valence is raised for ALL-CAPS, raised or lowered by intensifiers and
    dampeners (one word or two) among the three words before, turned for each negation among
    them, and weighted by the side of the first "but" it stands on.
    """
    v = boosted(F.coalesce(F.col("valence"), F.lit(0.0)))
    negations = F.lit(0)
    for i in (1, 2, 3):
        negations = negations + negates(i).cast("int")
    narrow = words.select(key, "pos", "word", "low", *steps(), negations.alias("negations"), contrast().alias("side"))
    joined = narrow.join(word_valences(stems, lexicon), "low", "left")
    return joined.select(key, "pos", "word", F.round(v * F.pow(F.lit(K.NEGATION_SCALAR), F.col("negations")) * F.col("side"), 6).alias("valence"))


def lexicon_score(docs: DataFrame, valences: DataFrame, keys=("doc_id",), text_col: str = "text") -> DataFrame:
    """Document scores from the valences in context (context_valences)."""
    return score_from_valences(docs, valences.select(*keys, "valence"), keys, text_col)
