"""Lexicon phrases of several words, matched longest first, and the rules beside them.

The phrases form a trie held as a table, one row per prefix.  Every word of a text starts at
the root and goes down a level with each join, so a word that begins no phrase is gone after
the first.  All of it grows with texts and phrases; only the depth reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import written
from . import lexicon as LX


def induce_phrases(runs: DataFrame, words: tuple = K.PHRASE_WORDS, min_count: int = K.LEXICON_MIN_COUNT,
                   clip: float = K.LEXICON_CLIP, label_col: str = "label") -> DataFrame:
    """(phrase, valence): sequences of the given numbers of words that occur ``min_count`` times
    or more, with the add-one log-odds of their occurrences in positive and negative documents
    among the sequences of that length, clipped.

    runs: label and run, an array of the words from one place on (raw_words with ``ahead``).
    Rows with other labels than 0 and 1 count nowhere; an empty table gives no phrases.
    """
    lengths = F.array(*[F.lit(n) for n in words])
    each = (runs.select(F.col(label_col).alias("y"), "run", F.explode(lengths).alias("n"))
            .where((F.size("run") >= F.col("n")) & F.col("y").isin(0, 1))
            .select("y", "n", F.array_join(F.slice("run", 1, F.col("n")), " ").alias("phrase")))
    y = F.col("y")
    counts = each.groupBy("n", "phrase").agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))
    # rare phrases only add to the totals: they are written as one row for each number of words
    frequent = F.when(F.col("n_pos") + F.col("n_neg") >= min_count, F.col("phrase")).alias("phrase")
    counts = written(counts.groupBy("n", frequent).agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.count(F.lit(1)).alias("kinds")), "phrase-counts")
    totals = counts.groupBy("n").agg(F.sum("n_pos").alias("t_pos"), F.sum("n_neg").alias("t_neg"), F.sum("kinds").alias("kinds"))
    odds = F.log((F.col("n_pos") + 1) / (F.col("t_pos") + F.col("kinds"))) - F.log((F.col("n_neg") + 1) / (F.col("t_neg") + F.col("kinds")))
    # totals: one row for each number of words
    return (counts.where(F.col("phrase").isNotNull()).drop("kinds").join(F.broadcast(totals), "n")
            .select("phrase", F.round(F.greatest(F.lit(-clip), F.least(F.lit(clip), odds)), 3).alias("valence")))


def phrase_trie(phrases: DataFrame) -> DataFrame:
    """(depth, prefix, valence, more): each prefix of the phrases, its valence where a phrase ends
    there (the greatest of repeated ones) and whether a longer one goes on.  Null and empty
    phrases and null valences are left out; words are told apart by white space and lower-cased."""
    w = F.filter(F.split(F.lower("phrase"), r"\s+"), lambda x: x != "")
    rows = phrases.where(F.col("valence").isNotNull()).select(w.alias("w"), F.col("valence").cast("double").alias("v")).where(F.size("w") > 0)
    prefixes = rows.select("w", "v", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth"))
    ends = F.col("depth") == F.size("w")
    return (prefixes.groupBy("depth", F.array_join(F.slice("w", 1, F.col("depth")), " ").alias("prefix"))
            .agg(F.max(F.when(ends, F.col("v"))).alias("valence"), F.max(~ends).alias("more")))


def depth_of(trie: DataFrame) -> int:
    """Words of the longest phrase; 0 without phrases."""
    return trie.agg(F.max("depth")).first()[0] or 0


def matches(words: DataFrame, trie: DataFrame, depth: int, key: str = "doc_id", also: tuple = ()) -> DataFrame:
    """(key, also..., pos, n, valence): the places at which phrases start, with n words each and
    their valence: leftmost first, of those at one place the longest, none overlapping another.

    words: key, pos, run (at least ``depth`` words) and the columns of ``also``, which tell rows of
    one key apart.  A key's matches go through one task in order, which holds nothing but the end
    of the last one; rows without a key have none.  Only these columns pass through the joins.
    """
    keys = [key, *also]
    live = words.select(*keys, "pos", "run", F.lit("").alias("__node")).where(F.col(key).isNotNull())
    found = None
    for k in range(1, depth + 1):
        level = trie.where(F.col("depth") == k).select("prefix", F.col("valence").alias("__v"), "more")
        word = F.get("run", F.lit(0))
        rest = F.slice("run", 2, depth).alias("run")
        live = (live.where(word.isNotNull()).select(*keys, "pos", rest, (word if k == 1 else F.concat_ws(" ", "__node", word)).alias("prefix"))
                .join(level, "prefix"))
        if k > 1:   # each level is read by its matches and by the next level
            live = written(live, f"phrase-level-{k}")
        here = live.where(F.col("__v").isNotNull()).select(*keys, "pos", F.lit(k).alias("n"), F.col("__v").alias("valence"))
        found = here if found is None else found.unionByName(here)
        live = live.where("more").select(*keys, "pos", "run", F.col("prefix").alias("__node"))
    if found is None:
        return words.select(*keys, "pos").limit(0).withColumns({"n": F.lit(0), "valence": F.lit(0.0)})

    def taken(batches):
        last, end = None, 0
        for pdf in batches:
            keep = []
            for i, (pos, n, *k) in enumerate(zip(pdf["pos"], pdf["n"], *[pdf[c] for c in keys])):
                if k != last:
                    last, end = k, 0
                if pos >= end:
                    end = pos + n
                    keep.append(i)
            yield pdf.iloc[keep]

    return found.repartition(*keys).sortWithinPartitions(*keys, "pos", F.desc("n")).mapInPandas(taken, found.schema)


def unit_places(spans, size):
    """(pos, n, valence) of a text's units in order, from its spans in order: the spans, and between
    them places of one word and no valence.  Grows with the words of the text."""
    plain = lambda x: F.struct(x.cast("int").alias("pos"), F.lit(1).alias("n"), F.lit(None).cast("double").alias("valence"))
    none = F.array().cast("array<struct<pos:int,n:int,valence:double>>")

    def places(low, high):
        return F.when(low < high, F.transform(F.sequence(low, high - 1), plain)).otherwise(none)

    def before(i):
        at = F.get(spans, i - 1)
        return F.coalesce(at["pos"] + at["n"], F.lit(0))
    gaps = F.transform(spans, lambda x, i: F.concat(places(before(i), x["pos"]), F.array(x)))
    return F.concat(F.flatten(gaps), places(before(F.size(spans)), size))


def phrase_valences(docs: DataFrame, stems: DataFrame, lexicon: DataFrame, phrases: DataFrame,
                    key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, pos, word, n, valence) of every unit of the texts: a phrase (n words, its place the
    first of them, in place of its words) or a word outside the phrases matched, 0 outside the lexicon.

    stems: (word, stem) of the lower-cased raw words; lexicon: (token, valence) by stem; phrases:
    (phrase, valence).  Beside the rules of ``context_valences``: "never so" and "never this"
    strengthen, "least" negates but after "at" and "very", "no" weighs nothing before a
    lexicon word and turns the unit after it (one or two places off; three before "or" and "nor").
    The key tells rows apart; a row without one has no phrases.  Null and empty texts have no units;
    without phrases all units are words.
    """
    trie = written(phrase_trie(phrases), "trie", ("depth",))
    depth = depth_of(trie)
    lists = docs.select(key, text_col, F.xxhash64(text_col).alias("__text"))
    starts = LX.raw_words(lists, key, text_col, ahead=max(1, depth), carry=("__text",))
    span = F.struct(F.col("pos").cast("int").alias("pos"), F.col("n").cast("int").alias("n"), F.col("valence").cast("double").alias("valence"))
    spans = (written(matches(starts, trie, depth, key, ("__text",)), "phrase-matches")
             .groupBy(key, "__text").agg(F.sort_array(F.collect_list(span)).alias("__spans")))
    # spans meet whole texts, not words; a text's units follow row by row
    texts = LX.word_lists(lists.join(spans, [key, "__text"], "left"), (key, "__spans"), text_col)
    none = F.array().cast("array<struct<pos:int,n:int,valence:double>>")
    units = texts.withColumn("__u", F.explode(unit_places(F.coalesce("__spans", none), F.size("w"))))
    units = units.select(key, "l", "c", "w", "first_but", F.col("__u.pos").alias("pos"), F.col("__u.n").alias("n"), F.col("__u.valence").alias("__v"))
    run = F.array_join(F.slice("l", F.col("pos") + 1, F.col("n")), " ")
    units = units.select(key, "pos", "n", "__v", F.when(F.col("__v").isNull(), F.get("w", F.col("pos"))).otherwise(run).alias("word"),
                         *LX.around(), F.get("l", F.col("pos") + 1).alias("__next"))
    by_word = LX.word_valences(stems, lexicon)
    no = (F.col("low") == "no") & (F.col("n") == 1)
    units = units.select(key, "pos", "n", "__v", "word", no.alias("__no"), F.when(no, F.col("__next")).otherwise(F.col("low")).alias("low"),
                         *LX.steps(), *_context())
    # one lookup: of the word itself, or of the word after a "no"
    itself = by_word.where(F.col("low") == "no").agg(F.max("valence")).scalar()
    looked = units.join(by_word, "low", "left")
    valence = (F.when(F.col("__no") & F.col("valence").isNotNull(), F.lit(0.0))
               .otherwise(F.coalesce("__v", F.when(F.col("__no"), itself).otherwise(F.col("valence")))))
    v0 = F.coalesce(valence, F.lit(0.0))
    # one-element generators end the chain: a filter on the valence doesn't repeat its rules, and
    # the generated method stays short enough to be compiled
    looked = looked.select(key, "pos", "word", "n", "a0", "a1", "a2", "a3", "factor", "side", F.explode(F.array(v0 * F.col("turn"))).alias("__v0"))
    valence = F.round(LX.boosted(F.col("__v0")) * F.col("factor") * F.col("side"), 6)
    return looked.select(key, "pos", "word", "n", F.explode(F.array(valence)).alias("valence"))


def _context():
    """turn, factor and side of a unit: what the words before it make of its valence."""
    def at(i, *values):
        one = F.coalesce(f"p{i}", F.lit(""))
        return one.isin(*values)
    turn = F.lit(K.NEGATION_SCALAR)
    so = {i: at(i, "so", "this") for i in (1, 2)}
    factor = (F.when(LX.negates(1), turn).otherwise(F.lit(1.0))
              * F.when(at(2, "never") & so[1], F.lit(K.NEVER_SO)).when(LX.negates(2), turn).otherwise(F.lit(1.0))
              * F.when(at(3, "never") & (so[1] | so[2]), F.lit(K.NEVER_SO_FAR)).when(LX.negates(3), turn).otherwise(F.lit(1.0))
              * F.when(at(1, "least") & ~at(2, *K.LEAST_AFTER), turn).otherwise(F.lit(1.0)))
    return [F.when(at(1, "no") | at(2, "no") | (at(3, "no") & at(1, "or", "nor")), turn).otherwise(F.lit(1.0)).alias("turn"),
            factor.alias("factor"), LX.contrast().alias("side")]
