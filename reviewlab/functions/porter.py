"""Porter (1980) suffix stripping as plain SQL expressions.

The stemmer is an expression over one word, so Spark evaluates it inside
the JVM (no Python worker) and DuckDB can evaluate the very same rules for
the oracle.  The word's consonant/vowel shape is a string of ``C``/``V``;
the measure ``m`` of a stem is the number of ``VC`` pairs in the shape of
its prefix, because the class of a letter only depends on the letters
before it.

Departures from the paper: words of at most two letters are returned as
they are (as in the author's reference implementation), and a run of more
than four ``y`` in a row is classified approximately.
"""

from __future__ import annotations

from .dialect import Dialect

# --- fixed values: rule lists of Porter (1980), in the paper's order --------
STEP2_RULES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3_RULES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4_SUFFIXES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
_ASCII = "abcdefghijklmnopqrstuvwxyz"
_SHAPE = "".join("V" if ch in "aeiou" else ("y" if ch == "y" else "C") for ch in _ASCII)


def shape(d: Dialect, w: str) -> str:
    """C/V shape of a lower-case word (y is a vowel after a consonant)."""
    x = f"translate({w}, '{_ASCII}', '{_SHAPE}')"
    x = d.rx_replace(x, "[^VCy]", "C")          # letters outside a-z are consonants
    x = f"CASE WHEN left({x}, 1) = 'y' THEN 'C' || substr({x}, 2) ELSE {x} END"
    for _ in range(2):
        x = f"replace(replace({x}, 'Cy', 'CV'), 'Vy', 'VC')"
    return f"replace({x}, 'y', 'C')"


def _static_shape(letters: str) -> str:
    # replacements hold no 'y', so their shape does not depend on the stem
    return "".join("V" if ch in "aeiou" else "C" for ch in letters)


def _n(w: str) -> str:
    return f"length({w})"


def _m(c: str, L: str) -> str:
    """2 * measure of the stem whose shape is left(c, L)."""
    p = f"left({c}, {L})"
    return f"(length({p}) - length(replace({p}, 'VC', '')))"


def _has_vowel(c: str, L: str) -> str:
    return f"contains(left({c}, {L}), 'V')"


def _cvc(w: str, c: str, L: str) -> str:
    return f"(right(left({c}, {L}), 3) = 'CVC' AND substr({w}, {L}, 1) NOT IN ('w', 'x', 'y'))"


def _ends(w: str, sfx: str) -> str:
    return f"right({w}, {len(sfx)}) = '{sfx}'"


def _cut(x: str, k, add: str = "") -> str:
    base = f"left({x}, {_n(x)} - {k})"
    return f"{base} || '{add}'" if add else base


def _pair(arms, w: str, c: str):
    """Render the same CASE for the word and its shape.

    arms: list of (condition, k_cut, appended letters or None for 'keep')."""
    ws, cs = [], []
    for cond, k, add in arms:
        if add is None:
            ws.append(f"WHEN {cond} THEN {w}")
            cs.append(f"WHEN {cond} THEN {c}")
        else:
            ws.append(f"WHEN {cond} THEN {_cut(w, k, add)}")
            cs.append(f"WHEN {cond} THEN {_cut(c, k, _static_shape(add))}")
    return (f"CASE {' '.join(ws)} ELSE {w} END", f"CASE {' '.join(cs)} ELSE {c} END")


def step1a(w: str, c: str):
    return _pair([(_ends(w, "sses"), 2, ""), (_ends(w, "ies"), 2, ""),
                  (_ends(w, "ss"), 0, None), (_ends(w, "s"), 1, "")], w, c)


def step1b_cut(w: str, c: str):
    n = _n(w)
    return _pair([(_ends(w, "eed") + f" AND {_m(c, f'{n} - 3')} > 0", 1, ""),
                  (_ends(w, "eed"), 0, None),
                  (f"{_ends(w, 'ed')} AND {_has_vowel(c, f'{n} - 2')}", 2, ""),
                  (f"{_ends(w, 'ing')} AND {_has_vowel(c, f'{n} - 3')}", 3, "")], w, c)


def step1b_flag(w: str, c: str) -> str:
    n = _n(w)
    return (f"(NOT ({_ends(w, 'eed')}) AND (({_ends(w, 'ed')} AND {_has_vowel(c, f'{n} - 2')}) "
            f"OR ({_ends(w, 'ing')} AND {_has_vowel(c, f'{n} - 3')})))")


def step1b_fix(w: str, c: str, f: str):
    n = _n(w)
    return _pair([(f"NOT {f}", 0, None),
                  (f"right({w}, 2) IN ('at', 'bl', 'iz')", 0, "e"),
                  (f"{n} >= 2 AND substr({w}, {n}, 1) = substr({w}, {n} - 1, 1) AND right({c}, 2) = 'CC' "
                   f"AND right({w}, 1) NOT IN ('l', 's', 'z')", 1, ""),
                  (f"{_m(c, n)} = 2 AND {_cvc(w, c, n)}", 0, "e")], w, c)


def step1c(w: str, c: str):
    return _pair([(f"{_ends(w, 'y')} AND {_has_vowel(c, f'{_n(w)} - 1')}", 1, "i")], w, c)


def _suffix_of(d: Dialect, w: str, rules) -> str:
    """Longest suffix of w among the rules ('' if none): an end-anchored
    alternation matches first at the leftmost start, i.e. the longest one."""
    alts = "|".join(sorted((r[0] for r in rules), key=len, reverse=True))
    return f"regexp_extract({w}, '({alts})$', 1)"


def _apply_suffix(w: str, c: str, s: str, g: str, rules):
    rep = "CASE " + " ".join(f"WHEN {s} = '{a}' THEN '{b}'" for a, b in rules) + " END"
    rsh = "CASE " + " ".join(f"WHEN {s} = '{a}' THEN '{_static_shape(b)}'" for a, b in rules) + " END"
    k = f"length({s})"
    return (f"CASE WHEN {g} THEN left({w}, {_n(w)} - {k}) || {rep} ELSE {w} END",
            f"CASE WHEN {g} THEN left({c}, {_n(c)} - {k}) || {rsh} ELSE {c} END")


def step5a(w: str, c: str):
    L = f"{_n(w)} - 1"
    return _pair([(f"{_ends(w, 'e')} AND ({_m(c, L)} > 2 OR ({_m(c, L)} = 2 AND NOT {_cvc(w, c, L)}))", 1, "")], w, c)


def step5b(w: str, c: str):
    return _pair([(f"{_m(c, _n(w))} > 2 AND {_ends(w, 'll')}", 1, "")], w, c)


_STEP4_RULES = [(s, "") for s in STEP4_SUFFIXES]


def stem_stages(d: Dialect):
    """The stemmer as successive projections over fields o (original word),
    w (word so far), c (its C/V shape), f (step 1b flag), s (matched suffix)
    and g (rule fires).

    Each stage is a function ``ref -> {field: expression}``, where
    ``ref(name)`` renders a field of the previous stage.
    """
    def base(r):
        return {"o": r("o"), "w": r("w"), "c": r("c")}

    def wc(r, pair):
        return {"o": r("o"), "w": pair[0], "c": pair[1]}

    st = [
        lambda r: {"o": r("o"), "w": r("o"), "c": shape(d, r("o"))},
        lambda r: wc(r, step1a(r("w"), r("c"))),
        lambda r: {**wc(r, step1b_cut(r("w"), r("c"))), "f": step1b_flag(r("w"), r("c"))},
        lambda r: wc(r, step1b_fix(r("w"), r("c"), r("f"))),
        lambda r: wc(r, step1c(r("w"), r("c"))),
    ]
    for rules, need in ((STEP2_RULES, 0), (STEP3_RULES, 0), (_STEP4_RULES, 2)):
        st.append(lambda r, rules=rules: {**base(r), "s": _suffix_of(d, r("w"), rules)})
        if need == 0:
            st.append(lambda r: {**base(r), "s": r("s"),
                                 "g": f"({r('s')} <> '' AND {_m(r('c'), f'length({r(chr(119))}) - length({r(chr(115))})')} > 0)"})
        else:
            st.append(lambda r: {**base(r), "s": r("s"),
                                 "g": f"({r('s')} <> '' AND {_m(r('c'), f'length({r(chr(119))}) - length({r(chr(115))})')} > 2 "
                                      f"AND ({r('s')} <> 'ion' OR substr({r('w')}, length({r('w')}) - 3, 1) IN ('s', 't')))"})
        st.append(lambda r, rules=rules: wc(r, _apply_suffix(r("w"), r("c"), r("s"), r("g"), rules)))
    st.append(lambda r: wc(r, step5a(r("w"), r("c"))))
    st.append(lambda r: wc(r, step5b(r("w"), r("c"))))
    st.append(lambda r: {"w": f"CASE WHEN length({r('o')}) <= 2 THEN {r('o')} ELSE {r('w')} END"})
    return st


def stem_array_sql(d: Dialect, arr: str) -> list[str]:
    """Array form: one ``transform`` per stage over an array of words.

    Apply the texts in order; each one after the first reads the column
    the previous one produced under the name ``__stem``.
    """
    stages = stem_stages(d)
    out = []
    for i, stage in enumerate(stages):
        if i == 0:
            fields = stage(lambda k: "t")
            src, var = arr, "t"
        else:
            fields = stage(lambda k: f"s.{k}")
            src, var = "__stem", "s"
        if i == len(stages) - 1:
            body = fields["w"]
        elif d.spark:
            body = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        else:
            body = "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"
        out.append(d.transform(src, var, body))
    return out


def stem_column_stages(d: Dialect, word_col: str) -> list[dict[str, str]]:
    """Scalar form as a list of projections {field: expression}; the first
    reads ``word_col`` and the last yields the field ``stem``."""
    stages = stem_stages(d)
    out = []
    for i, stage in enumerate(stages):
        fields = stage(lambda k: word_col if i == 0 else f"__st_{k}")
        if i == len(stages) - 1:
            out.append({"stem": fields["w"]})
        else:
            out.append({f"__st_{k}": v for k, v in fields.items()})
    return out

