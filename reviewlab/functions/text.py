"""Text rules as SQL expressions, rendered for Spark or DuckDB."""

from __future__ import annotations

from . import constants as K
from .dialect import Dialect
from .porter import stem_array_sql

# --- fixed values: tokenizer rule -------------------------------------------
# A token is a run of letters, or one sign that is neither letter nor space.
TOKEN_PATTERN = r"\p{L}+|[^\p{L}\s]"
WORD_PATTERN = r"\p{L}+"


def clean_sql(d: Dialect, text: str) -> str:
    """Drop links, the '#' sign and digit runs (in that order)."""
    x = d.rx_replace(f"coalesce({text}, '')", K.URL_PATTERN, "")
    x = d.rx_replace(x, K.HASH_SIGN_PATTERN, "")
    return d.rx_replace(x, K.NUMBER_PATTERN, "")


def tokenize_sql(d: Dialect, text: str) -> str:
    """Lower-case tokens of the cleaned text, in order."""
    return d.rx_extract_all(f"lower({clean_sql(d, text)})", TOKEN_PATTERN)


def stopword_list_sql(d: Dialect) -> str:
    return "(" + ", ".join(d.lit(w) for w in K.STOPWORDS_EN) + ")"


def keep_token_sql(d: Dialect, t: str) -> str:
    """Token survives: not a stop word and not a run of punctuation signs."""
    return f"({t} NOT IN {stopword_list_sql(d)} AND NOT contains({d.lit(K.PUNCTUATION)}, {t}))"


def kept_tokens_sql(d: Dialect, text: str) -> str:
    return d.filter(tokenize_sql(d, text), "t", keep_token_sql(d, "t"))


def word_count_sql(d: Dialect, text: str) -> str:
    """Whitespace-separated words (Python's str.split())."""
    fn = "split" if d.spark else "regexp_split_to_array"
    parts = f"{fn}(coalesce({text}, ''), {d.lit(r'\s+')})"
    return f"CAST({d.size(d.filter(parts, 'x', "x <> ''"))} AS BIGINT)"


# --- raw words: white-space runs, signs at both ends removed, inner ones (don't) kept
EDGE_PATTERN = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
# the same words found in one pass: from a run's first letter or digit to its last
RUN_PATTERN = r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"


def raw_words_sql(d: Dialect, text: str) -> str:
    """Words in order, case kept, typographic apostrophes made plain."""
    plain = f"replace(coalesce({text}, ''), '\u2019', {d.lit(chr(39))})"
    if d.spark:
        return d.rx_extract_all(plain, RUN_PATTERN)
    parts = f"regexp_split_to_array({plain}, {d.lit(r'\s+')})"
    return d.filter(d.transform(parts, "x", d.rx_replace("x", EDGE_PATTERN, "")), "x", "x <> ''")


def stem_array_steps(d: Dialect) -> list[str]:
    return stem_array_sql(d, "__stem")
