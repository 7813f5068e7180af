"""Text columns: query keys, search normalisation, word forms, typo variants."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

# The white space of the query key (ECMAScript white space and line ends).
WHITE = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
# Explicit queries that say nothing.
BLANK_QUERIES = ("", "direct", "unknown", "null", "undefined")
# Characters removed from, and separators blanked in, search text.
DROPPED = "[®™׳״'’`\"“”„«»″‟]"
SEPARATORS = "[-–—()\\[\\],:;!?]"
# Hebrew final letters and their ordinary forms, in alphabet order.
FINAL_LETTERS, PLAIN_LETTERS = "ךםןףץ", "כמנפצ"
# Letters that may be a one-letter prefix of a Hebrew word.
PREFIX_LETTERS = "והבלמשכ"
# The "up to N" clause with an optional currency word.
PRICE_CLAUSE = "עד\\s+(\\d+(?:\\.\\d+)?)\\s*(?:שקל(?:ים)?|שח|₪)?"
# Hebrew letters and the Latin letters on the same keys.
HEBREW_KEYS, LATIN_KEYS = "אבגדהוזחטיךכלםמןנסעףפץצקרשת", "tcdsvuzjyhlfkonibxg;p.mera,"


def squash(x: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(x, WHITE + "+", " "))


def query_key(x: Column) -> Column:
    """FN-01: trimmed, collapsed, lower-case query; null becomes the empty string."""
    return F.coalesce(F.lower(squash(x)), F.lit(""))


def blank_to_empty(q: Column) -> Column:
    """A query key with the values that mean "no query" replaced by the empty string."""
    return F.when(q.isin(*BLANK_QUERIES), F.lit("")).otherwise(q)


@pandas_udf(StringType())
def _fold_marks(values: pd.Series) -> pd.Series:
    def one(v: str) -> str:
        if v.isascii():
            return v.lower()
        v = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", v).lower())
        return "".join(c for c in v if not unicodedata.category(c).startswith("M"))

    return values.map(one, na_action="ignore")


# Values made into Python strings at a time; those of a whole batch take several times their bytes.
DECOMPOSED_AT_ONCE = 64


def decomposed(values: pa.Array) -> pa.Array:
    """The compatibility decomposition of every value; few of them are Python strings at a time."""
    one = lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKD", v)
    parts = (values[i : i + DECOMPOSED_AT_ONCE] for i in range(0, len(values), DECOMPOSED_AT_ONCE))
    made = [pa.array(map(one, p.to_pylist()), pa.string(), size=len(p)) for p in parts]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@arrow_udf(StringType())
def _decompose(values: pa.Array) -> pa.Array:
    return decomposed(values)


def search_normalize(x: Column, ascii_only: bool = False) -> Column:
    """FN-02: compatibility-composed, lower-case, mark-free text with punctuation blanked.

    Unicode normal forms have no built-in function, so that one step is an Arrow
    UDF; ``ascii_only=True`` skips it for columns known to hold ASCII.
    """
    folded = F.lower(x) if ascii_only else _fold_marks(x)
    kept = F.regexp_replace(folded, DROPPED, "")
    return F.coalesce(squash(F.regexp_replace(kept, SEPARATORS, " ")), F.lit(""))


def audit_normalize(x: Column) -> Column:
    """FN-03: letters, digits, ``%`` and ``+`` only; points dropped, final letters folded."""
    t = F.regexp_replace(_decompose(F.lower(x)), "[\\u0591-\\u05C7\\u0300-\\u036F]", "")
    t = F.regexp_replace(F.translate(t, FINAL_LETTERS, PLAIN_LETTERS), "[\"'׳״`]", "")
    return F.coalesce(F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}%+]+", " ")), F.lit(""))


def text_list(x: Column) -> Column:
    """FN-09 (string form): comma-joined text to trimmed non-empty items."""
    return F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")


def text_list_array(x: Column) -> Column:
    """FN-09 (array form): trimmed non-empty items."""
    return F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != "")


def words(x: Column) -> Column:
    """Letter-or-digit words of a text that is already normalised."""
    cleaned = F.regexp_replace(x, "[^\\p{L}\\p{N}\\s]", " ")
    return F.filter(F.split(cleaned, WHITE + "+"), lambda w: w != "")


def tokens(x: Column) -> Column:
    """Blank-separated tokens of normalised text."""
    return F.filter(F.split(x, " "), lambda w: w != "")


def stem2(w: Column) -> Column:
    """FN-11: words longer than three letters lose two, three always remain."""
    return F.when(F.length(w) <= 3, w).otherwise(
        F.substring(w, F.lit(1), F.greatest(F.lit(3), F.length(w) - 2)))


def word_matches(word: Column, candidates: Column) -> Column:
    """FN-12: equal to, or (from three letters) sharing a stem prefix with, any candidate."""
    s = stem2(word)
    return F.exists(candidates, lambda w: (w == word) | (
        (F.length(w) >= 3) & (w.startswith(s) | F.startswith(word, stem2(w)))))


def _with_last(w: Column, source: str, target: str) -> Column:
    head = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.concat(head, F.translate(F.right(w, F.lit(1)), source, target))


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def inflections(w: Column) -> Column:
    """FN-13: the other grammatical number(s) of a Hebrew word; empty for other scripts."""
    b3, b2, b1 = _cut(w, 3), _cut(w, 2), _cut(w, 1)
    n = F.length(w)
    closed = _with_last(b2, PLAIN_LETTERS, FINAL_LETTERS)
    opened = _with_last(w, FINAL_LETTERS, PLAIN_LETTERS)
    plural_yot = w.endswith("יות") & (n >= 6)
    plural_ot = w.endswith("ות") & (n >= 5)
    plural_im = w.endswith("ים") & (n >= 5)
    singular_h = w.endswith("ה") & (n >= 4)
    bare = ~(w.endswith("ות") | w.endswith("ים") | w.endswith("ה"))
    forms = F.array(
        F.when(plural_yot, F.concat(b3, F.lit("יה"))),
        F.when(plural_yot, F.concat(b3, F.lit("ייה"))),
        F.when(plural_yot, F.concat(b3, F.lit("ית"))),
        F.when(plural_ot, F.concat(b2, F.lit("ה"))),
        F.when(plural_ot, F.concat(b2, F.lit("ת"))),
        F.when(plural_ot, closed),
        F.when(plural_im, closed),
        F.when(singular_h, F.concat(b1, F.lit("ות"))),
        F.when(singular_h & b1.endswith("י"), F.concat(b2, F.lit("יות"))),
        F.when(bare, F.concat(opened, F.lit("ים"))),
        F.when(bare, F.concat(opened, F.lit("ות"))))
    kept = F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (f != w)))
    empty = F.array().cast("array<string>")
    return F.when(w.rlike("^[\\u05d0-\\u05ea]+$") & (n >= 3), kept).otherwise(empty)


def prefix_stems(w: Column) -> Column:
    """FN-14: the word without one, two, three leading prefix letters (longest first)."""
    can = lambda x: x.rlike(f"^[{PREFIX_LETTERS}]") & (F.length(x) > 3)
    hebrew = w.rlike("^[\\u05d0-\\u05ea]+$")
    s1 = F.when(hebrew & can(w), w.substr(F.lit(2), F.length(w)))
    s2 = F.when(can(s1), s1.substr(F.lit(2), F.length(s1)))
    s3 = F.when(can(s2), s2.substr(F.lit(2), F.length(s2)))
    return F.filter(F.array(s1, s2, s3), lambda x: x.isNotNull())


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """FN-15: Levenshtein distance, ``limit + 1`` once it exceeds ``limit``."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


def apply_spelling(query: Column, aliases: dict[str, str]) -> Column:
    """FN-21: whole-word or phrase corrections, longest phrase first.

    ``query`` and the aliases are normalised text; a replacement that overlaps the
    next occurrence needs a second pass, hence the doubled application.
    """
    text = F.concat(F.lit(" "), query, F.lit(" "))
    for source, target in sorted(aliases.items(), key=lambda kv: -len(kv[0])):
        if source and source != target:
            for _ in range(2):
                text = F.replace(text, F.lit(f" {source} "), F.lit(f" {target} "))
    return F.trim(text)


def max_price(query: Column) -> Column:
    """FN-20: the number of an "up to N" clause."""
    return F.regexp_extract(query, PRICE_CLAUSE, 1).try_cast("double")


def keyboard_layout(x: Column) -> Column:
    """FN-16: Hebrew letters replaced by the Latin letters on the same keys."""
    return F.translate(x, HEBREW_KEYS, LATIN_KEYS)


def swap_typo(x: Column) -> Column:
    """FN-17: the two middle letters of the (first) longest word swapped; null below four letters."""
    ws = F.split(x, " ")
    best = F.array_max(F.transform(ws, lambda w: F.length(w)))
    longest = F.element_at(F.filter(ws, lambda w: F.length(w) == best), 1)
    i = F.floor(F.length(longest) / 2).cast("int")
    swapped = F.concat(F.substring(longest, F.lit(1), i - 1), F.substring(longest, i + 1, F.lit(1)),
                       F.substring(longest, i, F.lit(1)), F.substring(longest, i + 2, F.length(longest)))
    pos = F.array_position(ws, longest).cast("int")
    out = F.array_join(F.transform(ws, lambda w, k: F.when(k == pos - 1, swapped).otherwise(w)), " ")
    return F.when((best >= 4) & (out != x), out)


def article_prefixed(x: Column) -> Column:
    """FN-18: a single Hebrew word with the article put in front."""
    fits = x.rlike("[\\u05d0-\\u05ea]") & ~x.rlike("^[הוב]") & ~x.contains(" ")
    return F.when(fits, F.concat(F.lit("ה"), x))


def title_matches(query: Column, title: Column) -> Column:
    """FN-19: some query word, or its form without article or plural ending, occurs in the title.

    Both arguments are audit-normalised text (final letters folded).
    """
    def forms(w):
        bare = F.when((F.length(w) > 3) & w.rlike("^[הובל]"), w.substr(F.lit(2), F.length(w))).otherwise(w)
        cut = F.when(F.length(bare) > 4, F.regexp_replace(bare, "(ימ|ות|ה)$", "")).otherwise(bare)
        return F.array(w, bare, cut)

    long_words = F.filter(F.split(query, " "), lambda w: F.length(w) >= 2)
    return F.exists(long_words, lambda w: F.exists(
        forms(w), lambda v: (F.length(v) >= 2) & F.contains(title, v)))
