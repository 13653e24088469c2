"""Text columns: normal forms, tokens, script flags, plausibility, romanisation.

Everything here is a native column expression, so it stays inside the JVM and needs no shuffle.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from modwarden import fixed_values as fv
from modwarden.profiles import OcrPolicy

# Java's \s alone is ASCII; with the flag it is the Unicode White_Space property.
U = "(?U)"
LETTERS = r"a-zऀ-ॿ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Compute a value once and use it many times in one expression.

    Spark shares common subexpressions only outside conditionals and lambdas; a lambda variable is
    a value, so binding through a one-element array pins the work.
    """
    return F.transform(F.array(value), body)[0]


@cache
def accent_map() -> tuple[str, str]:
    """Precomposed letters and the base letter each one decomposes to."""
    src, dst = [], []
    for code in range(0x00C0, 0xD800):
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.category(x).startswith("M"))
        if base != ch and len(base) == 1 and ("a" <= base <= "z" or "ऀ" <= base <= "ॿ"):
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold_accents(c: Column | str) -> Column:
    """Drop diacritics; plain ASCII text is passed through untouched."""
    c = _col(c)
    src, dst = accent_map()
    folded = F.regexp_replace(F.translate(c, src, dst), r"\p{M}+", "")
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(folded)


def normalize_for_match(c: Column | str) -> Column:
    """Lower, fold accents, other characters to spaces, runs of three or more to two."""
    folded = fold_accents(F.lower(_col(c)))
    spaced = F.regexp_replace(folded, f"[^{LETTERS}]+", " ")
    return F.regexp_replace(spaced, f"([{LETTERS}])\\1{{2,}}", "$1$1")


def collapse_repeats(c: Column | str) -> Column:
    """Every run of one repeated character becomes a single one."""
    return F.regexp_replace(_col(c), r"(.)\1+", "$1")


def normalize_for_dedupe(c: Column | str) -> Column:
    """Lower, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), rf"{U}\s+", " "))


def squeeze(c: Column | str) -> Column:
    """Whitespace runs to one space, trimmed; case kept."""
    return F.trim(F.regexp_replace(_col(c), rf"{U}\s+", " "))


def strip(c: Column | str) -> Column:
    """Trim with the Unicode whitespace class."""
    return F.regexp_replace(_col(c), rf"{U}^\s+|\s+$", "")


def text_digest(c: Column | str) -> Column:
    """Narrow identity of the deduplication form, so shuffles carry 32 characters and no texts."""
    return F.md5(normalize_for_dedupe(c))


def tokens(norm: Column | str) -> Column:
    """Tokens of a match-normalised text: its words, as it holds only letters and single spaces."""
    return F.filter(F.split(F.trim(_col(norm)), " "), lambda t: t != "")


def tokenize(c: Column | str) -> Column:
    """Tokens of a raw text."""
    return F.regexp_extract_all(normalize_for_match(c), F.lit(f"([{LETTERS}]+)"), F.lit(0))


def has_devanagari(c: Column | str) -> Column:
    return _col(c).rlike(r"[ऀ-ॿ]")


def has_latin(c: Column | str) -> Column:
    return _col(c).rlike(r"[a-zA-Z]")


def plausibility(c: Column | str, policy: OcrPolicy = OcrPolicy()) -> Column:
    """0..1 score of whether a string is language and no image noise; a broken rule gives 0."""

    consonants = "b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ"
    short = "|".join(fv.SHORT_WORDS)

    def measured(t: Column) -> Column:
        # Words reduced to their letters; what holds no letter vanishes between two spaces.
        spaced = F.regexp_replace(F.regexp_replace(t, rf"{U}[^A-Za-z\s]+", ""), rf"{U}\s+", " ")
        return F.struct(
            F.length(t).alias("len"),
            F.trim(spaced).alias("words"),
            F.regexp_count(t, F.lit(r"(.)\1{3,}")).alias("runs"),
        )

    def counted(m: Column) -> Column:
        words = m["words"]
        letters = F.length(F.replace(words, F.lit(" "), F.lit("")))
        return F.struct(
            m["len"].alias("len"),
            m["runs"].alias("runs"),
            letters.alias("letters"),
            F.when(words == "", 0).otherwise(F.length(words) - letters + 1).alias("n"),
            F.regexp_count(words, F.lit(rf"\b[{consonants}]++\b")).alias("vowelless"),
            # Only the words of one or two letters, each with its space.
            F.lower(F.regexp_replace(words, "[A-Za-z]{3,}+ ?", "")).alias("short"),
        )

    def score(m: Column) -> Column:
        n = m["n"]
        vowel_share, mean_len = (n - m["vowelless"]) / n, m["letters"] / n
        fragments = F.regexp_count(m["short"], F.lit("[a-z]+")) - F.regexp_count(
            m["short"], F.lit(rf"\b(?:{short})\b")
        )
        value = (
            F.lit(0.35)
            + 0.25 * F.least(F.lit(1.0), vowel_share)
            + 0.20 * F.least(F.lit(1.0), mean_len / 4)
            + 0.20 * F.least(F.lit(1.0), n / 2)
        )
        return (
            F.when(m["len"] < policy.min_chars, 0.0)
            .when(m["letters"] / m["len"] < 0.45, 0.0)
            .when(n == 0, 0.0)
            .when(vowel_share < 0.5, 0.0)
            .when(fragments / n > 0.4, 0.0)
            .when(mean_len < 1.4, 0.0)
            .when(m["runs"] > 2, 0.0)
            .otherwise(F.least(F.lit(1.0), value))
        )

    t = F.coalesce(strip(c), F.lit(""))
    return let(t, lambda v: let(measured(v), lambda m: let(counted(m), score)))


def ocr_candidate_score(text: Column | str, conf: Column | str) -> Column:
    """Plausibility times confidence; null when the text is not plausible."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(conf) / 100))
    return let(plausibility(squeeze(text)), lambda p: F.when(p > 0, p * (0.4 + 0.6 * share)))


def romanize_devanagari(c: Column | str) -> Column:
    """Devanagari runs as plain lower-case Latin; other text is untouched."""
    c = _col(c)
    consonants = "".join(k for k, _ in fv.DEVANAGARI_CONSONANTS)
    signs = "".join(k for k, _ in fv.DEVANAGARI_SIGNS)
    # Dotted letters: two have a sound of their own, the rest lose the dot.
    out = F.regexp_replace(c, "ड़|ड़", "र")
    out = F.regexp_replace(out, "ढ़|ढ़", "र्ह")
    out = F.regexp_replace(F.translate(out, "क़ख़ग़ज़फ़य़", "कखगजफय"), "़", "")
    out = F.regexp_replace(out, f"([{consonants}])(?![{signs}्])", "$1a")
    table = fv.DEVANAGARI_CONSONANTS + fv.DEVANAGARI_VOWELS + fv.DEVANAGARI_SIGNS + fv.DEVANAGARI_OTHER
    # What follows the first letter of a sound is written behind all characters that share it, in one pass each.
    for rest in sorted({v[1:] for _, v in table if len(v) > 1}):
        out = F.regexp_replace(out, f"([{''.join(k for k, v in table if v[1:] == rest)}])", "$1" + rest)
    out = F.translate(out, "".join(k for k, _ in table) + "्", "".join(v[0] for _, v in table))
    return F.when(has_devanagari(c), out).otherwise(c)
