"""Text expressions: words, normalisation, fingerprints, markup, token estimates and language scores.

White space is Unicode white space throughout; null texts give null unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stopwords
from .arrays import let

TOKENS_PER_WORD = 1.45
#: Fixed value: letters and other word characters that are no decimal digits.
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Fixed value: runs of Latin letters and apostrophes, on lower-cased text.
LATIN_TOKEN = "[a-zà-öø-ÿœæ']+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def strip(text: Column) -> Column:
    """Without white space at either end, as str.strip()."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def estimate_tokens(count: Column) -> Column:
    """Tokens that so many words are worth, truncated."""
    return F.floor(count.cast("double") * F.lit(TOKENS_PER_WORD)).cast("bigint")


def format_tokens(n: Column, *, billions: bool = True) -> Column:
    """A count with the suffix Md, M or k, without ``billions`` M at most; decimal ties go to the even digit."""
    d = n.cast("double")
    millions = F.format_string("%.2f M", F.bround(d / 1e6, 2))
    return (
        F.when(n >= 10**9, F.format_string("%.2f Md", F.bround(d / 1e9, 2)) if billions else millions)
        .when(n >= 10**6, millions)
        .when(n >= 10**3, F.format_string("%.1f k", F.bround(d / 1e3, 1)))
        .otherwise(n.cast("string"))
    )


def mapped(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """``change`` of every text that is not null, in Arrow batches."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else change(t) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


#: Marks beside Latin letters; and runs beyond, where others may be (general punctuation has none).
_MARKS, _OTHERS = re.compile("[\u0300-\u036f]+"), re.compile("[^\x00-\u036f\u2010-\u2027\u2030-\u205e]+")


def folded(t: str) -> str:
    """Lower case without accents."""
    if t.isascii():
        return t.lower()
    bare = _MARKS.sub("", unicodedata.normalize("NFD", t.lower()))
    return _OTHERS.sub(lambda m: "".join(c for c in m[0] if unicodedata.category(c) != "Mn"), bare)


_fold = folded

#: The Latin blocks beyond ASCII.
_LATIN_BLOCKS = [chr(c) for c in (*range(0x80, 0x250), *range(0x1E00, 0x1F00))]
#: What translate() folds on the JVM, and what it folds to.
LATIN = "".join(c for c in _LATIN_BLOCKS if len(folded(c)) == 1)
FOLDED = "".join(map(folded, LATIN))
#: A character that is neither that, nor general punctuation, which folds to itself.
BEYOND = r"[^\x00-\x{24F}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}\x{2030}-\x{205E}]" + "".join(f"|{c}" for c in _LATIN_BLOCKS if c not in LATIN)


def nfc(text: Column) -> Column:
    """Composed form. Spark has no function for it, so texts with a character from U+0300 on take an Arrow UDF.

    A UDF is evaluated for every row, so the others go to it as nulls.
    """
    there = F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)
    return F.coalesce(mapped(lambda t: unicodedata.normalize("NFC", t))(there), text)


def fold(text: Column) -> Column:
    """Lower case without accents; texts of composed Latin letters stay on the JVM, the others take an Arrow UDF."""
    return F.coalesce(mapped(folded)(F.when(text.rlike(BEYOND), text)), F.lower(F.translate(text, LATIN, FOLDED)))


#: What Python takes for white space beyond Unicode's.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CONTROLS, _BLANKS, _EMPTY_LINES = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), re.compile("[ \t]{2,}"), re.compile("\n{3,}")


def normalized(t: str, *, unify_apostrophes: bool = True, compose: bool = True) -> str:
    out = _CONTROLS.sub("", unicodedata.normalize("NFC", t) if compose else t)
    if unify_apostrophes:
        out = out.replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"')
    # Looking for a string is many times faster than a pattern that tries at every blank.
    if "  " in out or "\t" in out:
        out = _BLANKS.sub(" ", out)
    if "\n\n\n" in out:
        out = _EMPTY_LINES.sub("\n\n", out)
    return "\n".join(map(str.rstrip, out.split("\n"))).strip()


def normalize(text: Column, *, unify_apostrophes: bool = True, compose: bool = True) -> Column:
    """NFC, no control characters, ASCII quotes, single spaces, at most one blank line, no trailing white space.

    One pass in Arrow batches: a pattern after another on the JVM costs many times as much.
    """
    return mapped(lambda t: normalized(t, unify_apostrophes=unify_apostrophes, compose=compose))(text)


def split(t: str) -> list[str]:
    """The words of a text, as :func:`words` cuts them."""
    return _SEPARATORS.sub("\0", t).split()


_LETTER = re.compile(r"[^\W\d_]")


def word_figures(text: Column) -> Column:
    """A struct of a text's words, their characters, and the words with a letter; counted once however many steps ask."""

    def run(x: pa.Array) -> pa.Array:
        rows = []
        for t in x.to_pylist():
            if t is None:
                rows.append(None)
                continue
            w = split(t)
            lettered = sum(x.isalpha() or _LETTER.search(x) is not None for x in w)
            rows.append({"words": len(w), "chars": len("".join(w)), "lettered": lettered})
        return pa.array(rows, pa.struct([("words", pa.int32()), ("chars", pa.int64()), ("lettered", pa.int32())]))

    return F.arrow_udf(run, "words int, chars bigint, lettered int")(text)


def fingerprint(text: Column) -> Column:
    """A hash of the text that ignores case and white space."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")).cast("binary"))


def prefix_fingerprint(text: Column, length: int = 400) -> Column:
    """A hash of the first code points, as they are."""
    return F.md5(F.substring(text, 1, length).cast("binary"))


def strip_markdown(text: Column, *, keep_code: bool = True) -> Column:
    """Without front matter, embeds, link targets and lines of tags; embeds go before links.

    The patterns are fixed values; letters of any language are letters of a tag.
    """
    out = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    out = F.regexp_replace(out, r"!\[\[[^\]]+\]\]", "")
    out = F.regexp_replace(out, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[([^\]|]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?mdU)^#[\w/-]+(?:\s+#[\w/-]+)*\s*$", "")
    if not keep_code:
        out = F.regexp_replace(out, r"(?s)```.*?```", "")
    return strip(out)


def strip_book_frame(text: Column) -> Column:
    """What lies between a digital library's START and END marks (fixed values); all of it where they are missing."""
    start = r"(?i)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
    end = r"(?i)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG.*?\*\*\*"
    after = F.when(text.rlike(start), F.element_at(F.split(text, start, 2), -1)).otherwise(text)
    return strip(let(after, lambda t: F.split(t, end, 2)[0]))


def with_language_scores(text: Column, body: Callable[[dict[str, Column]], Column], *, max_tokens: int | None = None, least: int = 20) -> Column:
    """``body`` of the shares, by language, of the tokens that are its stop words; 0 below ``least`` tokens.

    The text is cut once. Only the first ``max_tokens`` count, where a bound is asked for.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({LATIN_TOKEN})"), F.lit(1))
    tokens = found if max_tokens is None else F.slice(found, 1, max_tokens)

    def share(t: Column, listed: frozenset) -> Column:
        # A long list of literals is looked up in a hash set.
        return F.when(F.size(t) < least, F.lit(0.0)).otherwise(F.size(F.filter(t, lambda w: w.isin(sorted(listed)))) / F.size(t))

    scores = let(tokens, lambda t: F.struct(*[share(t, listed).alias(lang) for lang, listed in stopwords.LANGUAGES.items()]))
    return let(scores, lambda s: body({lang: s[lang] for lang in stopwords.LANGUAGES}))


def language_scores(text: Column, *, max_tokens: int | None = None, least: int = 20) -> dict[str, Column]:
    """The shares as a column each; what uses several of them cuts the text once by :func:`with_language_scores`."""
    return {lang: with_language_scores(text, lambda s, of=lang: s[of], max_tokens=max_tokens, least=least) for lang in stopwords.LANGUAGES}


def detect_language(scores: dict[str, Column]) -> Column:
    """The language of the best score, the first of equal ones; ``unknown`` if all are 0."""
    best = F.greatest(*scores.values())
    out = F.when(best <= 0, F.lit("unknown"))
    for lang, s in scores.items():
        out = out.when(s == best, F.lit(lang))
    return out
