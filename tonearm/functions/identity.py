"""Identity keys: what two spellings of one artist or title share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space, let, match_form

#: White_Space and the four separators U+001C to U+001F.
_SPACES = "\\p{IsWhite_Space}\\x{1C}-\\x{1F}"

#: A text that ends in a group without inner brackets of its kind, after something.
SIMPLE_GROUP = "(?s)\\A(.+?) *(?:\\([^()]*\\)|\\[[^\\[\\]]*\\]) *\\z"


def _nested_parens(x: Column) -> Column:
    """Nesting is not regular: a fold over the characters from the right finds the opener."""

    def cut(trimmed: Column) -> Column:
        close = F.right(trimmed, F.lit(1))
        opener = F.when(close == ")", "(").otherwise("[")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("hit"))

        def step(acc: Column, c: Column) -> Column:
            depth = acc["depth"] + F.when(c == close, 1).when(c == opener, -1).otherwise(0)
            seen = acc["seen"] + 1
            return F.struct(depth.alias("depth"), seen.alias("seen"), F.when((acc["hit"] == 0) & (depth == 0), seen).otherwise(acc["hit"]).alias("hit"))

        hit = F.aggregate(F.split(F.reverse(trimmed), ""), start, step, lambda acc: acc["hit"])
        return let(F.char_length(trimmed) - hit, lambda at: F.when((at > 0) & (at < F.char_length(trimmed)), F.rtrim(F.substr(trimmed, F.lit(1), at))))

    return F.coalesce(let(F.rtrim(x), cut), x)


def strip_parens(x: Column) -> Column:
    """Drop one trailing bracket group, balanced in its own kind of bracket.

    Without an opener, or with the opener first, the text stays as it is. A group without inner
    brackets of its kind, the common case, is one regular expression.
    """

    def form(v: Column) -> Column:
        simple = SIMPLE_GROUP
        return F.when(v.rlike(simple), F.rtrim(F.regexp_replace(v, simple, "$1"))).when(v.rlike("[)\\]] *\\z"), _nested_parens(v)).otherwise(v)

    return let(x, form)


def drop_articles(x: Column) -> Column:
    """Drop one leading ``the``, ``a`` or ``an``, or else one after a trailing comma."""
    return F.regexp_replace(x, "(?s)\\A(?:(?:the|an?) (.*)|((?!(?:the|an?) ).+), (?:the|an?))\\z", "$1$2")


def collapse_punctuation(x: Column) -> Column:
    """Runs of what is neither letter, number nor white space become one space."""
    return F.regexp_replace(x, "[^\\p{L}\\p{N}\\p{IsWhite_Space}]+", " ")


def strip_disambiguator(x: Column) -> Column:
    """Drop a trailing `` /N``; at least one space must precede the slash."""
    return F.regexp_replace(x, " +/[0-9]+\\z", "")


def strip_leading_article(x: Column) -> Column:
    """For text in lower case: an article and all white space after it; a bare article gives ''."""
    return F.regexp_replace(x, f"\\A(?:the|an|a)(?:[{_SPACES}]+|\\z)", "")


def _key(x: Column) -> Column:
    return drop_articles(strip_parens(match_form(x)))


def identity_form(x: Column) -> Column:
    return collapse_space(_key(x))


def identity_form_title(x: Column) -> Column:
    """The same as for artists today; a function of its own so that callers say what they mean."""
    return identity_form(x)


def identity_form_punctuation(x: Column) -> Column:
    return collapse_space(collapse_punctuation(_key(x)))


def identity_form_disambiguator(x: Column) -> Column:
    return strip_disambiguator(identity_form(x))


def identity_key_with_fallback(x: Column) -> Column:
    """``struct<key, fallback>``: the punctuation form; if empty, the plain form, then the input."""

    def pick(k: Column) -> Column:
        strict, plain = k["strict"], k["plain"]
        key = F.when(strict != "", strict).when(plain != "", plain).otherwise(x)
        return F.struct(key.alias("key"), F.coalesce(strict == "", F.lit(False)).alias("fallback"))

    forms = let(_key(x), lambda k: F.struct(collapse_space(collapse_punctuation(k)).alias("strict"), collapse_space(k).alias("plain")))
    return let(forms, pick)
