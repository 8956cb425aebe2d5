"""Text forms as Column -> Column functions.

All are NULL in, NULL out. ``or_empty`` gives the other convention, NULL -> ''. Unicode
normalisation comes from the ICU classes in Spark's own jars, through ``reflect``; ASCII text,
which normalisation leaves alone, takes a path without it. ``*_arrow`` forms do the same in an
Arrow UDF, should those classes ever be missing.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of code page 1252 at bytes 80 to 9F, and those bytes.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
#: Characters that begin most misread UTF-8 sequences.
MOJIBAKE_TRIGGERS = "ÂÃÄÅÎÏÐÑØÙÚÛâ"
#: Ranges whose characters lose their combining marks (Latin, Greek and below).
MARKED_RANGES = ("\\x{0000}-\\x{024F}", "\\x{1E00}-\\x{1EFF}", "\\x{2C60}-\\x{2C7F}", "\\x{A720}-\\x{A7FF}", "\\x{AB30}-\\x{AB6F}", "\\x{0370}-\\x{03FF}", "\\x{1F00}-\\x{1FFF}")

_ICU = "com.ibm.icu.text.Normalizer"


def _reflected(method: str, x: Column, compat: bool) -> Column:
    # reflect raises on NULL, so callers guard; it is never folded, so it runs once per row
    return F.call_function("reflect", F.lit(_ICU), F.lit(method), x, F.lit(compat))


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.char_length(x)


def let(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _guarded(x: Column, method: str, compat: bool) -> Column:
    return F.when(is_ascii(x), x).when(x.isNotNull(), _reflected(method, x, compat))


def nfc(x: Column) -> Column:
    return _guarded(x, "compose", False)


def nfkc(x: Column) -> Column:
    return _guarded(x, "compose", True)


def nfd(x: Column) -> Column:
    return _guarded(x, "decompose", False)


def trim_space(x: Column) -> Column:
    """U+0020 only, both ends."""
    return F.trim(x)


def fix_mojibake(x: Column) -> Column:
    """Undo one reading of UTF-8 as code page 1252, if the whole text decodes.

    A text with a trigger that decodes has a character of several bytes, so it gets shorter.
    """
    suspect = x.rlike(f"[{MOJIBAKE_TRIGGERS}]") & x.rlike(f"\\A[\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}{CP1252_CHARS}]*\\z")
    as_bytes = F.encode(F.translate(x, CP1252_CHARS, CP1252_BYTES), "ISO-8859-1")
    return F.coalesce(F.when(suspect, F.try_validate_utf8(as_bytes.cast("string"))), x)


# Below, ``_..._raw`` forms take text that is neither NULL nor ASCII; each names its input once,
# so that chains of them stay as long as they look.


def _storage_raw(x: Column) -> Column:
    return trim_space(_reflected("compose", fix_mojibake(x), False))


def storage_form(x: Column) -> Column:
    """Repaired, NFC, trimmed. Keeps case, marks and inner spaces."""
    return F.when(is_ascii(x), trim_space(x)).when(x.isNotNull(), _storage_raw(x))


def _marks_raw(x: Column) -> Column:
    bare = F.regexp_replace(_reflected("decompose", x, False), f"(?<=[{''.join(MARKED_RANGES)}])\\p{{M}}+", "")
    return _reflected("compose", bare, False)


def strip_marks(x: Column) -> Column:
    """Drop combining marks after Latin and Greek base characters; NFC."""
    return F.when(is_ascii(x), x).when(x.isNotNull(), _marks_raw(x))


def apply_folds(x: Column) -> Column:
    return F.replace(F.replace(F.translate(x, "ς", "σ"), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def strip_cf(x: Column) -> Column:
    """Drop format characters except U+200D."""
    return F.regexp_replace(x, "[\\p{Cf}&&[^\\x{200D}]]", "")


def collapse_space(x: Column) -> Column:
    """Runs of U+0020 become one; both ends trimmed; no other white space is touched."""
    return F.trim(F.regexp_replace(x, " {2,}", " "))


#: ASCII and the letters of Latin-1, which both normal forms leave alone. None of them can be a
#: continuation byte of misread UTF-8, so such a text is never repaired.
_LATIN1 = "\\A[\\x{00}-\\x{7F}À-ÖØ-öø-ÿ]*\\z"
_MARKED = [c for c in map(chr, range(0xE0, 0x100)) if len(unicodedata.normalize("NFD", c)) > 1]
_BARE = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def match_form(x: Column) -> Column:
    """The comparison form: storage form, NFKC, lower case, marks, folds, format characters, spaces.

    ASCII and Latin-1 texts, most names, take short ways to the same result.
    """
    latin = F.replace(F.translate(F.lower(x), "".join(_MARKED), _BARE), F.lit("æ"), F.lit("ae"))
    full = collapse_space(strip_cf(apply_folds(_marks_raw(F.lower(_reflected("compose", _storage_raw(x), True))))))
    return F.when(is_ascii(x), collapse_space(F.lower(x))).when(x.rlike(_LATIN1), collapse_space(latin)).when(x.isNotNull(), full)


#: The ranges of characters that rules are made for, those that lose their marks.
_RULE_RANGES = ((0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0x370, 0x3FF), (0x1F00, 0x1FFF))


def unaccent_rules(spark: SparkSession) -> DataFrame:
    """``source, target``: lower-case characters that the match form changes, and what to.

    Rules for a database's unaccent dictionary: no empty target and none with white space.
    """
    points = F.explode(F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in _RULE_RANGES])).alias("points")
    each = spark.range(1).select(points).select(F.explode("points").alias("point"))
    rows = each.select(F.decode(F.unhex(F.lpad(F.hex("point"), 8, "0")), "UTF-32").alias("source")).where(F.lower("source") == F.col("source"))
    rows = rows.withColumn("target", match_form(F.col("source")))
    return rows.where((F.col("target") != F.col("source")) & (F.col("target") != "") & ~F.col("target").rlike("\\p{IsWhite_Space}")).select("source", "target")


# ---- ASCII form

#: Cyrillic and Greek letters, and Latin letters that do not decompose.
_ONE = (
    "абвгдезийклмнопрстуфыэіґ" "αβγδεζηικλμνοπρστυφω" "łøđıħŧðĸŋſƒɓɗəɛɨɲʀʉ",
    "abvgdezijklmnoprstufyeig" "abgdeziiklmnoprstufo" "lodihtdknsfbdeeinru",
)
_MANY = {
    "ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ъ": "", "ь": "'", "є": "ie", "ї": "yi", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
    "θ": "th", "ξ": "x", "χ": "kh", "ψ": "ps", "ß": "ss", "þ": "th", "ĳ": "ij", "ŉ": "'n",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": ",,", "–": "-", "—": "--", "‐": "-", "…": "...", "•": "*", "×": "x", "÷": "/", "¡": "!", "¿": "?", "«": "<<", "»": ">>", "€": "eur", "£": "ps", "¥": "y=", " ": " ",
}


def _in_order(first: int, names: str) -> dict[str, str]:
    """Consecutive code points and their letters; ``-`` stands for none."""
    return {chr(first + i): "" if n == "-" else n for i, n in enumerate(names.split())}


def _kana() -> dict[str, str]:
    """Syllables by their rows and vowels, for hiragana; katakana is 96 code points on."""
    out, at = {}, 0x3041

    def put(*names: str) -> None:
        nonlocal at
        for n in names:
            out[chr(at)], out[chr(at + 0x60)] = n, n
            at += 1

    for v in "aiueo":
        put(v, v)  # small and full size
    for plain, voiced in (("k", "g"), ("s", "z"), ("t", "d")):
        for v in "aiueo":
            here = {"si": "shi", "ti": "chi", "tu": "tsu"}.get(plain + v, plain + v)
            put(*([here] if here == "tsu" else []), here, voiced + v)
    put(*(f"n{v}" for v in "aiueo"))
    for v in "aiueo":
        put(f"h{v}", f"b{v}", f"p{v}")
    put(*(f"m{v}" for v in "aiueo"))
    for v in "auo":
        put(f"y{v}", f"y{v}")
    put(*(f"r{v}" for v in "aiueo"))
    put("wa", "wa", "wi", "we", "wo", "n", "vu")
    return out


#: Letters of other scripts, by the range of their block; Korean syllables decompose to three runs.
_SCRIPTS = {
    "\\x{3041}-\\x{30F4}": _kana(),
    "\\x{1100}-\\x{11C2}": _in_order(0x1100, "g kk n d tt r m b pp s ss - j jj c k t p h") | _in_order(0x1161, "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i") | _in_order(0x11A8, "g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h"),
    "\\x{05D0}-\\x{05EA}": _in_order(0x05D0, "a b g d h v z kh t y k k l m m n n s ` p p ts ts q r sh t"),
    "\\x{0621}-\\x{064A}": _in_order(0x0621, "' a a u' i y' a b h t th j h kh d dh r z s sh s d t z ` gh") | _in_order(0x0641, "f q k l m n h w a y"),
    "\\x{0561}-\\x{0587}": _in_order(0x0561, "a b g d e z e e t` zh i l kh ts k h dz gh ch m y n sh o ch` p j rh s v t r ts` w p` k` o f ew"),
}


def _replaced(x: Column, table: dict[str, str]) -> Column:
    """Each character of the table by its letters: single ones in one pass, others one by one."""
    one = {c: to for c, to in table.items() if len(to) == 1}
    none = [c for c, to in table.items() if not to]
    x = F.translate(x, "".join([*one, *none]), "".join(one.values()))
    for c, to in table.items():
        if len(to) > 1:
            x = F.replace(x, F.lit(c), F.lit(to))
    return x


def _plain_letters(x: Column) -> Column:
    """Latin, Greek and Cyrillic letters in ASCII. Marks that the match form keeps go with their letters."""
    x = _replaced(F.translate(x, *_ONE), _MANY)
    return F.translate(F.regexp_replace(_reflected("decompose", x, False), "\\p{M}+", ""), *_ONE)


#: Characters of the other scripts, and the syllables that decompose to some of them.
OTHER = "".join(_SCRIPTS) + "\\x{AC00}-\\x{D7A3}"
#: Each of them with its letters.
LETTERS = {c: to for table in _SCRIPTS.values() for c, to in table.items()}


def _other_letters(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def transliterate(x: Column) -> Column:
    """Letters of Latin, Greek, Cyrillic, kana, Hangul, Hebrew, Arabic and Armenian in ASCII; the rest
    is left for the caller to drop. Not for NULL. A text takes the shortest way that its letters allow.
    """

    def form(v: Column) -> Column:
        # twice: kana before its voicing marks go, Hangul when it is decomposed
        every = _other_letters(_plain_letters(_other_letters(v)))
        bare = F.translate(F.regexp_replace(_reflected("decompose", F.translate(v, *_ONE), False), "\\p{M}+", ""), *_ONE)
        return F.when(v.rlike(f"[{OTHER}]"), every).when(v.rlike(f"[{''.join(_MANY)}]"), _plain_letters(v)).otherwise(bare)

    return let(x, form)


def before_letters(plain: Column) -> Column:
    return F.replace(F.regexp_replace(plain, "\\p{So}", ""), F.lit("й"), F.lit("i"))


def after_letters(wide: Column) -> Column:
    return collapse_space(F.regexp_replace(F.lower(wide), "[^\\x{00}-\\x{7F}]", ""))


def ascii_of_match(plain: Column) -> Column:
    """The ASCII form of a text in match form."""
    return F.when(is_ascii(plain), plain).when(plain.isNotNull(), after_letters(transliterate(before_letters(plain))))


def ascii_form(x: Column) -> Column:
    """Match form in ASCII: other symbols dropped, letters transliterated, lower case."""
    return let(match_form(x), ascii_of_match)


def or_empty(form, x: Column) -> Column:
    """``form`` with NULL taken and given as the empty text."""
    return form(F.coalesce(x, F.lit("")))


# ---- the same in Arrow UDFs


def _match_form_of(text: str) -> str:
    """One text; used by the Arrow form and as a second implementation in tests."""
    if any(c in MOJIBAKE_TRIGGERS for c in text):
        table = dict(zip(CP1252_CHARS, CP1252_BYTES, strict=True))
        mapped = [table.get(c, c if ord(c) <= 0x7F or 0xA0 <= ord(c) <= 0xFF else None) for c in text]
        if None not in mapped:
            try:
                fixed = "".join(mapped).encode("latin-1").decode("utf-8")
                if not fixed.isascii() and len(fixed.encode()) < len(text.encode()):
                    text = fixed
            except UnicodeDecodeError:
                pass
    text = unicodedata.normalize("NFC", text).strip(" ")
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())
    out, base = [], None
    for c in text:
        if unicodedata.category(c)[0] == "M":
            if base is not None and _loses_marks(base):
                continue
        else:
            base = c
        out.append(c)
    text = unicodedata.normalize("NFC", "".join(out)).replace("ς", "σ").replace("æ", "ae").replace("œ", "oe")
    text = "".join(c for c in text if c == "‍" or unicodedata.category(c) != "Cf")
    return " ".join(w for w in text.split(" ") if w)


def _loses_marks(c: str) -> bool:
    n = ord(c)
    return n <= 0x24F or 0x370 <= n <= 0x3FF or 0x1E00 <= n <= 0x1FFF or 0x2C60 <= n <= 0x2C7F or 0xA720 <= n <= 0xA7FF or 0xAB30 <= n <= 0xAB6F


def match_form_arrow(x: Column) -> Column:
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(_match_form_of, na_action="ignore")

    return form(x)
