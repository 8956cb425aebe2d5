"""The forms as SQL functions of a session: ``SELECT identity_match_artist(name) FROM t``.

``register`` makes temporary SQL functions, which Catalyst inlines like any expression. A body is
the SQL of the Column expression, or is composed of functions made before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import artists, export, identity, text

_GROUP = identity.SIMPLE_GROUP.replace("\\", "\\\\")
#: The fold of ``identity.strip_parens`` for nested groups, in SQL.
_PARENS = f"""CASE WHEN x RLIKE '{_GROUP}' THEN rtrim(regexp_replace(x, '{_GROUP}', '$1'))
 WHEN x RLIKE '[)\\\\]] *\\\\z' THEN coalesce(get(transform(array(length(rtrim(x)) - aggregate(split(reverse(rtrim(x)), ''), named_struct('depth', 0, 'seen', 0, 'hit', 0),
  (acc, c) -> named_struct('depth', acc.depth + CASE WHEN c = right(rtrim(x), 1) THEN 1 WHEN c = translate(right(rtrim(x), 1), ')]', '([') THEN -1 ELSE 0 END, 'seen', acc.seen + 1,
   'hit', CASE WHEN acc.hit = 0 AND acc.depth + CASE WHEN c = right(rtrim(x), 1) THEN 1 WHEN c = translate(right(rtrim(x), 1), ')]', '([') THEN -1 ELSE 0 END = 0 THEN acc.seen + 1 ELSE acc.hit END),
  acc -> acc.hit)), at -> CASE WHEN at > 0 AND at < length(rtrim(x)) THEN rtrim(substr(x, 1, at)) END), 0), x) ELSE x END"""

_OTHER = text.OTHER.replace("\\", "\\\\")
_TABLE = ", ".join("'" + v.replace("'", "\\'") + "'" for pair in text.LETTERS.items() for v in pair)
#: ``transliterate`` of other scripts, by a table.
_OTHER_LETTERS = f"array_join(transform(split(x, ''), c -> coalesce(try_element_at(map({_TABLE}), c), c)), '')"

#: Name -> a Column form, or SQL over earlier functions (``{p}`` is the prefix).
FUNCTIONS = {
    "match_form": text.match_form,
    "storage_form": text.storage_form,
    # arguments are worked out before a CASE around the call
    "plain_letters": lambda x: F.when(x.isNotNull(), text._plain_letters(x)),
    "other_letters": _OTHER_LETTERS,
    "before_letters": text.before_letters,
    "after_letters": text.after_letters,
    "ascii_letters": f"CASE WHEN x RLIKE '[{_OTHER}]' THEN {{p}}other_letters({{p}}plain_letters({{p}}other_letters(x))) ELSE {{p}}plain_letters(x) END",
    "ascii_of_match": "CASE WHEN octet_length(x) = char_length(x) THEN x WHEN x IS NOT NULL THEN {p}after_letters({p}ascii_letters({p}before_letters(x))) END",
    "ascii_form": "{p}ascii_of_match({p}match_form(x))",
    "fix_mojibake": text.fix_mojibake,
    "collapse_space": text.collapse_space,
    "collapse_punctuation": identity.collapse_punctuation,
    "strip_disambiguator": identity.strip_disambiguator,
    "strip_trailing_parens": _PARENS,
    "drop_articles": identity.drop_articles,
    "identity_baseline": "{p}drop_articles({p}strip_trailing_parens({p}match_form(x)))",
    "identity_match_artist": "{p}collapse_space({p}identity_baseline(x))",
    "identity_match_title": "{p}collapse_space({p}identity_baseline(x))",
    "identity_match_with_punctuation": "{p}collapse_space({p}collapse_punctuation({p}identity_baseline(x)))",
    "identity_match_with_disambiguator_strip": "{p}strip_disambiguator({p}collapse_space({p}identity_baseline(x)))",
    "is_compilation_artist": artists.is_compilation,
    "pg_text_form": export.remove_nul,
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions in the session; their names."""
    probe = spark.createDataFrame([], "x string")
    made = []
    for name, form in FUNCTIONS.items():
        if isinstance(form, str):
            body = form.replace("{p}", prefix)
        else:
            body = _sql_of(probe, form(F.col("x")))
        kind = "BOOLEAN" if name == "is_compilation_artist" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS {kind} RETURN {body}")
        made.append(prefix + name)
    return made


def _sql_of(probe: DataFrame, form: Column) -> str:
    """The SQL of a form of the column x."""
    analyzed = probe.select(form.alias("y"))._jdf.queryExecution().analyzed()
    return analyzed.projectList().head().child().sql()
