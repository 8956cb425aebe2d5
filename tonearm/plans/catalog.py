"""Registered queries over the catalog tables.

The tables hold no music catalog, so one is derived: parts are releases, decorated with the
suffixes and articles that catalogs have; customers and suppliers are artists. Both sides use the
same SQL text for that. Every query covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, sqlfuncs
from ..functions import artists, export, identity, similarity, text
from ..operators import classify, dedup, filters, mapping, pipeline, report, resolve, search
from ..runtime import scratch_path, ship
from ..sinks import copy_text, csv_files, sqlite
from ..sources import files, mysql_dump

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RELEASES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ', The'
 WHEN 2 THEN p_name || ' (Remastered 2019)' WHEN 3 THEN p_name || ' [Live]' WHEN 4 THEN '  ' || upper(p_name) || '   /3'
 ELSE p_name END AS artist, p_type AS title FROM {part}"""
#: Credits: a customer with the suppliers of its nation's number, joined as credits are.
CREDITS = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN c_name || ', ' || c_mktsegment || ', and Various'
 WHEN 1 THEN c_name || ' / ' || c_mktsegment WHEN 2 THEN c_name || ' + ' || c_name WHEN 3 THEN '10,000 Maniacs'
 WHEN 4 THEN c_mktsegment || ' & ' || c_name WHEN 5 THEN 'Various Artists-' || c_mktsegment ELSE '  ' || c_name || ' ' END AS credit FROM {customer}"""
LIBRARY = "SELECT DISTINCT p_name AS artist, p_type AS title FROM {part} WHERE p_size > 10"

_TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def _duck(sql: str) -> str:
    return sql.format(**{t: t for t in _TABLES})


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: files.table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql})


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = _duck(oracle)
        return run

    return add


# ---- text forms over releases; SQL twins for their ASCII names

_MATCH = "trim(regexp_replace(lower(artist), ' +', ' ', 'g'), ' ')"


def _sql_parens(x: str) -> str:
    return f"regexp_replace({x}, '^(.+?) *(?:\\([^()]*\\)|\\[[^\\[\\]]*\\])$', '\\1')"


def _sql_articles(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, 'the ') THEN substr({x}, 5) WHEN starts_with({x}, 'a ') THEN substr({x}, 3) WHEN starts_with({x}, 'an ') THEN substr({x}, 4) "
        f"WHEN ends_with({x}, ', the') AND length({x}) > 5 THEN left({x}, length({x}) - 5) WHEN ends_with({x}, ', a') AND length({x}) > 3 THEN left({x}, length({x}) - 3) "
        f"WHEN ends_with({x}, ', an') AND length({x}) > 4 THEN left({x}, length({x}) - 4) ELSE {x} END"
    )


_KEY = _sql_articles(_sql_parens(_MATCH))
_IDENTITY = f"trim(regexp_replace({_KEY}, ' +', ' ', 'g'), ' ')"
_PUNCT = f"trim(regexp_replace(regexp_replace({_KEY}, '[^\\p{{{{L}}}}\\p{{{{N}}}}\\s]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_DISAMB = f"regexp_replace({_IDENTITY}, ' +/[0-9]+$', '')"


def _form(name: str, form, sql: str) -> None:
    @query(name, f"SELECT id, {sql} AS y FROM ({RELEASES})")
    def run(spark, sf_dir):
        return _rows(spark, sf_dir, RELEASES).select("id", form(F.col("artist")).alias("y"))


_form("collapse_space", text.collapse_space, "trim(regexp_replace(artist, ' +', ' ', 'g'), ' ')")
_form("storage_form_releases", text.storage_form, "trim(artist, ' ')")
_form("match_form_releases", text.match_form, _MATCH)
_form("strip_parens", lambda x: identity.strip_parens(text.match_form(x)), _sql_parens(_MATCH))
_form("drop_articles", lambda x: identity.drop_articles(text.match_form(x)), _sql_articles(_MATCH))
_form("punct_collapse", identity.collapse_punctuation, "regexp_replace(artist, '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g')")
_form("disamb_strip", identity.strip_disambiguator, "regexp_replace(artist, ' +/[0-9]+$', '')")
_form("strip_leading_article", lambda x: identity.strip_leading_article(F.lower(x)), "regexp_replace(lower(artist), '^(?:the|an|a)(?:\\s+|$)', '')")
_form("identity_form", identity.identity_form, _IDENTITY)
_form("identity_form_title", identity.identity_form_title, _IDENTITY)
_form("identity_form_punct", identity.identity_form_punctuation, _PUNCT)
_form("identity_form_disamb", identity.identity_form_disambiguator, _DISAMB)


@query("identity_fallback", f"SELECT id, CASE WHEN p <> '' THEN p WHEN i <> '' THEN i ELSE artist END AS key, p = '' AS fallback FROM (SELECT id, artist, {_PUNCT} AS p, {_IDENTITY} AS i FROM ({RELEASES}))")
def _fallback(spark, sf_dir):
    return _rows(spark, sf_dir, RELEASES).select("id", identity.identity_key_with_fallback(F.col("artist")).alias("k")).select("id", "k.*")


@query("identity_counts", f"SELECT {_DISAMB} AS key, count(*) AS n FROM ({RELEASES}) GROUP BY 1")
def _counts(spark, sf_dir):
    return _rows(spark, sf_dir, RELEASES).groupBy(identity.identity_form_disambiguator(F.col("artist")).alias("key")).agg(F.count("*").alias("n"))


# ---- text forms over documents, whose letters are ASCII and a few accented ones

_PLAIN = "translate(lower(text), 'äçèéêíñóöüàâîïôùûëáúìò', 'aceeeinoouaaiiouueauio')"


@query("match_form", f"SELECT doc_id, md5(trim(regexp_replace({_PLAIN}, ' +', ' ', 'g'), ' ')) AS y FROM {{documents}}")
def _match_documents(spark, sf_dir):
    return files.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_form(F.col("text")).cast("binary")).alias("y"))


@query("storage_form", "SELECT doc_id, md5(trim(text, ' ')) AS y FROM {documents}")
def _storage_documents(spark, sf_dir):
    return files.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.storage_form(F.col("text")).cast("binary")).alias("y"))


@query("strip_marks", "SELECT doc_id, md5(translate(text, 'äçèéêíñóöüÄÇÈÉÊÍÑÓÖÜàâîïôùûëáúìò', 'aceeeinoouACEEEINOOUaaiiouueauio')) AS y FROM {documents}")
def _marks_documents(spark, sf_dir):
    return files.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_marks(F.col("text")).cast("binary")).alias("y"))


@query("ascii_form", f"SELECT doc_id, md5(trim(regexp_replace(replace({_PLAIN}, 'ß', 'ss'), ' +', ' ', 'g'), ' ')) AS y FROM {{documents}}")
def _ascii_documents(spark, sf_dir):
    return files.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_form(F.col("text")).cast("binary")).alias("y"))


def _literal(name: str, form, pairs: list[tuple[str | None, str | None]]) -> None:
    """A form on given texts; the oracle has the wanted results."""
    quote = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(y)})" for i, (_, y) in enumerate(pairs))
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], "i int, x string").select("i", form(F.col("x")).alias("y"))
    ORACLE_SQL[name] = f"SELECT * FROM (VALUES {values}) t(i, y)"


def _decorated(name: str, form, sql: str, decorate: str) -> None:
    """A form over all parts, whose names get the characters that it is about."""
    source = f"SELECT p_partkey AS id, {decorate} AS x FROM {{part}}"

    @query(name, f"SELECT id, {sql} AS y FROM ({source})")
    def run(spark, sf_dir):
        return _rows(spark, sf_dir, source).select("id", form(F.col("x")).alias("y"))


def _turns(*forms: str) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(forms)} = {i} THEN {x}" for i, x in enumerate(forms)) + " END"


_decorated(
    "fix_mojibake",
    text.fix_mojibake,
    "CASE WHEN id % 7 IN (2, 4, 5) THEN x ELSE replace(replace(replace(x, 'Ã©', 'é'), 'Î£', 'Σ'), 'â€™', '’') END",
    _turns("p_name || ' Ã©tude'", "'Î£tella ' || p_name || 'â€™s'", "'EL NIÑO ' || p_name", "p_name", "p_name || ' Ã© 日本'", "'Â ' || p_name || ' Øster'", "p_name || ' â€™'"),
)
_decorated("apply_folds", text.apply_folds, "replace(replace(replace(x, 'ς', 'σ'), 'æ', 'ae'), 'œ', 'oe')", _turns("p_name || ' Στελλας'", "'ægir œuvre ' || p_name", "p_name || ' łøı Æ Œ'", "p_name"))
_decorated("strip_cf", text.strip_cf, "replace(replace(replace(replace(x, '\u200e', ''), '\u202e', ''), '\u202c', ''), '\u00ad', '')", _turns("p_name || '\u200ex'", "'\u202e' || p_name || '\u202c'", "p_name || '\u200db'", "'\u00ad' || p_name || '\u00ad'", "p_name"))
_literal(
    "ascii_literals",
    text.ascii_form,
    [("Аукцыон", "auktsyon"), ("Stereolab 🎸", "stereolab"), ("Łukasz", "lukasz"), ("Björk", "bjork"), ("Στελλάς", "stellas"), ("Кино", "kino"), ("Молчат Дома", "molchat doma"), ("Ё", "yo"), ("Aşıq Altay", "asiq altay"), ("‮Reversed‬", "reversed"), (None, None)],
)
_literal("match_literals", text.match_form, [("NILÜFER YANYA", "nilufer yanya"), ("Στελλάς", "στελλασ"), ("Ё", "ё"), ("Aşıq Altay", "asıq altay"), ("Î£tella", "σtella"), ("café", "cafe"), ("İ", "i"), ("  two   spaces ", "two spaces"), ("", ""), (None, None)])
_IMAGES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN array(named_struct('type', 'secondary', 'uri', p_name), named_struct('type', 'primary', 'uri', p_brand))
 WHEN 1 THEN array(named_struct('type', 'secondary', 'uri', p_name), named_struct('type', 'secondary', 'uri', p_brand)) WHEN 2 THEN CAST(array() AS ARRAY<STRUCT<type: STRING, uri: STRING>>)
 WHEN 3 THEN array(named_struct('type', 'primary', 'uri', p_type), named_struct('type', 'primary', 'uri', p_brand)) END AS images FROM {part}"""


@query("pick_artwork", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_name WHEN 3 THEN p_type END AS y FROM {part}")
def _artwork(spark, sf_dir):
    return _rows(spark, sf_dir, _IMAGES).select("id", export.pick_artwork(F.col("images")).alias("y"))


@query("unaccent_rules")
def _unaccent(spark, sf_dir):
    """Characters that the match form changes, and what to; see ``text.unaccent_rules``."""
    return text.unaccent_rules(spark)


# ---- the forms as SQL functions of the session: of a release's name, or of its match form

_SQL_FORMS = {
    "match_form": _MATCH,
    "strip_trailing_parens": _sql_parens("x"),
    "drop_articles": _sql_articles("x"),
    "identity_baseline": _KEY,
    "identity_match_artist": _IDENTITY,
    "identity_match_title": _IDENTITY,
    "identity_match_with_punctuation": _PUNCT,
    "identity_match_with_disambiguator_strip": _DISAMB,
}


def _sql_form(function: str, sql: str) -> None:
    of_form = function in ("strip_trailing_parens", "drop_articles")
    source = f"SELECT id, {_MATCH} AS x FROM ({RELEASES})" if of_form else RELEASES

    @query(f"sql_{function}", f"SELECT id, {sql} AS y FROM ({source})")
    def run(spark, sf_dir):
        sqlfuncs.register(spark, "tonearm_")
        argument = "tonearm_match_form(artist)" if of_form else "artist"
        return _rows(spark, sf_dir, f"SELECT id, tonearm_{function}({argument}) AS y FROM ({RELEASES})")


for _name, _sql in _SQL_FORMS.items():
    _sql_form(_name, _sql)


# ---- artists

_CREDIT_TRIM = "trim(credit, ' ')"


@query("is_compilation", f"SELECT id, lower(credit) IN ('various','soundtrack','compilation') OR regexp_matches(lower(credit), '^(various artists|v/a|v\\.a|soundtracks)([^\\p{{{{L}}}}\\p{{{{N}}}}]|$)') AS y FROM ({CREDITS})")
def _compilation(spark, sf_dir):
    return _rows(spark, sf_dir, CREDITS).select("id", artists.is_compilation(F.col("credit")).alias("y"))


@query(
    "split_artist",
    f"""SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN c_name || '|' || c_mktsegment || '|Various' WHEN 1 THEN c_name || '|' || c_mktsegment
 WHEN 2 THEN c_name END AS y FROM {{customer}}""",
)
def _split(spark, sf_dir):
    return _rows(spark, sf_dir, CREDITS).select("id", F.array_join(artists.split_artist(F.col("credit")), "|").alias("y"))


_SEGMENTS = "SELECT DISTINCT lower(c_mktsegment) AS key FROM {customer} WHERE c_mktsegment < 'F'"
_SPLIT_CTX = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN c_name || '|' || c_mktsegment || '|Various' WHEN 1 THEN c_name || '|' || c_mktsegment
 WHEN 2 THEN c_name WHEN 4 THEN CASE WHEN c_mktsegment < 'F' THEN c_mktsegment || '|' || c_name END END AS y FROM {customer}"""


@query("split_artist_ctx", _SPLIT_CTX)
def _split_ctx(spark, sf_dir):
    # market segments are a few; ``split_credits`` takes a known set of any size
    rows = _rows(spark, sf_dir, f"SELECT id, credit, (SELECT collect_set(key) FROM ({_SEGMENTS})) AS known FROM ({CREDITS})")
    return rows.select("id", F.array_join(artists.split_artist_contextual(F.col("credit"), F.col("known")), "|").alias("y"))


@query("split_artist_ctx_table", _SPLIT_CTX)
def _split_table(spark, sf_dir):
    out = artists.split_credits(_rows(spark, sf_dir, CREDITS), "id", "credit", _rows(spark, sf_dir, _SEGMENTS), "key")
    return out.select("id", F.array_join("artists", "|").alias("y"))


# ---- export

_ORDER_TEXT = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority || chr(9) || o_orderstatus || chr(10) || '\\' END AS x, substr(CAST(o_orderdate AS {kind}), 1, 10) AS d FROM {{orders}}"
_SPARK_ORDERS = _ORDER_TEXT.format(kind="STRING").replace("'\\'", "chr(92)")
_DUCK_ORDERS = _ORDER_TEXT.format(kind="VARCHAR")
_DUCK_ESCAPED = "replace(replace(replace(replace(x, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"


def _export(name: str, column, sql: str) -> None:
    @query(name, f"SELECT id, {sql} AS y FROM ({_DUCK_ORDERS})")
    def run(spark, sf_dir):
        return _rows(spark, sf_dir, _SPARK_ORDERS).select("id", column().alias("y"))


_export("extract_year", lambda: export.extract_year(F.col("d")), "CAST(substr(d, 1, 4) AS SMALLINT)")
_export("empty_to_none", lambda: export.empty_to_null(F.col("x")), "nullif(x, '')")
_export("copy_escape", lambda: export.escape_cell(F.col("x")), _DUCK_ESCAPED)
_export("copy_line", lambda: export.line(F.col("id"), F.col("x"), F.col("d")), f"CAST(id AS VARCHAR) || chr(9) || coalesce(nullif({_DUCK_ESCAPED}, ''), '\\N') || chr(9) || d")


@query("pg_text_form", "SELECT conv_id, turn, text AS y FROM {conversations}")
def _nul(spark, sf_dir):
    rows = files.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", export.remove_nul(F.concat(F.col("text"), F.lit("\x00"))).alias("y"))


@query("copy_batches", "SELECT 1 AS step, 'nation' AS t, count(*) AS n FROM {nation} UNION ALL SELECT 2, 'supplier', count(*) FROM {supplier} UNION ALL SELECT 3, 'customer', count(*) FROM {customer}")
def _batches(spark, sf_dir):
    """Parents before children, whatever the order of arrival."""
    done: list[DataFrame] = []

    def write(target, rows):
        done.append(copy_text.as_lines(rows).agg(F.lit(len(done) + 1).alias("step"), F.lit(target.table).alias("t"), F.count("*").alias("n")))

    names = {"nation": ["n_nationkey", "n_name"], "supplier": ["s_suppkey", "s_name"], "customer": ["c_custkey", "c_name"]}
    copier = copy_text.BatchCopier([copy_text.CopyTarget(t, c) for t, c in names.items()], write)
    for t in ("customer", "nation", "supplier"):
        copier.add(t, files.table(spark, sf_dir, t))
    copier.finish()
    return done[0].unionByName(done[1]).unionByName(done[2])


# ---- similarity: customers and the suppliers they have bought from, as many pairs as line items at most

_PAIRS = """SELECT c_custkey, s_suppkey, c_name || ' ' || c_mktsegment AS a, s_name || ' building' AS b FROM
 (SELECT DISTINCT o_custkey, l_suppkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey"""


def _pairs(name: str, column, oracle: str | None = None) -> None:
    @query(name, oracle and f"SELECT c_custkey, s_suppkey, round({oracle}, 6) AS y FROM ({_PAIRS})")
    def run(spark, sf_dir):
        return _rows(spark, sf_dir, _PAIRS).select("c_custkey", "s_suppkey", F.round(column(F.col("a"), F.col("b")), 6).alias("y"))


_pairs("levenshtein_ratio", similarity.levenshtein_ratio, "1 - levenshtein(a, b) / greatest(strlen(a), strlen(b))")
_pairs("jaro_winkler", similarity.jaro_winkler, "jaro_winkler_similarity(a, b)")


def _sql_masks(s: str) -> str:
    """Character -> the places where ``s`` has it, as the bits of a number; for up to 120 characters."""
    bits = f"list_transform(range(1, length({s}) + 1), lambda j: CASE WHEN substr({s}, j, 1) = ch THEN 1::HUGEINT << CAST(j - 1 AS INTEGER) ELSE 0::HUGEINT END)"
    return f"map_from_entries(list_transform(list_distinct(string_split({s}, '')), lambda ch: (ch, CAST(list_sum({bits}) AS HUGEINT))))"


def _sql_lcs(a: str, b: str, masks: str) -> str:
    """Length of the longest common subsequence, by the zeros of a row of bits."""
    full = f"((1::HUGEINT << CAST(length({b}) AS INTEGER)) - 1)"
    row = f"list_reduce(list_transform(string_split({a}, ''), lambda ch: coalesce({masks}[ch], 0::HUGEINT)), lambda r, k: ((r + (r & k)) | (r - (r & k))) & {full}, {full})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({b}) - bit_count({row}) END"


def _sql_ratios(pairs: str, keys: str) -> str:
    """Keys with the ratio ``y`` of a and b; each b gets its masks once."""
    whole = f"SELECT {keys}, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ({_sql_lcs('a', 'b', 'm')}) / (length(a) + length(b)) END AS y"
    return f"{whole} FROM ({pairs}) JOIN (SELECT b, {_sql_masks('b')} AS m FROM (SELECT DISTINCT b FROM ({pairs}))) USING (b)"


_WORDS = "list_sort(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> ''))"


def _sql_sorted(pairs: str, keys: str) -> str:
    """Keys with the token-sort ratio of a and b."""
    return _sql_ratios(f"SELECT {keys}, array_to_string({_WORDS.format(x='a')}, ' ') AS a, array_to_string({_WORDS.format(x='b')}, ' ') AS b FROM ({pairs})", keys)


def _sql_sets(pairs: str, keys: str) -> str:
    """Keys with the token-set ratio of a and b.

    The shared tokens begin both sides, so their longest common subsequence is themselves and that
    of the rest.
    """
    sets = f"SELECT {keys}, list_distinct({_WORDS.format(x='a')}) AS u, list_distinct({_WORDS.format(x='b')}) AS v FROM ({pairs})"
    parts = f"""SELECT {keys}, array_to_string(list_sort(list_filter(u, lambda t: list_contains(v, t))), ' ') AS i,
 array_to_string(list_sort(list_filter(u, lambda t: NOT list_contains(v, t))), ' ') AS l, array_to_string(list_sort(list_filter(v, lambda t: NOT list_contains(u, t))), ' ') AS r FROM ({sets})"""
    rest = f"SELECT {keys}, length(i) AS n, substr(trim(i || ' ' || l), length(i) + 1) AS a, substr(trim(i || ' ' || r), length(i) + 1) AS b FROM ({parts})"
    masked = f"SELECT * FROM ({rest}) JOIN (SELECT b, {_sql_masks('b')} AS m FROM (SELECT DISTINCT b FROM ({rest}))) USING (b)"
    scored = f"SELECT {keys}, n, length(a) AS na, length(b) AS nb, {_sql_lcs('a', 'b', 'm')} AS c FROM ({masked})"
    return f"SELECT {keys}, CASE WHEN n + na + nb = 0 THEN 1.0::DOUBLE WHEN n + na = 0 OR n + nb = 0 THEN 0.0::DOUBLE ELSE greatest(2.0::DOUBLE * (n + c) / (2 * n + na + nb), 2.0::DOUBLE * n / (2 * n + na), 2.0::DOUBLE * n / (2 * n + nb)) END AS y FROM ({scored})"


_pairs("fuzz_ratio", similarity.fuzz_ratio)
_pairs("token_sort_ratio", similarity.token_sort_ratio)
_pairs("token_set_ratio", similarity.token_set_ratio)
for _name, _make in (("fuzz_ratio", _sql_ratios), ("token_sort_ratio", _sql_sorted), ("token_set_ratio", _sql_sets)):
    ORACLE_SQL[_name] = _duck(f"SELECT c_custkey, s_suppkey, round(y, 6) AS y FROM ({_make(_PAIRS, 'c_custkey, s_suppkey')})")


# ---- library and classification

_LIB_SQL = f"SELECT DISTINCT lower(artist) AS artist, lower(title) AS title FROM ({LIBRARY})"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> '' AND t <> '|||'))"
_TEXTS = f"SELECT DISTINCT artist || ' ||| ' || title AS text FROM ({_LIB_SQL})"
_RELEASE_KEYS = f"SELECT DISTINCT {_MATCH} AS artist, lower(title) AS title FROM ({RELEASES})"


def _index(spark, sf_dir) -> classify.LibraryIndex:
    return classify.LibraryIndex.from_pairs(_rows(spark, sf_dir, LIBRARY))


def _keys(spark, sf_dir) -> DataFrame:
    return _rows(spark, sf_dir, RELEASES).select(text.match_form(F.col("artist")).alias("artist"), text.match_form(F.col("title")).alias("title")).distinct()


@query("library_index", f"SELECT artist, count(*) AS n_titles, min(title) AS first_title FROM ({_LIB_SQL}) GROUP BY artist")
def _library(spark, sf_dir):
    return _index(spark, sf_dir).pairs.groupBy("artist").agg(F.count("*").alias("n_titles"), F.min("title").alias("first_title"))


@query("token_index", f"SELECT unnest({_TOKENS.format(x='text')}) AS token, text FROM ({_TEXTS})")
def _token_index(spark, sf_dir):
    return classify.token_index(_index(spark, sf_dir).texts, "text")


@query(
    "blocked_candidates",
    f"""WITH q AS (SELECT artist || ' ||| ' || title AS q FROM ({_RELEASE_KEYS})), l AS (SELECT unnest({_TOKENS.format(x='text')}) AS token, text FROM ({_TEXTS})),
 k AS (SELECT unnest({_TOKENS.format(x='q')}) AS token, q FROM q) SELECT DISTINCT q, text FROM k JOIN l USING (token)""",
)
def _candidates(spark, sf_dir):
    queries = _keys(spark, sf_dir).select(classify.combined(F.col("artist"), F.col("title")).alias("q"))
    return classify.candidates(queries, "q", _index(spark, sf_dir).texts, "text")


@query("score_exact", f"SELECT r.artist, r.title, CASE WHEN l.artist IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS exact FROM ({_RELEASE_KEYS}) r LEFT JOIN ({_LIB_SQL}) l ON r.artist = l.artist AND r.title = l.title")
def _exact(spark, sf_dir):
    return classify.score_exact(_keys(spark, sf_dir), _index(spark, sf_dir))


_NEAR = f"""SELECT DISTINCT q AS a, text AS b FROM (SELECT unnest({_TOKENS.format(x='q')}) AS token, q FROM (SELECT artist || ' ||| ' || title AS q FROM ({_RELEASE_KEYS})))
 JOIN (SELECT unnest({_TOKENS.format(x='text')}) AS token, text FROM ({_TEXTS})) USING (token)"""
#: The same pairs under names that the ratios leave alone.
_NAMED_NEAR = f"SELECT a AS qa, b AS qb, a, b FROM ({_NEAR})"


def _sql_best(make, name: str) -> str:
    """The best score of each release's candidates, 0 without one."""
    return f"SELECT artist, title, coalesce(max(y), 0.0::DOUBLE) AS {name} FROM ({_RELEASE_KEYS}) LEFT JOIN ({make(_NAMED_NEAR, 'qa, qb')}) ON qa = artist || ' ||| ' || title GROUP BY ALL"


_TS, _TR = _sql_best(_sql_sets, "ts"), _sql_best(_sql_sorted, "tr")


@query("score_token_set", f"SELECT artist, title, round(ts, 6) AS ts FROM ({_TS})")
def _token_set(spark, sf_dir):
    return classify.score_tokens(_keys(spark, sf_dir), _index(spark, sf_dir)).select("artist", "title", F.round("ts", 6).alias("ts"))


@query("score_token_sort", f"SELECT artist, title, round(tr, 6) AS tr FROM ({_TR})")
def _token_sort(spark, sf_dir):
    return classify.score_tokens(_keys(spark, sf_dir), _index(spark, sf_dir)).select("artist", "title", F.round("tr", 6).alias("tr"))


_TWO_STAGE = f"""WITH q AS ({_RELEASE_KEYS}), lib AS ({_LIB_SQL}), la AS (SELECT DISTINCT artist FROM lib), lt AS (SELECT unnest({_TOKENS.format(x='artist')}) AS token, artist AS lib_artist FROM la),
 qt AS (SELECT unnest({_TOKENS.format(x='artist')}) AS token, artist FROM (SELECT DISTINCT artist FROM q)),
 near AS (SELECT DISTINCT artist, lib_artist FROM qt JOIN lt USING (token)), s AS (SELECT *, jaro_winkler_similarity(artist, lib_artist) AS a FROM near),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY a DESC, lib_artist) AS n FROM s WHERE a > 0) WHERE n = 1 AND a >= 0.7),
 t AS (SELECT q.artist, q.title, max(b.a) AS a, max(jaro_winkler_similarity(q.title, lib.title)) AS t FROM q JOIN b ON q.artist = b.artist JOIN lib ON lib.artist = b.lib_artist GROUP BY ALL)
 SELECT q.artist, q.title, coalesce(sqrt(t.a * t.t), 0.0) AS tw FROM q LEFT JOIN t ON q.artist = t.artist AND q.title = t.title"""
_VERDICT = """CASE WHEN exact THEN 'keep' WHEN ts >= 0.4 AND ts < 0.8 THEN 'review' WHEN tr >= 0.4 AND tr < 0.8 THEN 'review' WHEN ts >= 0.8 AND tr >= 0.8 AND tw >= 0.8 THEN 'keep'
 WHEN ts < 0.4 AND tr < 0.4 AND tw < 0.4 THEN 'prune' ELSE 'review' END"""
_CLASSIFIED = f"""SELECT k.artist, k.title, l.artist IS NOT NULL AS exact, ts, tr, tw FROM ({_RELEASE_KEYS}) k LEFT JOIN ({_LIB_SQL}) l ON k.artist = l.artist AND k.title = l.title
 JOIN ({_TS}) s ON s.artist = k.artist AND s.title = k.title JOIN ({_TR}) r ON r.artist = k.artist AND r.title = k.title JOIN ({_TWO_STAGE}) w ON w.artist = k.artist AND w.title = k.title"""


@query("score_two_stage", f"SELECT artist, title, round(tw, 6) AS tw FROM ({_TWO_STAGE})")
def _two_stage(spark, sf_dir):
    return classify.score_two_stage(_keys(spark, sf_dir), _index(spark, sf_dir)).select("artist", "title", F.round("tw", 6).alias("tw"))


# scores of a release that is in the library are not computed
@query(
    "classify_release",
    f"""SELECT artist, title, exact::INT::DOUBLE AS exact, CASE WHEN NOT exact THEN round(ts, 6) END AS ts, CASE WHEN NOT exact THEN round(tr, 6) END AS tr, CASE WHEN NOT exact THEN round(tw, 6) END AS tw,
 {_VERDICT} AS classification FROM ({_CLASSIFIED})""",
)
def _classify(spark, sf_dir):
    out = classify.classify(_keys(spark, sf_dir), _index(spark, sf_dir))
    return out.select("artist", "title", "exact", *[F.round(c, 6).alias(c) for c in ("ts", "tr", "tw")], "classification")


@query(
    "batch_classify",
    f"""SELECT o.id, o.artist, o.title, {_VERDICT} AS classification FROM (SELECT *, {_MATCH} AS match_artist, lower(title) AS match_title FROM ({RELEASES})) o
 JOIN ({_CLASSIFIED}) c ON c.artist = o.match_artist AND c.title = o.match_title""",
)
def _batch(spark, sf_dir):
    """Flagship: every release, with its verdict."""
    return classify.batch_classify(_rows(spark, sf_dir, RELEASES), _index(spark, sf_dir))


# ---- filters

_SUPPLIERS = "SELECT s_name AS value FROM {supplier} WHERE s_acctbal > 0 UNION ALL SELECT '  ' FROM {region}"
_NAMED = "SELECT s_suppkey AS id, s_nationkey AS artist_id, '  ' || upper(s_name) AS name FROM {supplier}"
_SET = "SELECT DISTINCT lower(trim(value)) AS key FROM ({})".format(_SUPPLIERS)


@query("filter_load", f"SELECT key FROM ({_SET}) WHERE key <> ''")
def _load(spark, sf_dir):
    return filters.name_set(_rows(spark, sf_dir, _SUPPLIERS))


@query("filter_artists", f"SELECT id, lower(trim(name)) IN (SELECT key FROM ({_SET})) AS matches FROM ({_NAMED})")
def _filter(spark, sf_dir):
    names = filters.name_set(_rows(spark, sf_dir, _SUPPLIERS))
    return filters.filter_artists(_rows(spark, sf_dir, _NAMED), "name", names).select("id", "matches")


@query("artist_filter", f"SELECT artist_id, bool_or(lower(trim(name)) IN (SELECT key FROM ({_SET}))) AS matches FROM ({_NAMED}) GROUP BY artist_id")
def _any(spark, sf_dir):
    return filters.matches_any(_rows(spark, sf_dir, _NAMED), "artist_id", "name", filters.name_set(_rows(spark, sf_dir, _SUPPLIERS)))


_ALIASES = "SELECT CAST(c_nationkey AS STRING) AS artist_id, c_name AS alias_name FROM {customer} WHERE c_acctbal > 9000"
_ALIAS_SET = "SELECT lower(c_name) AS key FROM {customer} WHERE c_mktsegment = 'BUILDING'"


@query("alias_load", "SELECT CAST(c_nationkey AS BIGINT) AS artist_id, lower(c_name) AS key FROM {customer} WHERE c_acctbal > 9000")
def _aliases(spark, sf_dir):
    """Written as a CSV with an id, a name and an alias, and read by the loader."""
    path = scratch_path(spark, "aliases")
    _rows(spark, sf_dir, _ALIASES).select("artist_id", F.lit("x").alias("artist_name"), "alias_name").write.option("header", True).csv(path)
    return filters.load_aliases(spark, path)


@query(
    "artist_filter_alias",
    f"""WITH s AS ({_ALIAS_SET}), a AS (SELECT DISTINCT c_nationkey AS n FROM {{customer}} WHERE c_acctbal > 9000 AND lower(c_name) IN (SELECT key FROM s))
 SELECT id, bool_or(lower(trim(name)) IN (SELECT key FROM s) OR artist_id IN (SELECT n FROM a)) AS matches FROM ({_NAMED}) GROUP BY id""",
)
def _alias_filter(spark, sf_dir):
    return filters.matches_any_with_aliases(_rows(spark, sf_dir, _NAMED), "id", "artist_id", "name", _rows(spark, sf_dir, _ALIAS_SET), _aliases(spark, sf_dir))


@query(
    "title_filter",
    f"SELECT id, {_MATCH} IN (SELECT lower(p_name) FROM {{part}}) OR (contains({_MATCH}, '[') AND rtrim(regexp_replace({_MATCH}, '\\[[^\\[]*$', '')) IN (SELECT lower(p_name) FROM {{part}})) AS matches FROM ({RELEASES})",
)
def _titles(spark, sf_dir):
    titles = filters.name_set(_rows(spark, sf_dir, "SELECT p_name AS value FROM {part}"))
    return filters.filter_titles(_rows(spark, sf_dir, RELEASES), "id", "artist", titles)


# ---- resolution

#: Catalog entries in the order of their least part number.
_CATALOG = "SELECT p_name AS name, min(p_partkey) AS idx FROM {part} GROUP BY p_name"
_QUERY_NAMES = "SELECT DISTINCT substr(p_name, 1, length(p_name) - 1) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END AS name FROM {part}"


def _numbered(spark, sf_dir) -> DataFrame:
    return _rows(spark, sf_dir, _CATALOG)


_SCORED = f"SELECT q.name, c.name AS entry, c.idx, jaro_winkler_similarity(q.name, c.name) AS s FROM ({_QUERY_NAMES}) q, ({_CATALOG}) c"


@query(
    "fuzzy_resolve",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, idx) AS n FROM ({_SCORED})),
 t AS (SELECT name, max(s) FILTER (n = 1) AS s1, max(s) FILTER (n = 2) AS s2, max(entry) FILTER (n = 1) AS entry FROM r GROUP BY name)
 SELECT name, CASE WHEN s1 >= 0.8 AND NOT coalesce(abs(s1 - s2) < 0.02, false) THEN entry END AS resolved FROM t""",
)
def _resolve(spark, sf_dir):
    return resolve.fuzzy_resolve(_rows(spark, sf_dir, _QUERY_NAMES), _numbered(spark, sf_dir))


@query(
    "best_match",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, idx) AS n FROM ({_SCORED}))
 SELECT name, CASE WHEN s >= 0.8 THEN idx END AS idx, CASE WHEN s >= 0.8 THEN round(s, 6) END AS score FROM r WHERE n = 1""",
)
def _best(spark, sf_dir):
    return resolve.best_match(_rows(spark, sf_dir, _QUERY_NAMES), _numbered(spark, sf_dir)).withColumn("score", F.round("score", 6))


# ---- deduplication, mapping, pipeline

_FIRST_EVENT = "SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY ALL"


@query("dedup_first", _FIRST_EVENT)
def _dedup(spark, sf_dir):
    return dedup.first_by_key(files.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


_ORDERS_KEYED = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderpriority END AS p, o_orderstatus AS s FROM {orders}"


@query("import_dedup", f"SELECT min(o_orderkey) AS o_orderkey, coalesce(p, '') AS k, s FROM ({_ORDERS_KEYED}) GROUP BY ALL")
def _import_dedup(spark, sf_dir):
    out = dedup.import_dedup(_rows(spark, sf_dir, _ORDERS_KEYED), ["p", "s"], "o_orderkey")
    return out.select("o_orderkey", F.coalesce("p", F.lit("")).alias("k"), "s")


@query("import_mapping", "SELECT c_nationkey AS nation, c_mktsegment AS segment, upper(first(c_name ORDER BY c_custkey)) AS name FROM {customer} GROUP BY ALL")
def _mapping(spark, sf_dir):
    m = mapping.ColumnMapping(["c_nationkey", "c_mktsegment", "c_name"], ["nation", "segment", "name"], ["name"], ["nation", "segment", "no_such"])
    m.add_transform("c_name", F.upper)
    return m.apply(files.table(spark, sf_dir, "customer"), order="c_custkey")


_EVENT_ITEM = "CASE WHEN value >= 50 THEN user_id END"


@query(
    "pipeline_dedup",
    f"""WITH t AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE {_EVENT_ITEM} END AS k FROM {{events}} WHERE {_EVENT_ITEM} IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM t) SELECT event_id, k FROM r WHERE k IS NULL OR n = 1""",
)
def _pipeline_dedup(spark, sf_dir):
    rows = pipeline.transform(files.table(spark, sf_dir, "events"), lambda d: F.expr(_EVENT_ITEM))
    rows = rows.select("event_id", F.when(F.col("event_type") != "view", F.col("item")).alias("k"))
    return pipeline.deduplicated(rows, "k", "event_id")


@query(
    "pipeline_stats",
    f"SELECT count(*) AS scanned, count({_EVENT_ITEM}) AS processed, count(DISTINCT {_EVENT_ITEM}) AS written, 0::BIGINT AS skipped, count({_EVENT_ITEM}) - count(DISTINCT {_EVENT_ITEM}) AS duplicates FROM {{events}}",
)
def _pipeline_stats(spark, sf_dir):
    rows = files.table(spark, sf_dir, "events")
    done = pipeline.transform(rows, lambda d: F.expr(_EVENT_ITEM))
    return pipeline.stats(rows, done, pipeline.deduplicated(done, "item", "event_id"))


@query("pipeline_seen", f"SELECT user_id, min(event_id) AS event_id FROM {{events}} WHERE user_id NOT IN (SELECT user_id FROM {{events}} WHERE event_id % 97 = 0) GROUP BY user_id")
def _seen(spark, sf_dir):
    rows = files.table(spark, sf_dir, "events")
    return dedup.against_seen(rows, "user_id", rows.where("event_id % 97 = 0"), "event_id").select("user_id", "event_id")


# ---- report

_FORMS = f"SELECT id, {_MATCH} AS b, {_sql_parens(_MATCH)} AS p, {_KEY} AS a, {_IDENTITY} AS i, {_PUNCT} AS u, {_DISAMB} AS d FROM ({RELEASES})"


@query("regress_diff", f"SELECT id, b AS baseline, i AS identity, u AS punctuation, d AS disambiguator FROM ({_FORMS}) WHERE i <> b OR u <> b OR d <> b")
def _diff(spark, sf_dir):
    return report.diff(_rows(spark, sf_dir, RELEASES), "id", "artist").select("id", "baseline", "identity", "punctuation", "disambiguator")


@query(
    "regress_impact",
    f"""WITH f AS (SELECT (p <> b)::INT AS s1, (a <> p)::INT AS s2, (u <> i)::INT AS s3, (d <> i)::INT AS s4 FROM ({_FORMS}) WHERE i <> b OR u <> b OR d <> b), n AS (SELECT *, s1 + s2 + s3 + s4 AS n FROM f)
 SELECT 'parens' AS step, count(*) FILTER (n = 1 AND s1 = 1) AS n_rows FROM n UNION ALL SELECT 'articles', count(*) FILTER (n = 1 AND s2 = 1) FROM n UNION ALL
 SELECT 'punctuation', count(*) FILTER (n = 1 AND s3 = 1) FROM n UNION ALL SELECT 'disambiguator', count(*) FILTER (n = 1 AND s4 = 1) FROM n UNION ALL SELECT 'multiple', count(*) FILTER (n > 1) FROM n""",
)
def _impact(spark, sf_dir):
    return report.impact(_rows(spark, sf_dir, RELEASES), "id", "artist")


@query(
    "regress_shift",
    f"""WITH f AS (SELECT b, d, count(*) OVER (PARTITION BY b) AS nb, count(*) OVER (PARTITION BY d) AS nd FROM ({_FORMS}))
 SELECT count(*) AS n_rows, count(DISTINCT b) AS distinct_baseline, count(DISTINCT d) AS distinct_key, count(*) FILTER (b <> d) AS changed, count(*) FILTER (nb = 1 AND nd > 1) AS lost,
 count(*) FILTER (nb > 1 AND nd = 1) AS gained, round(count(*) FILTER ((nb = 1 AND nd > 1) OR (nb > 1 AND nd = 1)) / count(*) * 10000) / 100 AS shift_percent FROM f""",
)
def _shift(spark, sf_dir):
    return report.shift(_rows(spark, sf_dir, RELEASES), "id", "artist", "disambiguator")


# ---- search

@query(
    "fts_match",
    "SELECT doc_id AS rowid FROM {documents} WHERE list_contains(regexp_split_to_array(translate(lower(text), 'äçèéêíñóöüàâîïôùûëáúìò', 'aceeeinoouaaiiouueauio'), '[^\\p{{L}}\\p{{N}}]+'), 'fur')",
)
def _fts(spark, sf_dir):
    return search.find(files.table(spark, sf_dir, "documents"), "doc_id", ["text"], "Für")


@query("fts_index", "SELECT p_partkey AS rowid FROM {part} WHERE list_contains(regexp_split_to_array(lower(p_name), '[^\\p{{L}}\\p{{N}}]+'), 'red') OR list_contains(regexp_split_to_array(lower(p_type), '[^\\p{{L}}\\p{{N}}]+'), 'red')")
def _fts_index(spark, sf_dir):
    return search.match(search.build_index(files.table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"]), "RED")


# ---- report bands

_BAND = "SELECT c_custkey AS id, c_acctbal / 10000 AS confidence, c_acctbal / 1000 AS shift FROM {customer}"


@query("confidence_bands", f"SELECT id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'review' WHEN confidence IS NOT NULL THEN 'low' END AS band, CASE WHEN shift <= 2 THEN 'green' WHEN shift <= 5 THEN 'review' ELSE 'refine' END AS gate FROM ({_BAND})")
def _bands(spark, sf_dir):
    return _rows(spark, sf_dir, _BAND).select("id", report.band(F.col("confidence")).alias("band"), report.gate(F.col("shift")).alias("gate"))


# ---- sinks, there and back

_QUOTED = "SELECT CAST(s_suppkey AS STRING) AS k, s_name || ', \"x\"' AS v FROM {supplier}"


@query("csv_round_trip", f"SELECT 'supplier' AS t, k, v FROM ({_QUOTED}) UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM {{nation}}")
def _csv_back(spark, sf_dir):
    w = csv_files.MultiCsvWriter(scratch_path(spark, "csv"), [csv_files.CsvFileSpec("supplier.csv", ["k", "v"]), csv_files.CsvFileSpec("nation.csv", ["k", "v"])])
    first = w.write("supplier.csv", _rows(spark, sf_dir, _QUOTED))
    second = w.write(1, _rows(spark, sf_dir, "SELECT n_nationkey AS k, n_name AS v FROM {nation}"), order="k", one_file=True)
    return files.csv(spark, first).select(F.lit("supplier").alias("t"), "k", "v").unionByName(files.csv(spark, second).select(F.lit("nation").alias("t"), "k", "v"))


_TABBED = "SELECT c_custkey AS k, c_name || chr(9) || c_mktsegment AS v FROM {customer}"


@query("copy_round_trip", _TABBED)
def _copy_back(spark, sf_dir):
    """Bulk-load lines, split and unescaped again."""
    path = scratch_path(spark, "copy")
    copy_text.write_copy(_rows(spark, sf_dir, _TABBED), path)
    cells = F.split("value", "\t")
    return files.lines(spark, path).select(F.get(cells, F.lit(0)).cast("long").alias("k"), F.replace(F.get(cells, F.lit(1)), F.lit("\\t"), F.lit("\t")).alias("v"))


@query("sqlite_round_trip", "SELECT s_suppkey AS id, s_name AS title, CAST(s_nationkey AS VARCHAR) AS artist FROM {supplier}")
def _sqlite_back(spark, sf_dir):
    """A SQLite file has one writer and reader, the driver, so this is for tables of that size."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/library.db"
        with sqlite.SqliteWriter(path, schema.LIBRARY_DDL) as w:
            w.write("library", _rows(spark, sf_dir, "SELECT s_suppkey, s_name, CAST(s_nationkey AS STRING), NULL, NULL, NULL, NULL, NULL, NULL FROM {supplier}"))
        rows = sqlite.read_rows(path, "SELECT id, title, artist FROM library")
        return spark.createDataFrame(rows, "id long, title string, artist string")


# ---- dump

_DUMP = "SELECT n_nationkey AS k, 'INSERT INTO `nation` VALUES (' || n_nationkey || ',''' || n_name || ''',NULL,' || n_regionkey || '.5),(-1,''it\\\\''s'',7,0.0);' AS value FROM {nation}"


@query("mysql_dump", "SELECT n_nationkey AS k, 0 AS row_in_line, CAST(n_nationkey AS BIGINT) AS i, n_name AS s, n_regionkey + 0.5::DOUBLE AS f, 'null' AS third FROM {nation} UNION ALL SELECT n_nationkey, 1, -1, 'it''s', 0.0, 'int' FROM {nation}")
def _dump(spark, sf_dir):
    cells = F.col("cells")
    rows = mysql_dump.parsed(_rows(spark, sf_dir, _DUMP))
    return rows.select("k", "row_in_line", mysql_dump.cell_as(cells, 0, "bigint").alias("i"), mysql_dump.cell_as(cells, 1, "string").alias("s"), mysql_dump.cell_as(cells, 3, "double").alias("f"), F.get(cells, F.lit(2))["kind"].alias("third"))


@query("dump_file", "SELECT n_nationkey AS i, n_name AS s, n_regionkey * 0.25::DOUBLE AS f FROM {nation} UNION ALL SELECT -p_partkey, p_name || ' it''s', NULL FROM {part}")
def _dump_file(spark, sf_dir):
    """A dump file of two tables, written line by line, of which one is read."""
    path = scratch_path(spark, "dump")
    lines = """SELECT 'INSERT INTO `t` VALUES (' || n_nationkey || ',''' || n_name || ''',' || n_regionkey * 0.25D || '),(' || n_nationkey || ');' AS value FROM {nation}
 UNION ALL SELECT 'INSERT INTO `t` VALUES (-' || p_partkey || ',''' || p_name || ' it' || chr(92) || '''s'',NULL);' FROM {part} UNION ALL SELECT 'INSERT INTO `other` VALUES (' || c_custkey || ');' FROM {customer}"""
    _rows(spark, sf_dir, lines).write.text(path)
    cells = F.col("cells")
    rows = mysql_dump.read_table(spark, path, "t").where(F.size("cells") == 3)
    return rows.select(mysql_dump.cell_as(cells, 0, "bigint").alias("i"), mysql_dump.cell_as(cells, 1, "string").alias("s"), mysql_dump.cell_as(cells, 2, "double").alias("f"))


#: Statements of all parts, with what the reader makes of numbers, quotes and other bytes.
_QUIRKS = """SELECT p_partkey AS i, 'INSERT INTO `t` VALUES ' || CASE p_partkey % 8 WHEN 0 THEN '(' || p_size || ',''' || p_name || ''',NULL)' WHEN 1 THEN '(' || p_size || ' ,2)' WHEN 2 THEN '(''' || p_name || chr(39) || chr(39) || 's'')'
 WHEN 3 THEN '(' || p_size || 'e5)' WHEN 4 THEN '()' WHEN 5 THEN '(' || p_size || '.5,-7)' WHEN 6 THEN '(1,.' || p_size || ',''x'')' ELSE '(99999999999999999999)' END || ';' AS value FROM {part}"""


@query(
    "parse_quirks",
    """SELECT p_partkey AS i, CASE p_partkey % 8 WHEN 0 THEN p_size || ',''' || p_name || ''',NULL' WHEN 1 THEN p_size || ',NULL,2' WHEN 2 THEN chr(39) || p_name || ''',''s''' WHEN 3 THEN p_size || ',NULL,5'
 WHEN 5 THEN p_size || '.5,-7' WHEN 6 THEN '1,NULL,' || p_size || ',''x''' ELSE '0' END AS y FROM {part} WHERE p_partkey % 8 <> 4""",
)
def _quirks(spark, sf_dir):
    # a file of one row group is read by one task; the texts are made and parsed by as many as the rows ask for
    part = files.table(spark, sf_dir, "part").repartition("p_partkey")
    return mysql_dump.parsed(spark.sql(_QUIRKS, part=part)).select("i", F.array_join(F.transform("cells", mysql_dump.display), ",").alias("y"))


_VALUES = [("(1,'a',NULL)", "1,'a',NULL"), ("(1 ,2)", "1,NULL,2"), ("('it''s')", "'it','s'"), ("(1e5)", "1,NULL,5"), ("()", None), ("(3.5,-7)", "3.5,-7"), ("('(remix)')", "'(remix)'"), ("('a\\nb')", "'a\nb'"), ("(99999999999999999999)", "0")]


def _parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, f"INSERT INTO `t` VALUES {v};") for i, (v, _) in enumerate(_VALUES)], "i int, value string")
    return mysql_dump.parsed(rows).select("i", F.array_join(F.transform("cells", mysql_dump.display), ",").alias("y"))


QUERIES["parse_values"] = _parse_values
ORACLE_SQL["parse_values"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '" + y.replace("'", "''") + "')" for i, (_, y) in enumerate(_VALUES) if y is not None) + ") t(i, y)"
