"""Every registered query of the catalog against its SQL, and operators on known cases."""

import glob
import math
import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tonearm import cli, log, schema, sqlfuncs, state
from tonearm.functions import artists, export, identity, similarity, text
from tonearm.operators import classify, dedup, filters, mapping, pipeline, report, resolve, search
from tonearm.plans import catalog
from tonearm.sinks import copy_text, csv_files, sqlite
from tonearm.sources import files, mysql_dump
from tonearm.streaming import pipeline as streaming


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_queries_without_sql_run(spark, sf_dir):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def column(spark, form, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", form(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_form(s):
    return text._match_form_of(s)


def plain_articles(s):
    for w in ("the ", "a ", "an "):
        if s.startswith(w):
            return s[len(w) :]
    for w in (", the", ", a", ", an"):
        if s.endswith(w) and len(s) > len(w):
            return s[: -len(w)]
    return s


def plain_punctuation(s):
    keep = lambda c: unicodedata.category(c)[0] in "LN" or c.isspace()
    out = []
    for c in s:
        if keep(c):
            out.append(c)
        elif not out or out[-1] is not GAP:
            out.append(GAP)
    return "".join(" " if c is GAP else c for c in out)


GAP = object()


def plain_disambiguator(s):
    head, slash, digits = s.rpartition("/")
    return head.rstrip(" ") if slash and digits and all("0" <= c <= "9" for c in digits) and head.endswith(" ") else s


def squeeze(s):
    return " ".join(w for w in s.split(" ") if w)


def decorated_names(n, seed=21):
    """Names with the articles, groups, numbers and marks that the identity forms are about."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdglmnrst") + rnd.choice("aeiouéø") for _ in range(rnd.randint(1, 3))).title()
    for _ in range(n):
        name = " ".join(word() for _ in range(rnd.randint(1, 3)))
        name = rnd.choice(["", "", "The ", "A ", "AN ", "theo "]) + name + rnd.choice(["", "", ", The", ", a", ", an", ",the"])
        name += rnd.choice(["", "", " (Live)", " [2nd issue]", " (a (b) c)", "(x) [y]", " )", " (open", "  ( ) "]) + rnd.choice(["", "", " /2", "/7", "  /31", " /x", " / 4"])
        yield rnd.choice(["", "", "(in) ", "...", "Q.T. "]) + name + rnd.choice(["", "", "!", " & co.", " -/+ "])


def test_identity(spark):
    names = [*decorated_names(800), "", "the", "The", "???", "-/+", "The ???", "山の音", "x /1\n", None]
    key = lambda s: plain_articles(brackets(plain_form(s)))
    plain = {
        identity.identity_form: lambda s: squeeze(key(s)),
        identity.identity_form_title: lambda s: squeeze(key(s)),
        identity.identity_form_punctuation: lambda s: squeeze(plain_punctuation(key(s))),
        identity.identity_form_disambiguator: lambda s: plain_disambiguator(squeeze(key(s))),
    }
    for form, want in plain.items():
        assert column(spark, form, names) == [None if s is None else want(s) for s in names]
    bare = [("a", ""), ("the moths", "moths"), ("the\u00a0moths", "moths"), ("thesis", "thesis"), ("an\t\tx", "x"), ("The x", "The x")]
    assert column(spark, identity.strip_leading_article, [x for x, _ in bare]) == [y for _, y in bare]
    back = column(spark, identity.identity_key_with_fallback, ["???", "The ???", "moth", None])
    assert [tuple(b) for b in back] == [("???", True), ("???", True), ("moth", False), (None, False)]


def brackets(s):
    """A plain version of the bracket rule."""
    t = s.rstrip(" ")
    if not t or t[-1] not in ")]":
        return s
    close, opener, depth = t[-1], {")": "(", "]": "["}[t[-1]], 0
    for i in range(len(t) - 1, -1, -1):
        depth += (t[i] == close) - (t[i] == opener)
        if depth == 0:
            return t[:i].rstrip(" ") if i > 0 else s
    return s


def test_brackets_at_random(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab ()[]") for _ in range(rnd.randrange(12))) for _ in range(1500)]
    assert column(spark, identity.strip_parens, texts) == [brackets(t) for t in texts]


def test_match_form_two_ways(spark):
    rnd = random.Random(4)
    letters = "aB ÄéñßłıİΣςσæœ̧́‍‎­йЁÃ©Î£ﬁ①日 \t/"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(14))) for _ in range(1500)] + [None, ""]
    assert column(spark, text.match_form, texts) == [None if t is None else text._match_form_of(t) for t in texts]
    assert column(spark, text.match_form_arrow, texts[:50]) == column(spark, text.match_form, texts[:50])
    assert column(spark, lambda x: text.or_empty(text.match_form, x), [None, "A"]) == ["", "a"]


def plain_split(s):
    """A credit's artists by the first kind of delimiter."""
    s = s.strip()
    valid = lambda parts: list(dict.fromkeys(p for p in parts if len(p.encode()) > 1)) or None
    if ", " in s:
        parts = [p.strip() for p in s.split(", ")]
        if not any(p and set(p) <= set("0123456789,") for p in parts):
            last = parts[-1]
            parts[-1] = last[4:].strip() if last[:4] in ("and ", "And ", "AND ") else last
            return valid(parts)
    for d in (" / ", " + "):
        if d in s:
            return valid([p.strip() for p in s.split(d)])
    return None


def plain_contextual(s, known):
    def around(part):
        parts = [p.strip() for p in part.split(" & ")]
        long = [p for p in parts if len(p.encode()) > 1]
        return long if " & " in part and len(long) >= 2 and any(plain_form(p) in known for p in parts) else None

    free = plain_split(s)
    if free is None:
        return around(s.strip())
    return list(dict.fromkeys(q for p in free for q in (around(p) or [p])))


def test_artists(spark):
    rnd = random.Random(13)
    words = ["Ida Moth", "Kel", "x", "Ōba", "ROWAN", "9", "12,5", "and Fen", "And  Sol", "ø", "Ida Moth", ""]
    credits = ["".join(rnd.choice(words) + rnd.choice([", ", " / ", " + ", " & ", " and ", ",", " & "]) for _ in range(rnd.randint(0, 3))) + rnd.choice(words) + rnd.choice(["", "", " ", "\u00a0"]) for _ in range(600)]
    known = ["rowan", "x", "ida moth", "o"]
    assert column(spark, artists.split_artist, [*credits, None]) == [*map(plain_split, credits), None]
    want = [plain_contextual(c, known) for c in credits]
    assert column(spark, lambda x: artists.split_artist_contextual(x, known), credits) == want
    rows = spark.createDataFrame(list(enumerate(credits)), "id int, x string")
    table = artists.split_credits(rows, "id", "x", spark.createDataFrame([(k,) for k in known], "k string"), "k").orderBy("id").collect()
    assert [r["artists"] for r in table] == want
    assert column(spark, lambda x: artists.split_artist_contextual(x, ["x"]), ["X & Bob & Cyd"]) == [["Bob", "Cyd"]]  # a part of one byte may be the known one
    heads, tails = ["various artists", "V/A", "v.a", "SOUNDTRACKS"], ["", " vol. 2", "-jazz", ".", "x", "2", "é"]
    cases = [(h + t, not t or not t[0].isalnum()) for h in heads for t in tails] + [(w, True) for w in ("Various", "soundtrack", "COMPILATION")] + [(w, False) for w in ("various ", "a soundtrack", "compilations", "")]
    assert column(spark, artists.is_compilation, [x for x, _ in cases]) == [y for _, y in cases]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _lcs_row(row, x, b)
    return row[-1]


def _lcs_row(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def test_similarity():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc d") for _ in range(rnd.randrange(12))) for _ in "ab")
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.winkler("", "") == 1.0
    assert similarity.winkler("crate", "trace") == pytest.approx(0.7333333, abs=1e-6)
    assert similarity.winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)  # a published example


def plain_ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def plain_sets(a, b):
    u, v = set(a.lower().split()), set(b.lower().split())
    if not u or not v:
        return float(not u and not v)
    both, x, y = (sorted(z) for z in (u & v, u - v, v - u))
    i, p, q = " ".join(both), " ".join(both + x), " ".join(both + y)
    return max(plain_ratio(i, p), plain_ratio(i, q), plain_ratio(p, q))


def test_batches_of_pairs():
    """The array versions against the single ones and against the definitions."""
    rnd = random.Random(17)
    make = lambda n: "".join(rnd.choice("abc dé山 ") for _ in range(rnd.randrange(n)))
    a, b = ([make(rnd.choice([2, 8, 20, 66, 140])) for _ in range(700)] + end for end in (["", " ", "abc", "a" * 70, "x" * 600], ["", "abc", " ", "a" * 200, "x" * 60]))
    assert similarity.lcs_lengths(a, b).tolist() == [similarity.lcs_length(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.winklers(a, b).tolist() == [similarity.winkler(x, y) for x, y in zip(a, b, strict=True)]
    some = [i for i in range(len(a)) if len(a[i]) < 30 and len(b[i]) < 30]
    a, b = [a[i] for i in some], [b[i] for i in some]
    assert similarity.ratios(a, b).tolist() == pytest.approx([plain_ratio(x, y) for x, y in zip(a, b, strict=True)])
    assert similarity.set_ratios(a, b).tolist() == pytest.approx([plain_sets(x, y) for x, y in zip(a, b, strict=True)])
    assert similarity.sort_ratios(a, b).tolist() == pytest.approx([plain_ratio(*(" ".join(sorted(z.lower().split())) for z in p)) for p in zip(a, b, strict=True)])


def invented(n, seed=31):
    """Artists and titles of made-up words."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    words = [word() for _ in range(60)]
    phrase = lambda a, b: " ".join(rnd.choice(words) for _ in range(rnd.randint(a, b))).title()
    return [(phrase(1, 3), phrase(1, 4)) for _ in range(n)]


LIBRARY = invented(30)


def plain_verdict(artist, title, library, c):
    """One release against the whole library."""
    a, t = plain_form(artist or ""), plain_form(title or "")
    pairs = {(plain_form(x), plain_form(y)) for x, y in library}
    if (a, t) in pairs:
        return "keep"
    words = lambda s: {w for w in s.split() if w != "|||"}
    q = f"{a} ||| {t}"
    near = [f"{x} ||| {y}" for x, y in pairs if words(f"{x} {y}") & words(q)]
    ts = max((plain_sets(q, e) for e in near), default=0.0)
    tr = max((plain_ratio(" ".join(sorted(q.split())), " ".join(sorted(e.split()))) for e in near), default=0.0)
    best = max(((similarity.winkler(a, x), [-ord(k) for k in x], x) for x in {x for x, _ in pairs} if words(x) & words(a)), default=(0.0, [], ""))
    tw = math.sqrt(best[0] * max(similarity.winkler(t, y) for x, y in pairs if x == best[2])) if best[0] > 0 and best[0] >= c.artist_threshold else 0.0
    for score, limit in ((ts, c.token_set_threshold), (tr, c.token_sort_threshold)):
        if c.prune_ceiling <= score < limit:
            return "review"
    if ts >= c.token_set_threshold and tr >= c.token_sort_threshold and tw >= c.two_stage_threshold:
        return "keep"
    return "prune" if max(ts, tr, tw) < c.prune_ceiling else "review"


def variants(library, seed=37):
    rnd = random.Random(seed)
    for artist, title in library:
        yield artist.upper(), f"  {title} "
        yield artist, "".join(c for i, c in enumerate(title) if i != len(title) // 2)
        yield " ".join(reversed(artist.split())), title
        yield artist, rnd.choice(library)[1]
        yield rnd.choice(library)[0] + "o", rnd.choice(library)[1]
        yield f"{artist} zzqx", "qq"
    yield from [("zqx", "qxz"), (None, library[0][1]), (library[0][0], None), (None, None), ("", "")]


@pytest.mark.parametrize("config", [classify.ClassifyConfig(), classify.ClassifyConfig(0.5, 0.5, 0.5, 0.5, 0.2), classify.ClassifyConfig(0.95, 0.95, 0.95, 0.9, 0.4)])
def test_classify(spark, config):
    rows = [(i, a, t) for i, (a, t) in enumerate(variants(LIBRARY))]
    releases = spark.createDataFrame(rows, "id int, artist string, title string").withColumns({c: F.lit("other") for c in ("classification", "_a", "_t", "match_artist")})
    out = classify.batch_classify(releases, spark.createDataFrame(LIBRARY, "artist string, title string"), config=config)
    assert out.columns == ["id", "artist", "title", "_a", "_t", "match_artist", "classification"]
    got = {r["id"]: r["classification"] for r in out.collect()}
    want = {i: plain_verdict(a, t, LIBRARY, config) for i, a, t in rows}
    assert got == want
    assert set(want.values()) == {"keep", "prune", "review"}


def test_resolve(spark):
    names = list(dict.fromkeys(a for a, _ in invented(40, seed=5)))
    entries = spark.createDataFrame(list(enumerate(names)), "idx int, name string")
    rnd = random.Random(2)
    ask = [n[:-1] for n in names[:15]] + [n + rnd.choice("aeiou") for n in names[15:30]] + [n.lower() for n in names[:5]] + ["qqqq xxxx", ""]
    for threshold, limit, gap in ((0.8, 2, 0.02), (0.7, 2, 0.1), (0.6, 1, 0.02)):
        want = {}
        for q in ask:
            scores = sorted(((similarity.winkler(q, n), -i) for i, n in enumerate(names)), reverse=True)[:limit]
            clear = len(scores) < 2 or abs(scores[0][0] - scores[1][0]) >= gap
            want[q] = names[-scores[0][1]] if scores[0][0] >= threshold and clear else None
        rows = spark.createDataFrame([(q,) for q in [*ask, None]], "name string")
        got = {r["name"]: r["resolved"] for r in resolve.fuzzy_resolve(rows, entries, threshold=threshold, limit=limit, ambiguity=gap).collect()}
        assert got == want | {None: None}
    with pytest.raises(ValueError, match="limit"):
        resolve.fuzzy_resolve(rows, entries, limit=0)
    turned = " ".join(reversed(names[0].split()))
    best = resolve.best_match(spark.createDataFrame([(turned,)], "name string"), entries, "token_sort", 0.7).first()
    assert plain_ratio(*(" ".join(sorted(x.lower().split())) for x in (names[best["idx"]], names[0]))) == 1.0


def test_filters(spark, tmp_path):
    (tmp_path / "names.txt").write_text("Velo Tam\n\n  Sólin \n")
    (tmp_path / "alias.csv").write_text('artist_id,artist_name,alias_name\n7,x,"Solin"\nbad,y,Other\n')
    names = filters.load_names(spark, str(tmp_path / "names.txt"))
    aliases = filters.load_aliases(spark, str(tmp_path / "alias.csv"))
    assert sorted(r["key"] for r in names.collect()) == ["solin", "velo tam"]
    assert sorted(tuple(r) for r in aliases.collect()) == [(0, "other"), (7, "solin")]
    rows = spark.createDataFrame([(1, 1, "VELO TAM"), (2, 7, "nobody"), (3, 8, "nobody"), (3, 8, None)], "id int, artist long, name string")
    got = {r["id"]: r["matches"] for r in filters.matches_any_with_aliases(rows, "id", "artist", "name", names, aliases).collect()}
    assert got == {1: True, 2: True, 3: False}
    titles = spark.createDataFrame([(1, "Velo Tam [x] [y]"), (2, "Sólin [y]"), (3, "[y]"), (4, None)], "id int, t string")
    assert {r["id"]: r["matches"] for r in filters.filter_titles(titles, "id", "t", names).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert filters.describe(names, aliases) == {"len": 2, "is_empty": False, "has_aliases": True}


def test_dedup_and_mapping(spark):
    rows = spark.createDataFrame([(3, None, "c"), (1, "", "a"), (2, "k", "b")], "n int, k string, v string")
    assert sorted(r["v"] for r in dedup.import_dedup(rows, ["k"], "n").collect()) == ["a", "b"]
    assert [r["v"] for r in dedup.import_dedup(rows, [], "n").collect()] == ["a"]
    m = mapping.ColumnMapping(["k", "v"], ["key", "value"], ["key"], ["key", "none"])
    assert (m.source_index("v"), m.source_index("x"), m.unique_key_indices()) == (1, None, [0])
    assert sorted(tuple(r) for r in m.apply(rows, "n").collect()) == [("", "a"), ("k", "b")]


def test_pipeline(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("n"), (F.col("id") % 3).alias("k"))
    out = str(tmp_path / "out")
    s = pipeline.run(rows, lambda d: F.when(d["n"] != 4, d["n"] * 10), lambda d: d.coalesce(1).write.parquet(out), "n", key="k")
    assert (s.scanned, s.processed, s.written, s.skipped, s.duplicates) == (10, 9, 3, 0, 6)
    assert "duplicates: 6" in str(s)
    assert [r["item"] for r in spark.read.parquet(out).orderBy("n").collect()] == [0, 10, 20]


def test_report_and_search(spark):
    rows = spark.createDataFrame([(1, "The A (x)"), (2, "A"), (3, "b"), (4, "b /2")], "id int, name string")
    s = report.shift(rows, "id", "name", "disambiguator").first()
    assert (s["n_rows"], s["changed"], s["distinct_baseline"]) == (4, 2, 4)
    assert (s["lost"], s["shift_percent"]) == (4, 100.0)
    docs = spark.createDataFrame([(1, "Velo", "tam"), (2, "Night Électrique", "Ida"), (3, None, "night-time Story"), (4, "knight", "")], "id int, title string, artist string")
    index = search.build_index(docs, "id", ["title", "artist"])
    cases = {("velo",): [1], ("NIGHT",): [2, 3], ("night", "title"): [2], ("electrique",): [2], ("nigh",): [], ("ida", "title"): []}
    for (term, *field), want in cases.items():
        assert sorted(r["rowid"] for r in search.match(index, term, *field).collect()) == want
        assert sorted(r["rowid"] for r in search.find(docs, "id", field or ["title", "artist"], term).collect()) == want
    # the order by term that a kept index has
    assert index.where("rowid = 3").orderBy("term").first()["term"] == "night"
    bands = spark.createDataFrame([(x,) for x in (0.9, 0.85, 0.8, 0.7, 0.69, None)], "x double").select(report.band(F.col("x")).alias("b"), report.gate(F.col("x") * 6).alias("g")).collect()
    assert [r["b"] for r in bands] == ["high", "high", "review", "review", "low", None]
    assert [r["g"] for r in bands[:2]] == ["refine", "refine"]


def test_dump(spark, tmp_path):
    rows = lambda s: [[next((v for v in c[1:] if v is not None), None) for c in r] for r in mysql_dump.parse_values(s)]
    assert rows(b"(4,'tam',NULL),(5,'o\\'clock',2.25);(9)") == [[4, "tam", None], [5, "o'clock", 2.25]]
    assert rows(b"(3 ,8)") == [[3, None, 8]]
    assert rows(b"('o''clock')") == [["o", "clock"]]
    assert rows(b"(2e7)") == [[2, None, 7]]
    assert rows(b"(0xAB)") == [[0, None, None, None]]
    assert rows(b"(1,.25,'x')") == [[1, None, 25, "x"]]  # a point begins no number
    assert rows(b"(-1.5.2,+3,--)") == [[0.0, 3, 0]]
    assert rows(b"('a\\qb\\0', -7, 1710000000000), ()") == [["a\\qb\0", -7, 1710000000000]]
    path = tmp_path / "dump.sql"
    path.write_text("-- c\nINSERT INTO `t` VALUES (1,'a;b'),(2,'(c)');\nINSERT INTO `u` VALUES (3);\ninsert into `t` values (4);\nINSERT INTO `t` (x) values (5,'é');\n")
    got = mysql_dump.read_table(spark, str(path), "t").select(mysql_dump.cell_as(F.col("cells"), 0, "bigint").alias("i")).collect()
    assert sorted(r["i"] or 0 for r in got) == sorted(r[0] or 0 for r in mysql_dump.iter_table(str(path), "t"))
    empty = tmp_path / "empty.sql"
    empty.write_text("")
    assert mysql_dump.read_table(spark, str(empty), "t").count() == 0


def test_dump_in_batches(spark, monkeypatch):
    """A task hands back short statements together and a long one in parts; other columns follow their statement."""
    import pyarrow as pa

    tuples = [[(1, "a"), (2, None)], [], None, [(3, "b")] * 3] * 500
    texts = [None if x is None else "INSERT INTO `t` VALUES " + ",".join(f"({i},{'NULL' if s is None else repr(s)})" for i, s in x) + ";" for x in tuples] + ["SELECT 1"]
    taken = []
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, value string").selectExpr("array(k, NULL) AS a", "named_struct('m', map('k', k)) AS m", "value", "k")
    true_map = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, *a, **b: (taken.append(f), true_map(self, f, *a, **b))[1])
    got = mysql_dump.parsed(rows).selectExpr("k", "a[0] = k AND a[1] IS NULL AND m.m['k'] = k AS same", "row_in_line", "cells[0].i", "cells[1].s").collect()
    want = [(k, True, n, i, s) for k, x in enumerate(tuples) for n, (i, s) in enumerate(x or [])]
    key = lambda r: (r[0], r[2])
    assert sorted(map(tuple, got), key=key) == want

    mysql_dump.parsed(rows.select("k", "value"))

    def batches(lines):
        batch = pa.record_batch({"k": range(len(lines)), "value": pa.array([x and x.encode() for x in lines], pa.binary())})
        return list(taken[-1](iter([batch])))

    short = batches(texts)
    assert len(short) == 1 and short[0].num_rows == len(want)
    long = batches(["INSERT INTO `t` VALUES " + ",".join(f"({i},'{i:0100}')" for i in range(100_000)) + ";"])
    assert sum(b.num_rows for b in long) == 100_000 and max(b.nbytes for b in long) < 8 << 20
    assert [x for b in long for x in b["row_in_line"].to_pylist()] == list(range(100_000))
    assert batches([]) == batches([None, "VALUES", "INSERT INTO `t` VALUES ();"]) == []


def test_quirks_of_one_row_group_are_spread(spark, tmp_path):
    """One task reads such a file; more than one makes and parses its statements."""
    rows = spark.range(1, 40_001, 1, 1).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CAST(id % 50 AS int) AS p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    kept = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(kept, "16k")  # as 16 MB of statements would be by default
    try:
        got = catalog.QUERIES["parse_quirks"](spark, str(tmp_path)).select("i", "y", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset(kept)
    assert sorted(r["i"] for r in got) == [i for i in range(1, 40_001) if i % 8 != 4]
    assert {r["i"]: r["y"] for r in got if r["i"] < 9} == {1: "1,NULL,2", 2: "'part 2','s'", 3: "3,NULL,5", 5: "5.5,-7", 6: "1,NULL,6,'x'", 7: "0", 8: "8,'part 8',NULL"}
    assert len({r["task"] for r in got}) > 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb"), (2, None), (3, ""), (4, 'q"x')], "id int, v string")
    copy_text.write_copy(rows, str(tmp_path / "copy"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "copy")).collect()) == ["1\ta\\tb", "2\t\\N", "3\t\\N", '4\tq"x']
    w = csv_files.MultiCsvWriter(str(tmp_path / "csv"), [csv_files.CsvFileSpec("r.csv", ["id", "v"])])
    path = w.write("r.csv", rows, order="id", one_file=True)
    assert [r["v"] for r in files.csv(spark, path).orderBy("id").collect()][3] == 'q"x'
    with pytest.raises(KeyError):
        w.spec("none")
    done = []
    c = copy_text.BatchCopier([copy_text.CopyTarget("parent", ["id"]), copy_text.CopyTarget("child", ["id", "v"])], lambda t, d: done.append((t.table, d.count())))
    c.add("child", rows)
    c.add("parent", rows)
    assert c.flush() == ["parent", "child"]
    assert c.flush() == []
    assert done == [("parent", 4), ("child", 4)]
    with pytest.raises(KeyError):
        c.add("other", rows)
    with pytest.raises(ValueError, match="plain"):
        copy_text.checked_name("a; b")
    copy_text.compact(rows, str(tmp_path / "fewer"), 1)
    assert spark.read.parquet(str(tmp_path / "fewer")).count() == 4
    assert len(list((tmp_path / "fewer").glob("part-*"))) == 1
    for header, want in (("name", [(None, "Velo")]), ("library_id,artist_name", [("7", "Velo")])):
        (tmp_path / "names.csv").write_text(f"{header}\n{'7,' if ',' in header else ''}Velo\n")
        assert [tuple(r) for r in files.names(spark, str(tmp_path / "names.csv")).collect()] == want
    (tmp_path / "names.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="name"):
        files.names(spark, str(tmp_path / "names.csv"))
    with sqlite.SqliteWriter(str(tmp_path / "l.db"), schema.LIBRARY_DDL, batch_size=2) as s:
        lib = spark.createDataFrame([(i, t, a) for i, (a, t) in enumerate(LIBRARY)], "id int, title string, artist string")
        s.write("library", lib.select("id", "title", "artist", *[F.lit(None).cast("string")] * 6))
        s.build_fts("library_fts", "library", "id", ["title", "artist", "alternate_artist_name"])
        n = lambda q: s.connection.execute("SELECT count(*) FROM library_fts WHERE library_fts MATCH ?", (q,)).fetchone()[0]
        word = LIBRARY[0][1].split()[0].lower()
        assert n(word) == sum(word in f"{a} {t}".lower().split() for a, t in LIBRARY)
        assert n(f"title:{word}") == sum(word in t.lower().split() for _, t in LIBRARY)
        assert n("unknown") == 0
    assert s.total_written == len(LIBRARY)
    assert len(sqlite.read_rows(str(tmp_path / "l.db"), "SELECT * FROM library")) == len(LIBRARY)


def test_letters(spark):
    """ASCII forms of other scripts, and the rules that the match form gives."""
    cases = [("さくら", "sakura"), ("パンダ", "panda"), ("서울", "seoul"), ("한글 café", "hangeul cafe"), ("שלום", "shlvm"), ("Երևան", "erewan"), ("Ω ß “x”", 'o ss "x"'), ("山", ""), ("がっき", "gatsuki")]
    assert column(spark, text.ascii_form, [x for x, _ in cases]) == [y for _, y in cases]
    rules = {r["source"]: r["target"] for r in text.unaccent_rules(spark).collect()}
    assert len(rules) == 432  # of Unicode 16; later versions have more
    assert all(rules[c] == text._match_form_of(c) for c in rules)
    assert (rules["é"], rules["æ"], rules["ς"], rules["ẚ"]) == ("e", "ae", "σ", "aʾ")
    assert not {"É", "ø", "й", "a"} & set(rules)


def test_state(tmp_path, spark):
    path = str(tmp_path / "s.json")
    s = state.PipelineState("db", "csv")
    s.mark_completed("create_schema")
    s.mark_failed("import_csv", "boom")
    s.save(path)
    t = state.PipelineState.load(path)
    assert (t.status("create_schema"), t.status("import_csv"), t.error("import_csv"), t.status("x"), t.next_step()) == ("completed", "failed", "boom", "unknown", "import_csv")
    with pytest.raises(ValueError, match="database_url"):
        t.validate_resume("other", "csv")
    with pytest.raises(KeyError):
        t.mark_completed("nope")
    (tmp_path / "v1.json").write_text('{"version": 1, "database_url": "d", "csv_dir": "c", "steps": {"import_csv": {"status": "completed"}, "dedup": {"status": "completed"}, "vacuum": {"status": "completed"}}}')
    v = state.PipelineState.load(str(tmp_path / "v1.json"))
    assert [v.is_completed(x) for x in ("import_tracks", "create_track_indexes", "set_logged", "prune")] == [True, True, True, False]
    (tmp_path / "v9.json").write_text('{"version": 9}')
    with pytest.raises(ValueError, match="version"):
        state.PipelineState.load(str(tmp_path / "v9.json"))
    spark.range(1).createOrReplaceTempView("one_row")
    assert state.table_exists(spark, "one_row")
    assert state.table_has_rows(spark, "one_row")
    assert state.column_exists(spark, "one_row", "id")
    assert not state.table_exists(spark, "none")


def test_shell(capsys):
    assert len(schema.tables("discogs")) == 13
    assert len(schema.tables("musicbrainz")) == 14
    assert len(schema.tables("wikidata")) == 8
    assert schema.columns("discogs", "artist_alias") == ["artist_id", "alias_id", "alias_name"]
    assert cli.resolve_database_url("", "X", {"X": "u"}) == "u"
    with pytest.raises(cli.CliError):
        cli.resolve_database_url(None, "X", {"X": ""})
    logger = log.init("r", "t", step="s", run_id="1")
    log.init("r", "t", step="s", run_id="1")
    assert len(logger.handlers) == 1


def test_sql_functions(spark):
    made = sqlfuncs.register(spark)
    assert "identity_match_artist" in made
    row = spark.sql("SELECT identity_match_artist('The Moth (Live)') AS a, match_form('SÓLIN  TAM') AS b, identity_match_with_punctuation('Q.T.V.') AS c, match_form(CAST(NULL AS STRING)) AS d, is_compilation_artist('V/A') AS e").first()
    assert tuple(row) == ("moth", "solin tam", "q t v", None, True)
    names = ["Шум", "한글", "がっき", "x “y”", "ÆØ", "", None, "שלום 9"]
    spark.createDataFrame([(n,) for n in names], "n string").createOrReplaceTempView("letters")
    assert [r["y"] for r in spark.sql("SELECT ascii_form(n) AS y FROM letters").collect()] == column(spark, text.ascii_form, names)


def test_export(spark):
    assert column(spark, export.extract_year, ["1999-01", "99", "abcd", None, "20x1"]) == [1999, None, None, None, None]


def test_streaming(spark, tmp_path):
    for k in range(3):
        spark.range(k * 5, k * 5 + 8).select(F.col("id").alias("n"), (F.col("id") % 10).alias("k")).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        f = next((tmp_path / f"in{k}").glob("part-*"))
        f.rename(folder / f"{k}.parquet")
    stream = streaming.read_parquet(spark, str(folder), "n long, k long", files_a_batch=1)
    streaming.run_deduplicated(stream, "k", "n", str(tmp_path / "out"), str(tmp_path / "seen"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == list(range(10))


def test_streaming_windows(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a", 1), ("2024-01-01 10:40:00", "a", 1), ("2024-01-01 10:50:00", "b", 2), ("2024-01-01 12:10:00", "a", 1)]
    spark.createDataFrame(rows, "t string, kind string, k long").selectExpr("CAST(t AS TIMESTAMP) AS t", "kind", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_parquet(spark, str(tmp_path / "in"), "t timestamp, kind string, k long")
    counts = streaming.windowed_counts(stream, "t", "kind")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((str(r["start"])[11:16], r["kind"], r["n"]) for r in spark.table("counts").collect()) == [("10:00", "a", 2), ("10:00", "b", 1), ("12:00", "a", 1)]
    first = streaming.dedup_within(stream, "k", "t", "2 hours")
    first.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == [1, 2]
