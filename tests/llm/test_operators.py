"""Each operator against a plain version, on real rows and on awkward ones."""

import random
import zlib

import numpy as np
import pytest
from llm_brute import WORD, base_quality, base_sha256, base_spans, crc, fingerprint, groups, ids_of
from pyspark.sql import functions as F

from tonearm.llm import (
    _common,
    crf_quality,
    html_density,
    language_id,
    packing,
    pii,
    pivot_search,
    rans_tokens,
    simhash,
    source_mix,
    token_rollups,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "\u0085\x1c x y", "A\tB\x0bC\x0cD\rE", "same line\nsame line\n\nsame line ", "x" * 5000, "word " * 3000,
    "mail a.b+c@d.e.f_g@h.ij, @no.pe a@b a@b.c.", "ip 1.2.3.4 01.002.255.0 256.1.1.1 1.2.3.4.5.6.7.8", "card 4433 6680 4113 3334 4433-6680-4113-3334 4433668041133335 44336680411333340000000",
    "+1 (438) 555-7372 +1 2 +123456789012345 +1--------------2 ++49 30 123456 78", "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000 GB82WEST12345698765433", "ssn 123-45-6789 and 123-45-6789 far", "é" * 50 + " ü@x.de a@x.de ñ", "日本語 テキスト 😀 1.1.1.1 😀 a@b.co",
    "<|endoftext|> don't I'M '' ß Σ", "1" * 4000, "a" * 4000 + "@", "a@" * 500, "+1" + " " * 3000,
]


@pytest.fixture(scope="module")
def real(sf_dir):
    import pyarrow.parquet as pq

    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def rows(real):
    odd = [(10_000 + i, t, "en" if i % 2 else None, None if i % 3 else "src0", 0) for i, t in enumerate(ODD)]
    return real + odd + [real[0], odd[12], odd[0]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    # other columns, with names that the operators use inside
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "fp", "size", "ids", "pack_group", "pii_spans", "bucket", "component_id")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_common.tokenizer_path())


def by_id(rows):
    return {r[0]: r[1] for r in rows}


def test_quality_base_counts(docs, rows, empty):
    out = crf_quality.judge(docs, None).collect()
    texts = by_id(rows)
    assert len(out) == len(rows)
    for r in out:
        want = base_quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, repr((texts[r["doc_id"]] or "")[:80])
        assert r["kept"] == (not r["base_failed"])
    assert crf_quality.judge(empty, None).count() == 0


def test_lines_of_mixed_documents(spark, sf_dir):
    """Documents spliced from good and bad ones: lines keep their labels, shares lie between."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    d, labels = _common.read(spark, folder, "documents"), _common.read(spark, folder, "labels")
    model = crf_quality.fit(d, labels)
    known = d.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").where("length(text) > 200").orderBy("doc_id").collect()
    lines = {k: [x for r in known if r["quality"] == k for x in r["text"].split("\n")[:6] if len(x) > 30][:600] for k in (0, 1)}
    rnd, texts, truth = random.Random(2), [], []
    for _ in range(60):
        text, marks = [], []
        for turn in range(4):
            n = rnd.randint(3, 8)
            text += rnd.sample(lines[turn % 2], n)
            marks += [turn % 2] * n
        texts.append("\n".join(text))
        truth += marks
    x = crf_quality.Lines(texts)
    label = crf_quality.viterbi(x.features, x.doc, len(texts), *model)
    assert len(label) == len(truth)
    assert (label == np.array(truth)).mean() > 0.85
    share = np.bincount(x.doc, label) / np.bincount(x.doc)
    assert ((share > 0) & (share < 1)).mean() > 0.9
    # long documents take part in the training: with nothing else there is still a model
    long = d.withColumn("text", F.concat_ws("\n", F.array_repeat("text", 30)))
    assert crf_quality.fit(long, labels, 100) is not None
    clash = d.withColumns({"l_doc_id": F.lit(1), "l_quality": F.lit(0), "d_doc_id": F.lit("x")})
    assert crf_quality.fit(clash, labels, 100) is not None
    assert crf_quality.fit(d.limit(0), labels) is None


def test_verdicts_against_all_labellings(spark, sf_dir):
    """The verdict of whole texts from the best of all labellings of their lines."""
    d, labels = (_common.read(spark, sf_dir, t) for t in ("documents", "labels"))
    w, pair = crf_quality.fit(d, labels)
    out = {r["doc_id"]: r for r in crf_quality.judge(d, (w, pair)).collect()}
    n = 0
    for r in d.where("length(text) < 3000").orderBy("doc_id").limit(120).collect():
        x = crf_quality.Lines([r["text"] or ""])
        if not 0 < len(x.doc) <= 9:
            continue
        s = x.features @ w
        best = max(np.ndindex(*[2] * len(s)), key=lambda c: sum(s[t, c[t]] for t in range(len(s))) + sum(pair[c[t - 1], c[t]] for t in range(1, len(s))))
        share = (x.chars * np.array(best)).sum() / x.chars.sum()
        assert out[r["doc_id"]]["content_share"] == pytest.approx(share)
        assert out[r["doc_id"]]["kept"] == (not base_quality(r["text"])["base_failed"] and share >= crf_quality.CONTENT_SHARE)
        n += 1
    assert n > 20


def test_crf_training_and_viterbi():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 80)
    x = np.ones((80, 6, 2))
    x[:, :, 1] = rng.normal(size=(80, 6)) + 3 * (y[:, None] - 0.5)
    n = rng.integers(1, 7, 80)
    w, pair = crf_quality.train(x, n, y)
    doc = np.repeat(np.arange(80), n)
    flat = np.concatenate([x[i, : n[i]] for i in range(80)])
    label = crf_quality.viterbi(flat, doc, 80, w, pair)
    assert (label == y[doc]).mean() > 0.97
    for i in range(10):  # against all labellings
        s = x[i, : n[i]] @ w
        best = max(np.ndindex(*[2] * n[i]), key=lambda c: sum(s[t, c[t]] for t in range(n[i])) + sum(pair[c[t - 1], c[t]] for t in range(1, n[i])))
        assert label[doc == i].tolist() == list(best)


def test_quality_verdicts_follow_labels(spark, sf_dir):
    d, labels = (_common.read(spark, sf_dir, t) for t in ("documents", "labels"))
    out = crf_quality.query(spark, sf_dir).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert (out["kept"] == (out["quality"] == 1)).mean() > 0.9
    assert out[out["quality"] == 1]["kept"].mean() > 0.97
    assert crf_quality.fit(d, labels.limit(0)) is None


def test_packing(docs, rows, tokenizer, empty):
    out = packing.pack_documents(docs).collect()
    want = {i: ids_of(tokenizer, t) for i, t in by_id(rows).items()}
    copies = {i: sum(r[0] == i for r in rows) for i in want}
    at, found = {}, {}
    for r in out:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == {i: len(ids) * copies[i] for i, ids in want.items()}
    total = 0
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert total / (2048 * len(at)) > 0.98
    assert packing.pack_documents(empty).count() == 0


def test_best_fill_is_optimal():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(1, 60)
        used = packing.best_fill(counts, room)
        sums = {0}
        for x, n in counts.items():
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= room}
        assert sum(x * n for x, n in used.items()) == max(sums)
        assert all(n <= counts[x] for x, n in used.items())


def test_sequences_hold_the_ids(spark, tokenizer):
    d = spark.createDataFrame([(i, f"word{i} " * (1 + 97 * i), None, None, 0) for i in range(30)], SCHEMA)
    packed = packing.pack_documents(d)
    sequences = {r["sequence_id"]: r["ids"] for r in packing.materialise(d, packed, _common.tokenizer_path()).collect()}
    for r in packed.collect():
        assert crc(sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == r["ids_crc32"]


def test_token_files(spark, docs, rows, tokenizer, empty):
    path = _common.new_path(spark, "test-tokens")
    rans_tokens.write_tokens(docs, path, _common.tokenizer_path(), block_ids=3000)
    out = sorted(rans_tokens.read_tokens(spark, path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    want = {i: ids_of(tokenizer, t) for i, t in by_id(rows).items()}
    assert [r["doc_id"] for r in out] == sorted(r[0] for r in rows)
    at = 0
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want[r["doc_id"]]), crc(want[r["doc_id"]]))
        at += r["n_tokens"]
    path = _common.new_path(spark, "test-tokens")
    rans_tokens.write_tokens(empty, path, _common.tokenizer_path())
    assert rans_tokens.read_tokens(spark, path).count() == 0


def test_coder_round_trip_and_checksums():
    rng = np.random.default_rng(1)
    for n in (1, 5, 1023, 1024, 1025, 131_072, 131_073, 300_000):
        ids = (rng.zipf(1.3, n) % 49_408).astype("u2")
        table = rans_tokens.Table(rans_tokens.scaled_table(np.bincount(ids, minlength=1 << 16)))
        assert int(table.freq.sum()) == 1 << rans_tokens.SCALE
        block = rans_tokens.pack_block(table, [7], [n], ids)
        assert (rans_tokens.unpack_block(rans_tokens.Table.unpack(table.pack()), block)[2] == ids).all()
        broken = bytearray(block)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans_tokens.unpack_block(table, bytes(broken))


def test_language(spark, docs, rows, real, empty):
    models = language_id.train(docs)
    out = {r["doc_id"]: r for r in language_id.identify(docs, models).collect()}
    assert set(models.languages) == {r[2] for r in rows if r[2]}
    for i, t in by_id(rows).items():
        letters = any(c.isalpha() for c in t or "")
        assert (out[i]["lang_pred"] == "und") == (not letters)
        assert 0 <= out[i]["score"] <= 1
    held = [r for r in real if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.9
    kept = {r["doc_id"] for r in language_id.keep_accepted(docs, models).collect()}
    assert sum(r[0] in kept for r in real) / len(real) > 0.98
    assert language_id.keep_accepted(docs, models).columns == docs.columns
    none = language_id.train(empty)
    assert {(r["lang_pred"], r["rejected"]) for r in language_id.identify(docs, none).collect()} == {("und", False)}
    assert language_id.keep_accepted(docs, none).count() == len(rows)  # without a model nothing is rejected
    assert language_id.identify(empty, models).count() == language_id.keep_accepted(empty, models).count() == 0


def test_kneser_ney_sums_to_one():
    words = ["aba", "abb", "b", "ba", "cab"]
    m = language_id.fit_models(words, np.array([[3, 0], [1, 2], [2, 2], [0, 5], [1, 1]], float), ["x", "y"], 3)
    for history in ("", "a", "ab", "ca", "q"):
        before = _prefix_bits(m, history)
        # z stands for all characters that no model has seen
        following = sum(np.exp2(before - _prefix_bits(m, history + c)) for c in "abcz")
        ends = np.exp2(before - m.score([history])[0][0])
        assert following + ends == pytest.approx(np.ones(2))


def _prefix_bits(m, text):
    """Bits of the characters of ``text`` without its end mark."""
    word, place, hashes = language_id.grams([text], len(m.gram))
    here = np.flatnonzero(place > 0)
    at, found = language_id.find(m.gram[0], hashes[0][here])
    p = np.where(found[:, None], m.prob[0][at], m.base[None])
    for n in range(2, len(m.gram) + 1):
        live = np.flatnonzero(place[here] >= n - 1)
        pos = here[live]
        at, found = language_id.find(m.gram[n - 1], hashes[n - 1][pos])
        up, got = language_id.find(m.context[n - 1], hashes[n - 2][pos - 1])
        p[live] = np.where(found[:, None], m.prob[n - 1][at], np.where(got[:, None], m.lower[n - 1][up], 1.0) * p[live])
    return -np.log2(p[:-1]).sum(0)


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    ("<p>one<p>two &amp; three", "one two & three"),
    ("<body><nav><a href=x>menu</a></nav><div class='sidebar-left'>side " + "bar " * 30 + "</div><article><h1>Head</h1><p>Long text " + "word " * 40 + "</p></article><footer>foot</footer>", "Head Long text " + ("word " * 40).strip()),
    ("<body><div id=cookie-notice>We use cookies</div><main><p>Body <b>bold</b>er <a href=y>link</a> text " + "w " * 50 + "</p><div class=comments><p>first!</p></div></main>", "Body bolder link text " + ("w " * 50).strip()),
    ("<!-- c --><script>var a='<p>no</p>'</script><style>p{}</style><p>yes  \n yes</p><form><input><p>ask</p></form>", "yes yes"),
    ("<ul><li>a long item here<li>another long item</ul>", "a long item here another long item"),
    ("<p hidden>no</p><p>1 &lt; 2 &#8364; &copy;</p>", "1 < 2 € ©"),
    ("<p>open <!-- never closed <p>gone", "open"),
]


def test_html(spark):
    out = {r["page_id"]: r for r in html_density.extract(spark.createDataFrame([(i, None, h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert out[i]["text"] == want, i
        assert out[i]["n_chars"] == len(want)
    long = "A fairly long sentence of an article, with a few words. " * 4
    two = f"<body><article><p>{long}</p></article><article><p>{long}</p><p>{long}</p></article></body>"
    assert html_density.main_text(two)[0] == " ".join([long.strip()] * 3)
    talk = f"<body><div class=post><p>{long}</p></div><div id=comments>{f'<p>{long}</p>' * 8}</div></body>"
    assert html_density.main_text(talk)[0] == long.strip()
    named = f"<body><div class=cookie-consent>{long}</div><div class='content sidebar-right'><p>{long}</p><p>{long}</p></div></body>"
    assert html_density.main_text(named)[0] == " ".join([long.strip()] * 2)
    deep = "<div>" * 5000 + "<p>deep text</p>"
    assert html_density.main_text(deep)[0] == "deep text"


def test_html_articles(spark, sf_dir):
    import html
    import re

    for r in html_density.query(spark, sf_dir).join(_common.read(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        body = r["html"]
        inner = body[body.index("<article>") + 9 : body.index("</article>")]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))
        assert r["text"] == " ".join(html.unescape(inner).split())


def test_pii(docs, rows, empty, spark):
    texts = by_id(rows)
    found = pii.add_spans(docs.select("doc_id", "text"))
    for r in found.collect():
        text = texts[r["doc_id"]]
        base = [(s["start"], s["kind_no"], s["end"], s["kind"]) for s in r["pii_spans"] if s["kind_no"] < 4]
        assert base == base_spans(text), repr((text or "")[:90])
    added = {(r["doc_id"], s["kind"]) for r in found.collect() for s in r["pii_spans"] if s["kind_no"] >= 4}
    assert {k for i, k in added if i == 10_000 + 16} == {"iban"}
    assert sum(k == "ssn" for _, k in added) == 1
    clean = found.select("doc_id", pii.redacted(F.coalesce("text", F.lit("")), F.col("pii_spans")).alias("t")).collect()
    for r in clean:
        assert not base_spans(r["t"]) or texts[r["doc_id"]] in ODD
    assert pii.add_spans(empty).count() == 0


def test_pii_query(spark, sf_dir, real):
    out = {r["doc_id"]: r for r in pii.query(spark, sf_dir).collect()}
    for i, t in by_id(real).items():
        spans = base_spans(t)
        assert out[i]["base_sha256"] == base_sha256(spans)
        assert [out[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[3] == k for s in spans) for k in pii.KINDS[:4]]


def test_simhash(docs, rows, empty):
    out = simhash.near_duplicates(docs, bucket=20).collect()
    fps = {i: fingerprint(t) for i, t in by_id(rows).items()}
    want = groups(fps)
    assert len(out) == len(rows)
    for r in out:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [4, 64])
def test_simhash_links_of_planted_fingerprints(spark, bucket):
    rnd = random.Random(bucket)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                y ^= 1 << b
            fps.add(y)
    signed = [(y - (1 << 64) if y >> 63 else y,) for y in fps]
    d = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(d, bucket=bucket)).collect()}
    want = groups({y[0] % (1 << 64): y[0] % (1 << 64) for y in signed})
    same = {}
    for node in fps:
        s = node - (1 << 64) if node >> 63 else node
        same.setdefault(roots.get(s, s), set()).add(want[node])
    assert all(len(v) == 1 for v in same.values())
    assert len(same) == len(set(want.values()))


def test_thresholds():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64)).astype("f8")
    for n in (500, 10**6, 10**10):
        parts = simhash.plan(n, bits.T @ bits * (n / 500))
        used = [b for g, _ in parts for b in g]
        assert len(used) == len(set(used))
    cost, ts = simhash.allocate([[0, 5, 50, 500, 5000], [0, 1, 2, 3, 4]], 3)
    assert (sum(ts), cost) == (2, 4.0)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(400)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8)]
    vectors += [(450, vectors[7][1]), (451, vectors[7][1]), (3, vectors[3][1])]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.top_k(d, d.where("vec_id % 50 = 0"), pivots=16).collect())
    fine = [(i, np.floor(np.array(v, "f8") * 256)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in fine:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in fine if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert pivot_search.top_k(d.limit(0), d.limit(0)).count() == 0
    assert pivot_search.top_k(d, d.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 30.0, 3e5, 3e9, 3e38])
def test_top_k_of_any_finite_size(spark, size):
    """Whole-number scores, also beyond doubles and longs; blocks of a few rows."""
    rng = np.random.default_rng(int(np.log10(size)) + 3)
    vectors = [(i, (rng.normal(size=6).astype("f4") * (size if i % 7 < 2 else 1)).clip(-3.3e38, 3.3e38).astype("f4").tolist()) for i in range(160)]
    vectors += [(200, [0.0] * 6), (250, [size] * 6), (251, [size] * 6), (252, [-size] * 6)]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.top_k(d, d.where("vec_id % 50 = 0"), pivots=3, query_block=2, candidate_block=16).collect())
    whole = lambda v: [int(np.floor(256 * float(x))) for x in v]
    fine = [(i, whole(v)) for i, v in vectors]
    want = []
    for q, x in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q)[:5]
            want += [(q, k + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_share(spark, sf_dir):
    """Most candidates are never scored, though these vectors have no structure to speak of."""
    vectors = _common.read(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings")
    assert pivot_search.evaluated_share(vectors, vectors.where("vec_id % 50 = 0")) < 0.3


def test_mix(docs, rows, empty):
    out = source_mix.mix(docs).collect()
    assert len(out) == len(rows)
    sizes, taken, goal = {}, {}, {}
    source = {r[0]: r[3] for r in rows}
    for r in out:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        goal[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted(x for x in sizes if x is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free and (over := [s for s in free if left / sum(weight[x] for x in free) * weight[s] > 2 * sizes[s]]):
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= set(over)
    want |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    for s in order:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - goal[s]) <= 1
    # the selection: in each source a prefix in the order of the keys, for what epochs leave
    keys = {(r["doc_id"], r["size"]): r["key"] for r in source_mix.sized(docs).collect()}
    for s in order:
        mine = sorted((r for r in out if source[r["doc_id"]] == s and r["size"]), key=lambda r: (keys[r["doc_id"], r["size"]], r["doc_id"]))
        epochs = int(round(goal[s])) // max(1, sizes[s])
        part = [r["taken"] - epochs * r["size"] for r in mine]
        whole = [p == r["size"] for p, r in zip(part, mine, strict=True)]
        n = whole.index(False) if False in whole else len(whole)
        assert not any(part[n + 1 :])
        assert sum(part) == int(round(goal[s])) - epochs * sizes[s]
    again = sorted((r["doc_id"], r["taken"]) for r in source_mix.mix(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in out)
    assert source_mix.mix(empty).count() == 0


CHANGES = "kind string, source string, lang string, tokenizer_version string, old_tokens long, new_tokens long"


def batches(spark):
    a = spark.createDataFrame([("insert", "s", "en", "1", None, 10), ("insert", "s", "en", "1", None, 5), ("insert", None, None, "1", None, None)], CHANGES)
    b = spark.createDataFrame([("delete", "s", "en", "1", 5, None), ("revise", "s", "en", "1", 10, 12), ("delete", None, None, "1", 0, None)], CHANGES)
    return a, b


def test_rollup_is_idempotent(spark):
    r = token_rollups.Rollup(spark, _common.new_path(spark, "test-rollup"))
    a, b = batches(spark)
    assert r.totals().count() == 0
    assert r.apply("a", a)
    assert not r.apply("a", a)
    assert r.apply("b", b.withColumn("extra", F.lit(1)))
    assert r.apply("none", a.limit(0))
    want = [("s", "en", "1", 1, 12)]
    assert [tuple(x) for x in r.totals().collect()] == want
    # folded, the batches count once and stay applied
    assert r.compact()
    assert not r.compact()
    assert [tuple(x) for x in r.totals().collect()] == want
    assert not r.apply("b", b)
    r.vacuum()
    assert [tuple(x) for x in r.totals().collect()] == want
    assert r.batches() == ["a", "b", "none"]
    with pytest.raises(Exception, match="unknown kind"):
        r.apply("bad", spark.createDataFrame([("what", "s", "en", "1", 1, 1)], CHANGES))
    assert not r.committed("bad")
    # a row that stands for many
    assert r.apply("many", spark.createDataFrame([("insert", "s", "en", "1", None, 2, 1000)], CHANGES + ", n_rows long"))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "1", 1001, 2012)]


def test_rollup_with_other_writers(spark):
    path = _common.new_path(spark, "test-rollup")
    a, b = batches(spark)
    one, two = token_rollups.Rollup(spark, path), token_rollups.Rollup(spark, path, fold=1)
    entry = one._entry
    # the other writer commits between this one's reading and writing
    seen = [entry(), None]

    def late():
        if seen[0] is not None:
            first, seen[0] = seen[0], None
            assert two.apply("a", a)
            return first
        return entry()

    one._entry = late
    assert not one.apply("a", a)  # the same batch: it counts once
    one._entry = entry
    assert one.apply("b", b)
    assert [tuple(x) for x in two.totals().collect()] == [("s", "en", "1", 1, 12)]
    # an entry that its writer did not finish does not count, nor does its number come again
    place = one._place(f"{path}/manifest/{99:012d}")
    one._fs.create(place, False).close()
    assert [tuple(x) for x in one.totals().collect()] == [("s", "en", "1", 1, 12)]
    assert two.apply("c", a)
    assert one.batches() == ["a", "b", "c"]
    assert [x["n_tokens"] for x in one.totals().where("source = 's'").collect()] == [27]


def test_rollup_of_documents(spark, docs, rows, tokenizer, empty):
    """Against counts of the rows that remain, without rollups."""
    versions = {v: _common.tokenizer_path(f) for v, f in token_rollups.VERSIONS.items()}
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(versions["byte-bpe-50k"], "rb"))}
    ranked = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollups.maintained(docs, _common.new_path(spark, "test-rollup")).totals().collect()}
    seen, want = set(), {}
    for _, text, lang, source, _ in sorted(rows, key=lambda r: (r[0], r[3] is None, r[3] or "", r[2] is None, r[2] or "")):
        if text is not None and text in seen:
            continue
        seen.add(text)
        for version, n in (("word-bpe-49k", len(ids_of(tokenizer, text))), ("byte-bpe-50k", len(ranked.encode_ordinary(text or "")))):
            docs_, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (docs_ + 1, tokens + n)
    assert got == want
    assert token_rollups.maintained(empty, _common.new_path(spark, "test-rollup")).totals().count() == 0


def redacted(text):
    spans, out, at = base_spans(text), [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def alike_groups(texts):
    """id -> least id of its group of five-word shingle sets at 0.8, all pairs compared."""
    sets = {}
    for i, t in texts.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and root[a] != root[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return root


def test_pipeline(spark, sf_dir, docs, rows):
    """Each stage against a plain version, on its own input."""
    import corpus_pipeline as p

    d = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in p.STAGES:
        path = _common.new_path(spark, f"test-{name}")
        stage(spark, d, sf_dir).write.parquet(path)
        before, out = d.collect(), spark.read.parquet(path)
        after = out.collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        if name != "packing":
            assert out.columns == d.columns
        if name == "language_id":
            assert not any(any(c.isalpha() for c in t or "") and r["doc_id"] < 10_000 for r in before for t in [r["text"]] if r["doc_id"] not in {a["doc_id"] for a in after})
            assert all(any(c.isalpha() for c in r["text"]) for r in after)
            assert len({r["doc_id"] for r in after} & {r[0] for r in rows if r[0] < 10_000}) == len({r[0] for r in rows if r[0] < 10_000})
        elif name == "simhash_near_dedup":
            want = alike_groups(texts)
            assert sorted(r["doc_id"] for r in after) == sorted(set(want.values()))
            assert all(r["text"] == texts[r["doc_id"]] for r in after)
        elif name == "pii":
            assert len(after) == len(before)
            for r in after:
                if "IBAN" not in (texts[r["doc_id"]] or "") and "ssn" not in (texts[r["doc_id"]] or ""):
                    assert r["text"] == redacted(texts[r["doc_id"]])
                assert r["n_chars"] == len(r["text"])
        elif name == "source_mix":
            taken = {(r["doc_id"], r["size"]): r["taken"] for r in source_mix.mix(d).collect()}
            want = {i: int(t / n + 0.5) for (i, n), t in taken.items() if n and int(t / n + 0.5)}
            for r in after:
                kept[r["doc_id"]] = kept.get(r["doc_id"], 0) + 1
                assert r["text"] == texts[r["doc_id"]]
            assert kept == want
        else:
            starts = {}
            for r in after:
                starts.setdefault(r["doc_id"], []).append(r["start"])
            assert {i: x.count(0) for i, x in starts.items()} == kept
        d = out
