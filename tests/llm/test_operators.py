"""The text operators on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specengine.llm import (
    dart_minhash, language_id, license_align, mixing, packing, quality_lm, quality_rules, scaled_sketch, toxicity,
    warc_dict,
)
from specengine.llm.common import table, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark, folder):
    """The smallest table with odd rows: nulls in every column, blank, long and repeated texts."""
    given = table(spark, folder, "documents")
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    odd = [(9001, None, "en", "src1", None), (9002, "", "en", None, 0), (9003, " \n\t ", None, "src1", 4),
           (None, "words of a row without id", None, None, 25), (9005, "one", "en", "src2", 3),
           (9006, long_text, "en", "src0", len(long_text)), (9007, "same text in five words", "en", "src1", 23),
           (9007, "same text in five words", "en", "src1", 23), (9008, "!!! 123 ---", "de", "src3", 11)]
    return given.select(*[c.split()[0] for c in SCHEMA.split(", ")]).union(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="module")
def labels(spark, folder):
    return table(spark, folder, "labels").select("doc_id", "quality", "toxic").union(spark.createDataFrame(
        [(None, 1, 1), (9006, None, None), (9007, 1, 0), (9007, 1, 0)], LABELS))


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def by_name(df):
    return sorted(df.select(sorted(df.columns)).collect(), key=str)


def test_mixing_is_its_sql(spark, docs, nothing):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(mixing.MIX_SQL).df()
    got = mixing.mix(docs).toPandas()
    key = ["doc_id", "source", "size"]
    order = sorted(want.columns)
    a, b = (x.assign(doc_id=x.doc_id.fillna(-1).astype("int64")).sort_values(key)[order] for x in (got, want))
    for column in order:
        assert a[column].tolist() == b[column].tolist()
    assert (got.taken <= 3 * got["size"]).all()
    sums = got.groupby("source", dropna=False).agg(t=("target", "first"), k=("taken", "sum"))
    assert (sums.t - sums.k).abs().max() <= 1
    assert mixing.mix(nothing[0]).count() == 0


def test_mixed_documents_take_what_is_planned(docs):
    want = {(r[0], r[1]): r[2] for r in mixing.mix(docs).groupBy("source", "doc_id").agg(F.sum("taken")).collect() if r[2]}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.source, r.doc_id] += len(WORD.findall(r.text))
    assert got == want


def test_caps_are_shared_again(spark):
    rows = [(i, "a " * n, s) for i, (s, n) in enumerate([("a", 900), ("b", 10), ("c", 10), (None, 80)])]
    out = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (out["b"].target, out["c"].target) == (30, 30)
    assert out["a"].target + out[None].target == pytest.approx(940)


def brute_counts(text):
    found = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    inside = {i + k for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for k in range(8)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_rule_counts(docs, nothing):
    out = quality_rules.judge(docs.withColumn("extra", F.lit(1)))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == Counter((i, *brute_counts(t)) for i, t in texts(docs))
    for r in out.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing[0]).count() == 0


def test_sketch_buckets(spark):
    values = spark.range(0, 5000).select("id", quality_rules.sketch_bucket(F.col("id")).alias("b")).withColumn(
        "top", quality_rules.bucket_top(F.col("b"))).orderBy("id").toPandas()
    assert (values.b.diff().dropna() >= 0).all()
    assert (values.top >= values.id).all() and (values.top <= values.id * (1 + 1 / 64)).all()


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = WORD.findall(t)
        if w:
            bags[i] = Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4)))
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    holders = {}
    for i in ids:
        for s in bags[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        shared = sum((bags[a] & bags[b]).values())
        if shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def test_near_duplicates(docs, nothing):
    got = dart_minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = brute_classes([x for x in texts(docs) if x[0] is not None])
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    kept = dart_minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert dart_minhash.near_duplicates(nothing[0]).count() == 0


def edited(text, places, mark):
    out = list(text)
    for p in places:
        out[p] = f"{mark}at{p}"
    return out


def test_near_duplicates_of_one_member(spark):
    """Groups of near copies, each with texts that are similar to one member only, and chains of three."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(300)]
        spots = np.arange(6, 294, 6)
        for v in range(200 if g == 0 else 50):
            one = edited(base, [rng.choice(spots[:24])], f"v{v}")
            rows.append(" ".join(one))
            if v < 15:
                rows.append(" ".join(edited(one, rng.choice(spots[24:], 6, False), f"p{v}")))
    for c in range(20):
        chain = [f"c{c}w{i}" for i in range(300)]
        for k in range(3):
            rows.append(" ".join(chain))
            chain = edited(chain, range(6 + 96 * k, 6 + 96 * k + 36, 6), f"k{k}")
    rows = list(enumerate(rows))
    got = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


@pytest.mark.parametrize("size", [1, 3, 7, 512])
def test_blocks_link_what_is_similar(spark, size):
    """Twenty texts of one bucket: links join exactly the classes that brute force joins, whatever the blocks."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    texts_ = [" ".join(edited(base, rng.choice(200, 2 * (i % 5), False), f"v{i}")) for i in range(20)]
    node = [bytes([i]) * 16 for i in range(20)]
    own = [node[0] if i < 5 else node[i] for i in range(20)]
    data = pa.array(texts_)
    element, row = dart_minhash.weighted_elements(*utf8(data))
    sig = dart_minhash.signatures(element, row, 20)
    short = (sig >> np.uint64(56)).astype(np.uint8)
    keys = np.array([[7, *range(100 * i, 100 * i + 39)] for i in range(20)])
    blocks, parts = -(-20 // size), -(-15 // size)
    rows = spark.createDataFrame(
        [(node[i], own[i], np.sort(element[row == i]).tobytes(), [(7, blocks, parts, i >= 5)],
          short[i].tobytes() + keys[i].tobytes()) for i in range(20)],
        "node binary, own binary, elements binary, buckets array<struct<key:long,blocks:long,parts:long,asks:boolean>>, "
        "sig binary")
    links = [(bytes(r.node)[0], bytes(r.leader)[0]) for r in dart_minhash.block_links(rows, 0.8).collect()]
    exact = {(a, b): dart_minhash.jaccard(data.take([a]), data.take([b]))[0] for a in range(20) for b in range(a)}
    assert all(exact[max(p), min(p)] >= 0.8 for p in links)

    def joined(pairs):
        label = list(range(20))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return sorted(sorted(i for i in range(20) if label[i] == x) for x in set(label))

    first = [(0, i) for i in range(5)]
    assert joined(first + links) == joined(first + [p for p, x in exact.items() if x >= 0.8])
    assert 1 < len(joined(first + links)) < 16 and len(links) < 20 * blocks * parts


def test_pairs_below_the_similarity_leave_no_rows(spark, monkeypatch):
    """Texts of 0.65 to 0.75 share buckets by the thousand; what is handed on doesn't grow with their pairs."""
    rng = np.random.default_rng(2)
    counted = []
    made = dart_minhash.block_links
    monkeypatch.setattr(dart_minhash, "block_links", lambda *a: counted.append(made(*a)) or counted[-1])
    for n in (150, 300):
        base = [f"w{i}" for i in range(150)]
        rows = [" ".join(edited(base, rng.choice(150, 3, False), f"v{i}")) for i in range(n)]
        rows = list(enumerate(rows))
        got = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
        assert counted[-1].count() < n


def test_quality_keeps_columns_and_finds_blanks_of_any_length(spark, folder):
    docs = table(spark, folder, "documents").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    blank = spark.createDataFrame([(8001, " " * 100, "en", "s", 1), (8002, " \t" * 5000, "en", "s", 1),
                                   (8003, "\n" * 300, "de", "s", 1)], SCHEMA)
    named = docs.union(blank).withColumns(
        {"kept": F.lit("mine"), "perplexity": F.lit("p"), "bits_limit": F.lit(1), "BITS_PER_BYTE": F.lit(2)})
    labels = table(spark, folder, "labels")
    out = quality_lm.keep_quality(named, labels)
    assert out.columns == named.columns
    rows = out.collect()
    assert {(r.kept, r.perplexity, r.bits_limit, r["BITS_PER_BYTE"]) for r in rows} == {("mine", "p", 1, 2)}
    assert {r.doc_id for r in rows} == {r.doc_id for r in quality_lm.keep_quality(docs, labels).collect()}
    scored = quality_lm.classify(blank, quality_lm.fit(docs, labels)).collect()
    assert [r.perplexity for r in scored] == [None] * 3 and not any(r.kept for r in scored)


def test_signatures_estimate_similarity():
    base = [f"w{i}" for i in range(400)]
    rows = [" ".join(base), " ".join(base[:-40] + [f"x{i}" for i in range(40)]), " ".join(base * 2), "a b"]
    element, row = dart_minhash.weighted_elements(*utf8(pa.array(rows)))
    sig = dart_minhash.signatures(element, row, 4)
    exact = dart_minhash.jaccard(pa.array(rows), pa.array([rows[0]] * 4))
    assert np.abs((sig == sig[0]).mean(1) - exact).max() < 0.09
    assert exact[2] == pytest.approx(0.5, abs=0.01)  # weights count
    assert (sig != 0).all()


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = docs.filter("doc_id >= 9001 OR doc_id < 60").union(docs.limit(1).select(
        F.lit(9100).cast("long"), F.lit("a  b  c　 d's 'll <|endoftext|> x \n y "), "lang", "source", "n_chars"))
    out = packing.pack(odd).toPandas()
    for doc, part in out.groupby("doc_id"):
        text = [t for i, t in texts(odd) if i == doc]
        ids = np.array(tokenizer.encode(text[0], add_special_tokens=False).ids + [1], "<u4")
        assert set(part.doc_tokens) == {len(ids)}
        for p in part.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
        assert part.length.sum() == len(ids) * len(text)
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all()
        n = part.length.sum()
        assert n <= 2048 and n & (n - 1) == 0
    assert packing.pack(nothing[0]).count() == 0


def test_language(spark, folder, docs, nothing):
    out = language_id.identify(docs).toPandas()
    known = docs.filter(F.col("lang").isNotNull() & (F.col("doc_id") < 9000)).toPandas().merge(out, on="doc_id")
    held = known[known.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.9
    assert set(out[out.doc_id.isin([9001, 9002, 9003, 9008])].lang_pred) == {"und"}
    assert out.score.between(0, 1).all()
    for r in out.dropna().itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)
    assert language_id.identify(nothing[0]).count() == 0


def test_bundles_are_sums_of_bound_trigrams():
    letters = {c: language_id.letter_vectors(np.array([ord(c)]))[0] for c in " abc"}

    def bound(t):
        return np.roll(letters[t[0]], 2) * np.roll(letters[t[1]], 1) * letters[t[2]]

    want = sum(bound(t) for t in (" ab", "ab ", " c "))
    got = language_id.bundles(pa.array(["AB, c!", None, "ab c"]))
    assert np.array_equal(got[0], want) and not got[1].any() and np.array_equal(got[2], want)


def plain_kneser_ney(train, text):
    """-log2 p of a text by the same model, written with dictionaries."""
    tables = {5: Counter()}
    for t in train:
        raw = b"\0" * 4 + t.encode() + b"\3"
        tables[5].update(raw[i:i + 5] for i in range(len(raw) - 4))
    for n in (4, 3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cuts, totals, freed = {}, {}, {}
    for n, grams in tables.items():
        c = [max(1, sum(v == i for v in grams.values())) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        cuts[n] = [min(i - 0.05, max(0.05, i - (i + 1) * y * c[i] / c[i - 1])) for i in (1, 2, 3)]
        totals[n], freed[n] = Counter(), Counter()
        for g, v in grams.items():
            totals[n][g[:-1]] += v
            freed[n][g[:-1]] += cuts[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 257
        if g[:-1] not in totals[n]:
            return lower
        v = tables[n][g]
        kept = v - cuts[n][min(v, 3) - 1] if v else 0
        return (kept + freed[n][g[:-1]] * lower) / totals[n][g[:-1]]

    raw = b"\0" * 4 + text.encode() + b"\3"
    return -sum(np.log2(p(raw[i:i + 5])) for i in range(len(raw) - 4))


@pytest.mark.parametrize("shard_rows", [10 ** 9, 40])
def test_language_model_is_kneser_ney(spark, shard_rows):
    train = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "thé chat"]
    asked = ["the cat", "zebra!", "", "a dog sat on thé mat", "\x00\x03"]
    counts = quality_lm.gram_counts(spark.createDataFrame([(t,) for t in train], "text string"))
    model = quality_lm.broadcast_model(spark, quality_lm.probabilities(counts), shard_rows)
    assert (len(model.shards) > 1) == (shard_rows == 40)
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.bits for r in quality_lm.with_bits(rows, model, "text", "bits", "size").collect()}
    for i, text in enumerate(asked):
        if text.strip():
            assert got[i] == pytest.approx(plain_kneser_ney(train, text), rel=1e-5)
        else:
            assert got[i] is None


def test_quality(spark, docs, labels, nothing):
    many = table(spark, "/root/testdata/sf0.01", "documents")  # enough labels for rates
    marks = table(spark, "/root/testdata/sf0.01", "labels")
    out = quality_lm.classify(many, quality_lm.fit(many, marks)).toPandas().merge(marks.toPandas(), on="doc_id")
    assert out[out.quality == 1].kept.mean() > 0.97
    assert out[out.quality == 0].kept.mean() < 0.4
    none = quality_lm.classify(docs, quality_lm.fit(docs, nothing[1])).filter("doc_id IN (9001, 9002, 9003, 9005)")
    assert {r.doc_id: r.kept for r in none.collect()} == {9001: False, 9002: False, 9003: False, 9005: True}
    assert quality_lm.keep_quality(nothing[0], labels).count() == 0


def test_toxicity(spark, docs, nothing):
    """Invented words mark the toxic rows; rows of held-out ids are told by them."""
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        w = list(rng.choice(plain, 60))
        if i % 3 == 0:
            w[i % 50] = f"nasty{i % 7}"
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 3 == 0)))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(own, spark.createDataFrame(marks, LABELS), shard_rows=100)
    assert model.parts > 1
    out = toxicity.with_score(own, model).withColumn("held", toxicity.is_held_out(F.col("doc_id"))).toPandas()
    held = out[out.held]
    assert ((held.score >= 0.7) == (held.doc_id % 3 == 0)).mean() > 0.98
    assert toxicity.with_score(docs, model).filter("score BETWEEN 0 AND 1").count() == docs.count()
    empty = toxicity.with_score(docs, toxicity.fit(docs, nothing[1]))
    assert empty.select("score").distinct().collect() == [(0.0,)]
    assert toxicity.keep_ordinary(nothing[0], nothing[1]).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_warc_round_trip(spark, folder, tmp_path):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    copy = pages.filter("page_id = 7").first().html
    odd = [(5000, "u", copy), (5001, None, None), (5002, "a\r\nb", "short"), (5003, "c", "short"), (None, "d", copy)]
    pages = pages.union(spark.createDataFrame(odd, pages.schema))
    out = warc_dict.archive(pages, payloads=True).collect()
    want = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in out) == Counter(
        (i, len(p), hashlib.sha256(p).hexdigest()) for i, p in want)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in out}
    assert kinds[5000] == kinds[None] == ("revisit", 7)
    assert kinds[7][0] == kinds[5001][0] == kinds[5002][0] == kinds[5003][0] == "response"
    assert all(bytes(r.payload) == dict(want)[r.page_id] for r in out if r.record_type == "response")
    manifest = warc_dict.write(warc_dict.with_types(pages.repartition(1)), str(tmp_path)).collect()
    assert manifest[0].dictionary_bytes > 0
    with open(manifest[0].path, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == 0x184D2A5D
    assert warc_dict.archive(pages.limit(0)).count() == 0


def test_alignment():
    assert license_align.align(list("xabcdex"), list("abcde")) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert license_align.align(list("aXbYc"), list("abc")) == [(0, 0), (2, 1), (4, 2)]
    assert license_align.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert license_align.align([], list("a")) == []


def test_license_scan(spark, docs, nothing):
    mit = license_align.TEMPLATES["MIT-text"]
    rows = [(1, "Some words.\n" + mit.replace("hereby", "herewith").upper() + " And more."), (2, "no license here"),
            (3, None), (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (5, "")]
    out = {r.doc_id: r for r in license_align.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(license_align.word_hashes(pa.array([mit]))[0])
    assert out[1].license == "MIT-text" and out[1].matched == n - 1
    assert (out[1].first_word, out[1].last_word) == (2, n + 1)
    assert {f.license for f in out[4].found} == {"MIT", "CC-BY-NC-4.0"}
    assert all(out[i].license is None for i in (2, 3, 5))
    marks = {"MIT": "Released under the MIT License.", "GPL-3.0": "under the GNU General Public License, version 3."}
    found = {r.doc_id: {f.license for f in r.found} for r in license_align.scan(docs).collect()}
    for i, t in texts(docs):
        for name, line in marks.items():
            assert line not in t or name in found[i]
    assert license_align.scan(nothing[0]).count() == 0


@pytest.mark.parametrize("name", sorted(license_align.TEMPLATES))
def test_license_copies_close_together(name):
    notice = license_align.TEMPLATES[name]
    scanner = license_align.Scanner(license_align.TEMPLATES, license_align.MIN_COVERAGE)
    n = len(license_align.word_hashes(pa.array([notice]))[0])
    words = notice.split()
    changed = " ".join("other" if i == len(words) // 2 and len(words) > 10 else w for i, w in enumerate(words))
    numbered = " ".join(f"{i} {w}" if len(words) > 40 and i % 3 == 2 else w for i, w in enumerate(words))
    for copies in ([notice] * 2, [notice] * 3, [notice, changed, notice], [changed] * 2, [numbered] * 2):
        for between in ("", "and", "some words that stand between them"):
            text = "foo " + f" {between} ".join(copies) + " bar"
            found = sorted(f for f in scanner.scan(pa.array([text]))[0] if f[0] == name)
            assert len(found) == len(copies), (copies, between)
            total = len(license_align.word_hashes(pa.array([text]))[0])
            gap = len(between.split())
            size = (total - 2 - gap * (len(copies) - 1)) // len(copies)
            places = [1 + k * (size + gap) for k in range(len(copies))]
            assert [(f[3], f[4]) for f in sorted(found, key=lambda f: f[3])] == [(p, p + size - 1) for p in places]
            assert all(f[2] >= n - 1 for f in found)


def test_fingerprints(spark, docs, nothing):
    rows = sorted(((i, t) for i, t in texts(docs)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        edited = t[:len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    out = scaled_sketch.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    long = [r for r in out if r.n_chars > 3000]
    assert abs(np.mean([r.near_edited for r in long]) - 0.75) < 0.05
    prints = {}
    for r in out:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert scaled_sketch.fingerprints(nothing[0]).count() == 0


def test_pipeline(spark, docs, labels, folder, tmp_path):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r.doc_id for r in kept.collect())
        path = str(tmp_path / name)
        stage(spark, kept, folder).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
        if name in ("quality", "toxicity", "near_dedup"):
            assert not Counter(r.doc_id for r in after.collect()) - before
        kept = after
    assert set(r.doc_id for r in kept.collect()) <= set(before)
