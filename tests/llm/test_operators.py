import hashlib
import io
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from waymark.llm import bpe, context_tree, html_extraction, image_copies, language_id, mixing, pieces, quality_rules, simhash, token_store, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "two words", "é ß 字\t\t x", "  lead  and trail  ", "a" * 3000, "word " * 4000, "don't we'll 12 345!!", "hello <|endoftext|> world", "Über, naïve; ǆ x's (a,b) don't. \u00d7 ß! 3rd\nline end.", "\u2003a \u2003 b\u00a0 c", "same text here", "same text here"]


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], KIND)


def test_pieces_join_back():
    for t in ODD:
        if t:
            assert " ".join(pieces.cut(t)) == t


def test_token_store_matches_whole_text_encoding(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, *[r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]]
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, texts), path)
    rows = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    rebuilt = {r.doc_id: r.ids for r in token_store.documents(spark, path).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert rebuilt[i] == ids
        start += len(ids)
    stored = token_store.chunks(spark, path)
    assert stored.count() == stored.select("digest").distinct().count()
    token_store.write_store(docs(spark, texts), f"{path}-small", part_docs=9)
    assert token_store.read_store(spark, f"{path}-small").select("doc_id", "start", "ids_crc32").exceptAll(token_store.read_store(spark, path).select("doc_id", "start", "ids_crc32")).count() == 0
    top = spark.read.parquet(f"{path}-small/manifest").orderBy(F.desc("level")).first()
    assert (top.part, top.n_docs, top.n_tokens) == (-1, len(texts), start)
    spark.read.parquet(f"{path}-small/recipes").where("doc_id <> 3").write.parquet(f"{path}-missing/recipes")
    spark.read.parquet(f"{path}-small/recipes").withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 5).cast("int")).write.parquet(f"{path}-tampered/recipes")
    for name in ("missing", "tampered"):
        spark.read.parquet(f"{path}-small/manifest").write.parquet(f"{path}-{name}/manifest")
        with pytest.raises(ValueError):
            token_store.verify_manifest(spark, f"{path}-{name}")
    token_store.write_store(docs(spark, []), f"{path}-empty")
    assert token_store.read_store(spark, f"{path}-empty").count() == 0


def test_crc_of_parts():
    parts = [b"abc", b"", b"x" * 1000, b"\0\1"]
    assert token_store.crc_of_parts([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/é x", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", big), (5, "u", "<p>small"), (6, "u", "<p>small"), (7, "u", "y\r\n\r\n" * 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w", archive_bytes=500)
    got = {r.page_id: r for r in warc.read_archives(archives, with_html=True).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        revisit = html == big and page_id != 2
        assert (r.record_type, r.refers_to, r.html) == (("revisit", 2, None) if revisit else ("response", None, html or ""))
    raw = bytearray(warc.record(1, "u", b"payload"))
    raw[-8] ^= 1
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(warc.member(bytes(raw)))))


def brute_repeats(words, n=8):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len({k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + n)})


def test_quality_measures_match_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [*[t for t in ODD if t is None or len(t) < 5000], *[" ".join(rng.choice(["a", "b"], n)) for n in range(5, 60, 5)], "l1 a\nl1 a\n\n \nl2", "# $ % text | <b>"]
    got = {r.doc_id: r for r in quality_rules.measures(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute_repeats(w))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, repr(t)[:50]


def test_quality_drops_bad_hosts_and_keeps_good_rows(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, "en", "good", 1) for i in range(30)] + [(100 + i, "short" if i else good, "en", "bad", 1) for i in range(30)] + [(200, good, "en", None, 1)]
    df = spark.createDataFrame(rows, KIND).withColumn("kept", F.lit("clash"))
    kept = {r.doc_id for r in quality_rules.kept_documents(df).collect()}
    assert kept == {*range(30), 200}
    assert quality_rules.kept_documents(df.limit(0)).count() == 0


def test_simhash_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice([f"w{k}" for k in range(50)], 80)) for _ in range(20)]
    texts = [*ODD, *base, *[b + " tail" for b in base], *base[:5], *["x y z" for _ in range(4)]]
    for max_cell in (256, 2):
        fps = [simhash.fingerprint(t) for t in texts]
        root = list(range(len(fps)))
        changed = True
        while changed:
            changed = False
            for i in range(len(fps)):
                for j in range(len(fps)):
                    if root[j] < root[i] and bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2:
                        root[i], changed = root[j], True
        distinct = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
        linked = {r.node: r.root for r in simhash.components(simhash.links(distinct, max_cell=max_cell)).collect()}
        monkeypatch.setattr(simhash, "MAX_CELL", max_cell)
        got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
        assert [got[i].component_id for i in range(len(texts))] == root
        for i in range(len(fps)):
            for j in range(len(fps)):
                assert (linked.get(fps[i], fps[i]) == linked.get(fps[j], fps[j])) == (root[i] == root[j])


def test_simhash_links_of_dense_bins(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 12)]
    flip = lambda x, bits: int(np.int64(np.uint64(x & (2**64 - 1)) ^ np.uint64(sum(1 << int(b) for b in bits))))
    fps = sorted({flip(x, rng.choice(64, n, False)) for x in base for n in (0, 1, 2, 3, 3, 4, 5)} | {flip(base[0], rng.choice(16, n, False)) for n in (1, 2, 3, 4) for _ in range(10)})
    near = lambda a, b, r: bin((a ^ b) & (2**64 - 1)).count("1") <= r
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius in (0, 1, 2):
        root = {f: f for f in fps}
        for _ in range(8):
            for a in fps:
                for b in fps:
                    if root[b] < root[a] and near(a, b, radius):
                        root[a] = root[b]
        for max_cell in (256, 3, 0):
            edges = simhash.links(df, radius, max_cell)
            if max_cell == 256:
                assert {tuple(r) for r in edges.collect()} == {(a, b) for a in fps for b in fps if a < b and near(a, b, radius)}
            linked = {r.node: r.root for r in simhash.components(edges).collect()}
            assert {f: linked.get(f, f) for f in fps} == root


def test_deduplicated_keeps_rows_of_repeated_ids(spark):
    kept = lambda rows: sorted((tuple(r) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, hash string")).collect()), key=str)
    a, b, x, y, z = "alpha one two", "beta three four", "gamma five", "delta six", "eps seven"
    assert kept([(0, a, "h"), (1, b, "h"), (1, a, "h")]) == [(0, a, "h"), (1, b, "h")]
    want = [(1, a, "h"), (1, b, "h"), (7, z, "h"), (None, x, "h"), (None, y, "h")]
    assert kept(want) == sorted(want, key=str)
    assert kept([(1, a, "h"), (1, a, "h"), (2, a, "h"), (3, None, "h"), (4, "", "i")]) == [(1, a, "h"), (3, None, "h")]
    assert kept([]) == [] and simhash.near_duplicates(docs(spark, [])).count() == 0


def test_first_of_each_is_exact_with_a_full_filter(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n"), (5, None, "n"), (None, "a", "k"), *[(i, f"t{i}", "u") for i in range(10, 30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, __hash string")
    found = df.select("doc_id", F.xxhash64("text").alias("hash"), F.xxhash64("text").alias("component"))
    gone = {(1, "a", "x"): 1, (2, "a", "y"): 1, (5, None, "n"): 1}  # rows of each kind that go
    want = sorted(set(rows) - {(2, "a", "y"), (5, None, "n")}, key=str)
    for bits in (64, 1 << 12):
        got = sorted((tuple(r) for r in simhash.first_of_each(df, found, bits).collect()), key=str)
        assert got == want and len(got) == len(rows) - sum(gone.values())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 203), (203, 204)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 203: 203, 204: 203, 205: 203}


def test_mixing_meets_targets_and_overlaps(spark):
    assert mixing.targets([100, 10, 10], [1, 2, 3]) == [60.0, 30.0, 30.0]
    flow = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 20})
    assert sum(v.get("a", 0) for v in flow.values()) == 25 and sum(v.get("b", 0) for v in flow.values()) == 20
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 4}" if i % 13 else None, 1) for i in range(600)] + [(600, None, "en", "s1", 0)]
    out, plan = mixing.mixed(mixing._sized(spark.createDataFrame(rows, KIND)).drop("text"))
    got = out.groupBy("source").agg(F.sum(F.col("size") * F.col("passes")).alias("taken"), F.max("passes").alias("most"))
    for r in got.collect():
        assert abs(r.taken - plan["targets"][r.source]) <= 9 and r.most <= 3
    assert mixing.mixed(mixing._sized(spark.createDataFrame([], KIND)).drop("text"))[0].count() == 0


def brute_ctw(train, text, depth):
    """log10 probability by walking the tree for each bit, with counts and weights from the definition."""
    from functools import cache
    from math import exp, lgamma, log, log10, pi

    counts = {}
    for t in train:
        data = b"\n" * depth + b" ".join(context_tree.tokens(t)) + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for j in range(8):
                    c = counts.setdefault((data[i - d : i], (1 << j) | data[i] >> (8 - j)), [0, 0])
                    c[data[i] >> (7 - j) & 1] += 1

    def kt(c):
        return lgamma(c[0] + 0.5) + lgamma(c[1] + 0.5) - lgamma(sum(c) + 1) - log(pi)

    @cache
    def weighted(ctx, m):
        own = kt(counts[ctx, m])
        if len(ctx) == depth:
            return own
        below = sum(weighted(bytes([b]) + ctx, m) for b in range(256) if (bytes([b]) + ctx, m) in counts)
        return log(0.5) + max(own, below) + log(1 + exp(-abs(own - below)))

    data, total = b"\n" * depth + b" ".join(context_tree.tokens(text)) + b"\n", 0.0
    for i in range(depth, len(data)):
        for j in range(8):
            m, bit, p = (1 << j) | data[i] >> (8 - j), data[i] >> (7 - j) & 1, None
            for d in range(depth, -1, -1):
                if (c := counts.get((data[i - d : i], m))) is not None:
                    est = (c[bit] + 0.5) / (sum(c) + 1)
                    w = 1.0 if d == depth else exp(log(0.5) + kt(c) - weighted(data[i - d : i], m))
                    p = est if p is None else w * est + (1 - w) * p
            total += log10(0.5 if p is None else p)
    return total


def test_context_tree_slices_and_merges():
    import pyarrow as pa

    texts = [None, "", "a" * 50, *["bc"] * 30, None, "d" * 9, ""]
    for rows in (texts, [], [None], [""]):
        for size in (1, 10, 1000):
            parts = list(context_tree._slices(pa.chunked_array([pa.array(rows, pa.string())]), size))
            assert [t for p in parts for t in p] == rows and all(parts)
    keys, counts = context_tree._merged([(np.array([3, 5], np.uint64), np.array([1, 2])), (np.array([1, 5], np.uint64), np.array([0, 4]))])
    assert (keys.tolist(), counts.tolist()) == ([1, 3, 5], [0, 1, 6])
    assert not len(context_tree._merged([(np.empty(0, np.uint64), np.empty(0, np.int64))])[0])


def test_context_tree_matches_brute_force(spark):
    texts = ["the cat sat", "the cat ran", "a dog ran the", None, "zebra", "The Cat"]
    df = docs(spark, texts).select("doc_id", "text", (F.col("doc_id") < 3).alias("train"))
    for depth in (3, context_tree.DEPTH):
        got = {r.doc_id: r for r in context_tree.scored(df, depth=depth, block_bytes=20).collect()}
        for i, t in enumerate(texts):
            assert got[i].score == pytest.approx(brute_ctw(texts[:3], t, depth), abs=1e-6)
            assert got[i].n_tokens == len((t or "").split()) + 1 and got[i].train_tokens == 13
    n, v = 13, 7  # the cat sat ran a dog end
    assert got[4].base_score == pytest.approx(np.log10(0.1 / (n + 0.1 * (v + 1))) + np.log10(3.1 / (n + 0.1 * (v + 1)))) and got[4].n_known == 1


def test_bpe_matches_the_library(spark):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encoded(docs(spark, ODD), keep_ids=True).collect()}
    for i, t in enumerate(ODD):
        ids = enc.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_html_main_text(spark):
    def page(i, body):
        return f"<html><head><title>t</title><style>p{{}}</style></head><body><div class='menu'><a href=x>m{i}</a></div><div class=main><h1>Head {i}</h1><p>One &amp; <b>two</b>{i}<p>long text number {i} {body}<br>end</div><div class='sidebar'>side {i}</div><div id=comments><p>nice {i}</p></div><div class='legal'>All rights reserved</div></body>"

    rows = [(i, f"http://h/{i}", page(i, "w " * 30)) for i in range(12)] + [(100, None, None), (101, "x", "plain text"), (102, "http://h/z", "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in html_extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"Head {i} One & two{i} long text number {i} " + "w " * 30 + "end" and got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[101].text, got[102].text) == ("", "plain text", "deep")


def html_texts(spark, rows):
    return {r.page_id: r.text for r in html_extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_host_with_two_layouts(spark):
    def page(i):
        text = f"<h1>Head {i}</h1><p>text {i} " + "w " * 30 + "</p>"
        body = f"<article>{text}</article>" if i % 3 else f"<main class='other'>{text}<div class='legal'>All rights</div></main>"
        return f"<html><body><nav><ul><li><a href=x>m</a></li></ul></nav><div class='ad'>ad {i}</div>{body}<footer><p>foot</p></footer></body></html>"

    got = html_texts(spark, [(i, "http://h/x", page(i)) for i in range(1, 31)] + [(100, "http://h/x", "<html><body><nav><ul><li>m</li></ul></nav><div class='ad'>a</div><section><p>only one</p></section><footer><p>foot</p></footer></body></html>")])
    assert got == {**{i: f"Head {i} text {i} " + " ".join(["w"] * 30) for i in range(1, 31)}, 100: "only one"}


def test_html_keeps_all_parts_of_a_text(spark):
    def page(i, open_, close, parts):
        text = "".join(f"<div class={c}>{c} {i} " + f"w{i} " * n + "</div>" for c, n in parts)
        return f"<body><div class=top><a href=x>link {i}</a></div>{open_}<h1>Head {i}</h1><p>lead {i}</p>{text}{close}<div class=legal>All rights</div></body>"

    nested, several = (("inner", 60),), (("intro", 20), ("inner", 60), ("more", 5))
    rows = [(i, "http://nested/", page(i, "<article>", "</article>", nested)) for i in range(10)]
    rows += [(100 + i, "http://several/", page(i, "<div class=post>", "</div>", several)) for i in range(10)]
    rows += [(200 + i, "http://flat/", page(i, "", "", several)) for i in range(10)]
    rows += [(300, "http://single/", page(0, "<main>", "</main>", several)), (400, "http://articles/", "<article class=a><p>one two three four</article><article class=b>five</article><div>other</div>")]
    got = html_texts(spark, rows)
    for i, _, _ in rows[:-1]:
        parts = nested if i < 100 else several
        k = i % 100
        assert got[i] == " ".join([f"Head {k} lead {k}", *[" ".join([c, str(k), *[f"w{k}"] * n]) for c, n in parts]])
    assert got[400] == "one two three four five"


def test_html_layout_names_are_no_roles(spark):
    opens = ["<body class='has-sidebar'><div>", "<body class='no-comments sidebar'><div>", "<body><article class='post related-enabled'>", "<body><div id='content-widget'>", "<body><article class=related>", "<body><div class='x content-widget'>", "<body><form>", "<body><div class='page widget'><h1>big</h1>", "<body><div class='a no-sidebar'>", "<body><article><div class=widget-body>"]
    rest = "</div></article></form><div class='box ads'>buy {0}</div><div class='site-footer'>foot {0}</div><aside>side {0}</aside></body>"
    rows = [(100 * k + i, f"http://h{k}/", f"{o}<p>text {i} " + "w " * 20 + "</p>" + rest.format(i)) for k, o in enumerate(opens) for i in range(8)]
    rows += [(5000 + k, f"http://single{k}/", f"{o}<p>text 1 " + "w " * 20 + "</p>" + rest.format(1)) for k, o in enumerate(opens)]
    rows += [(6000 + i, "http://ads/", f"<article><p>{'short' if i else ''}{i or ''}</p></article><div class=ad>{'much longer ' * 5}{i}</div>") for i in range(8)]
    rows += [(7000, "http://box/", "<div class='box sidebar'>side</div><div class='box'>text</div>")]
    got = html_texts(spark, rows)
    for i, _, _ in rows:
        k, n = (i % 1000, 1) if 5000 <= i < 6000 else (i // 100, i % 100)
        if i < 6000:
            single = i >= 5000
            assert got[i] == ("big " if k == 7 and single else "") + f"text {n} " + " ".join(["w"] * 20), (i, got[i])
        elif i < 7000:
            assert got[i] == (f"short{i - 6000}" if i > 6000 else "")
    assert got[7000] == "text"


def test_language_id_on_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = table.where("doc_id % 4 <> 2")
    model = language_id.fit(out)
    held = language_id.predict(table.where("doc_id % 4 = 2"), model)
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    odd = {r.doc_id: r for r in language_id.predict(docs(spark, [None, "", "12 !?", "x"]), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[0].score == 0 and 0 <= odd[3].score <= 1
    assert language_id.predict(docs(spark, ["text"]), language_id.fit(out.limit(0))).first().lang_pred == "und"


def test_images_find_crops_only(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (40, 64)).tolist()
    rows = [(i, image_copies.draw(v)) for i, v in enumerate(vectors)]
    rows += [(100, image_copies.draw(vectors[3], 4)), (101, image_copies.draw(vectors[7], 9)), (102, rows[5][1]), (103, None), (104, b"broken"), (105, b"P5 2 2 255\n\0\0\0\0")]
    got = {r.image_id: r for r in image_copies.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    want = {**{i: i for i in range(40)}, 100: 3, 101: 7, 102: 5, 103: 103, 104: 104, 105: 105}
    assert {i: r.class_id for i, r in got.items()} == want and got[3].n_links == 1 and got[5].n_copies == 2


def test_images_recall_against_all_pairs(spark):
    """Every 20th image against all: links that a comparison of all pairs with the same consensus finds, and no others."""
    table = image_copies.pictures(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    images = {r.image_id: bytes(r.image) for r in table.collect()}
    assert len(images) > 500
    first = {}
    for i in sorted(images):
        first.setdefault(images[i], i)
    ids = sorted(first.values())
    corners = {i: image_copies.describe(images[i]) for i in ids}
    bits = {i: np.array([c[4] for c in cs], np.int64).view(np.uint64) for i, cs in corners.items()}
    found = {(r.a, r.b) for r in image_copies.links(image_copies.descriptors(table.where(F.col("image_id").isin(ids)))).collect()}
    want = set()
    for a in ids:
        if a % 20 and (-1 - a) % 20:
            continue
        for b in ids:
            if a == b or not len(bits[a]) or not len(bits[b]):
                continue
            x, y = min(a, b), max(a, b)
            near = np.argwhere(np.bitwise_count(bits[x][:, None] ^ bits[y][None]).sum(axis=2) <= image_copies.MAX_DISTANCE)
            m = [dict(zip(("xa", "ya", "sa", "aa", "xb", "yb", "sb", "ab"), (*corners[x][i][:4], *corners[y][j][:4]))) for i, j in near]
            if len(m) >= image_copies.MIN_INLIERS and image_copies.consensus(m) >= image_copies.MIN_INLIERS:
                want.add((x, y))
    asked = {p for p in found if any(i % 20 == 0 or (-1 - i) % 20 == 0 for i in p)}
    print("recall", len(asked & want), len(want))
    assert asked <= want and len(asked) >= 0.9 * len(want)
    planted = {tuple(sorted((first[images[i]], -1 - i))) for i in images if i >= 0 and i % image_copies.EDITED == 7 and first[images[i]] == i}
    assert len(planted & found) >= 0.9 * len(planted) > 0


def test_image_pairs_of_crowded_values(spark):
    rng = np.random.default_rng(5)
    sets = {i: rng.integers(0, 4, (3, image_copies.BANDS)).tolist() for i in range(60)}
    corners = spark.createDataFrame([(i, d) for i, ds in sets.items() for d in ds], "image_id long, d array<long>")
    values = {i: {(k, v) for d in ds for k, v in enumerate(d)} for i, ds in sets.items()}
    want = sorted((a, b) for a in values for b in values if a < b and len(values[a] & values[b]) >= image_copies.MIN_SHARED)
    for size in (2, 7, 64):
        assert sorted(tuple(r) for r in image_copies.candidate_pairs(corners, max_bucket=size).collect()) == want


def test_images_whose_matches_share_no_band_value(spark):
    """Five matches of 24 bits with bits changed in each 64-bit word: linked, however images are dealt out; 25 bits are too many."""
    rng = np.random.default_rng(11)
    d = rng.integers(0, 2, (5, 256), dtype=np.uint8)
    places = [(20.0 * k, 11.0 * k * k, 1.0, 0.1) for k in range(5)]
    rows = []
    for image_id, changed in ((1, 0), (2, 24), (3, -25)):
        for at, bits in zip(places, d):
            bits = bits.copy()
            bits[np.linspace(0, 255, abs(changed)).astype(int)] ^= 1
            rows.append((image_id, *at, np.packbits(bits).view(np.int64).tolist()))
    corners = spark.createDataFrame(rows, "image_id long, x double, y double, scale double, angle double, d array<long>")
    for size in (1, 2, 8192):
        assert {(r.a, r.b): r.inliers for r in image_copies.links(corners, size).collect()} == {(1, 2): 5}


def test_near_descriptors_against_all_pairs():
    rng = np.random.default_rng(12)
    seeds = rng.integers(0, 2, (6, 256), dtype=np.uint8)
    d = np.packbits(np.repeat(seeds, 50, axis=0) ^ (rng.random((300, 256)) < 0.05), axis=1).view(np.uint64)
    d[250:] = d[:50]  # equal ones count each
    want = {tuple(p) for p in np.argwhere(np.bitwise_count(d[:, None] ^ d[None, 100:]).sum(axis=2) <= image_copies.MAX_DISTANCE).tolist()}
    found = list(zip(*[x.tolist() for x in image_copies.matches(d, d[100:])]))
    assert len(found) == len(want) > 300 and set(found) == want


def test_token_ids_in_small_blocks(monkeypatch):
    """Whatever words are remembered and ids are rolled at once, ids and marks are those of whole texts."""
    import pyarrow as pa

    path = public_tokenizers.path(token_store.TOKENIZER)
    texts = pa.array([None, *ODD, *[f"w{i} ab{i % 7}c Über{chr(97 + i % 26)} x, y. {'z' * (i % 9)}" for i in range(200)]]).slice(1)
    whole = token_store.TextEncoder(path).tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
    want = [e.ids for e in whole]
    for most in (0, 6, 1000):
        monkeypatch.setattr(token_store, "REMEMBERED", most)
        encoder = token_store.TextEncoder(path)
        for part in (texts, texts.slice(50, 100), texts.slice(0, 120), texts.slice(3, 0)):
            ids, edges = encoder(part)
            first = part.offset - texts.offset
            assert [ids[x:y].tolist() for x, y in zip(edges, edges[1:])] == want[first : first + len(part)]
    ids = np.random.default_rng(4).integers(0, 50_000, 3000).astype(np.uint16)
    at_once = token_store.marks(ids, 4).tolist()
    assert len(at_once) > 100
    for rolled in (1, 5, 8, 1000, 2999):
        monkeypatch.setattr(token_store, "ROLLED", rolled)
        assert token_store.marks(ids, 4).tolist() == at_once and not len(token_store.marks(ids[:0]))


def test_links_of_many_near_copies_are_counted(spark):
    """A row for each image and two blocks in place of one for each link; numbers and classes are those of the links."""
    rng = np.random.default_rng(21)
    rows = []
    for image_id in range(70):  # forty near copies, a chain of twenty (each linked to the next), ten alone
        seed = 0 if image_id < 40 else image_id
        d = np.random.default_rng(seed).integers(0, 2, (12, 256), dtype=np.uint8)
        if 40 < image_id < 60:
            d[:6] = np.random.default_rng(image_id - 1).integers(0, 2, (12, 256), dtype=np.uint8)[6:]
        for k in range(12):
            d[k, rng.integers(0, 256, 3)] ^= 1
            rows.append((1000 - image_id, 17.0 * (k % 6), 23.0 * (k % 6) + 5 * (k % 6) ** 2, 1.0, 0.2, np.packbits(d[k]).view(np.int64).tolist()))
    corners = spark.createDataFrame(rows, "image_id long, x double, y double, scale double, angle double, d array<long>")
    pairs = [(r.a, r.b) for r in image_copies.links(corners).collect()]
    assert len(pairs) == 40 * 39 // 2 + 19
    n = {i: sum(i in p for p in pairs) for p in pairs for i in p}
    root = {i: i for i in n}
    for _ in range(70):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    for size, most in ((8192, 60), (20, 60 * 7)):
        got = image_copies.link_counts(corners, size)
        rows = got.collect()
        assert len(rows) <= most and {i: sum(r.n for r in rows if r.image_id == i) for i in n} == n
        found = {r.node: r.root for r in image_copies.components(got.selectExpr("least AS a", "image_id AS b")).collect()}
        assert found == root
    assert image_copies.link_counts(corners.where("image_id < 935")).count() == 0


def test_image_blocks_are_stored_once(spark, monkeypatch):
    """Two blocks meet without a shuffle of their images, and over MAX_BROADCAST images none is shuffled: the same rows."""
    images = image_copies.pictures(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60"))
    images = images.union(images.where("image_id % 4 = 0").selectExpr("1000 + image_id", "image")).union(images.limit(3).selectExpr("CAST(NULL AS BIGINT)", "image"))
    corners = image_copies.descriptors(images)
    want = sorted(image_copies.links(corners).collect())
    found = image_copies.links(corners, 10)
    assert len(want) > 10 and sorted(found.collect()) == want and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [sorted(map(str, image_copies.image_copies(images).collect()))]
    monkeypatch.setattr(image_copies, "MAX_BROADCAST", 0)
    joined = []
    passing = image_copies.passing
    monkeypatch.setattr(image_copies, "passing", lambda *a: joined.append(passing(*a)) or joined[-1])
    rows.append(sorted(map(str, image_copies.image_copies(images).collect())))
    assert rows[0] == rows[1] and joined and "SortMergeJoin" not in joined[0]._jdf.queryExecution().executedPlan().toString()


def test_image_links_with_few_matches_at_once(monkeypatch):
    """Bits that go together lie in different bands; slices with too many matches are halved; pairs with equally many matches have the consensus each has alone."""
    rng = np.random.default_rng(3)
    bits = np.repeat(rng.integers(0, 2, (600, 64), dtype=np.uint8), 4, axis=1)  # four copies of each bit, side by side
    d = np.packbits(bits, axis=1).view(np.uint64)
    order = image_copies._spread(d)
    assert sorted(order.tolist()) == list(range(256))
    plain, spread = (image_copies.band_values(np.ascontiguousarray(np.packbits(b, axis=1)).view(np.uint64)) for b in (bits, bits[:, order]))
    most = [max(np.bincount(v).max() for v in x) for x in (plain, spread)]
    assert most[1] < 0.1 * most[0]

    copies = np.concatenate([d[:20]] * 12)  # twelve images with the same twenty corners, moved
    at = np.concatenate([np.stack([rng.permutation(200)[:20] + 3.0 * k, np.arange(20) * 9.0, np.ones(20), np.zeros(20)], axis=1) for k in range(12)])
    at[20:120, 0] = np.tile(at[:20, 0], 5) + np.repeat(np.arange(5), 20)
    image, block = np.repeat(np.arange(12, dtype=np.int32), 20), np.repeat(np.arange(12) % 2, 20)
    want = {(0, 0): [], (0, 1): [], (1, 1): []}
    for a in range(12):
        for b in range(12):
            m = np.concatenate([at[image == a], at[image == b]], axis=1)
            agreed = image_copies.agreeing(m)
            assert image_copies.agreeing_each(np.stack([m, m[::-1]])).tolist() == [agreed, agreed]
            blocks = (a % 2, b % 2)
            if agreed >= image_copies.MIN_INLIERS and blocks in want and (a < b or blocks == (0, 1)):
                want[blocks].append((a, b, agreed))
    assert len(want[0, 1]) >= 9 and image_copies.matches(copies, copies, 100) is None
    for most in (1 << 22, 100, 10):
        monkeypatch.setattr(image_copies, "MOST", most)
        assert {k: sorted(image_copies.linked(at, copies, image, block, *k)) for k in want} == {k: sorted(v) for k, v in want.items()}


def test_stage_has_fingerprints_and_a_pivot_table(spark):
    """The operator's fingerprint first; neither distances nor pivots discard a similar pair, and they do discard others."""
    from waymark.llm import similar

    rng = np.random.default_rng(17)
    text = " ".join(f"w{i}" for i in rng.permutation(900))
    assert int(np.frombuffer(similar.fingerprint_of(similar.shingles(text)), np.int64)[0]) == simhash.fingerprint(text, 5)
    sets = []
    for n in (9, 40, 700):  # every second and third set resemble the first by 0.8 and more
        common, others = rng.integers(1, 2**63, n, dtype=np.uint64), rng.integers(1, 2**63, n // 8, dtype=np.uint64)
        sets += [np.unique(common), np.unique(np.concatenate([common, others])), np.unique(common[: n - n // 9])]
    fp = np.frombuffer(b"".join(map(similar.fingerprint_of, sets)), np.uint64).reshape(-1, similar.WIDTH)
    mark = np.concatenate([fp.view(np.uint8).reshape(len(fp), -1), similar.to_pivots(fp, fp[[0, 3]])], axis=1)
    sizes = np.array([len(x) for x in sets])
    alike = lambda x, y: len(np.intersect1d(x, y)) >= similar.SIMILAR * len(np.union1d(x, y))
    for x in range(len(sets)):
        assert similar.may_be_similar(mark, sizes, mark[x], sizes[x]).tolist() == [alike(sets[x], y) for y in sets]
    kinds = spark.createDataFrame([(k, int(n), bytearray(f.tobytes())) for k, (n, f) in enumerate(zip(sizes, fp))], "key long, size long, fp binary")
    shared = spark.createDataFrame([(0, 1, k, 3) for k in (0, 1, 2)] + [(1, 5, k, 2) for k in (3, 4)], "band int, value long, key long, n long")
    table = {r.key: np.frombuffer(r.mark, np.uint8) for r in similar.pivot_table(shared, kinds).collect()}
    assert {0, 1, 2, 3, 4} <= set(table) and all(len(m) == 8 * similar.WIDTH + 2 and m[: 8 * similar.WIDTH].tobytes() == fp[k].tobytes() for k, m in table.items())
    assert all(sorted(table[k][-2:]) == sorted(similar.to_pivots(fp[k : k + 1], fp[[0, 3]])[0]) for k in table)


def test_stage_removes_copies_of_similarity_over_08(spark):
    import corpus_pipeline
    from waymark.llm import similar

    rng = np.random.default_rng(4)
    texts = [None, " ", "one two", "One  two", "one three"]
    for _ in range(8):
        words = [f"w{k}" for k in rng.integers(0, 5000, 200)]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 8):
            copy = list(words)
            for at in rng.choice(200, changes, False):
                copy[at] = "other"
            texts.append(" ".join(copy))
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if root[j] < root[i] and len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j]
    assert {i for i, r in enumerate(root) if r == i} != {i for i in range(len(texts)) if simhash.fingerprint(texts[i]) not in {simhash.fingerprint(t) for t in texts[:i]}}
    df = docs(spark, texts)
    for size in ((1024, 8), (2, 1), (1024, 1, 150), (2, 2, 500)):
        got = {r.doc_id: r.component_id for r in similar.near_duplicates(df, *size).collect()}
        assert [got[i] for i in range(len(texts))] == root
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, df.union(df.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))), None)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [*[(False, i) for i, r in enumerate(root) if r == i], (True, 0)]


def brute_language(rows):
    """(best language, share of its n-grams) of each text by exact sets: the rule of language_id without filters."""
    import re
    from collections import Counter

    def grams(text):
        letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
        padded = f" {letters} ".ljust(4)
        return [padded[i : i + 4] for i in range(len(padded) - 3)] if letters else []

    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    most = {}
    for lang, c in counts.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0), n / totals[lang])
    own = {lang: {g for g, n in c.items() if n >= language_id.MIN_COUNT and n / totals[lang] >= language_id.SHARE * most[g]} for lang, c in counts.items()}
    out = []
    for text, _ in rows:
        g = grams(text)
        shares = {lang: sum(x in s for x in g) / len(g) for lang, s in sorted(own.items())} if g else {}
        best = max(shares, key=shares.get, default="und")
        out.append((best, shares.get(best, 0.0)))
    return out


def brute_kept(rows):
    """Whether the quality stage keeps each (text, source)."""
    failed = []
    for text, _ in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        base = len(w) < 20 or 100 * brute_repeats(w) > 30 * len(w)
        failed.append(base or 100 * sum((text or "").count(c) for c in "#*$%&|<>") > 50 * len(w))
    by = {}
    for (_, host), f in zip(rows, failed):
        by.setdefault(host, []).append(f)
    rates = [sum(x) / len(x) for x in by.values()]
    mean, avg = sum(failed) / len(failed), sum(rates) / len(rates)
    var = sum((r - avg) ** 2 for r in rates) / len(rates)
    strength = max(1.0, avg * (1 - avg) / var - 1) if var > 1e-12 else len(failed)
    return [not f and (sum(by[host]) + mean * strength) / (len(by[host]) + strength) <= 0.5 for (_, host), f in zip(rows, failed)]


def brute_passes(rows):
    """How often the mix takes each (doc_id, text, source)."""
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    total = {n: sum(s for s, r in zip(sizes, rows) if r[2] == n) for n in names}
    target, free, left = {}, set(names), sum(sizes)
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * total[n]]
        if not over:
            break
        for n in over:
            target[n] = 3 * total[n]
        left, free = left - sum(3 * total[n] for n in over), free - set(over)
    target |= share
    out = {}
    for n in names:
        full, rest = divmod(round(target[n]), total[n]) if total[n] else (0, 0)
        before = 0
        for _, i in sorted((hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest(), i) for i, r in enumerate(rows) if r[2] == n):
            out[i] = full + (sizes[i] > 0 and 2 * before + sizes[i] <= 2 * rest)
            before += sizes[i]
    return [min(3, out[i]) for i in range(len(rows))]


def brute_components(texts):
    """The first of the texts of each one's group, linked by five-word shingles of a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if root[j] < root[i] and len(a & b) >= 0.8 * len(a | b):
                    root[i], changed = root[j], True
    return root


def test_pipeline_against_brute_force(spark):
    """Each stage on its predecessor's rows, with clashing columns, a null, an empty and a repeated row besides."""
    import corpus_pipeline
    import tiktoken

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "12 34", None, "s", 0)], table.schema)
    clash = {"lang_pred": F.lit("x"), "score": F.lit(-5.0), "kept": F.lit(7), "size": F.lit("s"), "fp": F.lit(1), "passes": F.lit(2)}
    d = table.union(odd).union(table.limit(1)).withColumns(clash)
    rows = [tuple(r) for r in d.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, d, None)
        assert own.columns == d.columns
        got = sorted((tuple(r) for r in own.collect()), key=repr)
        if name == "language_id":
            found = brute_language([(r[1], r[2]) for r in rows])
            sure = [abs(s - corpus_pipeline.MIN_SCORE) > 0.02 for _, s in found]
            assert all(sure)
            want = [r for r, (lang, s) in zip(rows, found) if lang != "und" and s >= corpus_pipeline.MIN_SCORE]
            predicted = {r.doc_id: r for r in language_id.predict(table, language_id.fit(d)).collect()}
            for r, (lang, s) in zip(rows, found):
                if r[0] in predicted:
                    assert predicted[r[0]].lang_pred == lang and abs(predicted[r[0]].score - s) < 0.02
        elif name == "quality_rules":
            want = [r for r, k in zip(rows, brute_kept([(r[1], r[3]) for r in rows])) if k]
        elif name == "simhash_dedup":
            ordered = sorted(rows, key=lambda r: r[0])
            want = [r for i, (r, c) in enumerate(zip(ordered, brute_components([r[1] for r in ordered]))) if c == i]
        else:
            want = [r for r, n in zip(rows, brute_passes([(r[0], r[1], r[3]) for r in rows])) for _ in range(n)]
        assert got == sorted(want, key=repr), name
        assert 0 < len(got) and (name == "mixing" or len(got) < len(rows))
        rows, d = got, spark.createDataFrame(got, d.schema)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = sorted((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()) for r in rows for ids in [enc.encode_ordinary(r[1])])
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, d, None).collect()) == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), None).count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_context_tree_without_rows_or_training(spark):
    texts = ["ab ab", None, "b" * 300_000, "ab ab"]
    df = docs(spark, texts).withColumn("score", F.lit("clash")).withColumn("blk", F.lit(1))
    none = {r.doc_id: r for r in context_tree.scored(df.withColumn("train", F.lit(False)), block_bytes=100_000).collect()}
    for i, t in enumerate(texts):
        n = len((t or "").encode()) + 1
        assert none[i].n_bytes == n and none[i].score == pytest.approx(-8 * n * np.log10(2), rel=1e-6) and none[i].bits_per_byte == pytest.approx(8, rel=1e-6)
        assert (none[i].n_known, none[i].train_tokens) == (0, 0)
    assert context_tree.scored(df.limit(0).withColumn("train", F.lit(True))).count() == 0
    split = {r.doc_id: r.score for r in context_tree.scored(df.withColumn("train", F.lit(True)), block_bytes=100_000, part_bytes=60_000, merged_blocks=2).collect()}
    whole = {r.doc_id: r.score for r in context_tree.scored(df.withColumn("train", F.lit(True))).collect()}
    assert split.keys() == whole.keys() and all(split[i] == pytest.approx(whole[i], rel=1e-6) for i in whole)


def test_empty_tables_and_other_columns(spark):
    df = docs(spark, ["one two three", None]).withColumns({"n_tokens": F.lit(1), "fp": F.lit("x"), "hash": F.lit(2), "kept": F.lit(3)})
    assert bpe.encoded(df).where("n_tokens >= 0").count() == 2 and bpe.encoded(df.limit(0)).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {0, 1}
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [r.text for r in html_extraction.main_texts(pages).collect()] == ["x"] and html_extraction.main_texts(pages.limit(0)).count() == 0
    images = spark.createDataFrame([(1, b"no image", 7)], "image_id long, image binary, n_links int")
    assert image_copies.image_copies(images).first().n_links == 0 and image_copies.image_copies(images.limit(0)).count() == 0
    model = language_id.fit(df)
    assert language_id.predict(df.limit(0), model).count() == 0
    assert quality_rules.judged(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    texts = ["x" * 300_000, "ab cd " * 20_000]
    df = docs(spark, texts)
    ids = {r.doc_id: r for r in bpe.encoded(df).collect()}
    assert all(ids[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    assert {r.doc_id: r.n_words for r in quality_rules.measures(df).collect()} == {0: 1, 1: 40_000}
    assert [r.component_id for r in simhash.near_duplicates(df).orderBy("doc_id").collect()] == [0, 1]
