"""Small tests of the training-data operators: brute force, round trips and odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import components, golay, line_dedup, mixing, posting_lists, secrets, sentencepiece_bpe, simhash, token_store, toxicity, va_file, warc
from meridian.llm.queries import ORACLE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, l long, size string"


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and names that clash with the operators' own."""
    long = " ".join(f"word{i % 977} the of" for i in range(30_000))
    rows = [(1, "Hello there my friend, how are you today?\nA second line stands here.", "en", "a", 5, "x", 1, "s"), (2, None, None, None, None, None, None, None), (3, "", "", "", 0, "", 0, ""), (4, long, "en", "a", 9, "k", 2, "t"), (4, long, "en", "a", 9, "k", 2, "t"), (None, "idiot " * 9, "en", None, 1, None, None, None), (5, "\n\n \t", "de", "b", 4, "", 1, ""), (6, "Hello there my friend, how are you today!\nAnother second line here.", "en", "b", 5, "x", 1, "s"), (7, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" pwd: xK9#mQ2$vL', "en", "c", 1, "", 1, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, empty):
    docs = odd(spark).where("false") if empty else odd(spark)
    n = 0 if empty else 9
    labels = spark.createDataFrame([(1, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    sp, wb = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
    for df in (secrets.digest(secrets.scan(docs)), sentencepiece_bpe.round_trip(docs, sp), token_store.stored(docs, wb), mixing.mix(docs), line_dedup.decisions(docs), line_dedup.without_repeated_lines(docs), simhash.near_duplicates(docs), toxicity.toxicity(docs, labels), toxicity.not_toxic(docs, labels)):
        assert df.count() == n
    assert set(simhash.keep_one(docs).columns) == set(docs.columns)
    assert set(mixing.mixed_documents(docs).columns) == set(docs.columns)


def test_bpe_equals_library():
    import sentencepiece
    from tokenizers import Tokenizer

    own, lib = sentencepiece_bpe.Bpe(tokenizer_path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    words, ref = token_store.Encoder(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rnd = random.Random(3)
    parts = ["the", "in", " ", "  ", "\n", "é", "日", "a", "22", ".", "▁", "<s>", "𐍈", "́", "ing", "aaaa", "'s", "<|endoftext|>", "Ÿ", "ƁA", "İ"]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        ids = np.frombuffer(own(t), dtype="<u4")
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True)
        assert own.decode(ids) == lib.decode(ids.tolist())
        assert np.frombuffer(words(t), dtype=words.dtype).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_blank_runs():
    """Runs of blanks take n log n steps; a million is no hang, and ids equal the library's."""
    import sentencepiece

    own, lib = sentencepiece_bpe.Bpe(tokenizer_path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rnd = random.Random(11)
    texts = [" " * n for n in (1, 2, 15, 16, 17, 63, 64, 65, 100, 1000, 4097)] + [f"a{' ' * rnd.randint(60, 300)}{rnd.choice(['b', ',', '', chr(10), 'é'])}{' ' * rnd.randint(0, 90)}c" for _ in range(100)]
    for t in [*texts, " " * 1_000_000 + "x"]:
        assert np.frombuffer(own(t), dtype="<u4").tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_sentencepiece_rows(spark):
    """Every column of op4 against the library, on odd rows and on the table."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for docs, got in ((odd(spark), sentencepiece_bpe.round_trip(odd(spark), tokenizer_path("piece_bpe_32k.model"))), (table, QUERIES["op4_sentencepiece"](spark, SF))):
        want = []
        for i, t in docs.select("doc_id", "text").collect():
            ids = lib.encode(t or "", add_bos=True, add_eos=True)
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
        assert sorted(want) == sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect())


def test_token_store_rows(spark):
    """Every column of op5 against the library: starts, counts and checksums."""
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start, want = 0, []
    for r in docs:
        ids = ref.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert want == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_store"](spark, SF).collect())


def test_varbyte_round_trip():
    for n in (0, 1, 5, 1000):
        v = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64) >> np.random.default_rng(n + 1).integers(0, 32, n, dtype=np.uint64)
        control, data = token_store.pack(v.astype(np.uint32))
        assert token_store.unpack(control, data, n).tolist() == v.tolist()


def test_warc_ranges(tmp_path):
    rnd, path = random.Random(1), tmp_path / "x.warc.gz"
    bodies = [rnd.randbytes(rnd.randint(0, 3000)) for _ in range(60)]
    path.write_bytes(b"".join(warc.record(i, "u", b, len(b), warc.base32_sha1(hashlib.sha1(b).hexdigest())) for i, b in enumerate(bodies)))
    size = path.stat().st_size
    for step in (997, 5000, size + 1):
        got = [warc.parse(r) for s in range(0, size, step) for r in warc.records(f"file://{path}", s, s + step)]
        assert [g["page_id"] for g in got] == list(range(60))


def test_warc_copies(spark):
    pages = spark.createDataFrame([(3, "u", "same"), (1, "v", "same"), (1, "v", "same"), (2, None, None), (None, "w", ""), (5, "x", "other")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    assert got == [("1", "response", None), ("1", "revisit", 1), ("2", "response", None), ("3", "revisit", 1), ("5", "response", None), ("None", "revisit", 2)]
    assert warc.archived(pages.where("false")).count() == 0


def test_warc_long_headers(spark, tmp_path):
    """Records whose headers are longer than any first look are found at a range's start, and lost ones are an error."""
    rnd = random.Random(7)
    urls = ["u", *("http://x/" + "".join(rnd.choices("abcdefghijkl0123456789", k=n)) for n in (70_000, 300_000, 1_500_000))]
    for url in urls[1:]:
        assert [(r.page_id, r.url) for r in warc.archived(spark.createDataFrame([(1, url, "body")], "page_id long, url string, html string")).collect()] == [(1, url)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(warc.record(i, u, b"b", 1, warc.base32_sha1(hashlib.sha1(b"b").hexdigest())) for i, u in enumerate(urls * 2)))
    size = path.stat().st_size
    manifest = [(f"file://{path}", size, 8), (f"file://{path}", size, 9)]
    for step in (10_007, 200_000):
        first, more = (spark.createDataFrame([m], "file string, bytes long, records long") for m in manifest)
        assert sorted(r.page_id for r in warc.read(first, step).collect()) == list(range(8))
        with pytest.raises(ValueError, match="8 records read, 9 written"):
            warc.read(more, step)


def test_golay_meets():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 1 << 23, 3000)
    for bit in range(23):
        y = x ^ (1 << bit)
        assert (golay.around(y) == golay.nearest(x)[:, None]).any(axis=1).all()


def test_simhash_links(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(1, 4))) for b in base for _ in range(3)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long")
    first = components.connected_components(simhash._links_in_segments(nodes, 4))
    named = nodes.join(first, nodes.fp == first.v, "left").select("fp", F.coalesce("label", "fp").alias("comp"))
    links = simhash._links_across(named, 4).collect()
    comp = {r.fp: r.comp for r in named.collect()}
    parent = {c: c for c in comp.values()}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for r in links:
        parent[find(r.a)] = find(r.b)
    for i in range(40):
        for j in range(3):
            assert find(comp[signed[i]]) == find(comp[signed[40 + 3 * i + j]])


def test_simhash_rows(spark):
    """Every column of op9 by brute force: fingerprints of whole texts, components of all pairs within 4 bits; nulls and odd rows, too."""
    import xxhash

    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    table = spark.read.parquet(f"{SF}/documents.parquet")
    for docs, got in ((odd(spark), simhash.near_duplicates(odd(spark))), (table, QUERIES["op9_simhash"](spark, SF))):
        rows = [(r.doc_id, fp(r.text)) for r in docs.select("doc_id", "text").collect()]
        f = sorted({x for _, x in rows})
        parent = {x: x for x in f}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, x in enumerate(f):
            for y in f[:i]:
                if (x ^ y).bit_count() <= 4:
                    parent[find(x)] = find(y)
        least = {}
        for i, x in rows:
            if i is not None:
                least[find(x)] = min(least.get(find(x), i), i)
        want = sorted((str(i), f"{x:016x}", str(least.get(find(x)))) for i, x in rows)
        assert want == sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.v: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_lines_against_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    found = {r.doc_id: [tuple(x) for x in r.dropped] for r in QUERIES["op8_line_dedup"](spark, SF).collect()}
    lines = [(i, k, x.strip(" ")) for i, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    texts = sorted({x for *_, x in lines})
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    at, first, want = {x: i for i, x in enumerate(texts)}, {}, {i: [] for i, _ in docs}
    for i, k, x in lines:
        c = find(at[x])
        if c in first:
            want[i].append((k, *first[c]))
        else:
            first[c] = (i, k)
    assert found == want


def test_signatures_find_similar_lines(spark):
    """Pairs at the wanted similarity or a little above share a key and have near sketches, nearly always; at any length."""
    rng, letters, texts = random.Random(5), "abcdefgh ijklm nopqé日", []
    for n in (24, 60, 150, 400, 1500, 6000):
        for _ in range(60):
            base = [rng.choice(letters) for _ in range(n)]
            edited = list(base)
            for at in rng.sample(range(n), max(1, round(n * 0.011))):
                edited[at] = rng.choice(letters)
            texts += ["".join(base), "".join(edited)]
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    sig = line_dedup._sketched(line_dedup._mins(spark.createDataFrame(list(enumerate(texts)), "l long, line string"), False))
    rows = {r.l: (set(r["keys"]), r.s) for r in line_dedup._banded(sig, line_dedup.BANDS).groupBy("l", "s").agg(F.collect_set("key").alias("keys")).collect()}
    similar = [i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]

    def near(x, y):
        d = (x ^ y) & (2**64 - 1)
        return ((d | d >> 1) & 0x5555555555555555).bit_count() <= line_dedup.APART

    assert len(similar) > 150
    assert sum(bool(rows[i][0] & rows[i + 1][0]) and near(rows[i][1], rows[i + 1][1]) for i in similar) >= 0.97 * len(similar)


def test_large_families_of_lines(spark):
    """Lines of one family, many of them apart by little less than the wanted similarity, in buckets over SMALL: at least 0.98 of the links' joins are found."""
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(60)]
    texts = set()
    for _ in range(400):
        own = list(base)
        for at in rng.sample(range(60), rng.randint(0, 7)):
            own[at] = "".join(rng.choices("abcdefghijklmnop", k=5))
        texts.add(" ".join(own))
    texts = sorted(texts)
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = len(texts) - len({find(i) for i in range(len(texts))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup.decisions(docs).where("n_kept = 0").collect()
    assert want > 100 and 0.98 * want <= len(found) <= want
    assert all(find(r.doc_id) == find(r.dropped[0].as_doc) for r in found)


def test_no_link_within_a_bucket_is_lost(spark, monkeypatch):
    """Any two similar lines that share a key are joined, also in large buckets of many components, where neither meets a centre; nothing else is joined."""
    rng, texts = random.Random(21), set()
    for _ in range(3):
        base = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(60)]
        for _ in range(250):
            own = list(base)
            for at in rng.sample(range(60), rng.randint(2, 9)):
                own[at] = "".join(rng.choices("abcdefghijklmnop", k=5))
            texts.add(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string").cache()
    sig = line_dedup.signed(docs, line_dedup.lines(docs).drop("line"))
    line = {r.l: r.line for r in line_dedup.lines(docs).select("l", "line").collect()}
    sets = {x: {t[i : i + 8] for i in range(len(t) - 7)} for x, t in line.items()}
    buckets, parent = {}, {x: x for x in line}
    for r in line_dedup._banded(sig, line_dedup.BANDS).select("key", "l").collect():
        buckets.setdefault(r.key, []).append(r.l)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for own in buckets.values() for a in own for b in own if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in line if sum(find(y) == find(x) for y in line) > 1}
    assert max(map(len, buckets.values())) > 8 * line_dedup.SMALL and len(want) - len(set(want.values())) > 100
    assert {r.v: r.label for r in line_dedup.links(sig, docs).collect()} == want
    for name, value in (("CENTRE", 16), ("CENTRES", 1), ("COMPARED", 100)):  # the number of centres changes nothing, nor that of tasks
        monkeypatch.setattr(line_dedup, name, value, raising=False)
    assert {r.v: r.label for r in line_dedup.links(sig, docs).collect()} == want


def test_bitmaps_allow_all_similar_lines(spark):
    """Bitmaps are made without strings, of the very shingles that are compared (by code points); they allow all similar pairs and few others."""
    rng, texts, letters = random.Random(31), [], "abcdefgh ijklm nopqé日\U0001f600\U0001f601"
    for n in (3, 8, 9, 40, 150, 700, 5000):
        for _ in range(8):
            base = [rng.choice(letters) for _ in range(n)]
            texts.append("".join(base))
            for share in (0.003, 0.006, 0.01):
                own = list(base)
                for at in rng.sample(range(n), max(1, round(n * share))):
                    own[at] = rng.choice(letters)
                texts.append("".join(own))
    texts = sorted({*texts, "-" * 24, "-" * 300, "ha " * 20, "ha " * 90, "\U0001f600" * 12, "\U0001f600" * 50})
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "l long, line string")
    assert {r.l: set(r.x) for r in df.select("l", line_dedup.shingles(F.col("line")).alias("x")).collect()} == dict(enumerate(sets))
    bits = line_dedup._bits(df)
    assert "regexp" not in bits._jdf.queryExecution().optimizedPlan().toString()
    bits = bits.cache()
    allowed = {tuple(r) for r in bits.alias("x").join(bits.alias("y"), F.expr("x.l < y.l")).where(line_dedup._may("x", "y")).select("x.l", "y.l").collect()}
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    similar = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(similar) > 50 and similar <= allowed and len(allowed) < 0.05 * len(pairs) + len(similar)


def joined_lines(spark, texts):
    """Whether each text, as a document of one line, is dropped for the first one."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.dropped] for r in line_dedup.decisions(docs).collect()}
    return [found[i] == [(0, 0, 0)] for i in range(1, len(texts))]


def test_long_lines_without_spaces(spark):
    """Long lines that differ in their first eight characters are found by what follows."""
    rnd = random.Random(9)
    for between, n in (("\t", 20), ("", 30), ("/", 60), ("é", 20)):
        rest = between.join("".join(rnd.choices("abcdefghijklmnop0123456789", k=6)) for _ in range(n))
        assert joined_lines(spark, [f"2024-01-01{between}{rest}", f"2025-01-01{between}{rest}", rest[::-1]]) == [True, False]


def test_rules_of_any_length(spark):
    """Lines of repeated content have equal sets of shingles at any length."""
    for unit in ("-", "* ", "ha "):
        assert joined_lines(spark, [unit * 24, unit * 200, "=" * 300]) == [True, False]


def test_vectors(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=6)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (305, [float("nan")] * 6), (306, [0.0] * 6), (None, rows[3][1]), (307, [1.0, 2.0]), (308, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in va_file.top_k(df.where("vec_id % 100 = 0"), df, 10).orderBy("query_id", "rank").collect()]
    good = {i: np.floor(1024 * np.array(v)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()}
    want = [(q, n + 1, i, int(-s)) for q in sorted(good) if q % 100 == 0 for n, (s, i) in enumerate(sorted((-(good[q] @ v), i) for i, v in good.items() if i != q)[:10])]
    assert got == want
    assert va_file.top_k(df.where("false"), df, 3).count() == 0 and posting_lists.search(df, df.where("false"), 3).count() == 0
    near = posting_lists.search(df.where("vec_id % 20 = 0"), df, 20).groupBy("query_id").count().collect()
    assert all(r["count"] == 20 for r in near) and 306 not in {r.query_id for r in near}


def test_posting_list_recall(spark):
    found = QUERIES["op6_posting_lists"](spark, "/root/testdata/sf0.01").toPandas()
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet' order by 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    hits = 0
    for q, g in found.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert hits >= 0.9 * len(found)


@pytest.mark.parametrize("search", [posting_lists.search, va_file.top_k])
def test_vectors_are_not_broadcast(spark, search):
    """What a query's vector is copied to isn't in Spark's estimates, so the join that follows must not go by them."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = search(df.where("vec_id % 20 = 0"), df, 5)
    found.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_posting_lists_of_clusters():
    """Where vectors lie in clusters, replicated boundary vectors and pruning find nine of ten neighbours in a fifth of the vectors."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(120, 24))[:, None] + 0.35 * rng.normal(size=(120, 60, 24))).reshape(-1, 24)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = posting_lists.Index(v, len(v), 20, 1.0)
    rows, lists = index.assign(v)
    n = np.bincount(lists, minlength=len(index.centroids))
    assert 1.01 < len(rows) / len(v) <= posting_lists.REPLICAS and n.max() <= 4 * posting_lists.LIST_ROWS
    hits, read = 0, 0
    for i in range(0, len(v), 60):
        asked = index.lists(v[i], 21, n)
        s = v @ v[i]
        s[i] = -9
        hits += len(set(np.argpartition(-s, 19)[:20]) & set(rows[np.isin(lists, asked)]))
        read += n[asked].sum()
    assert hits >= 0.9 * 20 * 120 and read < 0.2 * len(v) * 120


def test_posting_lists_fit_in_little_memory(spark, monkeypatch):
    """The fit of a table of millions of vectors holds a small part of the distances at a time; its sample is the least by hash, of few rows put in order."""
    v = np.random.default_rng(4).normal(size=(8000, 8))
    tracemalloc.start()
    index = posting_lists.Index(v, 2_000_000, 20, float(np.sqrt((v * v).sum(axis=1).max())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.centroids) > 1900 and peak < 60e6
    monkeypatch.setattr(posting_lists, "SAMPLE", 50)
    df = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    want = [r.vec for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r.vec for r in posting_lists.fit_rows(df, 1000).collect()] == want
    same = df.withColumn("id", F.lit(7).cast("long"))
    assert posting_lists.fit_rows(same, 1000).count() == 50


def test_large_vectors(spark):
    """Components near the greatest double: no square overflows on the way, every query has its full number of rows."""
    rows = [(i, [float(x) for x in 1e200 * np.random.default_rng(i).normal(size=8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = posting_lists.search(df.where("vec_id % 20 = 0"), df, 20).groupBy("query_id").count().collect()
    assert len(got) == 10 and all(r["count"] == 20 for r in got)


def test_ties_repeats_and_clashing_names(spark):
    """Equal vectors rank by id, a repeated candidate id counts once (posting lists) or as often as it stands (exact), and columns named like the operators' own do no harm."""
    unit = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, unit, "x", 1, [0.0]) for i in (0, 20, 3, 7, 7, 40)] + [(None, unit, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int, vecs array<double>")
    near = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in posting_lists.search(df.where("vec_id % 20 = 0"), df, 3).collect())
    assert near == [(q, n + 1, v, 1.0) for q in (0, 20, 40) for n, v in enumerate([x for x in (0, 3, 7, 20, 40) if x != q][:3])]
    exact = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in va_file.top_k(df.where("vec_id % 100 = 0"), df, 4).collect())
    assert exact == [(0, 1, 3, 1 << 20), (0, 2, 7, 1 << 20), (0, 3, 7, 1 << 20), (0, 4, 20, 1 << 20)]


def test_exact_search_in_blocks(spark):
    """With many blocks of queries the pairs lie in many groups, and results are the same."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = sorted(va_file.top_k(df, df, 5).collect())
    sizes = va_file.QUERY_ROWS, va_file.CHUNK_ROWS
    try:
        va_file.QUERY_ROWS, va_file.CHUNK_ROWS = 16, 50
        assert sorted(va_file.top_k(df, df, 5).collect()) == whole
    finally:
        va_file.QUERY_ROWS, va_file.CHUNK_ROWS = sizes


def test_base_secrets_by_brute_force(spark):
    """The base columns of op2 over the whole table, by plain patterns."""
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op2_secrets"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        found = [[(m.start(), n, m.end()) for m in re.finditer(p, texts[r.doc_id], re.A) if ok(m)] for n, (_, p, ok) in enumerate(kinds)]
        base = ",".join(f"{kinds[n][0]}:{a}:{b}" for a, n, b in sorted(x for f in found for x in f))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found)) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_secret_costs():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < 2 < cost("Summer2024") < 8 < cost("xK9#mQ2$vL")
    assert cost("aaaaaaaa") < 5 and cost("qwertyuiop") < 6
    assert secrets.find("pwd: xK9#mQ2$vL, password=password123456 secret: hunter") == [(5, 16, 3), (17, 40, 0)]


def test_secrets_of_any_length():
    rnd = random.Random(6)
    value = "".join(rnd.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789-_", k=300))
    assert secrets.find(f'auth: "{value}"') == [(7, 307, 3)] and secrets.find(f"bearer={value} x") == [(7, 307, 3)]
    assert secrets.find(f"pwd='{'z' * 5000}'") == []
    for n in (31, 32, 33, 64, 100, 400):
        for v in ("a" * n, value[:n], "password" * n, "qwertyuiop" * n, "x9#" * 4 + "a" * n, value[:40] + "1" * n):
            assert (secrets.guess_cost(v, 8.0) >= 8) == (secrets.guess_cost(v) >= 8)


def test_secret_costs_against_all_segmentations():
    """The cost is the least of every way to write a value as segments."""
    seg, beside, date = np.log10(2), secrets._beside, re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")

    def segments(value, per_char):
        low = value.lower()
        if len(value) == 1:
            yield per_char
        for form, extra in ((low, 0.0), (low.translate(secrets.LEET), 0.6)):
            if len(low) >= 3 and form in secrets.RANK:
                yield seg + np.log10(secrets.RANK[form] + 1) + extra + (np.log10(2) if value != low else 0)
        if date.fullmatch(low):
            yield seg + np.log10(365 * 120 if len(low) > 4 else 120)
        if len(low) >= 3 and len(set(low)) == 1:
            yield seg + per_char + np.log10(len(low))
        if len(low) >= 3 and all(beside(x, y) or abs(ord(x) - ord(y)) == 1 for x, y in zip(low, low[1:])):
            yield seg + np.log10(47) + 0.5 * np.log10(4) * (len(low) - 1)

    def least(value):
        per_char, cost = np.log10(secrets._class_size(value)), [0.0]
        for j in range(1, len(value) + 1):
            cost.append(min(cost[i] + c for i in range(j) for c in segments(value[i:j], per_char)))
        return cost[-1]

    rnd = random.Random(8)
    parts = ["password", "fghjkl", "coffee", "eeee", "Summer", "20", "201", "2012", "12", "1", "11", "/", "-", "qwe", "asdf", "dragon", "nnnn", "abc", "cba", "321", "4", "$", "x", "Z", "019", "99", "p4ss", "zzzzzz", "1999-12-31"]
    values = ["passwordfghjkl", "coffeeeeeee", "120121999", "11111111111111", "3120120101"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 6))) for _ in range(1500)]
    for v in values:
        assert abs(secrets.guess_cost(v) - least(v)) < 1e-9, v
    assert secrets.guess_cost("passwordfghjkl") < 4.5


def test_mix_budgets(spark):
    taken = mixing.mix(odd(spark)).groupBy("source", "target").agg(F.sum("taken").alias("n")).collect()
    assert all(r.n == int(r.target) for r in taken)


def test_toxicity_held_out(spark):
    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet' where toxic is not null").fetchall())
    held = got[got.held_out & got.doc_id.isin(labels)]
    assert (held.predicted == held.doc_id.map(labels)).mean() >= 0.9
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))


def test_length_alone_is_not_toxic():
    """Neutral texts of 1 to 10,000 sentences score alike; one that offends is found and located in any of them."""
    rnd = random.Random(3)
    words = [a + b + c for a in "bdfglm" for b in "aeiou" for c in ("n", "rt", "sk")]

    def clean(n):
        return ". ".join(" ".join(rnd.choices(words, k=8)) for _ in range(n))

    model = toxicity.fit([(clean(rnd.randint(1, 30)) + (". you vile scum. " + clean(2) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)])
    for n in (1, 10, 100, 1000, 10_000):
        text = clean(n)
        assert model.score(text) < 0.5 and model.score(f"{text}. you vile scum. {clean(1)}") >= 0.5
        (a, b, p), = model.located(f"{text}. you vile scum.")
        assert f"{text}. you vile scum."[a:b] == " you vile scum" and p >= 0.5
    assert model.score("lorem ipsum dolor. " * 5000) < 0.5 and model.score("") == model.score(None) == 0


def test_toxicity_fits_whole_texts(spark):
    """Sentences after a long clean beginning are learned from, and the memory bound takes fewer texts, not parts."""
    rnd = random.Random(4)
    words = [a + b + c for a in "bdfglm" for b in "aeiou" for c in ("n", "rt", "sk")]

    def clean(n):
        return ". ".join(" ".join(rnd.choices(words, k=6)) for _ in range(n))

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:80]
    texts = [(i, clean(1100) + (". you vile scum. " + clean(3) if k % 2 else ". " + clean(3))) for k, i in enumerate(ids)]
    assert min(t.find("vile scum") for _, t in texts[1::2]) > 20_000
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score("you vile scum") > 0.5 and model.score(clean(20)) < 0.5
    assert all((model.score(t) >= 0.5) == bool(k % 2) for k, (_, t) in enumerate(texts))
    seen, whole = [], toxicity.fit
    try:
        toxicity.fit = lambda pairs: seen.extend(pairs) or whole(pairs)
        toxicity.train(docs, labels, total=200_000)
    finally:
        toxicity.fit = whole
    assert 0 < len(seen) < 40 and {t for t, _ in seen} <= {t for _, t in texts} and {y for _, y in seen} == {0, 1}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.sql(ORACLE[name])
    cols = sorted(found.columns)
    want = [tuple(r[found.columns.index(c)] for c in cols) for r in found.fetchall()]
    got = [tuple(r[c] for c in cols) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(map(str, want)) == sorted(map(str, got))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, empty):
    """All five stages, one after the other, on nulls, empty and very long texts, repeated rows and clashing names; and on an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd(spark).where("false") if empty else odd(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert name == "sentencepiece" or docs.columns == columns
    assert docs.count() == 0 if empty else docs.where("doc_id in (1, 4)").count() >= 2


def test_pipeline(spark):
    """run() against the five stages written plainly in Python; the model of the first stage is the operator's own."""
    import sentencepiece

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    kept = {r.doc_id: r for r in docs.collect() if model.score(r.text) < 0.5}
    # lines: the components of similar ones, the first by document and place stays
    lines = [(i, k, x.strip(" ")) for i in sorted(kept) for k, x in enumerate((kept[i].text or "").split("\n")) if x.strip(" ")]
    texts = sorted({x for *_, x in lines})
    sets, parent = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    at, first, out = {x: i for i, x in enumerate(texts)}, {}, {}
    for i, k, x in lines:
        if first.setdefault(find(at[x]), (i, k)) != (i, k):
            out.setdefault(i, set()).add(k)
    text = {i: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in out.get(i, ())) if r.text is not None else None for i, r in kept.items()}
    # near copies: one of each component of fingerprints within 4 bits
    fps = {i: simhash.fingerprint(t) for i, t in text.items()}
    group = {i: i for i in fps}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sorted(fps):
        for j in sorted(fps):
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    stay = sorted(i for i in fps if top(i) == i)
    # mixing: budgets by water level, documents in order of their keys
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i] or "")) for i in stay}
    names = sorted({kept[i].source for i in stay}, key=lambda x: (x is None, x or ""))
    weight = {x: (5.0, 2.0, 1.0)[n % 3] for n, x in enumerate(names)}
    whole = {x: sum(size[i] for i in stay if kept[i].source == x) for x in names}
    target, open_, left = {}, set(names), 1.5 * sum(whole.values())
    while open_:
        level = left / sum(weight[x] for x in open_)
        above = {x for x in open_ if weight[x] * level > 2 * whole[x]}
        for x in above or open_:
            target[x] = 2.0 * whole[x] if above else weight[x] * level
            left -= target[x] if above else 0
        open_ = open_ - above if above else set()
    want, lib = [], sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for x in names:
        spent = 0
        for i in sorted((i for i in stay if kept[i].source == x), key=lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i)):
            epochs, rest = divmod(int(target[x] + 1e-9), whole[x]) if whole[x] else (0, 0)
            times = (epochs + (spent + size[i] <= rest)) if size[i] else 1
            spent += size[i]
            ids = lib.encode(text[i] or "", add_bos=True, add_eos=True)
            want += [(i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())] * times
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
