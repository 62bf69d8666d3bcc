"""The operators against brute-force versions on small tables with nulls, blanks, ties, repeats and long texts."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import boosting, decontaminate, gsaca, langid, packing, permutation, quality, repeats, simhash, substring, suffixes, transducer, warc
from orrery.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def documents(spark, rows, schema="doc_id long, text string"):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in ("id", "part", "bucket", "blob", "node", "print", "key", "grp", "n", "host", "component_id", "kind")})


def awkward(seed=0, n=80, pieces=12):
    r = random.Random(seed)
    letters = "abcdeé "
    base = ["".join(r.choice(letters) for _ in range(r.randint(0, 140))) for _ in range(pieces)] + ["a" * 120, "ab " * 50, "x y z " * 30, "the same words here again and again "]
    rows = []
    for _ in range(n):
        text = "".join(r.choice([b, b[r.randint(0, len(b)) :], b[: r.randint(0, len(b))]]) for b in r.choices(base, k=r.randint(0, 5)))
        rows.append((r.randint(0, n), text.replace(" ", r.choice([" ", "\n", " \t"]))))
    return [*rows, *rows[:4], (5, None), (6, ""), (7, " \n "), (None, rows[3][1]), (8, "one"), (9, "one two")]


# ---- 1


def test_language(spark):
    r = random.Random(1)
    vocab = {"en": "the of and thing that with have this from would".split(), "de": "der die das und nicht über können straße für eine".split(), "fr": "le la les été être avec pour une dans où".split()}
    say = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    rows = [(i, say(lang, 40), lang, f"src{i % 2}", 0) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    odd = [(100, None, "en", "src0", 0), (101, "", "de", None, 0), (102, "12345 !!! ### 99", "en", "src0", 0), (None, say("de", 30), None, None, 0), (103, say("fr", 30), "en", "src1", 0), (1, rows[1][1], "de", "src1", 0), (104, say("en", 3000), "zz", "src0", 0)]
    out = langid.identify(spark.createDataFrame(rows + odd, DOCS), declared=F.col("lang"), host=F.col("source")).collect()
    got = {}
    for x in out:
        got.setdefault(x["doc_id"], x)
    assert len(out) == len(rows) + len(odd)
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, _, lang, _, _ in rows)
    assert not any(got[i]["accepted"] for i in (100, 101, 102)) and got[100]["lang"] == "und"
    assert got[None]["lang"] == "de" and got[103]["lang"] == "fr" and got[104]["lang"] == "en"
    assert langid.identify(spark.createDataFrame([], DOCS), declared=F.col("lang"), host=F.col("source")).count() == 0


def test_language_evidence_and_pages(spark):
    docs = spark.createDataFrame([(i, "abc " * 30, lang, "h", 0) for i, lang in enumerate(["en", "de"] * 20)], DOCS)
    same = spark.createDataFrame([(1, "abc", "de", "x"), (2, "abc", "en", "x"), (3, "abc", None, "x")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang"] for r in langid.identify(same, declared=F.col("lang"), host=F.col("source"), labelled=docs).collect()}
    assert (got[1], got[2]) == ("de", "en")  # the text says nothing, so the declaration decides
    pages = spark.createDataFrame([(1, "https://u@News.Example.DE:80/x", '<html lang="de-AT"><script>var the;</script><p>abc</p>'), (2, None, None)], "page_id long, url string, html string")
    first, second = langid.page_evidence(pages).orderBy("doc_id").collect()
    assert (first["declared"], first["suffix"], first["host"], first["text"].split()) == ("de", "de", "news.example.de", ["abc"])
    assert (second["declared"], second["suffix"], second["host"], second["text"]) == (None, None, None, "")


# ---- 2


def test_boosting_learns_and_descends_like_a_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    f = boosting.train(x[:400], y[:400], trees=30, depth=4)
    assert ((f.score(x[400:]) > 0.5) == y[400:]).mean() > 0.9

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(row) for row in x[:20]], f.score(x[:20]))


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 60)))
    bad = lambda: " ".join(w + "###" for w in good().split())
    rows = [(i, good() if i % 2 else bad()) for i in range(300)] + [(400, None), (401, ""), (3, "again a row"), (None, good()), (402, good() * 2000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in out)
    held = [x for x in out if x["held_out"] and x["doc_id"] < 300]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out if x["doc_id"] is not None)
    assert len(held) > 30 and np.mean([x["predicted"] == x["doc_id"] % 2 for x in held]) > 0.95
    assert quality.quality_scores(documents(spark, []), labels).count() == 0
    assert quality.quality_scores(documents(spark, rows[:3]), labels.limit(0)).count() == 3


# ---- 3


def records(spark, rows, **options):
    out = warc.read_archive(warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, kind string"), **options))
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()), key=str)


def test_archives(spark):
    r = random.Random(3)
    texts = ["", "é" * 50, "<p>x</p>", "y" * 5000, "\r\n\r\n"]
    rows = [(i, r.choice([None, "http://a/\r\nX: 1", f"http://h/{i}"]), r.choice(texts), "k") for i in range(60)] + [(70, "u", None, "k"), (61, "u", "alone", "k"), (61, "u", "alone", "k"), (None, "u", "y" * 5000, "k")]
    for least in (0, 10):
        largest = {}
        for i, _, html, _ in rows:
            if i is not None:
                largest[html or ""] = max(largest.get(html or "", i), i)
        want = []
        for i, _, html, _ in rows:
            body = (html or "").encode()
            head = largest[html or ""]
            revisit = len(body) >= least and i != head
            want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
        assert records(spark, rows, min_revisit_bytes=least, chunk=64) == sorted(want, key=str)
    assert records(spark, []) == []


def test_archive_chunks_are_bounded_and_checked(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "z" * 1000, "k")], "page_id long, url string, html string, kind string"), chunk=100)
    rows = archive.orderBy("chunk_no").collect()
    assert len(rows) == 10 and max(len(x["data"]) for x in rows) < 700
    body = b"".join(bytes(x["data"]) for x in rows)
    assert body.startswith(b"WARC/1.1\r\nWARC-Type: response") and body.endswith(b"z\r\n\r\n")
    assert bytes(rows[-1]["running"]) == hashlib.sha1(b"z" * 1000).digest()
    broken = archive.withColumn("data", F.when(F.col("chunk_no") == 3, F.encode(F.lit("q" * 100), "UTF-8")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="chunk 3 does not match"):
        warc.read_archive(broken).collect()
    with pytest.raises(Exception, match="chunk 3 is missing"):
        warc.read_archive(archive.where("chunk_no <> 3")).collect()


# ---- 4


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    signs = "abcdetionséèßñÉΣσçİ0123456789'  \n\t!?.,-'tsdmrelv日本한😀👍́ﬁ½²Ⅷ_©"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 90))) for _ in range(600)]
    texts += ["", "I'll they've we're 'S 'ss ''s x's!'s", "a<|endoftext|>b", "<|startoftext|>" * 3, "x" * 3000, "thethe " * 900, "'re're'll", "a\x85b\x1cc"]
    want = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    t, special, tokenizer = transducer.compiled("word_bpe_49k.json")
    for chunk in (1 << 15, 61, 7):
        assert transducer.count_tokens(texts, t, special, tokenizer, chunk).tolist() == want
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "a b"), (7, None), (1, texts[1])]
    out = transducer.token_counts(documents(spark, rows)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out}
    assert len(out) == len(rows) and got[None] == (3, 2, False)
    assert all(got[i][0] == len(x.encode()) and got[i][1] == want[i] and got[i][2] == (want[i] > 2048) for i, x in enumerate(texts) if i != 7)
    assert transducer.token_counts(documents(spark, [])).count() == 0


def thue_morse(a, b, size):
    """Two strings on which any polynomial modulo a power of two agrees."""
    bits = [i.bit_count() & 1 for i in range(size)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_token_counts_of_pieces_that_weak_hashes_confuse(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = transducer.compiled("word_bpe_49k.json")
    for a, b in ("er", "th", "in", "ss"):
        texts = [x for size in (64, 1024, 2048, 4096) for x in thue_morse(a, b, size)]
        want = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
        assert transducer.count_tokens(texts, *made).tolist() == want
    zero = ["a\0", "a", "\0a", "a\0\0", "abcdefg", "abcdefg\0", "abcdefgh", "\0", "\0\0"]
    assert transducer.count_tokens(zero, *made).tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in zero]


def test_token_counts_of_every_kind_of_code_point():
    """Also of those that are newer than Python's Unicode tables."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = transducer.compiled("word_bpe_49k.json")
    codes = [0xA7CB, 0xA7DC, 0x13808, 0x1385C, 0x13988, *range(0x80, 0x110000, 37), *range(0xA700, 0xA800), *range(0x10D40, 0x10D90), *range(0x16100, 0x16140)]
    texts = [f"a{c}b {c}{c} 1{c}2 {c}\u0301" for c in map(chr, codes) if not 0xD800 <= ord(c) < 0xE000]
    want = [len(x.ids) for x in plain.encode_batch(texts, add_special_tokens=False)]
    got = transducer.count_tokens(texts, *made).tolist()
    assert [(hex(ord(t[1])), g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_maps_compose_associatively():
    r = np.random.default_rng(5)
    made = [transducer.Maps(r.integers(4, size=(1, 4)), r.integers(9, size=(1, 4))) for _ in range(3)]
    a, b = made[0].then(made[1]).then(made[2]), made[0].then(made[1].then(made[2]))
    assert (a.to == b.to).all() and (a.count == b.count).all()
    many = transducer.Maps(r.integers(4, size=(13, 4)), r.integers(9, size=(13, 4)))
    scanned, state, total = many.scan(), 2, 0
    for i in range(13):
        total += many.count[i, state]
        state = many.to[i, state]
        assert (scanned.to[i, 2], scanned.count[i, 2]) == (state, total)


# ---- 5


def test_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(1200, 16)).astype(np.float32)
    x[100:500] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [1.0], 0), (2200, [None] * 16, 0), (None, x[0].tolist(), 0), (100, x[100].tolist(), 0)]
    schema = "vec_id long, embedding array<float>, key int"
    got = {}
    for row in permutation.neighbours(spark.createDataFrame(rows + odd, schema), block=300).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert sorted(got) == list(range(0, 1200, 50))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        order = np.lexsort((np.arange(len(s)), -s.round(12)))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(s[i] - score) < 1e-12 for _, i, score in found)
        hits += len({f[1] for f in found} & set(order.tolist()))
        if 100 <= q < 500:
            assert [f[1] for f in found] == [i for i in range(100, 107) if i != q][:5]
    assert hits / (5 * len(got)) >= 0.9
    few = permutation.neighbours(spark.createDataFrame(rows[:3], schema)).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert permutation.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert permutation.neighbours(spark.createDataFrame([(0, [1.0, 0.0], 1)], schema)).count() == 0


@pytest.mark.parametrize("dim, noise", [(64, 0.0), (64, 9.0), (256, 9.0), (768, 0.5)])
def test_recall_of_a_pruned_search(spark, dim, noise):
    """Blocks far above what is reranked at least; clustered vectors and (noise 9) vectors with hardly any structure."""
    r = np.random.default_rng(dim)
    centres = r.normal(size=(40, dim))
    x = centres[r.integers(40, size=4000)] + (0.3 + noise) * r.normal(size=(4000, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = asked = 0
    for row in permutation.neighbours(df, every=40, block=1000, least=1).collect():
        s = u @ u[row["query_id"]]
        s[row["query_id"]] = -9
        hits += row["vec_id"] in np.argsort(-s)[:5]
        asked += 1
    assert asked == 500 and hits / asked >= 0.9
    share = permutation.fitted_share(u[:2048], permutation.PIVOTS, permutation.PREFIX, 5)
    assert share < 0.2 or noise


def test_slabs_change_nothing(spark):
    x = np.random.default_rng(7).normal(size=(400, 8)).tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, key int")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(permutation.neighbours(df, every=10)) == key(permutation.neighbours(df, every=10, slab=7))


# ---- 6


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["the", "thing", "é", "12", "ß!"]) for _ in range(r.randint(0, 300)))) for i in range(120)] + [(200, None), (201, ""), (202, "a <|endoftext|> b"), (203, "word " * 5000), (3, "again"), (None, "no id")]
    out = packing.pack(documents(spark, rows), size=64).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, windows = {}, {}
    for p in out:
        pieces.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert len(pieces) == sum(len({len(x) for x in v}) for v in ids.values())
    for (i, n), ps in pieces.items():
        own = next(x for x in ids[i] if len(x) == n)
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = np.array(own[at : at + p["length"]], "<u4")
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == n
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) for v in ids.values() for x in v)
    assert len(windows) * 64 < total * 1.1
    assert sorted(map(tuple, packing.pack(documents(spark, rows), size=64).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert packing.pack(documents(spark, [])).count() == 0


def test_best_fit_is_tightest():
    r = random.Random(9)
    fit, rooms = packing.BestFit(50), {}
    for _ in range(500):
        n = r.randint(1, 50)
        fits = [room for room in rooms.values() if room >= n]
        w, offset = fit.place(n)
        if fits:
            assert rooms[w] == min(fits) and offset == 50 - rooms[w]
        else:
            assert w not in rooms and offset == 0
        rooms[w] = rooms.get(w, 50) - n


# ---- 7


def brute_windows(rows, width):
    first, texts = {}, [(LAST if i is None else i, i, WORD.findall((t or "").encode())) for i, t in rows]
    for k, _, w in texts:
        for j in range(len(w) - width + 1):
            x = tuple(w[j : j + width])
            first[x] = min(first.get(x, (k, j)), (k, j))
    out = []
    for k, i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (k, j):
                gone[j : j + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, rounds", [(20, 4), (6, 3), (5, 1), (9, 6)])
def test_repeated_windows(spark, width, rounds):
    rows = awkward(width)
    out = substring.without_repeats(documents(spark, rows), width=width, rounds=rounds).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect()), key=str) == brute_windows(rows, width)


def test_repeated_windows_that_weak_hashes_confuse(spark):
    """Words and windows on which polynomials modulo a power of two agree, and words that differ late."""
    r = random.Random(20)
    plain = [f"w{i}" for i in range(19)]
    rows = []
    for a, b in (("a", "b"), ("e", "r")):
        for x in thue_morse(a, b, 1024):
            rows.append((len(rows), " ".join([*plain, x])))
    for x in thue_morse("one ", "two ", 64) + thue_morse("1 ", "2 ", 1024):
        rows.append((len(rows), x))
    long = "x" * 3000
    rows += [(len(rows) + k, " ".join([*plain, long + end])) for k, end in enumerate(("a", "b", "a"))]
    rows += [(100 + k, " ".join(r.choice(plain[:2]) for _ in range(400))) for k in range(4)]
    out = substring.without_repeats(documents(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute_windows(rows, 20)
    assert {i: n for i, _, n, _ in got}[1] == 0


def test_claims_are_held_against_the_text():
    """A claim that the lead's text does not bear out is an error, never a removal."""
    claims = np.zeros(2, repeats.CLAIM)
    claims["doc"], claims["lead"], claims["many"], claims["place"], claims["lead_place"] = 2, 1, 1, [0, 1], [5, 6]
    blob = lambda body: repeats.squeezed(repeats.planes(claims), np.zeros(2, "<u4"), np.array([5], "<i8"), np.array([len(body)], "<u4"), np.frombuffer(body, np.uint8))
    own = b"a b c d".split()
    good = repeats.Answers([blob(b"a b c d")], bytes.split).spans(2, 0, own, 3)
    assert good[["first", "last"]].tolist() == [(0, 1)]
    with pytest.raises(ValueError, match="differ"):
        repeats.Answers([blob(b"a b c e")], bytes.split).spans(2, 0, own, 3)


def test_repeated_windows_of_nothing(spark):
    assert substring.without_repeats(documents(spark, [])).count() == 0


# ---- 8

BENCH = [(7, "A train with 7 wagons leaves Berlin at 8:45 and goes 95 km/h while Carl buys 7 tickets for 6 dollars each."), (8, "of the and in"), (9, "short question about five plain words"), (10, None), (11, "")]


def flagged(spark, rows, bench=BENCH, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "item", "hash", "pos", "width", "m")})
    out = decontaminate.leaks(docs, spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(0)), **options)
    return sorted(((r["doc_id"], r["item_id"], r["verbatim"]) for r in out.collect()), key=str)


def test_leaks(spark):
    ask = "a train with {} wagons leaves {} at {} and goes {} km/h while {} buys {} tickets for {} dollars each"
    rows = [
        (1, "Before that, " + ask.format(12, "Paris", "9:30", 80, "Anna", 12, 5) + ". End"),
        (2, ask.format(12, "Paris", "9:30", 80, "Anna", 13, 5)),  # one value became two
        (3, None), (4, ""), (5, "A train with wagons. " * 50), (6, BENCH[0][1]), (6, BENCH[0][1]), (None, BENCH[0][1]),
        (8, "so here is a SHORT question about five plain words, again"), (9, "of the and in it"), (10, "x " * 20_000 + BENCH[0][1]),
        (11, ask.format(12, "Paris", "9:30", 80, "Anna", 12, 12)),  # two values became one
    ]
    assert flagged(spark, rows) == sorted([(1, 7, False), (6, 7, True), (None, 7, True), (8, 9, True), (9, 8, True), (10, 7, True), (11, 7, False)], key=str)
    assert flagged(spark, []) == [] and flagged(spark, rows, BENCH[3:]) == [] and flagged(spark, rows, []) == []


def test_leaks_of_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert flagged(spark, [(1, BENCH[0][1]), (2, "nothing of that kind stands in here at all")]) == [(1, 7, True)]


def test_leaks_run_no_python(spark):
    docs = spark.createDataFrame([(1, BENCH[0][1])], "doc_id long, text string")
    plan = decontaminate.leaks(docs, spark.createDataFrame(BENCH, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_leaks(docs, bench, words=8):
    """Whole-word windows without placeholders, as the test's texts have neither digits nor names."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for i, item in bench:
        own = cut(item)
        spots = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)}
        for d, t in docs:
            w = cut(t)
            if len(spots & {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}) >= 0.2 * len(spots) and spots:
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(10)
    vocab = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 5))) for _ in range(60)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(i, make(r.randint(12, 40))) for i in range(12)]
    docs = [(i, make(r.randint(0, 60)) + " " + (r.choice(bench)[1] if r.random() < 0.4 else "") + " " + make(5)) for i in range(80)]
    assert {(a, b) for a, b, _ in flagged(spark, docs, bench)} == brute_leaks(docs, bench)


def brute_template(text):
    """(raw, shape) of a text of words, numbers and sentence ends."""
    raw, shape, begins = [], [], True
    for t in re.findall(r"\w+|[.!?]", text):
        if t in ".!?":
            begins = True
            continue
        if t.isdigit():
            kind = "<num>"
        elif shape and shape[-1] == "<num>" and not (t[0].isupper() and not begins) and t.lower() in decontaminate.UNITS:
            kind = "<unit>"
        else:
            kind = "<name>" if t[0].isupper() and t[1:2].islower() and not begins else t.lower()
        raw.append(t.lower())
        shape.append(kind)
        begins = False
    return raw, shape


def brute_template_leaks(docs, bench):
    out = set()
    made = [(d, *brute_template(t)) for d, t in docs]
    for i, item in bench:
        raw, shape = brute_template(item)
        width = min(8, len(shape))
        spots = range(len(shape) - width + 1)
        few = [sum(not x.startswith("<") for x in shape[a : a + width]) < 5 for a in spots]
        for d, own, form in made:
            for shift in range(-len(shape), len(form)):
                found, slots = [], set()
                for a in spots:
                    p = a + shift
                    if p < 0 or form[p : p + width] != shape[a : a + width] or few[a] and own[p : p + width] != raw[a : a + width]:
                        continue
                    found.append(a)
                    slots |= {(shape[a + j], raw[a + j], own[p + j]) for j in range(width) if shape[a + j].startswith("<")}
                wide = sum(not few[a] for a in found)
                share = max(len(found) / len(spots), wide / max(1, len(spots) - sum(few)))
                if found and share >= 0.2 and len(slots) == len({s[:2] for s in slots}):
                    out.add((d, i))
    return out


def test_leaks_of_templates_against_brute_force(spark):
    """Numbers, units and names with new values, values that become equal or part, dense and short items."""
    r = random.Random(15)
    plain, names, units = "take make give find many much with from over then each some most only".split(), "Anna Berta Carl Dora".split(), "kg km min cm".split()

    def make(n, dense):
        out = []
        while len(out) < n:
            kind = r.random()
            out += [r.choice(plain)] if kind > dense else [str(r.randint(1, 5))] if kind > dense / 2 else [str(r.randint(1, 5)), r.choice(units)] if kind > dense / 4 else [r.choice(names)]
        return out

    bench = [make(r.choice((3, 4, 6, 9, 15, 25)), r.choice((0.1, 0.4, 0.8))) for _ in range(24)]
    docs = []
    for d in range(90):
        own = list(r.choice(bench))
        change = {x: r.choice((x, str(r.randint(1, 9)))) if x.isdigit() else r.choice((x, *names)) for x in own if x.isdigit() or x in names}
        own = [change.get(x, x) for x in own]
        if r.random() < 0.3:
            own[r.randrange(len(own))] = r.choice(plain + ["7"])
        docs.append((d, " ".join(make(r.randint(0, 12), 0.3) + [r.choice(("", "and")).strip() or "so"] + own) + r.choice((".", " now", ". Then Anna left"))))
    bench = [(i, "so " * (i % 2) + " ".join(w)) for i, w in enumerate(bench)]
    want = brute_template_leaks(docs, bench)
    assert {(a, b) for a, b, _ in flagged(spark, docs, bench)} == want and 20 < len(want) < 90


# ---- 9


def test_suffix_arrays():
    r = random.Random(11)
    for _ in range(3000):
        x = [r.randrange(r.choice((1, 2, 4))) for _ in range(r.randint(0, 24))]
        assert gsaca.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_strings(rows, width):
    least, texts = {}, [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, t in texts:
        for j in range(len(t) - width + 1):
            least[t[j : j + width]] = min(least.get(t[j : j + width], k), k)
    out = []
    for k, i, t in texts:
        gone = [False] * len(t)
        for j in range(len(t) - width + 1):
            if least[t[j : j + width]] < k:
                gone[j : j + width] = [True] * width
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, gram, most", [(50, 20, 200_000), (20, 8, 200_000), (12, 5, 60), (20, 8, 300)])
def test_shared_strings(spark, monkeypatch, width, gram, most):
    whole = suffixes._sorted
    monkeypatch.setattr(suffixes, "_sorted", lambda t, p, w, g: whole(t, p, w, g, most))
    rows = awkward(width + gram)
    out = suffixes.without_shared(documents(spark, rows), width=width, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, out.collect()), key=str) == brute_strings(rows, width)


def test_stretches_of_a_text_in_pieces(monkeypatch):
    """Keys do not depend on where a long text is cut, nor on ties across the cut."""
    data = np.frombuffer((b"abcab" * 300 + bytes(range(65, 91)) * 20 + b"a" * 200)[:2000], np.uint8)
    at = np.array([0, 700, 700, 1990, 2000])

    def keys(piece):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        first, many, key, _ = suffixes.stretches(data, at, 50, 20)
        window = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return dict(zip(window.tolist(), np.repeat(key, many).tolist()))

    whole = keys(1 << 22)
    assert set(whole) == {w for a, b in zip(at, at[1:]) for w in range(a, b - 49)} and all(w <= k <= w + 30 for w, k in whole.items())
    assert keys(64) == keys(333) == whole


def test_shared_strings_keep_characters_and_columns(spark):
    text = "é" * 40
    rows = [(1, "a" + text, "x", None), (2, "b" + text + "ß", "y", "s"), (3, None, None, None)]
    out = suffixes.without_shared(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept_by string"), carry=("lang", "kept_by"), characters=True)
    got = {r["doc_id"]: (bytes(r["kept"]).decode(), r["lang"], r["kept_by"]) for r in out.collect()}
    assert got == {1: ("a" + text, "x", None), 2: ("bß", "y", "s"), 3: ("", None, None)}
    assert suffixes.without_shared(documents(spark, []), carry=("host",)).count() == 0


# ---- 10


def brute_prints(rows, width=3):
    import xxhash

    out = []
    for _, t in rows:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


@pytest.mark.parametrize("bits, segments, bulk", [(2, 5, 2048), (2, 3, 4), (1, 2, 2048), (6, 13, 2048)])
def test_simhash(spark, monkeypatch, bits, segments, bulk):
    monkeypatch.setattr(simhash, "BULK", bulk)
    r = random.Random(bits)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(100, 200))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "NEW"
        rows.append((i if i % 9 else r.randint(0, 160), " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "One\n"), (304, "one two"), (None, rows[0][1]), (305, "solitary words in here"), rows[5]]
    prints = brute_prints(rows)
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    root = {k: k for k in known}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in known:
        for b in known:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for k in known:
        least[find(k)] = min(least.get(find(k), LAST), rows[k][0])
    of = {}
    for k in known:
        of[prints[k]] = least[find(k)]
    want = sorted(((i, f"{p:016x}", of.get(p)) for (i, _), p in zip(rows, prints)), key=str)
    out = simhash.simhash_groups(documents(spark, rows), max_bits=bits, segments=segments)
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_simhash_of_nothing_and_bad_segments(spark):
    assert simhash.simhash_groups(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.ring(4, 4)


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("orrery.llm.components.ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(60)] + [(100, 5), (200, 201), (201, 200), (7, 7), (None, 3), (300, 301)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 0, 201: 200, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(12):
        w = r.choices(vocab, k=r.randint(150, 400))
        for c in range(r.randint(1, 4)):
            own = list(w)
            if c:
                own[r.randrange(len(own))] = f"changed{g}{c}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    rows += [(500, ""), (501, None), (502, " "), (503, rows[0][1].upper()), (None, rows[0][1]), (504, "tiny one"), (505, "tiny  one")]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(documents(spark, rows)).collect()}
    firsts = {}
    for i, g in group.items():
        firsts.setdefault(g, i)
    assert all(got[i] == firsts[g] for i, g in group.items())
    assert (got[500], got[501], got[502], got[503], got[504], got[505]) == (500, 500, 500, 0, 504, 504) and None not in got
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_resemblance():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words).encode(), " ".join(words[:1500] + ["x"] + words[1501:]).encode()
    assert simhash.resemblance(simhash.sketch(a, 5), simhash.sketch(a, 5)) == 1
    assert simhash.resemblance(simhash.sketch(a, 5), simhash.sketch(b, 5)) > 0.97
    assert simhash.resemblance(simhash.sketch(b"", 5), simhash.sketch(b"", 5)) == 1 and simhash.resemblance(simhash.sketch(b"", 5), simhash.sketch(b"x", 5)) == 0


def test_resemblance_of_long_texts():
    """On whole texts: close to the threshold a sample of the shingles decides either way."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for seed in range(8):
        a = [f"w{seed}x{i}" for i in range(6000)]
        b = a[: 4800 + 10 * (seed - 4)] + ["y"] * 2
        x, y = shingles(a), shingles(b)
        assert simhash.resemblance(simhash.sketch(" ".join(a).encode(), 5), simhash.sketch(" ".join(b).encode(), 5)) == len(x & y) / len(x | y)


def similar(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_close_to_the_threshold(spark):
    """Appended blocks and scattered edits at a similarity of 0.80 to 0.85: every pair is found, none below 0.8."""
    r = random.Random(13)
    texts, want = [], {}
    for g in range(120):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 300))]
        if g % 2:
            own = w + [f"w{r.randrange(3000)}" for _ in range(int(len(w) * r.uniform(0.17, 0.27)))]
        else:
            own = list(w)
            for k in range(int(len(w) * r.uniform(0.015, 0.025))):
                own[r.randrange(len(own))] = f"changed{k}"
        texts += [w, own]
        want[2 * g + 1] = 2 * g if similar(w, own) >= 0.8 else 2 * g + 1
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])).collect()}
    assert 30 < sum(k != v for k, v in want.items()) < 110
    assert {k: got[k] for k in want} == want


def test_near_duplicates_of_large_groups(spark):
    """Variants of one text, alike in part only, and a shared template: the components of all pairs, not of the nearest."""
    r = random.Random(14)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(150):
        w = list(base)
        for j in range(r.randint(1, 5)):
            w[r.randrange(200)] = f"v{k}x{j}"
        texts.append(w + [f"t{k}x{j}" for j in range(r.choice((0, 0, 10, 25)))])
    texts += [base[:60] + [f"u{k}x{j}" for j in range(40)] for k in range(30)]
    r.shuffle(texts)
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and similar(texts[i], texts[j]) >= 0.8:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])).collect()}
    assert got == dict(enumerate(least))


def test_near_duplicates_begin_with_fingerprints(spark, monkeypatch):
    """Pigeonring buckets of SimHash fingerprints give the first candidates."""
    seen, boxes = [], simhash._boxes
    monkeypatch.setattr(simhash, "_boxes", lambda *a: seen.append(a[1:]) or boxes(*a), raising=False)
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    got = simhash.near_duplicates(documents(spark, [(1, near), (2, near + " aa"), (3, "other words than these are here")])).collect()
    assert seen and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}


def test_nearest_fingerprints_of_a_bucket():
    r = random.Random(15)
    prints = sorted({sum(1 << b for b in r.sample(range(9), r.randint(0, 4))) for _ in range(150)})
    n = len(prints)
    comp = [r.randrange(20) for _ in range(n)]
    batch = pa.record_batch({"key": pa.array([7] * n), "print": pa.array(prints), "start": pa.array([1] * n, pa.int32()), "node": pa.array(range(n)), "component": pa.array(comp)})
    got = [x for b in simhash._nearest(iter([batch]), 3, 7) for x in b.to_pylist()]
    assert len(got) <= n
    best = {}
    for x in got:
        d = (prints[x["a"]] ^ prints[x["b"]]).bit_count()
        assert d <= 3 and x["n"] == 64 - d and comp[x["a"]] != comp[x["b"]]
        for k in (x["a"], x["b"]):
            best[k] = min(best.get(k, 9), d)
    for i in range(n):
        within = [d for j in range(n) if comp[i] != comp[j] and (d := (prints[i] ^ prints[j]).bit_count()) <= 3]
        assert best.get(i) == min(within, default=None)


def test_candidates_of_a_large_group_grow_with_its_rows():
    """400 texts that all may be alike, each a component: a few rows for each, then the rest of those that had more."""
    n, r = 400, random.Random(16)
    sets = [np.array(sorted({*range(160), *(1000 + r.randrange(60) for _ in range(12))}), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(n)]
    size = [len(x) for x in sets]
    order = sorted(range(n), key=lambda k: (size[k], k))
    parities = [simhash.parity(x) for x in sets]

    def run(nodes, tried, **options):
        cells = {"node": nodes, "key": [1] * len(nodes), "size": [size[k] for k in nodes], "component": nodes, "parity": [parities[k] for k in nodes], "tried": [[b for a, b in tried if a == k] for k in nodes]}
        kinds = {"size": pa.int32(), "tried": pa.list_(pa.int64())}
        batch = pa.record_batch({k: pa.array(v, kinds.get(k)) for k, v in cells.items()})
        return [(x["a"], x["b"]) for b in simhash._across(iter([batch]), 0.8, **options) for x in b.to_pylist()]

    first = run(order, [])
    assert len(first) <= 3 * n
    pairs, nodes, found, most = set(), order, first, 2
    while True:
        new = {x for x in found if x[1] is not None}
        assert not new & pairs
        pairs |= new
        more = {a for a, b in found if b is None}
        nodes, most = [k for k in nodes if k in more], 8 * most
        if not nodes:
            break
        found = run(nodes, pairs, most=most)
    assert pairs == {(a, b) for a in range(n) for b in range(a)}


def test_small_tables_get_few_buckets(spark, monkeypatch):
    """Each bucket of keys sends a row to each bucket of documents: many partitions don't cut a small table finer."""
    monkeypatch.setattr(suffixes, "texts_in_buckets", lambda *a, **b: (_ for _ in ()).throw(ValueError(str(a[3]))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        with pytest.raises(ValueError) as said:
            suffixes.without_shared(documents(spark, [(i, f"text {i} " * 20_000) for i in range(10)]))
        assert int(str(said.value)) == 1 + 20_000 * 7 * 10 // (1 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_leaks_of_windows_with_few_literals(spark):
    """Number-dense items count where the values agree, and only there; those with other values keep their wide windows."""
    bench = [(1, "what is 37 * 48 + 12"), (2, "mix 3 kg of 4 l and 5 g"), (3, "take 3 kg of apples and 4 kg of pears then tell how many baskets you will need for all of them")]
    rows = [
        (1, "so: what is 37 * 48 + 12, then"), (2, "so: what is 37 * 49 + 12, then"), (3, "They mix 3 kg of 4 l and 5 g here"), (4, "They mix 3 kg of 4 l and 6 g here"),
        (5, "take 8 kg of apples and 9 kg of pears then tell how many baskets you will need for all of them"), (6, "nothing here but 37 48 12"),
    ]
    assert flagged(spark, rows, bench) == [(1, 1, True), (3, 2, True), (5, 3, False)]


def test_hashes_of_long_texts_leave_no_tables_behind():
    import tracemalloc

    from orrery.llm import common

    data = np.random.default_rng(7).integers(0, 256, 3_000_000).astype(np.uint8)
    data[2_000_000:2_000_100] = data[100:200]
    tracemalloc.start()
    try:
        hashes = common.Prefix.of_bytes(data)
        sums = hashes.sums.nbytes
        left, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert left - sums < 1 << 20 and peak - sums < 1 << 20
    start = np.array([100, 2_000_000, 0, 16_380, 0])
    end = np.array([200, 2_000_100, 100, 16_390, len(data)])
    got = hashes(start, end)
    assert got[0] == got[1] and len(set(got.tolist())) == 4
    values, most, inverse = common._BYTE[data[16_380:16_390]].tolist(), 1 << 64, pow(common._BASE, -1, 1 << 64)
    plain = sum(v * pow(common._BASE, 16_380 + i, most) for i, v in enumerate(values)) * pow(inverse, 16_380, most) + 10
    assert got[3] == common.mixed(np.array([plain % most], np.uint64))[0]
