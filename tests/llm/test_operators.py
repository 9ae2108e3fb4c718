"""The ten operators on small inputs: brute force, round trips, edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronoscope.llm import bpe, components, decontaminate, licenses, neardup, packed, quality, substrings, tokencount, toxicity, urlfilter, warc, wordhash
from tests.llm import brute

DOC = "doc_id long, text string"
VOCAB = [a + b for a in ("ba", "de", "Ki", "mo", "nü", "re", "ß") for b in ("la", "no", "ta", "é", "x,", "y.")]


def prose(rng, n):
    return "".join(w + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for w in rng.choices(VOCAB, k=n))


def corpus(seed=7):
    rng = random.Random(seed)
    base = prose(rng, 120)
    docs = [prose(rng, rng.choice([5, 30, 90, 200])) for _ in range(30)]
    docs += [base, base, base + " tail", "head " + base]
    words = base.split()
    for k in (1, 2, 4, 8, 15):
        for _ in range(4):
            w = list(words)
            for at in rng.sample(range(len(w)), k):
                w[at] = f"new{rng.randrange(999)}"
            docs.append(" ".join(w))
    shared = prose(rng, 40)
    docs += [prose(rng, 30) + shared + prose(rng, 20) for _ in range(6)]
    docs += [None, "", " \n\t", "one", "one two", "a " * 60, "a " * 40 + "b " + "a " * 30, "a " * 13, "\x1c\x85\xa0 word", "日本 語 " * 30, "x" * 5000 + " y", "<|endoftext|> <|ENDOFTEXT|> it's 's a<|endoftext|>b"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return list(zip(order, docs))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- word fingerprints and packed rows


def test_words_of_batches_match_the_pattern():
    import pyarrow as pa

    texts = [t for _, t in corpus()]
    data, off = wordhash.text_buffers(pa.array(texts).slice(1))
    for kind, pattern in (("space", brute.WORD), ("alnum", brute.ALNUM)):
        s, e, bounds = wordhash.word_bounds(data, off, kind)
        got = [[data[s[k] : e[k]].tobytes().decode() for k in range(bounds[r], bounds[r + 1])] for r in range(len(texts) - 1)]
        fold = (lambda t: t.translate(brute.LOWER)) if kind == "alnum" else str
        assert [[fold(w) for w in r] for r in got] == [pattern.findall(fold(t or "")) for t in texts[1:]]
    h = wordhash.word_hashes(data, s, e)
    words = [w for r in got for w in r]
    assert len(set(h.tolist())) == len(set(words)) and len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    text = "word " * 3000 + "y" * 9000 + " end"
    data, off = wordhash.text_buffers(pa.array([text]))
    s, e, _ = wordhash.word_bounds(data, off, "space")
    whole = wordhash.word_hashes(data, s, e)
    monkeypatch.setattr(wordhash, "PIECE", 512)
    assert (wordhash.word_hashes(data, s, e) == whole).all()


def test_deal_keeps_every_key():
    import numpy as np

    k = wordhash.mix(np.arange(1000, dtype=np.uint64))
    got = [np.frombuffer(p[0], np.uint64) for _, p in packed.deal(k, [], 7)]
    assert sorted(np.concatenate(got).tolist()) == sorted(k.tolist()) and len(got) == 7


# --- 1 WARC


def pages_table(spark):
    big = "<p>é</p>" * 20_000
    rows = [(1, "http://a/x y", big), (2, "http://a/2", big), (3, None, big + "!"), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a/8", "x" * 999), (9, "http://a/9", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (12, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_contract(spark):
    import hashlib

    rows, df = pages_table(spark)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(df).collect()}
    want = {}
    for i, _, h in rows:
        p = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "").encode() == p)
        again = len(p) >= 1000 and top > i
        want[i] = (len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None)
    assert got == want


def test_warc_round_trip_in_chunks(spark):
    rows, df = pages_table(spark)
    chunks = warc.read(warc.write(df)).orderBy("record_id", "chunk").collect()
    assert max(len(c["payload"]) for c in chunks) <= warc.CHUNK
    text = {}
    for c in chunks:
        text.setdefault((c["record_id"], c["record_type"]), []).append(c)
    for (rid, kind), part in text.items():
        i = int(rid.rpartition(":")[2])
        if kind == "response":
            assert b"".join(c["payload"] for c in part) == (dict((a, c) for a, _, c in rows)[i] or "").encode()
            assert part[-1]["last"] and part[-1]["sha1"] == part[-1]["stated"] and [c["chunk"] for c in part] == list(range(len(part)))


def test_warc_rows_that_repeat_and_none(spark):
    big = "z" * 2000
    df = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "u", big)], "page_id long, url string, html string")
    got = warc.digest(df).collect()
    assert len(got) == 3 and {r["record_type"] for r in got} == {"response"}
    assert warc.digest(df.where("false")).count() == 0


# --- 2 BPE


def library_tokens(path="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(path))


def test_bpe_agrees_with_the_library(spark, docs):
    t = library_tokens()
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode(docs).collect()}
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False)), text


def test_bpe_repeated_ids_and_extra_columns(spark, empty):
    long = prose(random.Random(3), 4000)
    rows = [(1, long, "a"), (1, "other " + long, "b"), (2, long, "c"), (None, long, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_of string")
    t = library_tokens()
    got = {r["ids_of"]: r["n_tokens"] for r in bpe.encode(df, wanted=("n_tokens",)).collect()}
    assert got == {c: len(t.encode(x, add_special_tokens=False).ids) for _, x, c in rows}
    assert bpe.encode(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_stitched_chunks_equal_the_whole(seed):
    import public_tokenizers

    enc = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(seed)
    raw = (prose(rng, 60) + "x" * rng.randrange(300) + " it's <|endoftext|> " + prose(rng, 40)).encode()
    at = sorted({0, len(raw), *(k for k in rng.sample(range(1, len(raw)), 25) if raw[k] & 0xC0 != 0x80)})
    keys, ends = [bytes([k]) for k in range(len(at) - 1)], at[1:]
    have = {k: enc.whole(raw[a:b]) for k, a, b in zip(keys, at, ends) if rng.random() < 0.5}
    assert enc.stitch(raw, keys, ends, have) == enc.whole(raw)


def test_long_text_is_stitched_in_time_that_follows_its_length(monkeypatch):
    import time

    import public_tokenizers

    monkeypatch.setattr(wordhash, "PIECE", 1 << 14)
    enc, took = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER)), []
    rng = random.Random(1)
    some = prose(rng, 30_000)
    for n in (1, 8):
        raw = (some * n).encode()
        import numpy as np

        ends = bpe.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        keys = [raw[a:b] for a, b in zip([0, *ends], ends)]
        have = {k: enc.encode(k) for k in keys}
        began = time.process_time()
        ids = enc.stitch(raw, keys, ends, have)
        took.append(time.process_time() - began)
        assert ids == enc.whole(raw)
    assert took[1] < 20 * took[0]


def test_bpe_with_another_tokenizer(spark):
    t = library_tokens("byte_bpe_50k.json")
    import public_tokenizers

    rows = [(i, x) for i, x in corpus()[:40]]
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode(spark.createDataFrame(rows, DOC), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("seed", range(3))
def test_words_and_parts_agree_with_the_library(seed):
    import public_tokenizers

    enc, rng = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER)), random.Random(seed)
    assert enc.by_words and enc.joins_tokens
    odd = ["a", "É", "ñ", "ß", "x", "9", "12", "'", "'s", "-", "!!", "<", "|", "<|", ".", "\u0301", "\u00d7", "\u00aa", "\u0130", "\u00a0", "日", "\x1c", " ", " ", "\n"]
    for _ in range(400):
        x = "".join(rng.choices(odd, k=rng.randrange(1, 14)))
        assert enc.encode(x.encode()) == enc.whole(x.encode()), repr(x)


# --- 3 toxicity


def test_factorisation_machine_learns_pairs(spark, empty, monkeypatch):
    """Labels are an exclusive or: neither word tells anything alone, so that weights without factors stay near one half."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.choices(VOCAB[:12], k=3)) + (" insultword" if a else "") + (" groupword" if b else "")))
        labels.append((i, int(a != b)))
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)

    def right():
        got = [(truth[r["doc_id"]], r["predicted"], r["score"]) for r in toxicity.digest(docs, lab).where("held_out").collect()]
        assert all(0 <= s <= 1 for _, _, s in got)
        return sum(y == p for y, p, _ in got) / len(got)

    monkeypatch.setattr(toxicity, "WEIGHT", 1.0)
    assert right() > 0.95
    fresh = toxicity.fresh
    monkeypatch.setattr(toxicity, "fresh", lambda n: (*fresh(n)[:2], 0 * fresh(n)[2]))
    assert right() < 0.7
    assert toxicity.digest(empty, lab).count() == 0
    assert toxicity.digest(docs.limit(5), lab.where("false")).select("score").distinct().count() == 1


def test_scores_are_those_of_the_plain_formula():
    import numpy as np

    rng = np.random.default_rng(1)
    w0, w, v = 0.3, rng.normal(size=50), rng.normal(size=(50, 4))
    rows = [rng.choice(50, n, replace=False) for n in (1, 2, 9)]
    start = np.array([0, 1, 3])
    z, _ = toxicity.raw_scores(np.concatenate(rows), start, w0, w, v)
    for x, got in zip(rows, z):
        plain = w0 + sum(w[i] for i in x) + sum(v[i] @ v[j] for a, i in enumerate(x) for j in x[:a])
        assert got == pytest.approx(plain)


def test_scores_do_not_depend_on_the_layout(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.digest(x, y).collect()} for x, y in ((d, lab), (d.repartition(7), lab.repartition(3))))
    assert one == two


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(50)], DOC)
    lab = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(50)] + [(None, 1)], "doc_id long, toxic int")
    assert toxicity.sample(docs, lab).agg(F.max("toxic")).first()[0] == 0
    s = toxicity.digest(docs.unionByName(spark.createDataFrame([(98, None), (99, "")], DOC)), lab)
    assert s.where("doc_id > 90").select("score").distinct().count() == 1
    assert {r["doc_id"] for r in s.where("held_out").collect()} == {i for i in [*range(50), 98, 99] if zlib.crc32(str(i).encode()) % 5 == 0}


# --- 4 URL filters


def test_intervals_and_as_of(spark):
    e = spark.createDataFrame([("ads", "B.com", "2024-01-05", True), ("ads", "b.com", "2024-01-10", False), ("ads", "b.com", "2024-01-10", True), ("ads", "b.com", "2024-01-20", False), ("mal", "x.b.com", "2024-01-01", True), ("ads", None, "2024-01-01", True)], "list string, domain string, since string, listed boolean")
    c = spark.createDataFrame([(1, "http://x.b.com/p", "2024-01-04"), (2, "https://u:p@X.B.com:80/", "2024-01-19"), (3, "http://b.com", "2024-01-20"), (4, "http://b.com?q", "2024-01-05"), (5, None, "2024-01-05"), (6, "no url", "2024-01-05"), (7, "http://b.com", None), (4, "http://b.com?q", "2024-01-05")], "page_id long, url string, fetched string")
    got = sorted((r["page_id"], r["blocked"], r["lists"], r["n_active"]) for r in urlfilter.judge(c, e).collect())
    assert got == [(1, True, "mal", 1), (2, True, "ads,mal", 2), (3, False, "", 0), (4, True, "ads", 1), (4, True, "ads", 1), (5, False, "", 0), (6, False, "", 0), (7, False, "", 0)]
    assert urlfilter.judge(c, e.where("false")).where("blocked").count() == 0
    assert urlfilter.judge(c.where("false"), e).count() == 0


# --- 5 quality


def test_quality_counts(spark, docs, empty):
    lab = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.digest(docs, lab).collect()}
    assert got == {i: brute.quality(t) for i, t in corpus()}
    assert quality.digest(docs, lab).where("base_failed and kept").count() == 0
    assert quality.digest(empty, lab).count() == 0
    assert quality.digest(docs, lab.where("false")).count() == len(corpus())


def test_log_ratio_parts_good_from_junk(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choices(VOCAB, k=80))) for i in range(60)]
    junk = [(100 + i, " ".join(f"{w.upper()}!!" for w in rng.choices(VOCAB, k=80))) for i in range(20)]
    lab = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    df = spark.createDataFrame(good + junk, DOC).withColumn("score_was", F.lit(1))
    kept = {r["doc_id"] for r in quality.judge(df, lab).where("kept").collect()}
    assert kept == {i for i, _ in good}


def test_log_ratio_is_the_mean_over_grams(spark):
    import math

    import xxhash

    docs = [(1, "a b a"), (2, "b c"), (3, "c")]
    df, lab, cells = spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), 64

    def cell(*ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        return h % cells if h < 1 << 63 else (h - (1 << 64)) % cells

    def grams(t):
        w = t.split()
        return [cell(x) for x in w] + [cell(x, y) for x, y in zip(w, w[1:])]

    raw = [sum(g == c for _, t in docs for g in grams(t)) for c in range(cells)]
    top = [grams(docs[0][1]).count(c) for c in range(cells)]
    a = quality.ALPHA
    scale = sum(top) / sum(raw)
    ratio = [math.log((t + a) / (r * scale + a)) for t, r in zip(top, raw)]
    got = {r["doc_id"]: r["score"] for r in quality.judge(df, lab, cells).collect()}
    for i, t in docs:
        assert got[i] == pytest.approx(sum(ratio[g] for g in grams(t)) / len(grams(t)))


@pytest.mark.parametrize("n", [60, 300, 1200])
def test_plain_text_stays_whatever_the_size(spark, n):
    rng = random.Random(n)
    vocab, junk = [f"w{i}" for i in range(4000)], [f"#{i}" for i in range(20)]
    weight = [1 / (i + 5) for i in range(4000)]
    plain = [(i, " ".join(rng.choices(vocab, weight, k=90))) for i in range(n)]
    bad = [(10_000 + i, " ".join(rng.choices(junk, k=45) + rng.choices(vocab, weight, k=45))) for i in range(n // 10)]
    lab = spark.createDataFrame([(i, 1) for i in range(n // 3)] + [(10_000 + i, 0) for i in range(n // 20)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(plain + bad, DOC), lab).where("kept").collect()}
    assert len(kept & set(range(n // 3, n))) >= 0.95 * (n - n // 3)
    assert not kept & {i for i, _ in bad}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_unlabelled_prose_stays_on_the_given_tables(spark, sf):
    d, lab = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rest = quality.digest(d, lab).where("not base_failed").join(lab.where("quality is not null"), "doc_id", "left_anti")
    n, gone = rest.agg(F.count("*"), F.count_if(~F.col("kept"))).first()
    assert gone <= 0.09 * n


def test_held_out_score_is_that_of_a_document_not_trusted(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(rng.choices(VOCAB, k=60))) for i in range(12)], DOC)
    lab = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, quality int")
    held = quality.scored(df, lab).where("doc_id = 3").first()["_held"]
    assert held == pytest.approx(quality.scored(df, lab.where("doc_id <> 3")).where("doc_id = 3").first()["score"])


def test_every_good_document_is_trusted(spark):
    lab = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted(lab).count() == 60_000


# --- 6 token counts


def test_token_counts_agree_with_the_library(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL))
    extra = [" ", "  a", "a  ", "\n", "\n\n a\nb", "▁", "a▁b ▁ c", "tab\tx", "<s> </s> <unk>", "a\x00b"]
    df = docs.unionByName(spark.createDataFrame(list(enumerate(extra, 1000)), DOC))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.digest(df).collect()}
    for i, t in [*corpus(), *enumerate(extra, 1000)]:
        assert got[i] == (len((t or "").encode()), len(sp.encode(t or ""))), repr(t)
    assert tokencount.digest(empty).count() == 0


# --- 7 substring dedup


@pytest.mark.parametrize("width", [4, 13])
def test_substrings(spark, docs, empty, width):
    got = sorted((r["doc_id"], r["_n_words"], r["_n_removed"], r["_kept"]) for r in substrings.deduplicate(docs, width).collect())
    assert got == sorted(brute.substrings(corpus(), width))
    assert substrings.deduplicate(empty, width).count() == 0


def test_substrings_ids_that_repeat_or_miss(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text, "b"), (None, text, "c")], "doc_id long, text string, k string")
    got = sorted((r["k"], r["_n_removed"]) for r in substrings.deduplicate(df).collect())
    assert got == [("a", 0), ("a", 0), ("b", 20), ("c", 0)]


# --- 8 decontamination


def test_decontamination(spark, docs, empty):
    c = corpus()
    items = [(1, c[30][1]), (2, "one"), (10, "One, TWO"), (3, None), (4, "..."), (5, "zzz unseen"), (6, c[3][1]), (7, c[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.hits(c, items)
    for blocks in (10**6, 40):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.mark(docs, bench, block_words=blocks).collect()}
        assert got == {i: (n, h, x) for i, n, h, x in want}
    d = {r["doc_id"]: (r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.digest(docs, bench).collect()}
    assert d == {i: (len(x), brute.sha(",".join(sorted(map(str, x)))), h > 0 and 20 * h >= n) for i, n, h, x in want}
    assert decontaminate.digest(empty, bench).count() == 0
    assert decontaminate.digest(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0


# --- 9 licenses


def test_licenses(spark, empty):
    rng = random.Random(2)
    t = licenses.templates(spark)
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.NOTICES.items()):
        for j in range(4):
            i = 10 * k + j
            rows.append((i, prose(rng, j * 23) + " " + text + " " + prose(rng, j * 11)))
            want[i] = plain_scan(rows[-1][1])[0]
            assert name in want[i].split(",")
    rows += [(900, None), (901, ""), (902, prose(rng, 300)), (903, "released under the license")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.digest(spark.createDataFrame(rows, DOC), t).collect()}
    assert got == {i: want.get(i, "") for i, _ in rows}
    assert licenses.digest(empty, t).count() == 0
    assert licenses.digest(spark.createDataFrame(rows, DOC), t.where("false")).where("n_licenses > 0").count() == 0


def plain_scan(text):
    """Every window of every template, by sets of words."""
    import re

    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    ws, best = split(text), {}
    for name, t in licenses.NOTICES.items():
        t = split(t)
        k, step = min(licenses.SHINGLE, len(t)), max(1, len(t) // 4)
        own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        sh = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
        for first in range(0, len(sh), step):
            share = len(own & set(sh[first : first + len(t) + step - k])) / len(own)
            if share >= licenses.CONTAINED:
                best[name] = max(best.get(name, 0), share)
    return ",".join(sorted(best)), max(best.values(), default=None)


def test_licenses_against_every_window(spark):
    """Whole and edited license texts, across window borders, twice, and around the threshold."""
    rng, rows = random.Random(11), []
    for text in licenses.NOTICES.values():
        w = text.split()
        for k in (0, 1, 2, 3, 5, 8, 12):
            x = list(w)
            for at in rng.sample(range(len(w)), min(k, len(w) - 1)):
                x[at] = rng.choice(VOCAB)
            rows.append((len(rows), prose(rng, rng.randrange(60)) + " ".join(x) + " " + prose(rng, rng.randrange(60)) + (" ".join(x) if k == 2 else "")))
    rows.append((len(rows), prose(rng, 60_000) + " " + licenses.NOTICES["isc-text"]))
    rows += [(i, t) for i, t in corpus() if i > 100]
    got = {r["doc_id"]: (r["licenses"], r["containment"]) for r in licenses.digest(spark.createDataFrame(rows, DOC), licenses.templates(spark)).collect()}
    for i, t in rows:
        assert got[i] == plain_scan(t), t[:200]


# --- 10 near duplicates


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, empty, k, percent):
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, k, percent).collect())
    assert got == brute.near(corpus(), k, percent)
    assert neardup.near_duplicates(empty, k, percent).count() == 0


def test_near_duplicates_without_a_common_centre(spark):
    """A chain of small steps, and copies that are near the base but not near one another."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows, w = [], list(base)
    for i in range(12):
        rows.append((100 + i, " ".join(w)))
        for at in rng.sample(range(150), 3):
            w[at] = f"c{i}x{at}"
    for i in range(25):
        w = list(base)
        for at in rng.sample(range(150), 4):
            w[at] = f"d{i}x{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, DOC).repartition(4)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()) == brute.near(rows, 3, 85)


def test_near_duplicates_that_share_edits(spark):
    """Copies about the threshold from their base, some with the same edits, so that they have in common what a leader lacks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    places = rng.sample(range(0, 120, 4), 12)
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(places, rng.randrange(2, 6)):
            w[at] = f"s{at}x{rng.randrange(2)}"
        for at in rng.sample(range(120), rng.randrange(3)):
            w[at] = f"o{i}x{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, DOC).repartition(4)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()) == brute.near(rows, 3, 85)


def test_near_duplicates_ids(spark):
    t = " ".join(VOCAB[:20])
    df = spark.createDataFrame([(3, t), (3, t), (5, t), (None, t), (None, None)], DOC)
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(3, 18, 3, True), (3, 18, 3, True), (5, 18, 3, False), (None, 18, None, True), (None, 0, None, True)], key=str)


def thue_morse(n):
    """Two words of a and b whose difference cancels in every polynomial modulo a power of two."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 256, 2048])
def test_structured_words_have_their_own_fingerprints(n):
    import pyarrow as pa

    data, off = wordhash.text_buffers(pa.array(thue_morse(n)))
    for seed in (0, 1, 2):
        assert len(set(wordhash.word_hashes(data, off[:-1], off[1:], seed).tolist())) == 2


def test_structured_words_are_no_duplicates(spark):
    a, b = thue_morse(2048)
    df = spark.createDataFrame([(1, a), (2, b), (3, " ".join([a] * 13)), (4, " ".join([b] * 13))], DOC)
    assert neardup.near_duplicates(df, 3, 85).where("not kept").count() == 0
    assert substrings.deduplicate(df).where("_n_removed > 0").count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 80)
    df = spark.createDataFrame([(1, a, "p"), (1, b, "q"), (3, b + " tail", "r"), (4, a + " tail", "s"), (5, a, "t"), (5, a, "t"), (6, prose(rng, 50), "u"), (None, a, "v")], DOC + ", score string")
    for n in (1, 5):
        got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df.repartition(n), 3, 85).collect()}
        assert got == {(1, 1), (3, 1), (4, 1), (5, 1), (6, 6), (None, None)}
        left = sorted(neardup.survivors(df.repartition(n), 3, 85).collect(), key=str)
        assert len(left) == 3 and {r["doc_id"] for r in left} == {1, 6, None} and {r["score"] for r in left if r["doc_id"] == 1} <= {"p", "q"}


def test_pairs_of_a_large_group_are_not_all_made(spark):
    """Copies apart from one another and from their leader meet by their cells, not one by one."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(200), 4 if i % 3 else 12):
            w[at] = f"d{i}x{at}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC).repartition(5), 3, 85).collect())
    assert got == brute.near(rows, 3, 85)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (7, 7), (200, 101)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_of_few_edges_take_no_round(spark, monkeypatch, seed):
    """A chain and a graph at random: one block holds them; where blocks are small, rounds of stars join what these find."""
    rng, rounds, star, root = random.Random(seed), [], components._star, {}
    names = rng.sample(range(-5000, 5000), 400)
    edges = list(zip(names[:80], names[1:80], strict=False)) + [tuple(rng.choices(names[100:], k=2)) for _ in range(170)]

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b) if a != b else top(a)
        root[max(a, b)] = min(a, b)
    want = sorted((x, top(x)) for x in {x for a, b in edges if a != b for x in (a, b)})
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    monkeypatch.setattr(components, "_star", lambda e, large: (rounds.append(large), star(e, large))[1])
    assert sorted(tuple(r) for r in components.components(df).collect()) == want
    assert not rounds
    monkeypatch.setattr(components, "BLOCK", 40)
    assert sorted(tuple(r) for r in components.components(df).collect()) == want
    assert rounds


def test_plans_of_near_duplicates_are_of_bounded_size(spark, monkeypatch):
    """The driver holds a plan, and posts all of it after each of its stages: what it needs follows the largest one."""
    largest, plain = [], neardup.stored

    def seen(df, name):
        largest.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return plain(df, name)

    monkeypatch.setattr(neardup, "stored", seen)
    monkeypatch.setattr(components, "stored", seen)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(200), 4 if i % 3 else 12):
            w[at] = f"d{i}x{at}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC).repartition(5), 3, 85).collect())
    assert got == brute.near(rows, 3, 85)
    assert max(largest) <= 24, largest


# --- extra columns, long texts


def test_odd_columns_pass_and_long_texts_are_whole(spark):
    """Columns named as an operator's own, a struct with an odd field, repeated rows, and a text of megabytes."""
    rng = random.Random(3)
    long = prose(rng, 400_000)
    rows = [(1, long), (2, "head " + long), (2, "head " + long), (3, None), (4, ""), (5, prose(rng, 100))]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in ("_key", "_have", "_owned", "_cell", "keys", "ends", "have", "rest", "key_id", "print", "my col")}).withColumn("s", F.struct(F.lit(1).alias("a b")))
    odd = [c for c in df.columns if c not in ("doc_id", "text")]
    t = library_tokens()
    out = bpe.encode(df, wanted=("n_tokens",))
    assert out.columns == ["doc_id", *odd, "n_tokens"]
    assert sorted((r["doc_id"], r["n_tokens"], r["my col"], r["s"]["a b"]) for r in out.collect()) == sorted((i, len(t.encode(x or "", add_special_tokens=False).ids), "x", 1) for i, x in rows)
    n = len(long.split())
    out = substrings.deduplicate(df)
    assert out.columns == [*df.columns, "_n_words", "_n_removed", "_kept"]
    assert sorted((r["doc_id"], r["_n_words"], r["_n_removed"]) for r in out.collect()) == [(1, n, 0), (2, n + 1, n), (2, n + 1, n), (3, 0, 0), (4, 0, 0), (5, 100, 0)]
    assert sorted(r["doc_id"] for r in neardup.survivors(df).collect()) == [1, 3, 4, 5]
    assert tokencount.count_tokens(df).columns == ["doc_id", *odd, "n_tokens"]
    scores = toxicity.score(df, spark.createDataFrame([(5, 1)], "doc_id long, toxic int"))
    assert scores.columns == ["doc_id", *odd, "score"] and scores.where("doc_id = 2").select("score").distinct().count() == 1
