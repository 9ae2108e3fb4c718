"""Token files, resampling and spelling variants on small inputs, and quality's threshold for any layout."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoscope.llm import quality, resample, spelling, tokenfiles
from tests.llm import brute
from tests.llm.test_operators import DOC, VOCAB, corpus

LONG = " ".join(f"word{i % 977}x" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def odd(spark):
    """Rows that repeat, ids and texts that are null, a very long text, and columns of names that operators use."""
    rows = [(5, "one two three " * 10), (5, "one two three " * 10), (5, "other words here"), (None, "no id at all, none"), (None, None), (9, None), (7, ""), (8, LONG)]
    d = spark.createDataFrame(rows, DOC)
    for c in ("tie", "cell", "score", "rank", "n_tokens", "word", "_id", "_run", "weight", "part", "n_words", "_ws", "_good", "_rest"):
        d = d.withColumn(c, F.lit("x"))
    return rows, d


# --- 11 token files


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_packed_ids_come_back(width, ids):
    ids = np.array([i & ((1 << width) - 1) for i in ids], "<u4")
    data = tokenfiles.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8) and tokenfiles.unpack(data, width, len(ids)).tolist() == ids.tolist()


def test_width_is_the_least():
    assert [tokenfiles.width_of(n) for n in (1, 2, 3, 4, 5, 50_257, 1 << 16, (1 << 16) + 1)] == [1, 1, 2, 2, 3, 16, 16, 17]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))


SPACES = ["  two  spaces ", " lead", "tail ", "a \n b\n\n c", "　wide 　 x", "x  y", "a\x1c b \x1f c", "\x85 z", "<|endoftext|> a<|endoftext|>b", " <|endoftext|> <|endoftext", "it's we'LL 'd x'", "﻿ a", "tab\t tab", "a​ b", "日本 語", "é ́x", "\x00 \x00"]


def test_encoder_gives_what_the_library_gives():
    import public_tokenizers

    rng, t = random.Random(2), library()
    texts = [x for _, x in corpus() if x is not None] + SPACES + ["".join(rng.choice(["a", " ", "\n", "é", ".", " ", "1", "'s", "\x1d", "<|endoftext|>"]) for _ in range(rng.randrange(40))) for _ in range(600)] + [LONG]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for together in (50, 1 << 22):
        old, tokenfiles.TOGETHER = tokenfiles.TOGETHER, together
        got = [g.tolist() for g in tokenfiles.encoded(pa.array(texts).slice(0), public_tokenizers.path(tokenfiles.TOKENIZER))]
        tokenfiles.TOGETHER = old
        assert got == want


def test_encoder_forgets_and_still_agrees(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenfiles, "CACHED", 3)
    e = tokenfiles.Encoder(public_tokenizers.path(tokenfiles.TOKENIZER))
    texts = [x for _, x in corpus() if x]
    for _ in range(3):
        assert [g.tolist() for g in e.encode(pa.array(texts))] == [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e = tokenfiles.Encoder(path)
    assert not e.parts and e.encode(pa.array(["Ab  c"]))[0].tolist() == Tokenizer.from_file(path).encode("Ab  c", add_special_tokens=False).ids


def plain_tokens(rows):
    t, at, out = library(), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_contract(spark, docs, monkeypatch):
    assert [tuple(r) for r in tokenfiles.digest(docs).orderBy("doc_id").collect()] == plain_tokens(corpus())


def test_token_files_in_small_pieces(spark, docs, tmp_path, monkeypatch):
    """Many blocks, stretches and files: all of them are read back, in whole and from any place."""
    for name, n in (("BLOCK", 64), ("STRETCH", 500), ("FILE", 3000), ("DOCUMENTS", 40)):
        monkeypatch.setattr(tokenfiles, name, n)
    import public_tokenizers

    rows = sorted(corpus())
    keys, texts = [i for i, _ in rows], pa.array([t for _, t in rows])
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), texts], ["doc_id", "text"])
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 0})()))
    (made,) = tokenfiles._write(f"file://{tmp_path}", public_tokenizers.path(tokenfiles.TOKENIZER), 17, 2)([batch])
    manifest = spark.createDataFrame(made.to_pandas(), tokenfiles.MANIFEST)
    monkeypatch.undo()
    assert manifest.count() > 5 and manifest.select("path").distinct().count() > 1 and manifest.groupBy("path").agg(F.sum("docs").alias("n")).agg(F.max("n")).first()[0] <= 40
    got = tokenfiles.read(manifest).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == plain_tokens(corpus())
    stream = [x for r in got for x in r["ids"]]
    rng = random.Random(1)
    starts = {r["path"]: r["start"] for r in tokenfiles.placed(manifest).where("seq >= 0 and doc = 0").collect()}
    for path, base in starts.items():
        f = tokenfiles.TokenFile(path)
        assert f.width == 17 and f.block == 64
        for _ in range(50):
            a = rng.randint(0, f.n)
            z = rng.randint(a, f.n)
            assert f.ids(a, z).tolist() == stream[base + a : base + z]
        assert f.document(0)[-1] == 2
        with pytest.raises(IndexError):
            f.ids(0, f.n + 1)
        f.close()


def test_token_files_edges(spark, empty):
    rows, d = odd(spark)
    got = sorted((tuple(r) for r in tokenfiles.digest(d).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    t = library()
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows)
    assert Counter((r[0], r[2]) for r in got) == want and [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert tokenfiles.digest(empty).count() == 0 == tokenfiles.digest(empty.withColumn("start", F.lit(1))).count()


def test_token_files_bits_too_few(tmp_path):
    with pytest.raises(Exception, match="needs more than"):
        import public_tokenizers

        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["hello strange words"])], ["doc_id", "text"])
        from unittest.mock import patch

        from pyspark import TaskContext

        with patch.object(TaskContext, "get", return_value=type("C", (), {"partitionId": lambda self: 0})()):
            list(tokenfiles._write(f"file://{tmp_path}", public_tokenizers.path(tokenfiles.TOKENIZER), 5, 2)([batch]))


# --- 12 resampling


def plain_resample(rows, target, buckets=10_000, seed=7, percent=25):
    def features(t):
        w = brute.ALNUM.findall((t or "").translate(brute.LOWER))
        return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *features(x)) for i, x in rows]
    s, t = Counter(bucket(f) for _, _, fs in each for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for i, w, fs in each:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


TARGET = ["Ba la de no.", "re ta x, " * 20, None, ""]


def resampled(df, target):
    return sorted((tuple(r) for r in resample.digest(df, target).collect()), key=str)


def test_resampling_contract(spark, docs):
    target = spark.createDataFrame([(str(k), t) for k, t in enumerate([*TARGET, *VOCAB])], "item_id string, text string")
    want = plain_resample(corpus(), [*TARGET, *VOCAB])
    assert resampled(docs, target) == want and any(r[4] == 1 for r in want)


def test_resampling_in_small_cells(spark, docs, monkeypatch):
    monkeypatch.setattr(resample, "CELL", 500)
    target = spark.createDataFrame([(1, t) for t in TARGET], "item_id int, text string")
    assert resampled(docs, target) == plain_resample(corpus(), TARGET)


def test_resampling_edges(spark, empty, docs):
    rows, d = odd(spark)
    none = spark.createDataFrame([], "text string")
    target = spark.createDataFrame([("one two",)], "text string").withColumn("cell", F.lit(1)).withColumn("a b", F.create_map(F.lit(1), F.lit(2)))
    assert resampled(d, target) == plain_resample(rows, ["one two"])
    assert resampled(docs, none) == plain_resample(corpus(), [])
    assert resample.digest(empty, target).count() == 0
    blank = [(1, None), (2, ""), (3, " .,; ")]
    assert resampled(spark.createDataFrame(blank, DOC), target) == plain_resample(blank, ["one two"])


def test_ranks_of_equal_scores(spark):
    rng = random.Random(3)
    rows = [(i, 30 if rng.random() < 0.9 else 5, i % 4, 0, rng.choice([-700, -1, 0, 1, 255, 256, 9000])) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    want = {r[0]: k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    assert {r["doc_id"]: r["rank"] for r in resample.ranked(d).collect()} == {r[0]: want.get(r[0]) for r in rows}


def test_grams_of_three(spark):
    c = resample.Cell(pa.array(["a b c a b c", None, "c a"]), 3, 4)
    got = dict(zip(c.strings.to_pylist(), c.counts.tolist()))
    assert got == {b"a": 3, b"b": 2, b"c": 3, b"a b": 2, b"b c": 2, b"c a": 2, b"a b c": 2, b"b c a": 1, b"c a b": 1}


# --- 13 spelling variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, slips=199):
    import re

    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def misspelt(seed):
    rng, rows = random.Random(seed), []
    base = ["running", "Walking", "étendue", "aaaaaaa", "abababab", "ÿøÿøÿøÿ", "international", "straße"]
    letters = "abéÿx"

    def slip(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])

    for b in base:
        rows += [b] * 800 + [v for v in (slip(b) for _ in range(25)) for _ in range(rng.choice([4, 5, 6, 30]))] + [slip(slip(b)) for _ in range(3)] * 5
    rng.shuffle(rows)
    return [(k, " ".join(rows[k * 40 : k * 40 + 40])) for k in range(len(rows) // 40 + 1)]


def test_automata_number_their_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("c") is None and a.number("") is None
    assert len(a.edges) < sum(map(len, words)) / 2  # equal ends are shared
    for w in words + ["".join(rng.choice("abc") for _ in range(6)) for _ in range(50)]:
        for cut in range(len(w) + 1):
            got = {words[k] for k in a.one_error(w[:cut], w[cut:])}
            assert got == {v for v in words if v.startswith(w[:cut]) and one_apart(w[cut:], v[cut:])}
    assert spelling.Automaton([]).number("") is None and spelling.Automaton([""]).number("") == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_contract(spark, seed):
    rows = misspelt(seed)
    want = plain_variants(plain_words(rows))
    assert sum(1 for r in want if r[1]) > 20
    d = spark.createDataFrame(rows, DOC).repartition(4)
    assert sorted(map(tuple, spelling.digest(d).collect()), key=lambda r: r[0]) == want


def test_spelling_of_slips(spark):
    rows = misspelt(3)
    for slips in (0, 2):
        got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, DOC), slips).collect()}
        assert got == plain_words(rows, slips)


def test_words_that_share_a_half_in_blocks(spark):
    """Small blocks and few shards give the pairs of one automaton, each once."""
    rng = random.Random(7)
    n = {p + "".join(rng.choice("abc") for _ in range(rng.randint(3, 4))): rng.randint(5, 99) for p in ("aaa", "baa", "aab") for _ in range(60)}
    d = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((w, v) for w in n for v in n if one_apart(w, v))
    for block, shard in ((100_000, 20_000), (7, 50), (3, 10_000)):
        assert sorted(map(tuple, spelling.pairs(d, block, shard).collect())) == want
        got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.nearest(d, block, shard).collect()}
        assert got == {r[0]: (r[4], n[b], b) for r in plain_variants(n) if (b := min((v for w, v in want if w == r[0]), key=lambda v: (-n[v], v), default=None))}


def test_long_chains_of_forms(spark):
    chain = ["a" * (6 + k) for k in range(9)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string"), 9).collect()}
    assert got == dict.fromkeys(chain[:-1], chain[-1])
    rows = [(k, f"{w} " * 5 ** (k + 1)) for k, w in enumerate(["straßen", "straßeen", "straßeeen", "straßeeeen"])]
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, DOC), slips=0).collect()))
    assert [(r[1], r[2]) for r in got if r[0] == "straßen"] == [("straßeen", "straßeeeen")]


def test_of_near_words_as_frequent_the_first_in_code_point_order(spark):
    """A word that begins another comes before it, whether both are found in one automaton or in two."""
    n = {"abcdefg": 5, "abcdef": 50, "abcdefz": 50, "abcdefgh": 50, "zzzzzza": 5, "zzzzzz": 40, "zzzzzzaa": 40, "ÿéøabcd": 6, "ÿéøabc": 30, "ÿéøabce": 30}
    rows = [(k, f"{w} " * c) for k, (w, c) in enumerate(n.items())]
    want = plain_variants(n)
    assert {r[0]: r[1] for r in want if r[1]} == {"abcdefg": "abcdef", "zzzzzza": "zzzzzz", "ÿéøabcd": "ÿéøabc"}
    got = spelling.variants(spark.createDataFrame(rows, DOC), slips=0).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    for block, shard in ((100_000, 20_000), (1, 5)):
        assert {r["word"]: r["best"] for r in spelling.nearest(words, block, shard).collect()} == {w: min((v for v in n if one_apart(w, v)), key=lambda v: (-n[v], v)) for w in n}


def test_spelling_edges(spark, empty):
    rows, d = odd(spark)
    more = rows + [(None, "Nothing nothing nothing NOTHING nothing")] * 2
    d = d.select("doc_id", "text").unionByName(spark.createDataFrame(more[-2:], DOC)).withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    assert sorted(map(tuple, spelling.digest(d).collect()), key=lambda r: r[0]) == plain_variants(plain_words(more))
    assert spelling.digest(empty).count() == 0 == spelling.digest(empty.withColumn("form", F.lit(1))).count()


# --- 5 quality


def test_threshold_is_the_same_for_any_layout(spark):
    rng = random.Random(9)
    rows = [(i, rng.gauss(0.2 if i % 3 else -0.6, 0.2), False) for i in range(120_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120_000)], "doc_id long, quality int")
    scores = spark.createDataFrame(rows, "doc_id long, _held double, base_failed boolean")
    got = {quality.parting(scores.repartition(k), labels).first()[0] for k in (1, 7, 40)}
    assert len(got) == 1
    low = sorted(s for i, s, _ in rows if i % 3)[int(80_000 * 0.01) - 1]
    high = sorted(s for i, s, _ in rows if not i % 3)[int(40_000 * 0.99) - 1]
    assert abs(got.pop() - (low if high >= low else (low + high) / 2)) < 2 / quality.STEPS


def test_judge_takes_any_column_name(spark):
    rows, d = odd(spark)
    labels = spark.createDataFrame([(8, 1)], "doc_id long, quality int")
    out = quality.judge(d, labels)
    assert set(out.columns) == set(d.columns) | set(quality.ADDED) and out.select("_ws", "_good", "_rest", "tie").distinct().collect() == [("x", "x", "x", "x")]
    assert sorted(map(str, (r["n_words"] for r in out.collect()))) == sorted(str(brute.quality(t)[0]) for _, t in rows)


def test_no_text_is_exchanged(spark):
    from conftest import SF

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    plan = quality.scored(d.select("doc_id", "text"), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


# --- 10 near duplicates


def test_words_of_one_fingerprint_are_two(spark):
    """Two words made to agree in the first fingerprint still count as two, and link nothing by it."""
    from chronoscope.llm import decontaminate, neardup, substrings, wordhash

    one, two = "abcdefghijklmnop", "jwzfsqpbre]}u\\5e"
    data, off = wordhash.text_buffers(pa.array([f"{one} {two}"]))
    start, end, _ = wordhash.word_bounds(data, off, "space")
    assert len(set(wordhash.word_hashes(data, start, end, 0, fold=True).tolist())) == 1 < len(set(wordhash.word_hashes(data, start, end, 1, fold=True).tolist()))
    tail = " ".join(f"t{k}" for k in range(12))
    rows = [(1, f"{one} p q {two} p q"), (2, f"{one} a b"), (3, f"{two} a b"), (4, f"{one} {tail}"), (5, f"{two} {tail}"), (6, f"{one} p q {two} p q")]
    d = spark.createDataFrame(rows, DOC)
    got = sorted(tuple(r) for r in neardup.digest(d).collect())
    assert got == brute.near(rows, 3, 85) and got[0][1] == 4
    assert {r["doc_id"]: r["n_removed"] for r in substrings.digest(d).collect()} == {i: gone for i, _, gone, _ in brute.substrings(rows)}
    bench = [("x", f"{one} {tail}"), ("y", "zz")]
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.digest(d, spark.createDataFrame(bench, "item_id string, text string")).collect()}
    assert hit == {i: h for i, _, h, _ in brute.hits(rows, bench)}


# --- 9 licenses


def test_each_license_counts_once(spark):
    from chronoscope.llm import licenses

    names = list(licenses.NOTICES)
    d = spark.createDataFrame([(k, f"Some words before. {licenses.NOTICES[n]} And some after.") for k, n in enumerate(names)], DOC)
    got = {names[r["doc_id"]]: (r["license_ids"], r["n_licenses"]) for r in licenses.digest(d, licenses.templates(spark)).collect()}
    assert got == {n: (licenses.LICENSE.get(n, n), 1) for n in names}
    found = licenses.by_license(licenses.scan(d, licenses.templates(spark)), licenses.templates(spark)).collect()
    longest = {names[r["doc_id"]]: r["template"] for r in found}
    assert longest["mit-text"] == "mit-text" and longest["bsd-2-clause-text"] == "bsd-2-clause-text"


# --- names, long texts and repeated rows of operators 1, 4 and 8


def test_columns_of_any_name_pass(spark):
    from chronoscope.llm import decontaminate, urlfilter

    rows, d = odd(spark)
    for c in ("_text", "_bits", "_items", "_n", "_kept", "items"):
        d = d.withColumn(c, F.lit("y"))
    bench = spark.createDataFrame([("a", "one two three one two three one two three one two three one"), ("b", "word7x")], "item_id string, text string")
    out = decontaminate.mark(d, bench)
    plain = brute.hits(rows, [tuple(r) for r in bench.collect()])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in out.collect()) == sorted((str(i), n, h) for i, n, h, _ in plain)
    assert out.select("_text", "_bits", "_kept", "tie").distinct().collect() == [("y", "y", "y", "x")] and set(d.columns) <= set(out.columns)
    pages = spark.createDataFrame([(1, "http://a.b.c/" + "x" * 100_000, "2024-01-31"), (1, "http://a.b.c/", "2024-02-01"), (1, "http://a.b.c/", "2024-02-01"), (2, None, None)], "page_id long, url string, fetched string")
    for c in ("_day", "_row", "_m", "_host", "_on", "host", "lists"):
        pages = pages.withColumn(c, F.lit("z"))
    entries = spark.createDataFrame([("l", "b.c", "2023-06-01", True), ("l", "b.c", "2024-02-01", False), ("m", "a.b.c", "2024-02-01", True)], "list string, domain string, since string, listed boolean")
    got = sorted((r["page_id"], str(r["fetched"]), r["lists"], r["n_active"], r["_day"], r["_m"]) for r in urlfilter.judge(pages, entries).collect())
    assert got == [(1, "2024-01-31", "l", 1, "z", "z"), (1, "2024-02-01", "m", 1, "z", "z"), (1, "2024-02-01", "m", 1, "z", "z"), (2, "None", "", 0, "z", "z")]
    assert urlfilter.judge(pages.where("false"), entries).count() == 0


def test_revisits_by_a_join_of_payloads(spark, monkeypatch):
    from chronoscope.llm import warc
    from tests.llm.test_operators import pages_table

    _, df = pages_table(spark)
    few = sorted(map(tuple, warc.digest(df).collect()), key=str)
    monkeypatch.setattr(warc, "REVISITS", 0)
    assert sorted(map(tuple, warc.digest(df.withColumn("sha1", F.lit(1))).collect()), key=str) == few


def test_a_cluster_needs_a_shared_folder():
    from chronoscope.llm import shared

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("X", (), {"master": "spark://host", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.shared_dir(Session, "x")


def test_the_last_stage_keeps_other_columns(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, d = odd(spark)
    d = d.drop("n_tokens")
    out = corpus_pipeline.tokens(spark, d, "")
    assert set(d.columns) - {"text"} <= set(out.columns) and out.select("tie", "cell", "_ws", "_rest").distinct().collect() == [("x", "x", "x", "x")]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert corpus_pipeline.tokens(spark, d.where("false"), "").count() == 0
