"""Collocations, vector codes and language identification against plain restatements."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from plumbline.llm import languages, phrases, vectors
from plumbline.llm.perfect_hash import PerfectHash, block_of, build
from plumbline.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_vector_codes"])
def test_sql(spark, name):
    same_rows(QUERIES[name](spark, DATA), ORACLE[name])


# perfect hashes


@pytest.mark.parametrize("width", [1, 2])
def test_perfect_hash(width):
    rng = np.random.default_rng(width)
    keys = np.unique(rng.integers(0, 1 << 63, (5000, width), dtype=np.uint64), axis=0)
    keys[:, 0] &= np.uint64((1 << 40) - 1) if width == 2 else np.uint64((1 << 63) - 1)
    blocks, rows = 9, []
    for i in range(blocks):
        own = keys[block_of(keys, blocks) == i]
        sizes, bits, order = build(own)
        rows.append((i, sizes, bits, own[order].tobytes()))
    h = PerfectHash(rows, blocks, width)
    slots = h.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (h.keys[slots] == keys).all()
    other = rng.integers(0, 1 << 63, (5000, width), dtype=np.uint64)
    assert (h.slots(other) == -1).all()  # the stored keys tell
    part = PerfectHash(rows[3:6], blocks, width, first=70)
    assert (part.slots(keys) >= 0).sum() == len(part) and part.first == 70
    assert (PerfectHash([], blocks, width).slots(keys) == -1).all() and build(keys[:0])[2].size == 0
    with pytest.raises(ValueError, match="twice"):
        build(np.concatenate([keys[:1], keys[:1]]))


# phrases


def plain_phrases(docs, longest, least, most, percent=50):
    counts, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, g), a in found.items():
        if any(100 * b >= percent * a and len(o) > len(g) and any(o[i : i + len(g)] == g for i in range(len(o))) for (x, o), b in found.items() if x == lang):
            continue
        score, k = min((1_000_000 * a * a // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    rows = []
    for lang, own in out.items():
        rows += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:most], 1)]
    return sorted(rows)


def phrase_docs(n=120, seed=4):
    rng, words = random.Random(seed), ["a", "B", "the", "Thé", "of", "x\x00y", "naïve", "A", "on", " ", "z"]
    docs = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und", "en"])) for _ in range(n)]
    return docs + [(None, "en"), ("", None), (" . ", "fr"), docs[0], docs[0]]


@pytest.mark.parametrize("longest,settings", [(3, {}), (4, {}), (2, {}), (3, {"pass_keys": 5, "block_pairs": 300})])
def test_phrases_by_brute_force(spark, longest, settings):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "text string, lang string").withColumns({"id": F.lit(1), "ids": F.lit("x"), "f": F.lit(2)})
    got = phrases.Phrases(spark, df.repartition(3), longest=longest, least=4, **settings).best(30)
    want = plain_phrases(docs, longest, 4, 30)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_phrases_of_little_and_of_much(spark, monkeypatch):
    empty = spark.createDataFrame([], "text string, lang string")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for df in (empty, spark.createDataFrame([(None, None), ("once only", "en")], "text string, lang string")):
        out = phrases.Phrases(spark, df).best(5)
        assert out.columns == columns and out.count() == 0
    monkeypatch.setattr(phrases, "SLICE", 50)  # a long text goes slice by slice
    text = " ".join(random.Random(1).choice("abcd") + "w" * 30 for _ in range(3000)) + ". end"
    assert sum(len(ws) for ws in phrases.pieces(text.encode())) == 3002
    assert b" ".join(w for ws in phrases.pieces(text.encode()) for w in ws) == text.replace(".", " .").encode()


def test_counts_pass_64_bits(spark):
    """a * a * 1,000,000 over l * r in exact arithmetic."""
    p = phrases.Phrases.__new__(phrases.Phrases)
    big = 3_000_000_007
    rows = [(0, "en", ["a", "b"], big, [big + 5, big], [big + 9, big], None, None)]
    level = spark.createDataFrame(rows, "id int, lang string, words array<string>, f long, heads array<long>, tails array<long>, left int, right int")
    p.levels, p.work = [level, level], None
    assert p.scored().first()["score"] == 1_000_000 * big * big // ((big + 5) * (big + 9))


# codes


def plain_codes(rows, parts, entries, rounds, scale):
    vs = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = next((len(v) for _, _, v in sorted(vs, key=lambda r: (r[0] is None, r[0] or 0, r[2])) if v and len(v) % parts == 0), 0)
    own = sorted((r for r in vs if len(r[2]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = dim // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, _, v in own]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        at = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (i, label, _), c in zip(own, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest(), [r for r in vs if len(r[2]) != dim]


@pytest.mark.parametrize("scale", [64, 200_000_000])
def test_codes_by_brute_force(spark, scale):
    rng = random.Random(9)
    # few different values, so that distances tie and entries stay unused; repeated rows, nulls, odd lengths and clashing columns
    rows = [(i, [rng.randrange(-4, 5) / 8 + rng.choice([0, 0.01]) for _ in range(8)], rng.choice([None, 0, 1, 2])) for i in range(90)]
    rows += [rows[5], rows[5], (200, None, 1), (201, [0.1] * 7 + [None], 1), (202, [float("nan")] * 8, 1), (203, [float("-inf")] + [0.0] * 7, None), (None, [0.25] * 8, None), (204, [1.0] * 4, 0), (205, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rid": F.lit(7), "q": F.lit("x"), "n": F.lit(0)}).repartition(3)
    codes = vectors.Codes(spark, df, parts=4, entries=6, rounds=5, scale=scale)
    want, digest, others = plain_codes(rows, 4, 6, 5, scale)
    got = codes.with_label_errors().collect()
    assert codes.digest() == digest and len(others) == 2
    assert sorted((repr(tuple(r)[:4]) for r in got)) == sorted([repr(x) for x in want] + [repr((i, label, None, None)) for i, label, _ in others])
    sums = Counter()
    for _, label, _, e in want:
        sums[label] += e
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    # contributions get fewer: only changed parts are counted again
    assert codes.moved[0] > codes.moved[1] and len(codes.moved) <= 5


def test_codes_of_few_and_of_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none = vectors.Codes(spark, spark.createDataFrame([], kind))
    assert none.with_label_errors().count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()
    one = vectors.Codes(spark, spark.createDataFrame([(3, [0.5] * 16, None)], kind))
    assert [tuple(r) for r in one.with_label_errors().collect()] == [(3, None, "00" * 8, 0, 0)] and one.books.shape == (8, 1, 2)
    with pytest.raises(Exception, match="too large"):
        vectors.Codes(spark, spark.createDataFrame([(1, [1e9] * 8, 0)], kind))


def test_rounds_join_without_a_shuffle(spark):
    from plumbline.llm.common import Work

    kept = vectors.Bucketed(Work(spark, "t"), 4)
    a, b = (kept.save(spark.range(100).withColumnRenamed("id", "rid").repartition(4, "rid"), x) for x in "ab")
    plan = a.join(b.hint("shuffle_hash"), "rid")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    kept.drop(a, b)
    assert not kept.tables


# languages


@pytest.fixture(scope="module")
def vocabulary():
    return languages.read_vocabulary()


def all_segmentations(word, known, probs):
    """The sum over all segmentations, each written out."""
    if not word:
        return 1.0
    return sum(probs[known[word[:n]]] * all_segmentations(word[n:], known, probs) for n in range(1, len(word) + 1) if word[:n] in known)


def test_forward_sums_all_segmentations(vocabulary):
    rng = np.random.default_rng(2)
    probs = rng.random((len(vocabulary.pieces), 3))
    probs /= probs.sum(0)
    known = {p: i for i, p in enumerate(vocabulary.pieces)}
    words = [languages._bytes(w) for w in ("a", "the", "tionheed", "naïveté", "привет", "of", "的", "x" * 9)]
    want = np.log([[all_segmentations(w, known, probs[:, k]) for k in range(3)] for w in words])
    assert np.abs(languages.scores(words, vocabulary, probs) - want).max() < 1e-9
    assert np.abs([languages.long_forward(w, vocabulary, probs) for w in words] - want).max() < 1e-9
    for part, matrix in languages.by_length(words):
        assert np.abs(languages.forward(matrix, vocabulary, probs) - want[part]).max() < 1e-9
    long = [languages._bytes("ab" * n) for n in (14, 15, 40, 2047, 2048, 2100)]  # across all ways of scoring
    got = languages.scores(long, vocabulary, probs)
    assert np.abs(got - [languages.long_forward(w, vocabulary, probs) for w in long]).max() < 1e-6 and np.isfinite(got).all()


def test_expected_uses(vocabulary):
    probs = np.random.default_rng(3).random((len(vocabulary.pieces), 2))
    probs /= probs.sum(0)
    word, known = languages._bytes("tion"), {p: i for i, p in enumerate(vocabulary.pieces)}

    def ways(w):
        return [[]] if not w else [[known[w[:n]], *rest] for n in range(1, len(w) + 1) if w[:n] in known for rest in ways(w[n:])]

    want, total = np.zeros_like(probs), np.zeros(2)
    for way in ways(word):
        p = probs[way].prod(0)
        total += p
        for i in way:
            want[i] += p
    got = languages.expected(np.frombuffer(word, np.uint8).reshape(1, -1), np.array([[3.0, 0.5]]), vocabulary, probs)
    assert np.abs(got - want / total * [3.0, 0.5]).max() < 1e-9


def test_held_out_languages(spark):
    out = QUERIES["op13_language_id"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").alias("h"))
    rows = out.join(docs, "doc_id").collect()
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == docs.count() == out.count()
    assert all(r["held_out"] == r["h"] and 0 <= r["score"] <= 1 for r in rows)
    own = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and r["lang"]]
    assert len(own) > 30 and sum(own) >= 0.98 * len(own)


def test_odd_texts(spark):
    train = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)] + [(99, None, "fr"), (98, "sans langue", None)]
    model = languages.learn(spark, spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"] and abs(model.probs.sum(0) - 1).max() < 1e-3
    texts = [None, "", "12 ... 34", "\n", "the dog", "und die", "THE " * 60_000, "x" * 9000, "the 😀 é́ \x00 cat"]
    docs = spark.createDataFrame([(i, t, "zz", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in languages.predict(docs, model, most_words=3).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["und"] * 4 + ["en", "de", "en"] and [got[i]["score"] for i in range(4)] == [0.0] * 4
    assert all(got[i]["lang_pred"] in model.langs for i in (7, 8)) and got[4]["lang"] == "zz" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = languages.learn(spark, spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in languages.predict(docs, nothing).collect()} == {"und"}
    assert languages.predict(docs.limit(0), model).count() == 0
    # at most max_rows teach, at least half as many
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("en").alias("lang"))
    z = many.select(languages.zero_bits(F.xxhash64("doc_id", "text")).alias("z")).groupBy("z").count().collect()
    assert sum(r["count"] for r in z) == 3000 and 1300 < sum(r["count"] for r in z if r["z"] == 0) < 1700
