import zlib
from collections import Counter
from itertools import groupby

import numpy as np

from sparkwright.llm import language_id as li

from .helpers import documents, empty, frame


def test_predicts_held_out_and_awkward_texts(spark):
    rows = [r for s in range(6) for r in documents(s)]
    rows = [(None if r[0] is None else r[0] + 1000 * (k // 90), *r[1:]) for k, r in enumerate(rows)]
    got = li.language_id(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add((r[1], r[2]))
    right = total = 0
    for g in got:
        assert 0 <= g["score"] <= 1
        own = texts[g["doc_id"]]
        if len(own) == 1:
            text, lang = next(iter(own))
            if not text or not any(c.isalpha() for c in text):
                assert (g["lang_pred"], g["score"]) == ("und", 0)
            elif g["held_out"] and lang and len(text) > 60 and "xxxx" not in text:
                total += 1
                right += g["lang_pred"] == lang
    assert total > 20 and right >= 0.95 * total, (right, total)


def slow_grams(text):
    """A text's letter 4-grams, from its characters one by one."""
    signs = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    line = "".join(k if k != " " else " " for k, run in ((k, list(r)) for k, r in groupby(signs, key=lambda c: c)) for k in ([" "] if k == " " else run))
    return [line[i : i + 4] for i in range(len(line) - 3)]


def test_against_exact_gram_sets(spark):
    """The same decision from whole sets of n-grams instead of filters."""
    rows = [r for s in range(4) for r in documents(s)]
    rows = [(None if r[0] is None else r[0] + 1000 * (k // 90), *r[1:]) for k, r in enumerate(rows)]
    counts = {}
    for doc_id, text, lang, _ in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slow_grams(text))
    langs = {lang: {g for g, n in c.items() if n >= li.SHARE * sum(c.values())} for lang, c in counts.items()}
    want = {}
    for doc_id, text, *_ in rows:
        if text and any(c.isalpha() for c in text):
            g = slow_grams(text)
            shares = {lang: sum(x in of for x in g) / max(1, len(g)) for lang, of in langs.items()}
            want.setdefault((doc_id, text), (max(sorted(shares), key=shares.get), max(shares.values()), sorted(shares.values())))
        else:
            want[doc_id, text] = ("und", 0.0, [0.0, 0.0])
    model = li.learn(frame(spark, rows).filter(~li.held_out(li.F.col("doc_id"))).select("text", "lang"))
    got = li.predict(frame(spark, rows), model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score, every = want[r["doc_id"], r["text"]]
        near = 0.02 + 2 / max(1, len(slow_grams(r["text"] or "")))  # a short text's filters may be wrong once or twice
        assert abs(r["score"] - score) < near, (r["text"][:80], r["score"], score)
        assert r["lang_pred"] == lang or every[-1] - every[-2] < near


def test_filter_finds_all_languages_of_a_gram_and_corrects_mistakes():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    masks = rng.integers(1, 16, (3000, 1), dtype=np.uint64)
    f = li.Filter(["a", "b", "c", "d"], h, masks)
    counts = f.counts(np.arange(3000), h, 3000)
    assert all(counts[i, k] == 1 for i in range(3000) for k in range(4) if masks[i, 0] >> np.uint64(k) & np.uint64(1))
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    scores = f.scores(f.counts(np.zeros(20000, int), other, 1), np.array([20000]))
    assert (scores < 0.01).all()


def test_many_languages_and_long_texts():
    langs = [f"l{k:03d}" for k in range(130)]
    h = np.arange(1, 131, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    masks = np.zeros((130, 3), np.uint64)
    for k in range(130):
        masks[k, k // 64] = np.uint64(1) << np.uint64(k % 64)
    f = li.Filter(langs, h, masks)
    assert (f.counts(np.arange(130), h, 130).argmax(axis=1) == np.arange(130)).all()


def own_grams(texts, block):
    """Hashes of each text's n-grams, as ``grams`` gives them."""
    out = [[] for _ in texts]
    for i, n, _, owner, h in li.grams(texts, block):
        for k in range(n):
            out[i + k] += h[owner == k].tolist()
    return out


def test_grams_are_a_texts_own_alone_in_any_batch_and_at_any_length():
    texts = ["cd", "a", "zz", "the", "ab", "", None, ".", "..x", "End.", " two  words ", "äb cd, efg " * 40, "x" * 90, "İi" * 30, "12 34", "q,", "\n\n"]
    code = lambda g: li.windows(np.array([0 if c == " " else ord(c) for c in g], np.uint32)).tolist()
    want = [[h for g in slow_grams(t or "") for h in code(g)] for t in texts]
    assert len(want[0]) == 1 and not want[1]
    for block in (1, 2, 3, 5, 64, 1 << 19):
        assert own_grams(texts, block) == want
        assert own_grams(texts[::-1], block) == want[::-1]
    for t, w in zip(texts, want, strict=True):
        assert own_grams([t], 7) == [w] and own_grams(["ab", t, "ab"], 1 << 19)[1] == w


def test_scores_do_not_depend_on_partitions(spark):
    df = frame(spark, [r for s in range(3) for r in documents(s)])
    once, again = (sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in li.language_id(df.repartition(n)).collect()), key=str) for n in (1, 7))
    assert once == again


def test_empty_and_nothing_learned(spark):
    assert li.language_id(empty(spark)).count() == 0
    rows = [(1, "some words", None, "s"), (2, None, None, None)]
    assert {(r["doc_id"], r["lang_pred"]) for r in li.language_id(frame(spark, rows)).collect()} == {(1, "und"), (2, "und")}
    df = frame(spark, rows)
    assert sorted(map(str, li.recognised(df, 0.2).collect())) == sorted(map(str, df.collect()))
