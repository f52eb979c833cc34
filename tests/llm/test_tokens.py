import io
import random
import zlib

import numpy as np
import pytest

from sparkwright.llm import token_counts as tc
from sparkwright.llm import token_planes as tp
from sparkwright.llm.pieces import PieceEncoder, load
from sparkwright.llm.queries import tokenizer_path

from .helpers import documents, empty, frame

ODD = ["", " ", "a", " a ", "a  b", "a \n b\n \nc", "x\n y", "<|endoftext|> hi<|endoftext|>", "a <|endoftext|>b", "　a b", "don't 's it'll x've", "a\t b c\x1c d", "é  ,,, ü!", "a \x85 b", "w" * 300, "12 345a b1", "Ünïcödé, wörds!!", "日本語 テキスト、です。", "word%%% other### end.", "a, b. c!", "\n\n a"]


def direct(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_are_what_the_library_gives():
    e = PieceEncoder(tokenizer_path(), keep=50)
    texts = ODD + [r[1] for r in documents() if r[1] and len(r[1]) < 4000]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == direct(e.tokenizer, t), t


@pytest.mark.parametrize("added", ["pad", "no.", "<|x|>"])
def test_added_tokens_are_found_as_by_the_library(tmp_path, added):
    t = load(tokenizer_path())
    t.add_special_tokens([added])
    t.save(str(tmp_path / "t.json"))
    e = PieceEncoder(str(tmp_path / "t.json"))
    assert e.cut == (added == "<|x|>")
    texts = ["my pad here", "padding no. no, nono.", "a <|x|> b<|x|>", "pad"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [direct(e.tokenizer, x) for x in texts]


def test_other_tokenizers_encode_whole_texts():
    e = PieceEncoder(tokenizer_path("word_bpe_49k.json"))
    assert not e.cut and all(np.frombuffer(e.encode_one(t), "<u4").tolist() == direct(e.tokenizer, t) for t in ODD)


def test_resynchronised_counts_and_widening():
    t = load(tokenizer_path())
    rng = random.Random(1)
    widened = []
    parts = ["word ", "don't ", "\n\n", "   ", "<|endoftext|>", "x" * 150, "éàü ", "12345 ", "!!! ", "\t", "日本語"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(10, 400)))
        for chunk, overlap in ((120, 20), (64, 40), (400, 60)):
            assert tc.resynchronised(t, text, chunk, overlap, widened.append) == len(direct(t, text))
    for text in ("y" * 3000, "a" * 500 + " " + "b" * 1500, " " * 900 + "x"):
        assert tc.resynchronised(t, text, 200, 32, widened.append) == len(direct(t, text))
    assert widened


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    import sentencepiece

    rows = [r for r in documents() if len(r[1] or "") < 200_000]
    path = tokenizer_path(name)
    if name.endswith(".model"):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda s: len(m.encode(s or ""))
    else:
        t = load(path)
        count = lambda s: len(direct(t, s))
    got = sorted(map(tuple, tc.token_counts(frame(spark, rows), path, chunk=5000).collect()), key=str)
    assert got == sorted(((r[0], len((r[1] or "").encode()), n := count(r[1]), n > 512) for r in rows), key=str)
    assert tc.token_counts(empty(spark), path).count() == 0


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_round_trip_of_a_shard(plane):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 2**32 if i % 3 else 60_000, int(n), dtype=np.uint32) for i, n in enumerate([0, 5, 64, 1000, 0, 63, 130])]
    b = io.BytesIO()
    w = tp.ShardWriter(b, plane, block=64)
    for i, d in enumerate(docs):
        w.add(i if i != 4 else None, d.astype("<u4").tobytes())
    assert w.close() == len(b.getvalue())
    source = type("S", (), {"size": lambda s: len(b.getvalue()), "seek": lambda s, x: b.seek(x), "read": lambda s, n: b.read(n)})()
    r = tp.ShardReader(source)
    at = 0
    for (doc_id, start, ids), d, i in zip(r.docs(), docs, range(99), strict=False):
        assert doc_id == (None if i == 4 else i) and start == at and (ids == d).all()
        at += len(d)
    every = np.concatenate(docs)
    assert (r.ids(10, 700) == every[10:700]).all() and len(r.ids(5, 5)) == 0


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_files(spark, plane):
    rows = documents()
    path = tokenizer_path()
    t = load(path)
    got = tp.token_planes(frame(spark, rows), path, plane=plane, block=1024).orderBy("start", "doc_id").collect()
    start, at = 0, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*direct(t, text), 2], "<u4")
        at[start] = (doc_id, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["start"]: (r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got} == at
    assert tp.token_planes(empty(spark), path).count() == 0
