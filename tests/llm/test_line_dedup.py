import random

import pytest

from sparkwright.llm import line_dedup
from sparkwright.llm.line_dedup import duplicate_lines, line_deduped, line_report

from .helpers import documents, empty, frame


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, share=1 / 16):
    """{(doc_id, text): {line: earlier line's place}}, places by doc_id (null first), text, line."""
    seen, gone = [], {}
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc in docs:
        for at, raw in enumerate(doc[1].split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if not line:
                continue
            if any(line == x or (min(len(line), len(x)) * share >= 1 and within_one(line, x)) for x in seen):
                gone.setdefault(doc, set()).add(at)
            seen.append(line)
    return gone


def sample(seed=4):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc dé") for _ in range(rng.choice([3, 15, 16, 17, 40, 90]))).strip() or "x" for _ in range(25)]
    pool.append("z" * 3000)
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            s = rng.choice(pool)
            p = rng.randrange(len(s))
            lines.append(rng.choice([s, s, s[:p] + s[p + 1 :], s[:p] + "q" + s[p:], s[:p] + "w" + s[p + 1 :], f"  {s}\t", "", s[:p] + rng.choice("abc") + s[p:]]))
        rows.append((i, "\n".join(lines), "en", "s"))
    return rows


def test_against_all_pairs(spark):
    rows = sample()
    want = brute(rows)
    got = {(r["doc_id"]): set(r["gone"]) for r in line_report(frame(spark, rows)).collect()}
    assert got == {k[0]: v for k, v in want.items()}
    texts = {r["doc_id"]: r["text"] for r in line_deduped(frame(spark, rows)).collect()}
    assert texts == {i: "\n".join(x for at, x in enumerate(t.split("\n")) if at not in want.get((i, t), ())) for i, t, *_ in rows}


@pytest.mark.parametrize(("share", "piece"), [(1.0, 7), (0.25, 4096), (0.0, 4096)])
def test_any_length_and_pieces(spark, monkeypatch, share, piece):
    monkeypatch.setattr(line_dedup, "PIECE", piece)
    rows = sample(9)
    got = {r["doc_id"]: set(r["gone"]) for r in line_report(frame(spark, rows), share).collect()}
    assert got == {k[0]: v for k, v in brute(rows, share).items()}


def test_long_lines_and_columns_of_any_name(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    rows = [(1, long), (2, long[:20_000] + "Z" + long[20_001:]), (3, long[:5] + long[6:]), (4, long[:9] + "YY" + long[11:]), (4, None)]
    df = spark.createDataFrame([(*r, 7, 8, 9, 1.5) for r in rows], "doc_id long, text string, __id int, own_0 int, gone int, `a.b` double")
    out = line_deduped(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], -1 if r["text"] is None else len(r["text"]), r["__id"], r["own_0"], r["gone"], r["a.b"]) for r in out.collect()) == [(1, 30_000, 7, 8, 9, 1.5), (2, 0, 7, 8, 9, 1.5), (3, 0, 7, 8, 9, 1.5), (4, -1, 7, 8, 9, 1.5), (4, 30_000, 7, 8, 9, 1.5)]


def test_awkward(spark):
    rows = [r for r in documents() if len(r[1] or "") < 5000] + [(5000, "only\n\nonly\nonly line of this text here", "en", "s"), (5001, "Only line of this text here", "en", "s"), (5002, "only line of this texts here", "en", "s")]
    out = line_deduped(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and out.count() == len(rows)
    got = {r["doc_id"]: r for r in line_report(frame(spark, rows)).collect()}
    assert got[5000]["gone"] == [2] and got[5001]["gone"] == [0] and (got[5002]["n_equal"], got[5002]["n_near"]) == (0, 1)
    assert duplicate_lines(empty(spark)).count() == 0 and line_deduped(empty(spark)).count() == 0
