"""Language ID: language-bitmask n-gram filters.

For each language, learning takes the letter n-grams that make up at least ``share`` of its n-grams, so at most
1 / share of them. One Bloom filter holds all languages, bit-sliced: its rows are bitmasks with one bit for each
language, and an n-gram's languages are the AND of its ``PROBES`` rows. A text's n-grams are looked up, the bits of
each language counted, and each count corrected by the rate at which that language's slice answers by mistake
(its share of set rows to the power of PROBES). The language with the largest corrected share of the text's n-grams
wins; ties go to the first by code point. That share is the score.

N-grams are of lower-cased letters, any run of other characters counting as one boundary sign; an n-gram is known by a
64-bit hash of its code points. Learning counts over all texts that it may see; the filter's size follows from the
number of languages and ``share`` only, so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, small
from sparkwright.llm.shingles import PLACE, U, mix

GRAM, SHARE, PROBES, BLOCK = 4, 1e-5, 2, 1 << 19


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str | None], block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of texts, has letters, each n-gram's text counted from the first, its hash), in blocks.

    A text's n-grams are those of its letters between one boundary before and one after it, whatever texts it comes with.
    A long text comes in parts that overlap by what an n-gram spans, as blocks of their own.
    """
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size + len(texts[j] or "") < block):
            part.append((texts[j] or "").lower())
            size += len(part[-1]) + 2
            j += 1
        if j - i > 1 or size <= 2 * block:
            yield (i, j - i, *hashed(part))
        else:
            text, at, carry = part[0], 0, np.zeros(1, np.uint32)
            while at < len(text):
                codes = np.concatenate([carry, squeezed(text[at : at + block], carry[-1] == 0)])
                at += block
                if at >= len(text) and codes[-1]:
                    codes = np.append(codes, np.uint32(0))
                yield i, 1, np.array([codes.any()]), np.zeros(max(0, len(codes) - GRAM + 1), int), windows(codes)
                carry = codes[-(GRAM - 1) :]
        i = j


def squeezed(text: str, after_gap: bool) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    before = np.concatenate([[not after_gap], is_letter[:-1]])
    keep = is_letter | before
    return np.where(is_letter, codes, 0)[keep].astype(np.uint32)


def hashed(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(("\n" + "\n\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter, lengths = letters()[codes], np.array([len(p) + 2 for p in part])  # each with a separator at both ends
    owner = np.repeat(np.arange(len(part)), lengths)
    has = np.bincount(owner[is_letter], minlength=len(part)) > 0
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    keep[np.cumsum(lengths) - lengths] = True
    codes, owner = np.where(is_letter, codes, 0)[keep].astype(np.uint32), owner[keep]
    if len(codes) < GRAM:
        return has, np.zeros(0, int), np.zeros(0, np.uint64)
    first = owner[: len(owner) - GRAM + 1]
    inside = first == owner[GRAM - 1 :]
    return has, first[inside], windows(codes)[inside]


def windows(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64) + U(1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out += c[k : k + n] * PLACE[k]
    return mix(out)


class Filter:
    """The bit-sliced filter: ``rows`` has one mask for each row, in words of up to 64 languages."""

    def __init__(self, langs: list[str], hashes: np.ndarray, masks: np.ndarray):
        self.langs = langs
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(hashes)) * 16))))
        bits = min(64, max(8, 1 << max(0, len(langs) - 1).bit_length()))
        self.rows = np.zeros((masks.shape[1], size), f"u{bits // 8}")
        for p in range(PROBES):
            for w in range(masks.shape[1]):
                np.bitwise_or.at(self.rows[w], self.at(hashes, p), masks[:, w].astype(self.rows.dtype))
        full = [np.count_nonzero(self.rows[k // 64] >> (k % 64) & 1) / size for k in range(len(langs))]
        self.wrong = np.array(full) ** PROBES

    def at(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h >> U(32 * probe)) & U(0xFFFFFFFF)) % U(self.rows.shape[1])

    def counts(self, owner: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
        """For each text, each language's number of n-grams."""
        out = np.zeros((texts, len(self.langs)))
        first = [self.at(h, p).astype(np.int64) for p in range(PROBES)]
        for w in range(len(self.rows)):
            mask = self.rows[w][first[0]]
            for p in first[1:]:
                mask &= self.rows[w][p]
            for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                out[:, k] = np.bincount(owner[mask >> (k % 64) & 1 > 0], minlength=texts)[:texts]
        return out

    def scores(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        n = np.maximum(total, 1)[:, None]
        return np.clip((counts / n - self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Documents from which nothing is learned; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(labelled: DataFrame, share: float = SHARE) -> Filter:
    """The filter from ``labelled`` (text, lang); rows where either is null are left out."""

    def count(batches):
        held: dict[str, list] = {}

        def rows():
            out = {"lang": [], "gram": [], "n": []}
            for lang, (g, c) in held.items():
                out["lang"] += [lang] * len(g)
                out["gram"].append(g)
                out["n"].append(c)
            return pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "gram": pa.array(np.concatenate(out["gram"]).astype(np.int64)), "n": pa.array(np.concatenate(out["n"]))})

        waiting: dict[str, list] = {}
        size = 0

        def fold():
            for lang, parts in waiting.items():
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    old, n = held[lang]
                    both, inverse = np.unique(np.concatenate([old, g]), return_inverse=True)
                    g, c = both, np.bincount(inverse, np.concatenate([n, c])).astype(np.int64)
                held[lang] = (g, c.astype(np.int64))
            waiting.clear()

        for b in small(batches):
            langs = np.array(b.column(1).to_pylist(), object)
            for i, n, _, owner, h in grams(b.column(0).to_pylist()):
                of = langs[i : i + n]
                for lang in set(of.tolist()):
                    waiting.setdefault(lang, []).append(h[(of == lang)[owner]] if n > 1 else h)
                size += len(h)
                if size > 1 << 21:
                    fold()
                    size = 0
            if sum(len(g) for g, _ in held.values()) > 1 << 21:
                yield rows()
                held.clear()
        fold()
        if held:
            yield rows()

    known = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # n-grams below the share are dropped by their language's total, so at most 1 / share of a language reach the driver
    counted = cut(counted, "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.select("lang").collect())
    kept = counted.join(totals, "lang").filter(F.col("n") >= F.col("total") * share).select("lang", "gram").toArrow()
    number = {lang: k for k, lang in enumerate(langs)}
    all_grams, inverse = np.unique(kept.column("gram").to_numpy().astype(np.uint64), return_inverse=True)
    masks = np.zeros((len(all_grams), max(1, -(-len(langs) // 64))), np.uint64)
    of = np.array([number[x] for x in kept.column("lang").to_pylist()], int)
    for k in range(len(langs)):
        masks[inverse[of == k], k // 64] |= U(1) << U(k % 64)
    return Filter(langs, all_grams, masks)


def predict(docs: DataFrame, model: Filter, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text, ...), then lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in small(batches):
            texts = b.column(len(keep)).to_pylist()
            total, counts, has = np.zeros(len(texts)), np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), bool)
            for i, n, letters_in, owner, h in grams(texts):
                has[i : i + n] |= letters_in
                if m.langs:
                    total[i : i + n] += np.bincount(owner, minlength=n)[:n]
                    counts[i : i + n] += m.counts(owner, h, n)
            score = m.scores(counts, total) if m.langs else np.zeros((len(texts), 1))
            best = score.argmax(axis=1)
            lang = [m.langs[k] if ok and m.langs else "und" for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
            value = np.where(has, score[np.arange(len(texts)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(value, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select(*keep, "text").mapInArrow(run, schema)


def recognised(docs: DataFrame, least: float, share: float = SHARE) -> DataFrame:
    """``docs`` without the rows whose text is in none of the languages that it teaches: ``und``, or a score under ``least``.

    ``docs`` has doc_id, text and lang; all columns are kept, whatever their names, and repeated rows fare alike. A null
    text and one without letters are ``und``; one too short for an n-gram stays. Where no lang teaches anything, nothing is
    known about any text, and all rows stay; an empty table stays empty.
    """
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"), share)
    if not model.langs:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in small(batches):
            texts = b.column(at).to_pylist()
            total, counts, has = np.zeros(len(texts)), np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), bool)
            for i, n, letters_in, owner, h in grams(texts):
                has[i : i + n] |= letters_in
                total[i : i + n] += np.bincount(owner, minlength=n)[:n]
                counts[i : i + n] += m.counts(owner, h, n)
            good = has & ((m.scores(counts, total).max(axis=1, initial=0) >= least) | (total == 0))
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang).

    Learned from text and lang of the documents that are not held out. ``und`` with score 0: a null text, one without
    letters, or nothing learned. A text too short for an n-gram gets score 0 and the first language, as do ties. Rows are
    judged by text alone, so equal texts agree; texts are whole, whatever their length. Other columns, whatever their
    names, are ignored; an empty table gives no rows.
    """
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"), share)
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
