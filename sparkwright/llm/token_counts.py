"""Token counts: overlap resynchronisation of huge documents.

A text of more than ``chunk`` characters is encoded as chunks that overlap, each with its tokens' offsets. Two
neighbours are spliced at a common boundary that is proven stable, and only the tokens on its true side are counted:

* a boundary between two matches of the tokenizer's splitting pattern, in both encodings: what a match covers depends
  on the text from its start onward only, so from a common boundary on both go on alike;
* at least ``margin`` characters (a special token's length and one of look-ahead) before the left chunk's end and
  after the right chunk's start, so that neither a cut special token nor a cut run of white space can show.

By induction the left chunk is right up to its end's margin, so the boundary is one of the whole text's. Where two
neighbours share no such boundary, the right chunk starts earlier by four times the overlap, again and again; at the
left chunk's start the two are one chunk. Tokenizers for which this is not proven (see pieces.cuttable) encode whole
texts. Shorter texts go to the piece encoder, which gives the library's ids.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import small
from sparkwright.llm.pieces import PieceEncoder

CHUNK, OVERLAP = 32_768, 512


def boundaries(tokenizer, text: str, start: int, stop: int) -> tuple[dict[int, int], int]:
    """Of text[start:stop]: each match's first character -> tokens before it, and the number of tokens."""
    e = tokenizer.encode(text[start:stop], add_special_tokens=False)
    found, last = {}, object()
    for k, (word, (at, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
        if word != last:
            found.setdefault(start + at, k)
            last = word
    return found, len(e.ids)


def resynchronised(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, on_widen=None) -> int:
    """The number of tokens of ``text``, from chunks; equal to len(tokenizer.encode(text).ids)."""
    if len(text) <= chunk:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    margin = 1 + max([1, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    start, stop, total, since = 0, chunk, 0, 0
    left, n = boundaries(tokenizer, text, start, stop)
    while stop < len(text):
        wide = max(overlap, 2 * margin + 2)
        while True:
            begin, end = stop - wide, min(len(text), stop - wide + max(chunk, 2 * wide))
            if begin <= start:  # one chunk from the left one's start on, which is a boundary already
                stop, since_at = end if end > stop else min(len(text), stop + chunk), min((p for p, k in left.items() if k >= since), default=start)
                left, n = boundaries(tokenizer, text, since_at, stop)
                start, since = since_at, 0
                break
            right, m = boundaries(tokenizer, text, begin, end)
            common = [p for p in right if begin + margin <= p <= stop - margin and left.get(p, -1) >= since]
            if common:
                at = max(common)
                total += left[at] - since
                left, n, since, start, stop = right, m, right[at], begin, end
                break
            wide *= 4
            if on_widen:
                on_widen(wide)
    return total + n - since


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of ``docs`` (doc_id, text).

    ``path``: a tokenizers .json or a sentencepiece .model. No special tokens are added; a null text counts as empty;
    rows are independent of each other, so ties, repeated rows and other columns change nothing.
    """

    def count(batches):
        encoder = Encoder(path, chunk, overlap)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([encoder(t) for t in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


class Encoder:
    def __init__(self, path: str, chunk: int, overlap: int):
        self.chunk, self.overlap, self.pieces, self.model = chunk, overlap, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.pieces = PieceEncoder(path)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.model:
            return len(self.model.encode(text, add_bos=False, add_eos=False, num_threads=1))
        if self.pieces.cut and len(text) > self.chunk:
            return resynchronised(self.pieces.tokenizer, text, self.chunk, self.overlap)
        return len(self.pieces.encode_one(text)) // 4
