"""Token counts of whole texts, huge ones by overlapping chunks that are put together again.

A text of at most ``HUGE`` characters is encoded at once. A longer one is encoded in chunks
that overlap, each with the offsets of its tokens. Two neighbouring chunks are spliced at a
place in their overlap where both have a token boundary and which is proven stable: between two
characters that no piece of the vocabulary holds side by side (the pairs are looked up when the
model is loaded), for instance before a blank. No merge ever crosses such a place, so
what is left and right of it is encoded alike whatever else the text holds. If an overlap
has no such place it is widened, at last to the whole of both chunks, which then are one and as
long again, so a text without any stable place costs a few times its length.

Rules for odd rows: null is empty; an empty text has no bytes and no tokens; each row is
counted for itself.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices

HUGE = 1 << 16
CHUNK = 1 << 15
OVERLAP = 1 << 8
LIMIT = 4096
BLANK = "▁"
#: Characters that normal forms of text change, alone or together.
PROBE = "xﬁ①Ａe\u0301\u00a0가"


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.IdToPiece(k) for k in range(self.model.GetPieceSize())]
        self.pairs = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
        #: Characters stand for themselves; a model that rewrites them could join what the text holds apart.
        self.plain = self.model.Normalize(PROBE).lstrip(BLANK) == PROBE

    def starts(self, text: str) -> list[int]:
        """Where each token begins, in characters."""
        return [a for a, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def stable(self, text: str, place: int) -> bool:
        """Whether no piece reaches across this place; a rewriting model is trusted with plain ASCII only."""
        if not 0 < place < len(text):
            return False
        pair = text[place - 1 : place + 1]
        return (self.plain or pair.isascii()) and pair.replace(" ", BLANK) not in self.pairs

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text, encoded in overlapping chunks."""
        done, total = 0, 0  # all before ``done`` is counted; it is 0 or a stable place
        begin, end = 0, min(chunk, len(text))
        mine = self.starts(text[begin:end])
        while end < len(text):
            width = overlap
            while True:
                follow = max(end - width, begin)
                ahead = min(max(end, follow) + chunk, len(text))
                other = self.starts(text[follow:ahead])
                low = max(done, follow)
                common = {begin + a for a in mine[bisect_right(mine, low - begin) :]} & {follow + a for a in other[bisect_right(other, low - follow) :]}
                places = [p for p in common if p < end and self.stable(text, p)]
                if places or follow == begin:
                    break
                width *= 2
            if not places:
                # the new chunk begins where this one did and stands for both, twice as long
                ahead = min(max(ahead, begin + 2 * (end - begin)), len(text))
                other = self.starts(text[begin:ahead])
            else:
                place = max(places)
                total += sum(done <= begin + a < place for a in mine)
                done = place
            begin, end, mine = follow, ahead, other
        return total + sum(begin + a >= done for a in mine)

    def count(self, texts: list[str], huge: int = HUGE) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        usual = [k for k, t in enumerate(texts) if len(t) <= huge]
        out[usual] = self.whole([texts[k] for k in usual])
        for k, t in enumerate(texts):
            if len(t) > huge:
                out[k] = self.spliced(t)
        return out


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def counted(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document row."""

    def make(batches):
        counter = piece_counter(vocabulary)
        for part in slices(batches, "text"):
            column = pc.fill_null(part.column("text"), "")
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pc.binary_length(column).cast(pa.int64()), pa.array(counter.count(column.to_pylist())),
            ], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
