"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import small_batches
from lectern.llm.units import UnitCoder, byte_letters, held, slices


class MergeCounts(UnitCoder):
    """Counts the tokens of a byte-level BPE vocabulary file without giving ids.

    A pre-token's symbols form a linked list; a heap holds its adjacent pairs by
    (rank, place). Every pop of a pair that still stands is one merge, and the
    count is the number of symbols less the merges. The special tokens' strings
    count one each, as the library does by default.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["model"]["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normaliser is needed")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        ids = told["model"]["vocab"]
        self.symbols = {b: ids[c] for b, c in byte_letters().items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = tuple(t["content"] for t in told["added_tokens"])
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def piece(self, text: str) -> int:
        """Tokens of one match of the pattern."""
        merges = self.merges
        sym = [self.symbols[b] for b in text.encode()]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the pair has gone into another merge
            count -= 1
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, sym[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, sym[k]))
            if (h := before[i]) >= 0 and (m := merges.get((sym[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], sym[h], made))
        return count

    def section(self, text: str) -> int:
        """Tokens of a text without special strings, split as the library splits it."""
        return self.matches([text[a:b] for _, (a, b) in self.split(text)]) if text else 0

    def whole(self, text: str) -> int:
        """Special strings count one each, leftmost first, as the library takes them."""
        if not self.specials or not (found := self.specials.split(text))[1:]:
            return self.section(text)
        return sum(map(self.section, found)) + len(found) - 1

    def total(self, values) -> int:
        return sum(values)

    def counts(self, texts):
        """Tokens of each of an Arrow array of texts."""
        import numpy as np

        values, codes, offsets = self.coded(texts)
        sums = np.concatenate([[0], np.cumsum(np.array(values, dtype="int64")[codes])])
        return np.diff(sums[offsets])


def merge_counts(path: str) -> MergeCounts:
    return held(MergeCounts, path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row; narrow, no shuffle.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated
    rows are counted each; an empty table gives none; other columns are not read.
    A text's cost is n log n, however long its words are.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def count(batches):
        coder = merge_counts(vocabulary)
        for batch in batches:
            for part in slices(batch):
                n = coder.counts(part.column(1))
                size = pc.cast(pc.binary_length(pc.fill_null(part.column(1), "")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
