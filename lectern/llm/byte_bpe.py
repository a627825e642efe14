"""Byte-level BPE encoding and decoding by backtracking over longest matches."""

from __future__ import annotations

import base64
import hashlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import small_batches
from lectern.llm.units import IdCoder, held, slices

#: Adjacent pairs that one worker remembers before it starts afresh.
PAIRS = 1_000_000


class Backtracking(IdCoder):
    """Encodes by rank file as the tiktoken library does, each match of the pattern separately.

    Bytes are read as Latin-1 so that a string automaton finds, for every place, the longest
    token that starts there. Tokens are taken longest first; one is kept only if it may follow
    the token before it: merging the two tokens' bytes by rank gives back exactly the two.
    A sequence of which all neighbours agree is the one that the merges make. A place from which
    nothing leads on is marked and never tried again, so the work is linear in the text.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick

        import numpy as np

        super().__init__(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.letter = "H" if max(self.ranks.values()) < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.letter == "H" else "<u4")
        self.size = self.dtype.itemsize
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges by rank, one at a time; for a token or two."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def stands(self, a: int) -> bool:
        """Whether the merges make token ``a`` of its own bytes."""
        if (ok := self.alone.get(a)) is None:
            ok = self.alone[a] = self.merged(self.tokens[a]) == [a]
        return ok

    def follows(self, a: int, b: int) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def prefix(self, a: int) -> int:
        """The longest token that is a proper prefix of token ``a``; -1 if there is none."""
        if (p := self.shorter.get(a)) is None:
            t = self.tokens[a]
            p = self.shorter[a] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1)
        return p

    def ids(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern. A match that is a token is that token, as in the library."""
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        n, tokens = len(data), self.tokens
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = i  # ends ascend, so the last to be set is the longest
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            end = at + len(tokens[token])
            if not dead[end] and (self.follows(out[-1], token) if out else self.stands(token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif (token := self.prefix(token)) < 0:
                dead[at] = 1
                token = out.pop()  # fails at its dead end and goes on to its prefix
                at -= len(tokens[token])
        return out

    def piece(self, text: str) -> bytes:
        return array(self.letter, self.ids(text.encode())).tobytes()

    def whole(self, text: str) -> bytes:
        return self.matches(self.find(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def backtracking(path: str, pattern: str) -> Backtracking:
    return held(Backtracking, path, pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for every row: the operator's own output. Narrow, no shuffle.

    Null and empty texts have no ids; null ids and repeated rows stay; other columns are not read.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches):
        coder = backtracking(ranks, pattern)
        for batch in batches:
            for part in slices(batch):
                ids, ends = coder.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(ids.astype("<i4")))], [id_col, "ids"])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(encodings: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, data binary``: the bytes of each row's ``ids``; null ids give no bytes."""
    import pyarrow as pa

    src = encodings.select(id_col, "ids")

    def run(batches):
        coder = backtracking(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], [id_col, "data"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids, in one pass.

    Null and empty texts have 0 tokens and the digest of nothing, twice; null ids and repeated rows stay, each with its own figures; an empty
    table gives an empty result; other columns are not read, whatever their names.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches):
        coder = backtracking(ranks, pattern)
        names = {i: str(i) for i in coder.tokens}
        for batch in batches:
            for part in slices(batch):
                rows, (flat, ends) = [], coder.encode(part.column(1))
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    ids = flat[a:b].tolist()
                    rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
