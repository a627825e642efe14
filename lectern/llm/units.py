"""Byte-level BPE of whole texts, remembered by space-delimited unit.

The splitting pattern of the byte-level tokenizers lets a token start at every
space that a non-space follows. A text therefore falls into units (a word with
the one space before it) that can be encoded apart, and a unit met before
costs one dictionary look-up. Texts in which a space is followed by white space, or which
hold a special token's string, are encoded whole.
"""

from __future__ import annotations

import functools
import json

#: A remembered unit or piece has at most so many characters; longer ones are encoded each time.
UNIT_CHARS = 80
#: Units and pieces that one worker remembers before it starts afresh (bounds its memory).
UNITS, PIECES = 600_000, 400_000
#: Fixed value: the pattern by which the byte-level tokenizers split a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of characters below this one split alike under every Unicode version of the pattern's classes.
LATIN = "\u0250"


class UnitCoder:
    """Maps texts to values; subclasses say what a piece (one match of the pattern) is worth.

    ``piece(p)`` gives the value of one piece, ``total(values)`` that of what lies side by side,
    ``whole(text)`` that of any text, and ``special`` are strings that force a text to be taken whole.
    """

    special: tuple[str, ...] = ()

    def __init__(self, pattern: str = PATTERN) -> None:
        import regex

        self.known: dict = {}
        self.pieces: dict = {}
        self.find = regex.compile(pattern).findall

    def piece(self, text: str):
        raise NotImplementedError

    def whole(self, text: str):
        raise NotImplementedError

    def total(self, values):
        raise NotImplementedError

    def matches(self, found: list[str]):
        """The value of a text from the pieces found in it."""
        pieces, out = self.pieces, []
        for p in found:
            if (v := pieces.get(p)) is None:
                v = self.piece(p)
                if len(p) <= UNIT_CHARS:
                    pieces[p] = v
            out.append(v)
        return out[0] if len(out) == 1 else self.total(out)

    def head(self, text: str):
        """The value of a text's first word."""
        return self.whole(text) if not text or max(text) >= LATIN or any(s in text for s in self.special) else self.matches(self.find(text))

    def learn(self, words: list[str]) -> list:
        """Values of new units, a space before each; all plain ones are split in one go.

        A word that begins with white space is the first of its text (a space before it would make the text odd), so it
        is no unit and its value is never asked for; beside a word that ends in white space it would swallow the space between.
        """
        plain = [w for w in words if w and max(w) < LATIN and not w[0].isspace()]
        out = {}
        for k in range(0, len(plain), 5000):
            out.update(self.side_by_side(plain[k : k + 5000]))
        return [out[w] if w in out else self.total([]) if w and w[0].isspace() else self.whole(" " + w) for w in words]

    def side_by_side(self, words: list[str]) -> dict:
        """Values of plain units, split as one text; should a space in it begin no piece, each is taken by itself."""
        pieces, piece, total = self.pieces, self.piece, self.total
        out, values, at = {}, [], -1
        for p in self.find(" " + " ".join(words)):
            if (v := pieces.get(p)) is None:
                v = piece(p)
                if len(p) <= UNIT_CHARS:
                    pieces[p] = v
            if p[0] == " ":
                if at >= 0:
                    out[words[at]] = values[0] if len(values) == 1 else total(values)
                at, values = at + 1, [v]
            else:
                values.append(v)
        if at != len(words) - 1:
            return {w: self.whole(" " + w) for w in words}
        out[words[at]] = total(values)
        return out

    def coded(self, texts):
        """``values, codes, offsets`` of an Arrow array of texts: text ``i`` is ``values[c] for c in codes[offsets[i]:offsets[i + 1]]``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, " [\\x09-\\x0D\\x1C-\\x20\\x{85}\\pZ]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        apart = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        split = pc.split_pattern(apart, " ")
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype("int32")
        words = coded.dictionary.to_pylist()
        if len(self.known) > UNITS:
            self.known.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        values = list(map(self.known.get, words))
        if new := [k for k, v in enumerate(values) if v is None]:
            fresh = [words[k] for k in new]
            for k, w, v in zip(new, fresh, self.learn(fresh)):
                values[k] = v
                if len(w) <= UNIT_CHARS:
                    self.known[w] = v
        heads = codes[offsets[:-1]]
        codes[offsets[:-1]] = len(values) + np_arange(len(heads))
        first = [self.whole(texts[i].as_py()) if o else self.head(words[h]) for i, (o, h) in enumerate(zip(odd.tolist(), heads.tolist()))]
        return values + first, codes, offsets


def np_arange(n: int):
    import numpy as np

    return np.arange(n, dtype="int32")


class IdCoder(UnitCoder):
    """Values are ids as bytes: little-endian unsigned integers of ``dtype``."""

    def total(self, values) -> bytes:
        return b"".join(values)

    def encode(self, texts):
        """Ids of an Arrow array of texts, flat, and each text's edges in them."""
        import numpy as np

        values, codes, offsets = self.coded(texts)
        flat = np.frombuffer(b"".join(values), dtype=self.dtype)
        # A slice's ids are far fewer than 2^31: narrow indexes halve the memory.
        sizes = np.fromiter(map(len, values), dtype="int32", count=len(values)) // np.int32(self.size)
        del values
        starts = np.cumsum(sizes, dtype="int32") - sizes
        n = sizes[codes]
        ends = np.zeros(len(n) + 1, dtype="int32")
        np.cumsum(n, out=ends[1:])
        shift = starts[codes]
        shift -= ends[:-1]
        at = np.repeat(shift, n)
        del n, shift, codes
        at += np.arange(len(at), dtype="int32")
        return flat[at], ends[offsets].astype("int64")


def slices(batch, column: int = 1, most: int = 1 << 24):
    """A record batch in runs of rows of about ``most`` bytes of text (a row at least)."""
    rows, k = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes))), 0
    while k < batch.num_rows:
        yield batch.slice(k, rows)
        k += rows


class LibraryIds(IdCoder):
    """Token ids as the tokenizers library gives them."""

    def __init__(self, path: str) -> None:
        import numpy as np
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["model"]["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normaliser is needed")
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.size = self.dtype.itemsize
        self.special = tuple(t["content"] for t in told["added_tokens"])
        self.letters = byte_letters()
        self.raw = [i.to_bytes(self.size, "little") for i in range(self.library.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return b"".join([self.raw[i] for i in self.library.encode(text, add_special_tokens=False).ids]) if text else b""

    def piece(self, text: str) -> bytes:
        letters = text.encode().decode("latin-1").translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(letters)])


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_held: dict = {}


def held(kind: type, *args: str):
    """One encoder for each Python worker; another one takes its place, so a worker holds the memory of one."""
    if (key := (kind, *args)) not in _held:
        forget()
        _held[key] = kind(*args)
    return _held[key]


def forget() -> None:
    """Drop the encoder that this worker holds; operators without one begin with this, as workers outlive stages."""
    import pyarrow as pa

    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()


def library_ids(path: str) -> LibraryIds:
    return held(LibraryIds, path)
