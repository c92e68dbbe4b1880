"""Token ids of whole texts, by a public vocabulary file, in Arrow batches.

The vocabulary drops white space and never merges across it, so the ids of a text are those of its words one after
the other. Each batch is split at ASCII white space and its distinct words into parts, both by Arrow; the distinct parts are looked up in
a bounded cache of the worker (two generations of CACHE_PARTS parts, so those in use stay), and the ids of words and of
texts are gathered with numpy. A word outside plain Latin letters, digits and ASCII signs goes to the
tokenizer itself (a cache of CACHE_WORDS such words), so every text gets the ids that encoding it whole would give.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
CACHE_WORDS = 50_000
CACHE_PARTS = 100_000
SLICE_BYTES = 8 << 20

# The pre-tokenizer's pattern for lower-cased words of the plain alphabet.
PLAIN = r"\A[!-~À-ÖØ-öø-ÿ]*\z"
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent:
    """A bounded cache of two generations: when the younger is full, the older goes; a hit in the older renews it."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Encoder:
    """Encodes Arrow string arrays; one per worker process and vocabulary file."""

    _made: dict[tuple, Encoder] = {}

    @classmethod
    def of(cls, path: str, words: int = CACHE_WORDS, parts: int = CACHE_PARTS) -> Encoder:
        if (path, words, parts) not in cls._made:
            cls._made[path, words, parts] = cls(path, words, parts)
        return cls._made[path, words, parts]

    def __init__(self, path: str, words: int = CACHE_WORDS, parts: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.signs = byte_signs()
        self.words, self.parts = Recent(words), Recent(parts)

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            # Printable ASCII stands for itself in the vocabulary.
            signs = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
            found = array("H", [t.id for t in self.model.tokenize(signs)]).tobytes()
            self.parts.put(part, found)
        return found

    def _odd(self, word: str) -> bytes:
        """The ids of a word that only the tokenizer itself takes apart, as little-endian 16-bit integers."""
        found = self.words.get(word)
        if found is None:
            found = np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint16).tobytes()
            self.words.put(word, found)
        return found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, and where those of each word start and how many they are."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        low = pc.utf8_lower(pc.if_else(plain, words, ""))
        # Plain words hold no space, so spaces can part them.
        lists = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(low, PARTS, r"\0 "), " "), " ")
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        encoded = list(map(self.parts.young.get, distinct))
        for i, e in enumerate(encoded):
            if e is None:
                encoded[i] = self._part(distinct[i])
        ids, ends = _gathered(*_pool(encoded), flat.indices.to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], ends])[_bounds(lists)]
        starts, lens = ends[:-1], np.diff(ends)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            more, at, lens[odd] = _pool([self._odd(w) for w in words.take(pa.array(odd)).to_pylist()])
            starts[odd] = at + len(ids)
            ids = np.concatenate([ids, more])
        return ids, starts, lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's ids followed by END_ID, and the offsets of the texts."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = lists.flatten().dictionary_encode()
        ids, starts, lens = self._of_words(flat.dictionary)
        # The end id is one more word, which stands behind the words of each text.
        ids, starts, lens = np.append(ids, np.uint16(END_ID)), np.append(starts, len(ids)), np.append(lens, 1)
        bounds = _bounds(lists)
        index = np.insert(flat.indices.to_numpy(zero_copy_only=False), bounds[1:], len(starts) - 1)
        out, ends = _gathered(ids, starts, lens, index)
        offsets = np.concatenate([[0], ends[bounds[1:] + np.arange(len(texts))]])
        return out, offsets


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where the rows of a list column start in its flat values, and where the last one ends."""
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0]


def _pool(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all entries one after the other, where those of each start and how many they are."""
    lens = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 2
    return np.frombuffer(b"".join(encoded), np.uint16), np.cumsum(lens) - lens, lens


def _gathered(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries that ``index`` names, one entry after the other, and where each of them ends."""
    of = lens[index]
    ends = np.cumsum(of)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts[index] - (ends - of)).astype(kind), of)
    at += np.arange(n, dtype=kind)
    return pool[at], ends


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so memory is bounded by the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
