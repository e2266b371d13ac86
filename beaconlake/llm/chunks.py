"""Texts as lists of chunks that a byte-level vocabulary encodes apart from each other, and ids by chunk.

The rule holds for the pattern ``PATTERN`` alone. A pre-token of it holds a space only in front, and of a run of white space before other
characters the last one stands apart. So a text may be cut before any space or newline that stands alone between characters that aren't white
space, and before both of two newlines. A text with other white space is cut only at its lone spaces and newlines.
Letters and marks behind them are pre-tokens of their own, so a text is also cut between an ASCII letter and a mark.
``chunk_lists`` cuts a batch at bytes, without a copy of it, and numbers the distinct chunks; ``ChunkIds`` keeps the ids of the short ones it has seen, at most
``cache_size``. With another pattern, or where a text holds a string that the tokenizer looks for first, the text is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pattern that the rule above was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in the widest sense of the libraries; what only some of them count as such is never cut at.
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ODD = _WHITE.replace("\n", "")
#: A run of white space that isn't one character, or two newlines before something else.
_RUNS = f"[{_ODD}][{_WHITE}]|\n[{_ODD}]|\n\n(?:\n|\\z)"
_LONE = re.compile(f"(?<=[^{_WHITE}])(?=[ \n][^{_WHITE}])")
#: Characters that make pre-tokens of their own after letters; an apostrophe doesn't.
MARKS = ".,;:!?#*$%&|<>-()\""
#: What each byte is: white space to cut at, a mark, an ASCII letter, or another.
_CUT_AT, _MARK, _LETTER = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \n")], _KINDS[list(MARKS.encode())], _KINDS[[*range(65, 91), *range(97, 123)]] = _CUT_AT, _MARK, _LETTER
#: Longer chunks are encoded anew each time, so that a cache holds words and not texts.
CACHED_CHARS = 64


def chunk_lists(texts: pa.Array, whole: tuple[str, ...] | None = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, the number of each chunk of the batch in order, and where each text's chunks end.

    Texts that hold one of the strings ``whole`` stay one chunk; all do if it is None. Null counts as empty.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if whole is None or not len(texts):
        return *_numbered(texts), np.arange(1, len(texts) + 1)
    kept = np.zeros(len(texts), bool)
    for string in whole:
        kept |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    kinds = _KINDS[data]
    begins = kinds == _CUT_AT
    begins[1:] |= (kinds[1:] == _MARK) & (kinds[:-1] == _LETTER)
    for i in np.flatnonzero(kept | odd).tolist():
        begins[starts[i] : ends[i]] = False
        if not kept[i]:
            sizes = [len(part.encode()) for part in _LONE.split(texts[i].as_py())]
            begins[starts[i] + np.cumsum(sizes[:-1], dtype=np.int64)] = True
    begins[starts[starts < ends]] = True
    at = np.flatnonzero(begins)
    chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
    return *_numbered(chunks), np.searchsorted(at, ends)


def _numbered(chunks: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings, and the number of each string."""
    distinct = chunks.dictionary_encode()
    return distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy()


class ChunkIds:
    """Ids of texts from the ids of their chunks; ``fresh`` gives those of chunks that aren't known yet, as little-endian 32-bit integers."""

    def __init__(self, fresh: Callable[[list[str]], list[bytes]], whole: tuple[str, ...] | None, cache_size: int = 1 << 19):
        self.fresh, self.whole, self.cache_size = fresh, whole, cache_size
        self.known: dict[str, bytes] = {}

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't known; marks behind other letters than ASCII are encoded apart from them too, as the pattern takes them."""
        known, cuts = self.known, {}
        if self.whole is not None:
            for c in chunks:
                if c[-1] in MARKS:
                    body = c.rstrip(MARKS)
                    if body[1:].isalpha() and (body[0] == " " or body[0].isalpha()):
                        cuts[c] = len(body)
        plain = [c for c in chunks if c not in cuts] if cuts else chunks
        parts = dict.fromkeys([*plain, *(x for c, k in cuts.items() for x in (c[:k], c[k:]) if x not in known)])
        found = dict(zip(parts, self.fresh(list(parts)), strict=True))
        of = lambda x: found[x] if x in found else known[x]
        joined = {c: of(c[:k]) + of(c[k:]) for c, k in cuts.items()}
        for ids in (found, joined):
            known.update(ids if max(map(len, ids), default=0) <= CACHED_CHARS else {c: x for c, x in ids.items() if len(c) <= CACHED_CHARS})
        found.update(joined)
        return list(map(found.__getitem__, chunks))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch (uint32), and where each text's end."""
        if len(self.known) > self.cache_size:
            self.known.clear()
        chunks, at, ends = chunk_lists(texts, self.whole)
        found = list(map(self.known.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(missing, self._learned([chunks[i] for i in missing]), strict=True):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        taken = sizes[at]
        stop = np.cumsum(taken)
        out = flat[np.repeat(first[at] - stop + taken, taken) + np.arange(stop[-1] if len(stop) else 0)]
        return out, np.concatenate([[0], stop])[ends]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, ends = self.ids(pa.array(texts, pa.large_string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])] if texts else []


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 4096, megabytes: int = 8) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``megabytes``; a row is never cut, and batches without rows are left out."""
    for batch in batches:
        if not len(batch):
            continue
        step = max(1, min(rows, int(len(batch) * (megabytes << 20) / max(1, batch.nbytes))))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)
