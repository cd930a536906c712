"""Token ids of many texts at once, and their words as codes.

A text falls into segments, each a run of white space with the run of other characters after it.
The byte-level vocabulary never merges across the start of a segment, so every distinct segment of
a batch is tokenised once and the ids are gathered by segment. Texts with white space beyond ASCII
or with the name of a special token are tokenised whole.
"""

from __future__ import annotations

import base64
import ctypes
import functools
import gc
import os
import re

import numpy as np
import pyarrow as pa

# Texts of these go through the plain tokenizer: Unicode white space and the special token's name.
UNUSUAL = re.compile("[\u0085   -     　]|<\\|endoftext\\|>".encode().decode())
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
TEXT_AT_ONCE = 2_000_000


@functools.cache
def plain_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def rank_encoder(path: str, pattern: str):
    """The encoder of a ranks file, and the bytes of every token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def default_paths() -> tuple[str, str, str, str]:
    """Plain vocabulary, its ranks, the splitting pattern, and the vocabulary with byte fallback."""
    import public_tokenizers as public

    return (
        public.path("byte_bpe_50k.json"),
        public.path("byte_bpe_50k.tiktoken"),
        public.PATTERN,
        public.path("piece_bpe_32k.model"),
    )


def flat(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, and where each starts (with the end at last)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return b"".join(texts), bounds


def _coded(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of adjacent byte strings and the distinct strings."""
    offsets = np.append(starts, ends[-1:] if len(ends) else [0]).astype(np.int64)
    cells = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).dictionary_encode()
    return cells.indices.to_numpy().astype(np.int64), cells.dictionary


def words_of(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without ASCII white space), their texts, and the number of words per text."""
    space = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = ~space
    begins = inside & (edge[:-1] | np.concatenate([[True], space[:-1]]))
    stops = inside & (edge[1:] | np.concatenate([space[1:], [True]]))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, owner, np.bincount(owner, minlength=len(bounds) - 1)


def word_codes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of words and the distinct words."""
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.large_binary())
    # Words and the gaps between them are adjacent strings; only the words' codes are kept.
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    offsets = np.append(cuts, cuts[-1:])
    cells = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    words = cells.take(pa.array(np.arange(0, len(cuts), 2))).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def token_ids(texts: list[bytes], paths: tuple[str, str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text starts (with the end at last)."""
    data, bounds = flat(texts)
    raw = np.frombuffer(data, np.uint8)
    space = SPACE[raw]
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = space[1:] & ~space[:-1]
    for i, text in enumerate(texts):
        # The unusual characters all have a byte beyond ASCII or the token's name.
        if (not text.isascii() or b"<|endoftext|>" in text) and UNUSUAL.search(text.decode("utf-8", "replace")):
            start[bounds[i] : bounds[i + 1]] = False
    start[bounds] = True
    start[-1] = False
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    codes, distinct = _coded(data, starts, np.append(starts[1:], len(data)))
    ids, cuts = _encode_distinct(distinct.to_pylist(), paths)
    lengths = np.diff(cuts)[codes]
    ends = np.cumsum(lengths)
    out = ids[np.repeat(cuts[:-1][codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
    first = np.searchsorted(starts, bounds)
    return out, np.concatenate([[0], ends])[first]


def _encode_distinct(segments: list[bytes], paths) -> tuple[np.ndarray, np.ndarray]:
    encoder, token_bytes = rank_encoder(paths[1], paths[2])
    joined, alone = [], {}
    for i, segment in enumerate(segments):
        body = segment.strip()
        if segment[:1].isspace() and body and segment.isascii():
            joined.append(i)
        elif segment[:1].isspace() and body and not UNUSUAL.search(segment.decode("utf-8", "replace")):
            joined.append(i)
        else:
            text = segment.decode("utf-8", "replace")
            if UNUSUAL.search(text):
                alone[i] = plain_tokenizer(paths[0]).encode(text, add_special_tokens=False).ids
            else:
                alone[i] = encoder.encode_ordinary(text)
    lengths = np.zeros(len(segments), np.int64)
    parts = []
    for at in range(0, len(joined), 50_000):
        some = [segments[i] for i in joined[at : at + 50_000]]
        found = np.array(encoder.encode_ordinary(b"".join(some).decode("utf-8", "replace")), np.int64)
        ends = np.searchsorted(np.cumsum(token_bytes[found]), np.cumsum([len(s) for s in some]), side="left") + 1
        lengths[joined[at : at + 50_000]] = np.diff(ends, prepend=0)
        parts.append(found)
    order = joined + list(alone)
    for i, found in alone.items():
        lengths[i] = len(found)
        parts.append(np.array(found, np.int64))
    packed = np.concatenate(parts) if parts else np.empty(0, np.int64)
    # ``packed`` is in the order of ``order``; bring it into the order of the segments.
    at = np.zeros(len(segments), np.int64)
    at[order] = np.cumsum(lengths[order]) - lengths[order]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    return packed[np.repeat(at - cuts[:-1], lengths) + np.arange(int(cuts[-1]))], cuts


def give_back() -> None:
    """Memory that a task no longer needs goes back to the system: workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def portions(texts: list[bytes], most: int = TEXT_AT_ONCE):
    """Ranges of texts of at most ``most`` bytes together (one text at least)."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > most:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)
