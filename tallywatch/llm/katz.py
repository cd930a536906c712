"""Katz backoff bigrams over a corpus, and the log probability of every document.

Words and bigrams of the training documents are counted; counts up to ``GT_MOST`` are discounted
by Good-Turing, and what a history gives up goes to the words never seen after it, in proportion
to their own (again discounted) probability. The backoff weight divides by the exact probability
of those words, so every history's distribution sums to one.

A *chunk* is a few thousand documents as word numbers, stored once in a table bucketed by chunk.
Chunks and *parts* of the model exchange packed arrays: a chunk sends its distinct words to the
part of each word's hash, with their training counts; the part adds up and answers with corpus
counts. Bigrams go to the part of their history the same way and come back with their count and
the history's sums. So the shuffles carry distinct n-grams per chunk, never tokens or texts, and a
lost task rereads stored chunks. Histories above ``HEAVY`` of all tokens are spread over all parts
by the second word; there are at most 1 / HEAVY of them, whose sums are added up and broadcast.

Defined results: a null text is empty and has the end token alone; rows with the same id are
separate documents; a null id counts as the text 'null' for the split; an empty table gives no
rows; without training tokens every word has probability one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import bounded, crc_remainder, documents, small_batches, stored
from tallywatch.llm.exchange import (
    SENT,
    bucketed,
    by_part,
    joined,
    mixed,
    packed,
    packed_ids,
    sent,
    split,
    unpacked,
    unpacked_ids,
)
from tallywatch.llm.pieces import flat, portions, word_codes, words_of

CHUNK_BYTES = 6_000_000
PART_ENTRIES = 3_000_000
SERVED_AT_ONCE = 400_000
GT_MOST = 5
HEAVY = 1 / 4096
END, BEGIN = 0, 1  # numbers of the end token and of the start of a text in every chunk
END_HASH, BEGIN_HASH = np.uint64(xxhash.xxh64_intdigest(b" end")), np.uint64(xxhash.xxh64_intdigest(b" begin"))
CHUNK = (
    "chunk bigint, doc_ids binary, held array<boolean>, sizes binary, words binary, tokens binary, "
    "n_tokens bigint, n_train bigint, n_train_docs bigint"
)
LEVELS = [f"n{r}" for r in range(GT_MOST + 2)]
# kind 0: in n0 the distinct n-grams with a count, in n1.. those with that count; 1 and 2: answers to
# a chunk about its words and bigrams; 3: a spread history (its hash as chunk), n1.. its numbers of
# continuations per small count, seen their probability.
ANSWER = "chunk bigint, part int, kind int, answer binary, " + ", ".join(f"{n} bigint" for n in LEVELS) + ", seen double"


def good_turing(levels: list[int]) -> np.ndarray:
    """Discounts of the counts 0..GT_MOST (0: unused) from how many n-grams have the counts 1...

    Where the counts of counts do not fall as the estimate needs, half an occurrence is taken off.
    """
    n = [0, *levels]
    last = GT_MOST + 1
    out = [1.0]
    for r in range(1, last):
        if not n[1] or not n[r]:
            break
        lost = last * n[last] / n[1]
        d = ((r + 1) * n[r + 1] / (r * n[r]) - lost) / (1 - lost) if lost < 1 else 0.0
        if not 0 < d < 1:
            break
        out.append(d)
    if len(out) <= GT_MOST:
        out = [1.0] + [(r - 0.5) / r for r in range(1, last)]
    return np.array(out)


class Unigrams:
    """Probabilities of words from their counts; what is left over is that of a word never seen."""

    def __init__(self, tokens: int, levels: list[int]):
        self.tokens, self.discounts = tokens, good_turing(levels)
        given_up = sum(r * n * (1 - d) for r, n, d in zip(range(1, GT_MOST + 1), levels, self.discounts[1:]))
        # With no small count nothing is given up; one occurrence more is then set aside.
        self.scale = 1.0 if given_up > 0 else tokens / (tokens + 1)
        self.unseen = given_up / tokens if given_up > 0 else 1 / (tokens + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = self.discounts[np.where(counts <= GT_MOST, counts, 0)]
        return np.where(counts > 0, self.scale * d * counts / max(self.tokens, 1), self.unseen)


def _chunk_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    made = 0
    held_back: list[tuple] = []
    size = 0

    def emit() -> pa.RecordBatch:
        nonlocal made, size
        ids, held, texts = (list(c) for c in zip(*held_back))
        data, bounds = flat([t.lower() for t in texts])
        starts, ends, owner, n_words = words_of(data, bounds)
        codes, distinct = word_codes(data, starts, ends)
        hashes = np.array([END_HASH, BEGIN_HASH, *(xxhash.xxh64_intdigest(w) for w in distinct.to_pylist())], np.uint64)
        sizes = n_words + 1
        tokens = np.full(int(sizes.sum()), END, np.uint32)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(sizes) - 1] = False
        tokens[inner] = codes + 2
        trained = ~np.array(held, bool)
        values = [
            task + made, packed_ids(ids), held, packed(sizes.astype(np.uint32)), hashes.tobytes(), packed(tokens),
            len(tokens), int(sizes[trained].sum()), int(trained.sum()),
        ]
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.bool_()), *[pa.binary()] * 3, *[pa.int64()] * 3]
        names = [f.split()[0] for f in CHUNK.split(", ")]
        made, size = made + 1, 0
        held_back.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        ids, held = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for low, high in portions(texts, most):
            for i in range(low, high):
                if held_back and size + len(texts[i]) > most:
                    yield emit()
                held_back.append((ids[i], held[i], texts[i]))
                size += len(texts[i])
    if held_back:
        yield emit()


class Chunk:
    """The numbers of one chunk; every step derives the same order of entries from them."""

    def __init__(self, row, parts: int):
        self.parts = parts
        self.doc_ids, self.held = unpacked_ids(row["doc_ids"]), np.array(list(row["held"]), bool)
        self.sizes = unpacked(row["sizes"], np.uint32).astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = unpacked(row["tokens"], np.uint32).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.trained = ~self.held[self.owner]

    def word_order(self) -> tuple[np.ndarray, np.ndarray]:
        return by_part(self.words, self.parts)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trained], minlength=len(self.words))

    def bigrams(self, heavy: np.ndarray):
        """History and word of each distinct bigram in part order, where each part starts, the
        bigram of every token, and the histories that are spread over all parts."""
        before = np.concatenate([[BEGIN], self.tokens[:-1]])
        before[np.cumsum(self.sizes) - self.sizes] = BEGIN
        keys, of_token = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        first, second = keys // len(self.words), keys % len(self.words)
        spread = np.isin(self.words, heavy)
        spread[BEGIN] = True
        salt = np.where(spread[first], mixed(self.words[second]), np.uint64(0))
        order, cuts = by_part(self.words[first] + salt, self.parts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return first[order], second[order], cuts, place[of_token], spread


def _send_words(chunk_id: int, chunk: Chunk) -> pd.DataFrame:
    order, cuts = chunk.word_order()
    counts = chunk.word_counts()
    rows = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[p] : cuts[p + 1]]
        rows.append((p, chunk_id, joined(packed(chunk.words[own]), packed(counts[own].astype(np.int64)))))
    return sent(rows)


def _levels(counts: np.ndarray) -> list[int]:
    seen = counts[counts > 0]
    return [len(seen), *(int((seen == r).sum()) for r in range(1, GT_MOST + 2))]


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "part", "kind", "answer", *LEVELS, "seen"])


NOTHING = [0] * len(LEVELS)


def _signed(hash_value: np.uint64) -> int:
    return int(hash_value.astype(np.int64))


def _serve_words(part: int, received: pd.DataFrame, heavy_from: float) -> pd.DataFrame:
    halves = [split(p, 2) for p in received["payload"]]
    words = [unpacked(w, np.uint64) for w, _ in halves]
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([unpacked(c, np.int64) for _, c in halves])).astype(np.int64)
    rows, low = [], 0
    for chunk, own in zip(received["chunk"].tolist(), words):
        rows.append((chunk, part, 1, packed(counts[at[low : low + len(own)]]), *NOTHING, 0.0))
        low += len(own)
    for i in np.flatnonzero(counts > heavy_from):
        rows.append((_signed(distinct[i]), part, 3, None, *NOTHING, 0.0))
    rows.append((-1, part, 0, None, *_levels(counts), 0.0))
    return _answers(rows)


def _word_counts_of(chunk: Chunk, answers: pd.DataFrame) -> np.ndarray:
    """Corpus counts by word number, from the answers of the parts."""
    order, _ = chunk.word_order()
    got = answers[answers["kind"] == 1].sort_values("part")["answer"]
    counts = np.empty(len(order), np.int64)
    counts[order] = np.concatenate([unpacked(a, np.int64) for a in got])
    return counts


def _send_bigrams(chunk_id: int, chunk: Chunk, answers: pd.DataFrame, heavy: np.ndarray) -> pd.DataFrame:
    """Per part: histories with their numbers of bigrams, the words met with their corpus counts,
    and per bigram the number of its word and its training count."""
    corpus = _word_counts_of(chunk, answers)
    first, second, cuts, of_token, spread = chunk.bigrams(heavy)
    counts = np.bincount(of_token[chunk.trained], minlength=len(first))
    rows = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = first[cuts[p] : cuts[p + 1]], second[cuts[p] : cuts[p + 1]]
        histories, runs = np.unique(a, return_counts=True)
        met, at = np.unique(b, return_inverse=True)
        payload = joined(
            packed(chunk.words[histories]), packed(runs.astype(np.uint32)), packed(spread[histories]),
            packed(chunk.words[met]), packed(corpus[met]), packed(at.astype(np.uint32)),
            packed(counts[cuts[p] : cuts[p + 1]].astype(np.uint32)),
        )
        rows.append((p, chunk_id, payload))
    return sent(rows)


class Received:
    """The bigrams that one chunk sent to a part, unexpanded, and what the part found out about them."""

    def __init__(self, payload: bytes):
        h, runs, spread, met, corpus, at, own = split(payload, 7)
        self.histories, self.runs, self.spread = unpacked(h, np.uint64), unpacked(runs, np.uint32), unpacked(spread, bool)
        self.met, self.corpus = unpacked(met, np.uint64), unpacked(corpus, np.int64)
        self.at, self.own = unpacked(at, np.uint32), unpacked(own, np.uint32)
        self.back = np.empty(len(self.at), np.uint32)
        self.no_small = np.empty(len(self.histories), bool)
        self.seen = np.empty(len(self.histories))
        self.small = np.empty((GT_MOST, len(self.histories)), np.uint32)

    def of_range(self, i: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Which histories, and which bigrams, belong to a range of the histories' hashes."""
        own = (mixed(mixed(self.histories)) >> np.uint64(32)) % np.uint64(ranges) == i
        return own, np.repeat(own, self.runs)

    def answer(self) -> bytes:
        asked = np.zeros(len(self.histories), bool)  # histories with a bigram never seen in training
        asked[np.repeat(np.arange(len(asked)), self.runs)[self.back == 0]] = True
        asked &= ~self.spread
        return joined(
            packed(self.back), np.packbits(self.no_small).tobytes(), np.packbits(asked).tobytes(),
            packed(self.seen[asked]), *(packed(few[asked]) for few in self.small),
        )


def _serve_bigrams(part: int, received: pd.DataFrame, unigrams: Unigrams, at_once: int) -> pd.DataFrame:
    """Adds up every bigram; answers with its count, and per history with how many continuations
    have each small count and the probability of all its continuations.

    A history's bigrams lie in one range of hashes; ranges are added up one after the other, so what
    is expanded and sorted at a time is about ``at_once`` bigrams and at least one history's.
    """
    chunks = [Received(payload) for payload in received["payload"]]
    ranges = max(1, -(-sum(len(c.at) for c in chunks) // at_once))
    levels, spread_sums = np.zeros(len(LEVELS), np.int64), {}
    for i in range(ranges):
        levels += _serve_range(chunks, i, ranges, unigrams, spread_sums)
    numbers = received["chunk"].tolist()
    rows = [(n, part, 2, c.answer(), *NOTHING, 0.0) for n, c in zip(numbers, chunks)]
    rows += [(h, part, 3, None, *sums) for h, sums in sorted(spread_sums.items())]
    rows.append((-1, part, 0, None, *levels.tolist(), 0.0))
    return _answers(rows)


def _serve_range(chunks: list[Received], i: int, ranges: int, unigrams: Unigrams, spread_sums: dict) -> np.ndarray:
    """Notes the sums of one range of histories in ``chunks`` and ``spread_sums``; its counts of counts."""
    chosen = [c.of_range(i, ranges) for c in chunks]
    first = np.concatenate([np.repeat(c.histories[h], c.runs[h]) for c, (h, _) in zip(chunks, chosen)])
    if not len(first):
        return np.zeros(len(LEVELS), np.int64)
    second = np.concatenate([c.met[c.at[e]] for c, (_, e) in zip(chunks, chosen)])
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new_first = np.concatenate([[True], first[1:] != first[:-1]])
    starts = np.flatnonzero(new_first | np.concatenate([[True], second[1:] != second[:-1]]))
    groups = np.flatnonzero(new_first[starts])
    histories = first[starts][groups]
    del first, second, new_first
    own = np.concatenate([c.own[e] for c, (_, e) in zip(chunks, chosen)])
    counts = np.add.reduceat(own[order], starts, dtype=np.int64)
    corpus = np.concatenate([c.corpus[c.at[e]] for c, (_, e) in zip(chunks, chosen)])[order[starts]]
    count_of = np.empty(len(order), np.uint32)
    count_of[order] = np.repeat(counts, np.diff(np.append(starts, len(order))))

    chances = np.where(counts > 0, unigrams.probability(corpus), 0.0)
    seen = np.add.reduceat(chances, groups)
    small = np.stack([np.add.reduceat((counts == r).astype(np.int64), groups) for r in range(1, GT_MOST + 1)])
    no_small = small.sum(axis=0) == 0
    low = 0
    for c, (h, e) in zip(chunks, chosen):
        high = low + int(e.sum())
        c.back[e] = count_of[low:high]
        at = np.searchsorted(histories, c.histories[h])
        c.no_small[h], c.seen[h], c.small[:, h] = no_small[at], seen[at], small[:, at]
        low = high
        for k in at[c.spread[h]].tolist():
            spread_sums[_signed(histories[k])] = (0, *small[:, k].tolist(), 0, float(seen[k]))
    return np.array(_levels(counts), np.int64)


class Model:
    """What scoring needs beside the answers to a chunk; all of it bounded by HEAVY."""

    def __init__(self, unigrams: Unigrams, distinct: int, begins: int, heavy: np.ndarray):
        self.unigrams, self.distinct, self.begins, self.heavy = unigrams, distinct, begins, heavy
        self.discounts = good_turing([0] * (GT_MOST + 1))
        self.spread: dict[int, tuple] = {}  # history -> numbers of continuations per small count, their probability


def backoff(counts: np.ndarray, small: np.ndarray, seen: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """The exactly normalised backoff weight of histories with these counts, numbers of
    continuations per small count (one row each) and probability of all continuations."""
    rates = np.arange(1, GT_MOST + 1) * (1 - discounts[1:])
    given_up = rates @ small
    left = np.where(given_up > 0, given_up / np.maximum(counts, 1), 1 / (counts + 1))
    return np.where(counts > 0, left / (1 - seen), 1.0)


def _score(chunk: Chunk, answers: pd.DataFrame, model: Model) -> pd.DataFrame:
    uni = model.unigrams
    corpus = _word_counts_of(chunk, answers)
    history = corpus.copy()
    history[BEGIN] = model.begins
    first, second, cuts, of_token, spread = chunk.bigrams(model.heavy)
    got = answers[answers["kind"] == 2].sort_values("part")
    n = len(chunk.words)
    counts, small, seen, no_small = [], np.zeros((GT_MOST, n), np.int64), np.zeros(n), np.zeros(n, bool)
    for part, answer in zip(got["part"].tolist(), got["answer"]):
        own, flags, asked, chances, *numbers = split(answer, 4 + GT_MOST)
        counts.append(unpacked(own, np.uint32))
        histories = np.unique(first[cuts[part] : cuts[part + 1]])
        no_small[histories] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(histories)).astype(bool)
        at = histories[np.unpackbits(np.frombuffer(asked, np.uint8), count=len(histories)).astype(bool)]
        seen[at] = unpacked(chances, np.float64)
        for r, few in enumerate(numbers):
            small[r, at] = unpacked(few, np.uint32)
    for i in np.flatnonzero(spread).tolist():
        *few, chance = model.spread.get(_signed(chunk.words[i]), (0,) * (GT_MOST + 1))
        small[:, i], seen[i], no_small[i] = few, chance, not any(few)
    counts = np.concatenate(counts).astype(np.int64)
    full = np.maximum(history, 1).astype(np.float64)
    # A history without small counts gives up nothing: its words share count / (count + 1).
    scale = np.where(no_small, history / (history + 1.0), 1.0)
    d = model.discounts[np.where(counts <= GT_MOST, counts, 0)]
    below = np.log10(uni.probability(corpus))
    with np.errstate(divide="ignore"):
        weights = np.log10(backoff(history, small, seen, model.discounts))
        found = np.log10(d * counts * scale[first] / full[first])
    values = np.where(counts > 0, found, weights[first] + below[second])
    base = np.log10((corpus + 0.5) / (uni.tokens + 0.5 * (model.distinct + 1)))
    docs = len(chunk.sizes)
    add = lambda v: np.bincount(chunk.owner, weights=v, minlength=docs)
    return pd.DataFrame(
        {
            "doc_id": pd.array(chunk.doc_ids, "Int64"),
            "held_out": chunk.held,
            "n_tokens": chunk.sizes,
            "n_known": add((corpus[chunk.tokens] > 0).astype(np.float64)).astype(np.int64),
            "train_tokens": np.full(docs, uni.tokens),
            "base_score": add(base[chunk.tokens]),
            "score": add(values[of_token]),
        }
    )


def _chunk_of(frame: pd.DataFrame, parts: int) -> tuple[int, Chunk]:
    row = frame.iloc[0]
    return int(row["chunk"]), Chunk(row, parts)


def _totals(answers: DataFrame) -> list[int]:
    row = answers.filter("kind = 0").agg(*(F.sum(n).alias(n) for n in LEVELS)).first()
    return [int(row[n] or 0) for n in LEVELS]


def token_chunks(docs: DataFrame, held: Column, most: int = CHUNK_BYTES) -> DataFrame:
    """The documents as chunks of word numbers, in a table bucketed by chunk: later steps group
    chunks without moving them."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"), "text")
    made = rows.mapInArrow(lambda batches: _chunk_rows(batches, most), CHUNK)
    return bucketed(made, "token_chunks")


def score_documents(
    docs: DataFrame, held: Column, chunk_bytes: int = CHUNK_BYTES, entries: int = PART_ENTRIES, served: int = SERVED_AT_ONCE
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document;
    the model learns from those that are not ``held``."""
    chunks = token_chunks(docs, held, chunk_bytes)
    sums = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "n_train_docs"))).first()
    parts = max(1, -(-sums["n_tokens"] // entries))
    heavy_from = max(sums["n_train"] * HEAVY, 1)

    def send_words(frame: pd.DataFrame) -> pd.DataFrame:
        return _send_words(*_chunk_of(frame, parts))

    def serve_words(key: tuple, received: pd.DataFrame) -> pd.DataFrame:
        return _serve_words(int(key[0]), received, heavy_from)

    asked = chunks.groupBy("chunk").applyInPandas(send_words, SENT)
    words = stored(asked.groupBy("part").applyInPandas(serve_words, ANSWER), "katz-words")
    levels = _totals(words)
    most = int(1 / HEAVY)
    heavy = np.array([r["chunk"] for r in bounded(words.filter("kind = 3").select("chunk"), most, "heavy words")], np.int64)
    unigrams = Unigrams(sums["n_train"], levels[1:])
    model = Model(unigrams, levels[0], sums["n_train_docs"], heavy.view(np.uint64))
    lookup = words.filter("kind = 1").select("chunk", "part", "kind", "answer")

    def send_bigrams(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _send_bigrams(*_chunk_of(frame, parts), answers, model.heavy)

    def serve_bigrams(key: tuple, received: pd.DataFrame) -> pd.DataFrame:
        return _serve_bigrams(int(key[0]), received, unigrams, served)

    asked = chunks.groupBy("chunk").cogroup(lookup.groupBy("chunk")).applyInPandas(send_bigrams, SENT)
    bigrams = stored(asked.groupBy("part").applyInPandas(serve_bigrams, ANSWER), "katz-bigrams")
    model.discounts = good_turing(_totals(bigrams)[1:])
    few = [f"n{r}" for r in range(1, GT_MOST + 1)]
    spread = bigrams.filter("kind = 3").groupBy("chunk").agg(*(F.sum(c).alias(c) for c in [*few, "seen"]))
    model.spread = {r["chunk"]: tuple(r[c] for c in [*few, "seen"]) for r in bounded(spread, most + 1, "spread histories")}
    lookup = lookup.unionByName(bigrams.filter("kind = 2").select("chunk", "part", "kind", "answer"))

    def score(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _score(_chunk_of(frame, parts)[1], answers, model)

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(lookup.groupBy("chunk")).applyInPandas(score, out)


def op10_katz(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_documents(docs, crc_remainder(F.col("doc_id"), 5) == 1)
