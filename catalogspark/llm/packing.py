"""Hierarchical packing: documents go to context-size tiers, every tier fills its own windows, gaps in long windows are
filled from shorter tiers, and all windows are dealt to step groups of equal token count.

Each partition packs its own rows in one streaming pass with bounded pools; no text is gathered or shuffled. Its last
open windows are cut to powers of two, so that padding doesn't grow with the number of partitions. Groups are numbered
over all partitions afterwards, from the number of windows of each."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, deque
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored

END_ID = 2
#: Distinct words whose ids a task keeps, at most.
WORDS_KEPT = 300_000
#: Documents that are tokenized together.
DOCS_AT_ONCE = 512

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, part long, nth long"


def _letter_merges(path: str):
    """A fast encoder of words of basic Latin letters and accented ones, or None if the file's merges aren't in the
    order of their ids.

    The file's symbols are bytes, of which the last in a word is another symbol than the same byte before it. Here
    both kinds get a byte value of their own, so that a merge by ranks of byte strings gives the file's ids."""
    import tiktoken

    data = json.loads(Path(path).read_text())
    vocabulary, merges = data["model"]["vocab"], data["model"]["merges"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if data["model"]["end_of_word_suffix"] != "</w>" or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    inner = [*range(97, 123), 0xC3, *range(0x80, 0xC0)]
    inner_code = {b: k for k, b in enumerate(inner)}
    final_code = {b: len(inner) + k for k, b in enumerate(x for x in inner if x != 0xC3)}
    # the byte-level alphabet: printable characters stand for themselves, the other bytes for 256 and up in order
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in same)}
    ranks = {}
    for token, number in vocabulary.items():
        ends = token.endswith("</w>")
        symbols = [byte_of.get(c) for c in token.removesuffix("</w>")]
        if symbols and all(x in inner_code for x in symbols) and not (ends and symbols[-1] == 0xC3):
            last = final_code[symbols[-1]] if ends else inner_code[symbols[-1]]
            ranks[bytes([*[inner_code[x] for x in symbols[:-1]], last])] = number
    if any(bytes([c]) not in ranks for c in [*inner_code.values(), *final_code.values()]):
        return None
    inner_table = bytes(inner_code.get(b, 255) for b in range(256))
    final_table = bytes(final_code.get(b, 255) for b in range(256))
    core = tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(word: str) -> list[int]:
        raw = word.encode()
        return core.encode_single_piece(raw[:-1].translate(inner_table) + raw[-1:].translate(final_table))

    return encode


#: A word of letters with at most punctuation behind it: the two are encoded apart.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


class WordTokenizer:
    """Token ids of many texts, each distinct word encoded once per worker while it is kept.

    Right for tokenizers that lower the case, drop white space before the merges and split letters from punctuation;
    texts are cut at blanks and line ends only. Words of letters go through :func:`_letter_merges`, all others through
    the tokenizer itself; special tokens' strings within a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.letters = _letter_merges(path)
        self.tails: dict[str, list[int]] = {"": []}
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"\n": 0}  # no word holds a line end: that entry is the end of a text
        self.sizes = np.ones(1, np.int64)
        self.pool = np.array([END_ID], np.uint32)

    def _tail(self, text: str) -> list[int]:
        if text not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": []}
            self.tails[text] = self.plain.encode(text, add_special_tokens=False).ids
        return self.tails[text]

    def _learn(self, words: list[str]) -> None:
        if len(self.at) > WORDS_KEPT:
            self._clear()
        new = [w for w in words if w not in self.at]
        coded: list[list[int] | None] = [None] * len(new)
        if self.letters:
            for k, w in enumerate(new):
                if found := _LETTERS.fullmatch(w):
                    coded[k] = self.letters(found[1].lower()) + self._tail(found[2])
        rest = [k for k, c in enumerate(coded) if c is None]
        for k, c in zip(rest, self.plain.encode_batch([new[k] for k in rest], add_special_tokens=False), strict=True):
            coded[k] = c.ids
        for w in new:
            self.at[w] = len(self.at)
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in coded], np.int64)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(coded), np.uint32)])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text its ids and END_ID."""
        lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[ \n]")
        flat = pc.list_flatten(lists)
        coded = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn(words)
        code = np.array([self.at[w] for w in words], np.int64)[coded.indices.to_numpy()]
        code = np.insert(code, np.cumsum(pc.list_value_length(lists).to_numpy()), 0)
        starts = np.cumsum(self.sizes) - self.sizes
        n = self.sizes[code]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(starts[code] - (ends - n), n) + np.arange(ends[-1])]
        return np.split(ids, ends[np.flatnonzero(code == 0)])[:-1]


@cache
def _tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker."""
    return WordTokenizer(path)


class _Piece:
    """Ids of a document from ``start`` on."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start, ids, total):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class HierarchicalPacker:
    """Packs the documents of one partition; ``out`` collects finished pieces."""

    def __init__(self, tiers: tuple[int, ...], pool_docs: int, part: int):
        self.tiers, self.pool_docs, self.part = tiers, pool_docs, part
        self.sizes: list[list[int]] = [[] for _ in tiers]  # of the pieces that wait in each tier, sorted, each size once
        self.waiting: dict[int, deque[_Piece]] = {}  # pieces of a size in order of arrival
        self.docs, self.tokens = [0] * len(tiers), [0] * len(tiers)  # waiting in each tier
        self.sequences = 0
        self.written: Counter[int] = Counter()  # sequences of each window
        self.out: list[tuple] = []

    def _tier(self, size: int) -> int:
        return bisect_left(self.tiers, size)

    def _put(self, piece: _Piece) -> None:
        size = len(piece.ids)
        k = self._tier(size)
        if size not in self.waiting:
            self.waiting[size] = deque()
            insort(self.sizes[k], size)
        self.waiting[size].append(piece)
        self.docs[k] += 1
        self.tokens[k] += size

    def _pop(self, size: int) -> _Piece:
        k, queue = self._tier(size), self.waiting[size]
        piece = queue.popleft()
        if not queue:
            del self.waiting[size]
            del self.sizes[k][bisect_left(self.sizes[k], size)]
        self.docs[k] -= 1
        self.tokens[k] -= size
        return piece

    def _fitting(self, room: int, below: int) -> list[int]:
        """Sizes of waiting pieces of the tiers up to ``below`` to put next: one or two that fill ``room`` exactly, else the
        longest that fits."""
        if room <= self.tiers[below] and room in self.waiting:
            return [room]
        for k in range(below + 1):
            for size in self.sizes[k]:
                other = room - size
                if other < size:
                    break
                if other <= self.tiers[below] and other in self.waiting and (other > size or len(self.waiting[size]) > 1):
                    return [other, size]
        for k in range(below, -1, -1):
            at = bisect_right(self.sizes[k], room)
            if at:
                return [self.sizes[k][at - 1]]
        return []

    def _write(self, pieces: list[_Piece], window: int) -> None:
        at, number = 0, (self.part << 36) + self.sequences
        for p in pieces:
            crc = zlib.crc32(p.ids.astype("<u4").tobytes())
            self.out.append((p.doc, p.start, len(p.ids), crc, p.total, number, at, window, self.part, self.written[window]))
            at += len(p.ids)
        self.sequences += 1
        self.written[window] += 1

    def _fill(self, window: int, pieces: list[_Piece], below: int) -> None:
        """Complete one window: whole pieces that fit, and only if none does the head of one more."""
        room = window - sum(len(p.ids) for p in pieces)
        while room and (sizes := self._fitting(room, below)):
            for size in sizes:
                pieces.append(self._pop(size))
                room -= size
        if room and (longer := next((s[0] for s in reversed(self.sizes[: below + 1]) if s), None)):
            head, tail = self._pop(longer).cut(room)
            pieces.append(head)
            self._put(tail)
        self._write(pieces, window)

    def add(self, doc, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        piece = _Piece(doc, 0, ids, len(ids))
        while len(piece.ids) > top:
            head, piece = piece.cut(top)
            self._write([head], top)
        self._put(piece)
        last = len(self.tiers) - 1
        while self.docs[last] > self.pool_docs and sum(self.tokens) >= 2 * top:
            size = self.sizes[last][-1]
            self._fill(top, [self._pop(size)], last - 1 if sum(self.tokens[:last]) >= top - size else last)
        for k in range(last):
            while self.docs[k] > self.pool_docs and self.tokens[k] >= self.tiers[k]:
                self._fill(self.tiers[k], [], k)

    def finish(self) -> None:
        last, top = len(self.tiers) - 1, self.tiers[-1]
        while sum(self.tokens) >= top:
            self._fill(top, [], last)
        while rest := sum(self.tokens):  # powers of two need no padding
            self._fill(1 << (rest.bit_length() - 1), [], last)


def _pack(path: str, tiers: tuple[int, ...], pool_docs: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        packer = HierarchicalPacker(tiers, pool_docs, TaskContext.get().partitionId())
        names = [f.strip().split(" ")[0] for f in _PIECES.split(",")]

        def flush():
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in zip(names, columns, strict=True)})

        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids = part.column("doc_id").to_pylist()
                for doc, tokens in zip(ids, tokenizer(part.column("text")), strict=True):
                    packer.add(doc, tokens)
                if len(packer.out) >= 2000:
                    yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096),
    group_tokens: int = 65536,
    pool_docs: int = 64,
) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of at most ``tiers[-1]`` tokens; one row per piece of a document.

    A document is its token ids and then END_ID; a null or empty text is END_ID alone. Every id lies in exactly one
    piece; pieces of a sequence stand at gapless offsets from 0. ``window`` is the sequence's length: a tier, or a
    smaller power of two for the last tokens of a partition, so that no sequence needs padding. Sequences of a
    ``step_group`` have ``group_tokens`` tokens together, a power of two from ``tiers[-1]``; only the last group of all
    can have fewer. ``tiers`` are ascending powers of two.

    Sequences depend on how rows lie in partitions, not on the order of tasks: a task that runs again gives the same
    rows for the same partition. Repeated rows and null ids are packed like others; an empty table gives no pieces;
    further columns are ignored."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    if group_tokens & (group_tokens - 1) or group_tokens < tiers[-1]:
        raise ValueError("group_tokens must be a power of two, of the longest tier at least")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(source.mapInArrow(_pack(tokenizer_path, tuple(tiers), pool_docs), _PIECES), "pieces", "zstd")
    return _in_groups(pieces, group_tokens)


def _in_groups(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """``pieces`` with ``step_group``: sequences in order of window, the longest first, each ``group_tokens`` tokens of
    that order. Windows are powers of two, so no window lies across a group's end. What is counted is a row for each
    partition and window; the sums of whole windows, a row for each power of two, pass the driver."""
    counts = stored(pieces.groupBy("part", "window").agg(((F.max("nth") + 1) * F.col("window")).alias("tokens")), "counts")
    longer, before = 0, F.lit(0).cast("long")
    for r in counts.groupBy("window").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("window")).collect():
        before = F.when(F.col("window") == r["window"], F.lit(longer)).otherwise(before)
        longer += r["tokens"]
    earlier = F.sum("tokens").over(Window.partitionBy("window").orderBy("part")) - F.col("tokens")
    starts = stored(counts.select("part", "window", (before + earlier).alias("at")), "starts")
    group = F.floor((F.col("at") + F.col("nth") * F.col("window")) / group_tokens).cast("long")
    return pieces.join(starts, ["part", "window"]).select(*[f.strip().split(" ")[0] for f in _PIECES.split(",")[:8]], group.alias("step_group"))
