"""Alignment of two tokenizers' tokens over the same bytes.

Of each stretch of text the cumulative byte ends of both token lists go into end-to-index dictionaries; the ends that both
hold, sorted, slice the two id lists into groups, and a group's links are expanded slice by slice. A stretch is white space
and the word behind it: neither tokenizer merges over the place where a word ends and white space begins (which is looked
up in the vocabularies), so a stretch's groups are the same in every text and are kept while a task meets it again. Where
that doesn't hold, a text is one stretch.

Each text is read once: its numbers and pairs are stored, and so are the pairs' document counts of each task, which are
then added up. The counts of the most frequent pairs, a bounded number, come back to the stored rows by broadcast; what a
text holds of rarer pairs is joined."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tables import scratch, stored

#: Id pairs (17 bytes each) whose counts are broadcast, at most; rarer ones are joined.
BROADCAST_PAIRS = 1 << 20
#: Stretches, and characters of them, that a worker keeps besides those of the texts it is at.
KEPT, KEPT_CHARS = 250_000, 1 << 23
#: New stretches that are encoded in one call.
TOGETHER = 64
#: Characters of text that are worked on together.
CHARS_AT_ONCE = 1 << 20

_STRETCH = re.compile(r"\s*\S+|\s+")
#: White space for Python but not for the tokenizers' pattern.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_MARK = "▁"
#: Fixed value: how byte-level vocabularies of this kind split text before the merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches whose characters any version of Unicode puts in the same classes.
_COMMON = re.compile(r"[ \t\n!-~À-ÖØ-öø-ÿ]+")


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable characters stand for themselves, other bytes for U+0100 and up in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in same)}


def slices(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the cumulative byte ends of two token lists over the same bytes: where each group ends in the one and the other."""
    index_a = dict(zip(end_a.tolist(), range(1, len(end_a) + 1), strict=True))
    index_b = dict(zip(end_b.tolist(), range(1, len(end_b) + 1), strict=True))
    common = sorted(index_a.keys() & index_b.keys())
    return np.fromiter(map(index_a.__getitem__, common), np.int64), np.fromiter(map(index_b.__getitem__, common), np.int64)


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each link, by number. In a group no end but the last is common, so that between an end of either list
    and the next just one token of each goes on: that is a link, and each link is met once."""
    ends = np.union1d(end_a, end_b)
    return np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)


@dataclass
class PairCounts:
    """Id pairs (see ``Aligner.pair``) in order, the documents that hold each, and whether no pair of its first id is held
    by more."""

    pairs: np.ndarray
    n: np.ndarray
    best: np.ndarray

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether each pair is there)."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        return at, self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)


#: What is known of a stretch; ``wrong`` if a tokenizer doesn't give its bytes back.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "wrong")


def _ranked(path: str, letters: dict[str, int]):
    """A faster encoder of stretches in common letters, or None if the file's merges aren't in the order of their ids."""
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return None
    ranks = {bytes(letters[c] for c in t): k for t, k in vocabulary.items() if all(c in letters for c in t)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _gathered(pool: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of the lists ``rows`` behind each other, which of ``rows`` each is of); list k ends at ``ends[k + 1]``."""
    sizes = ends[rows + 1] - ends[rows]
    of = np.repeat(np.arange(len(rows)), sizes)
    return pool[np.arange(len(of)) + np.repeat(ends[rows] - np.cumsum(sizes) + sizes, sizes)], of


class Aligner:
    """Groups and links of stretches of text, each worked out once while it is kept."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_of_letter()
        self.ranked = _ranked(path_a, letters)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, k in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[k] = bytes(letters[c] for c in t) if all(c in letters for c in t) else b""
        self.a_sizes = np.fromiter(map(len, self.a_bytes), np.int64)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.b_ids = len(pieces)
        self.b_sizes = np.fromiter(map(len, self.b_bytes), np.int64)
        self.mark = self.b.piece_to_id(_MARK)
        several = [p.replace(_MARK, " ") for k, p in enumerate(pieces) if not self.b.is_byte(k) and len(p) > 1]
        #: whether no piece goes on with a blank, and white space that is part of longer pieces: texts with it aren't cut
        self.cuts_at_space = not any(re.search(r"\S ", p) for p in several)
        self.odd = re.compile("[" + re.escape(_ODD_SPACE + "".join(sorted({c for p in several for c in p if c != " " and c.isspace()}))) + "]")
        # an id of the first and of the second, followed by another of its own or not
        self.words = [f"{k}{end}" for ids, ends in ((len(self.a_bytes), ",|"), (self.b_ids, ",;")) for end in ends for k in range(ids)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.uses = np.zeros(0, np.int64)
        self.numbers = np.zeros((0, len(NUMBERS)), np.int64)
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def stretches(self, text: str) -> list[str]:
        """``text`` with a blank before it, cut where white space begins."""
        whole = " " + text
        return _STRETCH.findall(whole) if self.cuts_at_space and not self.odd.search(whole) else [whole]

    def _encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of some stretches behind each other. Neither tokenizer merges over their ends, so these are the ids of each."""
        a = self.ranked.encode_ordinary(text) if self.ranked and _COMMON.fullmatch(text) else self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            return a, [self.mark]
        # the processor puts a blank before the text: the text's own, or a mark that isn't of the text
        return a, self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]

    def _right(self, text: str, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == text.encode()

    def _encoded(self, stretches: list[str]) -> tuple[list[str], int, list[int], list[int]]:
        """(the stretches in a new order, the wrong ones last; how many are right; the ids of the right ones)."""
        runs: dict[bool, list[str]] = {True: [], False: []}
        alone = []
        for s in stretches:
            # white space alone ends a text; long stretches are texts of their own
            (alone if not self.cuts_at_space or s[-1].isspace() or len(s) > 100 else runs[_COMMON.fullmatch(s) is not None]).append(s)
        together = [own[k : k + TOGETHER] for own in runs.values() for k in range(0, len(own), TOGETHER)] + [[s] for s in alone]
        right, wrong, id_a, id_b = [], [], [], []
        while together:
            own = together.pop()
            a, b = self._encode(text := "".join(own))
            if self._right(text, a, b):
                right += own
                id_a += a
                id_b += b
            elif len(own) == 1:
                wrong += own
            else:
                together += [[s] for s in own]
        return right + wrong, len(right), id_a, id_b

    def _learn(self, stretches: list[str]) -> None:
        if not stretches:
            return
        stretches, n, id_a, id_b = self._encoded(stretches)
        # stretches behind each other on one axis of bytes; each ends with tokens of both
        id_a, id_b = np.array(id_a, np.int64), np.array(id_b, np.int64)
        end_a, end_b = np.cumsum(self.a_sizes[id_a]), np.cumsum(self.b_sizes[id_b])
        ends = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in stretches[:n]], dtype=np.int64)
        to_a, to_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        cut_a, cut_b = slices(end_a, end_b)
        link_a, link_b = links(end_a, end_b)
        last_a, last_b = np.zeros(len(id_a), np.int64), np.zeros(len(id_b), np.int64)
        last_a[cut_a - 1] = last_b[cut_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        word = np.concatenate([id_a + last_a * len(self.a_bytes), 2 * len(self.a_bytes) + id_b + last_b * self.b_ids])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = list(map(self.words.__getitem__, word[order].tolist()))
        to = (to_a + to_b).tolist()
        self.groups += ["".join(words[x:y])[:-1] for x, y in zip([0, *to], to, strict=False)] + [""] * (len(stretches) - n)

        rest = np.zeros(len(stretches) - n, np.int64)
        each = lambda to: np.concatenate([np.diff(to, prepend=0), rest])
        n_links = each(np.searchsorted(link_a, to_a))
        nothing = np.zeros(len(stretches), np.int64)
        known = [each(to_a), each(to_b), each(np.searchsorted(cut_a, to_a, "right")), n_links, np.concatenate([nothing[:n], rest + 1])]
        first = len(self.numbers)
        self.numbers = np.concatenate([self.numbers, np.stack(known, axis=1)])
        self.uses = np.concatenate([self.uses, nothing])
        self.pairs = np.concatenate([self.pairs, self.pair(id_a[link_a], id_b[link_b])])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_links)])
        self.at.update(zip(stretches, range(first, first + len(stretches)), strict=True))
        self.chars += sum(map(len, stretches))

    def _forget(self) -> None:
        """Keep the stretches that were met again, if that makes room."""
        stay = self.uses > 1
        kept = [s for s, k in self.at.items() if stay[k]]
        if len(kept) > KEPT // 2 or sum(map(len, kept)) > KEPT_CHARS // 2:
            self.clear()
            return
        rows = np.flatnonzero(stay)
        number = np.cumsum(stay) - 1
        self.at = {s: int(number[self.at[s]]) for s in kept}
        self.chars = sum(map(len, kept))
        self.groups = [self.groups[k] for k in rows]
        pooled = lambda pool, ends: (_gathered(pool, ends, rows)[0], np.concatenate([[0], np.cumsum(ends[rows + 1] - ends[rows])]))
        self.pairs, self.ends = pooled(self.pairs, self.ends)
        self.numbers, self.uses = self.numbers[rows], self.uses[rows] // 2

    def pair(self, a, b):
        """A pair of ids as one number."""
        return a * self.b_ids + b

    def place(self, texts: list[str]) -> list[list[int]]:
        """The stretches of each text by number; the numbers hold until the next call."""
        if len(self.at) > KEPT or self.chars > KEPT_CHARS:
            self._forget()
        cut = [self.stretches(t) if t else [] for t in texts]
        self._learn(list(set(chain.from_iterable(cut)) - self.at.keys()))
        placed = [list(map(self.at.__getitem__, own)) for own in cut]
        self.uses += np.bincount(np.fromiter(chain.from_iterable(placed), np.int64), minlength=len(self.uses))
        return placed

    def sums(self, placed: list[list[int]]) -> np.ndarray:
        """A row of NUMBERS for each text, zeros but for ``wrong`` where a stretch is wrong."""
        flat = np.fromiter(chain.from_iterable(placed), np.int64)
        added = np.zeros((len(flat) + 1, len(NUMBERS)), np.int64)
        np.cumsum(self.numbers[flat], axis=0, out=added[1:])
        ends = np.cumsum([0, *map(len, placed)])
        out = added[ends[1:]] - added[ends[:-1]]
        out[out[:, -1] > 0, :-1] = 0
        return out

    def links_of(self, placed: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, how often) of the pairs that each text links, in order of text and pair."""
        flat = np.fromiter(chain.from_iterable(placed), np.int64)
        pairs, of = _gathered(self.pairs, self.ends, flat)
        text = np.repeat(np.arange(len(placed)), [len(p) for p in placed])[of]
        both, times = np.unique(text << 40 | pairs, return_counts=True)  # two ids' product is well under 40 bits
        return both >> 40, both & (1 << 40) - 1, times


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a worker, so that what it has learned serves the next."""
    return Aligner(path_a, path_b)


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of bounded size; null is empty."""
    first, run, chars = 0, [], 0
    for k, text in enumerate(texts):
        run.append(text.as_py() or "")
        chars += len(run[-1])
        if chars >= CHARS_AT_ONCE:
            yield first, run
            first, run, chars = k + 1, [], 0
    if run:
        yield first, run


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


class _Tally:
    """Counts of pairs of a task, added up when there are many parts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pairs: np.ndarray) -> None:
        self.parts.append(np.unique(pairs, return_counts=True))
        if len(self.parts) > 32:
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, of = np.unique(np.concatenate([p for p, _ in self.parts]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, of, np.concatenate([n for _, n in self.parts]))
        return pairs, n


_COLUMNS = ", ".join(f"{n} long" for n in NUMBERS[:-1]) + ", groups string, pairs array<long>, times array<int>"


def _read(path_a: str, path_b: str, digest: bool):
    """A row for each text, and at the end a row for each pair of the task with the number of texts that hold it."""

    def run(batches):
        aligner, tally, kind = _aligner(path_a, path_b), _Tally(), None
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for first, texts in _runs(batch.column("text")):
                placed = aligner.place(texts)
                numbers = aligner.sums(placed)
                good = [p if not bad else [] for p, bad in zip(placed, numbers[:, -1], strict=True)]
                text, pairs, times = aligner.links_of(good)
                tally.add(pairs)
                groups = [";".join([aligner.groups[k] for k in p]) for p in good]
                ends = pa.array(np.searchsorted(text, np.arange(len(good) + 1)).astype(np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(first, len(texts)),
                        **{name: pa.array(numbers[:, k], pa.int64()) for k, name in enumerate(NUMBERS[:-1])},
                        "groups": pa.array(map(_sha256, groups) if digest else groups, pa.string()),
                        "pairs": pa.ListArray.from_arrays(ends, pa.array(pairs)),
                        "times": pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                        "row": pa.array(np.arange(row, row + len(texts)), pa.int64()),
                        "pair": pa.nulls(len(texts), pa.int64()),
                        "n": pa.nulls(len(texts), pa.int64()),
                    }
                )
                row += len(texts)
        pairs, n = tally.total()
        if len(pairs):
            lists = {"groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32()), "row": pa.int64()}
            nothing = {"doc_id": kind, **dict.fromkeys(NUMBERS[:-1], pa.int64()), **lists}
            yield pa.record_batch({**{name: pa.nulls(len(pairs), t) for name, t in nothing.items()}, "pair": pa.array(pairs), "n": pa.array(n)})

    return run


def _weighed(counts, rare: bool):
    """n_best and count_sum of stored rows; with ``rare`` their links whose pairs have no count yet."""

    def run(batches):
        known = counts.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
            ends = np.concatenate([[0], np.cumsum(batch.column("pairs").value_lengths().to_numpy())])
            at, there = known.of(pairs)
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")}
            for name, values in (("n_best", known.best), ("count_sum", known.n)):
                own = np.where(there, values[at], 0) * times if len(values) else np.zeros(len(pairs), np.int64)
                columns[name] = pa.array(np.diff(np.concatenate([[0], np.cumsum(own)])[ends]), pa.int64())
            if rare:
                left = pa.array(np.concatenate([[0], np.cumsum(~there)])[ends].astype(np.int32))
                columns["pairs"] = pa.ListArray.from_arrays(left, pa.array(pairs[~there]))
                columns["times"] = pa.ListArray.from_arrays(left, pa.array(times[~there].astype(np.int32)))
            yield pa.record_batch(columns)

    return run


def pair_counts(read: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): id pairs linked anywhere as one number, the rows that hold each, and whether no pair of its first id
    is held by more. A first id has no more pairs than the second tokenizer has ids."""
    held = read.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.floor(F.col("pair") / ids_b))
    return held.withColumn("best", F.col("n") == F.max("n").over(own))


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row of ``docs(doc_id, text, ...)``.

    The first tokenizer (a ``tokenizers`` file, byte-level) encodes a blank and the text, the second (a ``sentencepiece``
    model that puts the blank there itself) the text. ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids between bytes where both
    tokenizers end a token; with ``digest`` its SHA-256, so that the texts of the groups are neither kept nor moved. A link
    is an occurrence of two tokens that share a byte; the count of its id pair is the number of rows that hold it linked.
    ``n_best`` counts links whose pair has the highest count of its first id, ties included; ``count_sum`` adds the counts
    of all links.

    Null and empty texts and texts whose tokens don't give blank and text back byte by byte (such as any with U+2581) have
    no tokens: zeros and an empty text. Rows with a null or repeated doc_id are rows of their own. Strings of special
    tokens are ordinary text. An empty table gives no rows; further columns are ignored."""
    import sentencepiece

    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    kind = f"doc_id {dict(source.dtypes)['doc_id']}"
    ids_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    with scratch() as keep:
        read = keep(stored(source.mapInArrow(_read(path_a, path_b, digest), f"{kind}, {_COLUMNS}, row long, pair long, n long"), "aligned", "zstd"))
        counts = keep(stored(pair_counts(read, ids_b), "pairs"))
        found = counts.count()
        frequent = counts
        if found > broadcast_pairs:  # those above a quantile of the counts; the others are joined
            limit = counts.agg(F.percentile_approx("n", 1 - broadcast_pairs / found, 100_000)).first()[0]
            frequent = counts.where(F.col("n") > limit)
        table = frequent.orderBy("pair").toArrow()
        known = spark.sparkContext.broadcast(PairCounts(*(table.column(c).to_numpy() for c in ("pair", "n", "best"))))
        rows = read.where("pair is null").drop("pair", "n")
        numbers = f"{kind}, " + ", ".join(f"{n} long" for n in NUMBERS[:-1]) + ", groups string"
        result = [*NUMBERS[:-1], "n_best", "count_sum", "groups"]
        if found <= broadcast_pairs:
            return rows.drop("row").mapInArrow(_weighed(known, False), f"{numbers}, n_best long, count_sum long").select("doc_id", *result)
        part = keep(stored(rows.mapInArrow(_weighed(known, True), f"{numbers}, row long, n_best long, count_sum long, pairs array<long>, times array<int>"), "weighed", "zstd"))
    links = part.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("t"))))
    added = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    full = part.drop("pairs", "times").join(added, "row", "left")
    sums = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return full.withColumns(sums).select("doc_id", *result)
