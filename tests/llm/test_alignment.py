"""Token alignment against whole texts, every pair of tokens and plain counters."""

import hashlib
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from catalogspark.llm.queries import op13_token_alignment
from catalogspark.llm.token_alignment import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def by_hand(coders, texts: list[str | None]) -> list[tuple]:
    """Whole texts through the tokenizers; every pair of tokens of a group is tried for a common byte."""
    a, b = coders
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable}
    letter.update({chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)})

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    rows, held = [], Counter()
    for text in texts:
        row = None
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            p = [bytes(letter[c] for c in a.id_to_token(k)) for k in x]
            q = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
            raw = (" " + text).encode()
            if b"".join(p) == raw and b"".join(q) == raw:
                s, t = spans(p), spans(q)
                cuts = sorted({e for _, e in s} & {e for _, e in t})
                groups, links, at = [], [], [0, 0]
                for cut in cuts:
                    i, j = [], []
                    for own, z, side in ((i, s, 0), (j, t, 1)):
                        while at[side] < len(z) and z[at[side]][1] <= cut:
                            own.append(at[side])
                            at[side] += 1
                    groups.append(",".join(str(x[k]) for k in i) + "|" + ",".join(str(y[k]) for k in j))
                    links += [(x[k], y[m]) for k in i for m in j if s[k][0] < t[m][1] and t[m][0] < s[k][1]]
                held.update(set(links))
                row = (len(x), len(y), len(groups), links, ";".join(groups))
        rows.append(row)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    full = lambda r: (r[0], r[1], r[2], len(r[3]), sum(held[p] == most[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4])
    return [full(r) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


TEXTS = [
    None, "", " ", "  ", "\n", "\n\n x", "a  b\t c \n\n  d  ", "plain words, and more: it's 2024!", "plain words", "plain words", "▁ mark", "café naïve über", "\U0001f600 你好 क्ष",
    "<s> </s> <|endoftext|> <0x0A> [UNK]", "x\x1cy \x1d z", "\x00 \x01\x7f", "a b   c　d", "\r\n end \r\n", "é ﬁ Å", "word " * 500, "k" * 3000, "    indented\n        more", " lead", "trail ", ".\n", "﻿bom ​ zero", "1 22 333 4444 55555", "\u0085next",
]


def rows_of(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


@pytest.mark.parametrize("limit", [1 << 20, 40, 1])
def test_cases(spark, coders, limit):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"groups": F.lit(1), "row": F.lit(2), "n_a": F.lit(3)}).repartition(3)
    want = sorted((k, *r) for k, r in enumerate(by_hand(coders, TEXTS)))
    assert rows_of(align(df, A, B, broadcast_pairs=limit)) == want


def test_null_and_repeated_ids(spark, coders):
    texts = ["same words here", "same words here", "other words", None]
    df = spark.createDataFrame(list(zip([None, 7, 7, None], texts, strict=True)), "doc_id long, text string")
    want = Counter(by_hand(coders, texts))
    for limit in (1 << 20, 2):
        assert Counter(tuple(r)[1:] for r in align(df, A, B, broadcast_pairs=limit).collect()) == want
    assert align(df.limit(0), A, B).count() == 0


def test_query(spark, coders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: r for d, r in zip(docs, by_hand(coders, [d.text for d in docs]), strict=True)}
    got = op13_token_alignment(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[1:7] == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_what_is_forgotten_comes_back_the_same(coders, monkeypatch):
    """With little room most stretches are forgotten between runs, those met again stay."""
    import catalogspark.llm.token_alignment as module

    monkeypatch.setattr(module, "KEPT", 12)
    aligner = module.Aligner(A, B)
    texts = [t for t in TEXTS if t] + ["plain words again", "more plain words"]
    want = {t: r for t, r in zip(texts, by_hand(coders, texts), strict=True)}
    for round_ in range(3):
        for k in range(0, len(texts), 5):
            some = texts[k : k + 5]
            placed = aligner.place(some)
            numbers = aligner.sums(placed)
            for text, own, row in zip(some, placed, numbers, strict=True):
                groups = "" if row[-1] else ";".join(aligner.groups[n] for n in own)
                assert (*row[:4], groups) == (*want[text][:4], want[text][6]), (round_, text)
        assert len(aligner.at) < 40
