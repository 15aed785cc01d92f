import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftmark.llm import packing
from siftmark.llm.common import resource


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(resource("word_bpe_49k.json"))


def texts(n=150):
    rng = random.Random(8)
    parts = ["the", "Ring", "éa", "ßtz", "'s", "don't", "12,5", "4.0.", "...", "x", "ñadoobo", "ÉCOLE", "Σίσυφος", "日本語", "áb", " ", "\x1c", "🙂", "İx", "I'LL", "<|", "--", "ǅ", "é!"]
    out = [" ".join(rng.choice(parts) + rng.choice(["", "", ".", "!", ","]) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(n)]
    return out + ["", "   ", "word" * 3000, "no stop " * 4000, "<|endoftext|> and <|startoftext|>"]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encoder = packing.WordEncoder(resource("word_bpe_49k.json"))
    for text in texts():
        assert encoder.encode(text)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def check(rows, docs, tokenizer):
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[doc]) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(want[doc][r["start"] : at], "<u4").tobytes())
        assert at == len(want[doc])
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / total


def test_round_trip_and_little_padding(docs_of, tokenizer, monkeypatch):
    docs = [(i, t) for i, t in enumerate(texts(400))] + [(9000, None)]
    assert check(packing.pack(docs_of(docs).coalesce(2)).collect(), docs, tokenizer) < 0.03
    monkeypatch.setattr(packing, "HELD", 4096)
    encoder, packer, pieces = packing.WordEncoder(resource("word_bpe_49k.json")), packing.Packer(), []
    for i, t in docs:
        ids, ends = encoder.encode(t or "")
        pieces += packer.feed((i, np.append(ids, 1)), np.append(ends, True))
    pieces += packer.finish()
    rows = [{"doc_id": d[0], "start": s, "length": n, "doc_tokens": len(d[1]), "sequence_id": q, "offset": o, "ids_crc32": zlib.crc32(d[1][s : s + n].astype("<u4").tobytes())} for d, s, n, q, o in pieces]
    assert check(rows, docs, tokenizer) < 0.2


def test_queue_finds_the_best_cuts():
    rng = random.Random(3)
    for _ in range(60):
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + rng.randint(1, 9))
        penalty = [0] + [rng.choice([0, 2, 5]) for _ in places[1:]]
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if places[j] - places[i] <= 10:
                    best[j] = min(best[j], best[i] + 10 - places[j] + places[i] + penalty[j])
        cuts = packing.best_cuts(np.array(places), np.array(penalty), 10)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        assert sum(10 - places[b] + places[a] + penalty[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_ids_come_out_on_demand(docs_of, tokenizer):
    rows = packing.pack(docs_of([(1, "some text."), (1, "some text."), (None, "x")]), with_ids=True).collect()
    assert sorted(len(r["ids"]) for r in rows) == sorted(r["length"] for r in rows) and len({r["sequence_id"] for r in rows}) >= 1


def test_empty_table(docs_of):
    assert packing.pack(docs_of([])).count() == 0
