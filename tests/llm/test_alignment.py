import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from odd_rows import LONG, NASTY
from tokenizers import Tokenizer

from isobar.llm import alignment as module
from isobar.llm.alignment import NEUTRAL, Known, align, compose, fragment, whole
from isobar.llm.queries import tokenizer_spec

PATH_B = public_tokenizers.path("piece_bpe_32k.model")
SPEC_A, SPEC_B = tokenizer_spec("byte_bpe_50k.json"), open(PATH_B, "rb").read()
A = Tokenizer.from_str(SPEC_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
BYTES = {c: bytes([b]) for c, b in module._byte_of().items()}


def groups_of(text):
    """Groups by whole encodings and a walk over both, or None."""
    data = b" " + (text or "").encode()
    if not text:
        return None
    sides = []
    for ids, raw in (
        (A.encode(" " + text, add_special_tokens=False).ids, lambda i: b"".join(BYTES[c] for c in A.id_to_token(i))),
        (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()),
    ):
        pieces = [raw(i) for i in ids]
        if b"".join(pieces) != data:
            return None
        ends, at = [], 0
        for p in pieces:
            at += len(p)
            ends.append(at)
        sides.append(list(zip(ids, ends)))
    common = {e for _, e in sides[0]} & {e for _, e in sides[1]}
    out = []
    for side in sides:
        parts, own = [], []
        for i, end in side:
            own.append(i)
            if end in common:
                parts.append(own)
                own = []
        out.append(parts)
    return list(zip(*out))


def brute_force(rows):
    made = [(i, groups_of(t)) for i, t in rows]
    count = Counter(p for _, g in made for p in {(a, b) for x, y in g or [] for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, g in made:
        links = [(a, b) for x, y in g or [] for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((
            i, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def check(rows, result):
    found = sorted((tuple(r) for r in result.collect()), key=repr)
    assert found == sorted(brute_force(rows), key=repr)


ODD = [
    "a  b\t\tc \n\n d\n e\nf", "x\n\ny", "x \ny", "x\n y", "x  y　\nz", "  a", "It's  <s> </s> <|endoftext|> <0x41> ▁ x",
    "<|endoftext|>", " leading", "trailing  ", "\n", "漢字 かな\n漢", "é\nü x\n— y", "a\u0085b c", "1234 56,78 9.0", "'s 't x's", "é x", "\x1c x \x1f", "",
]


def test_whole_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(rows, align(docs(rows), SPEC_A, SPEC_B))


def test_odd_rows(docs, monkeypatch):
    rows = NASTY + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "x" * 70_000), (201, LONG[:-1] + "é " * 30_000), (201, "漢" * 20_000 + " a b")]
    check(rows, align(docs(rows), SPEC_A, SPEC_B))
    monkeypatch.setattr(module, "FREQUENT", 5)
    check(rows, align(docs(rows), SPEC_A, SPEC_B))
    assert align(docs([]), SPEC_A, SPEC_B).collect() == []


def same(x, y):
    return (x.good, x.closed, tuple(map(list, x.prefix)), tuple(map(list, x.suffix)), list(map(int, x.n)), x.groups, x.codes.tolist(), x.weights.tolist()) == (
        y.good, y.closed, tuple(map(list, y.prefix)), tuple(map(list, y.suffix)), list(map(int, y.n)), y.groups, y.codes.tolist(), y.weights.tolist())


@pytest.mark.parametrize("seed", range(6))
def test_fragments_form_a_monoid(seed):
    """Any byte ranges, joined in any order of joining, give the fragment of the whole."""
    rng, known = random.Random(seed), Known(SPEC_A, SPEC_B)
    text = " ".join(rng.choice(ODD + ["hello world", "unbelievable", "Schifffahrt"]) for _ in range(12)).replace("▁", "_")
    data = b" " + text.encode()
    cuts = [0, *sorted(rng.sample(range(1, len(data)), 9)), len(data)]
    parts = [fragment(known, data, a, b, True) for a, b in zip(cuts, cuts[1:])]
    left = NEUTRAL
    for p in parts:
        left = compose(left, p)
    right = NEUTRAL
    for p in reversed(parts):
        right = compose(p, right)
    once = fragment(known, data, 0, len(data), True)
    assert same(left, right) and same(left, once)
    expected = groups_of(text)
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in expected) + ";"
    assert whole(left).groups == text.encode() and whole(left).good


def test_pairs_of_a_group_with_many_links(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 50), rng.integers(0, 9, 40)
    few = module._linked(a, b, np.array([0, 20, 50]), np.array([0, 30, 40]), np.array([0, 1]))
    monkeypatch.setattr(module, "_MANY", 0)
    many = module._linked(a, b, np.array([0, 20, 50]), np.array([0, 30, 40]), np.array([0, 1]))
    assert all(np.array_equal(x, y) for x, y in zip(few, many))


def test_what_a_worker_remembers_is_bounded_in_bytes(monkeypatch):
    """However long the units are; what was forgotten is learnt again, to the same groups and scores."""
    known = Known(SPEC_A, SPEC_B)
    table = {"key": "t", "codes": np.arange(0, 1 << 31, 5000), "counts": np.arange(0, 1 << 31, 5000) % 9, "best": np.arange(0, 1 << 31, 5000) % 2 == 0}

    def seen(text):
        data = np.frombuffer(b" " + text.encode(), np.uint8)
        slots, _ = known.units(data, np.array([0, len(data)]))
        known.score(table)
        return [v.tolist() for v in (known.good[slots], known.n[slots], *known.text.gather(slots), *known.pairs.gather(slots), known.scores[slots], *known.rare.gather(slots))]

    rng = random.Random(5)
    texts = ["".join(rng.choice("漢字かな人大小中") for _ in range(4000)) + " a b" for _ in range(30)]
    first = [seen(t) for t in texts]
    monkeypatch.setattr(module, "HELD", 200_000)
    held = []
    for text, expected in zip(texts, first):
        assert seen(text) == expected
        held.append(known.bytes)
    assert max(held[1:]) < 600_000
