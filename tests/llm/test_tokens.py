import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from remitweave.llm import binary_output, packing, token_counts
from remitweave.llm.tokens import PieceEncoder

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def direct(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "style"), [(BYTES, "spaced"), (WORDS, "unspaced")])
def test_pieces_give_the_texts_ids(path, style):
    ours, plain = PieceEncoder(path, style), direct(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from(list("aAbß ~'s\n\t .,!1é́ \x85\x1f<|>x中\U0001f600ΣΟ")), max_size=40))
    def check(text):
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == plain(text)

    check()
    odd = ["", None, " ", "  a", "a ", "a  b", "~ ~", "it's we'll", "<|endoftext|> <|startoftext|>", "a \n b", "x" * 5000]
    for text, ids in zip(odd, ours.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_packing_holds_every_id_once(odd_docs):
    rows, plain = [(r["doc_id"], r["text"]) for r in odd_docs.collect()], direct(BYTES)
    pieces = packing.pack(odd_docs, BYTES).collect()
    want = sorted(repr((i, [*plain(t), 0])) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        by_doc.setdefault((p["id"], p["doc_tokens"]), []).append((p["start"], ids))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(len(plain(t)) + 1 for _, t in rows)
    assert sum(p["length"] for p in pieces) == total
    lengths = [sum(n for _, n in spans) for spans in by_sequence.values()]
    assert all(n & (n - 1) == 0 for n in lengths)  # no padding at all
    assert sum(n < 1024 for n in lengths) <= 10
    single = {k: v for k, v in by_doc.items() if sum(i == k[0] for i, _ in rows) == 1}
    for (ident, n), spans in single.items():
        ids = [x for _, part in sorted(spans) for x in part]
        assert len(ids) == n and repr((ident, ids)) in want


def test_packing_balances_cost():
    rng = random.Random(1)
    pieces = [(rng.randint(1, 1023), k) for k in range(400)]
    seqs, left = packing.assign(pieces, 1024, 1.0, 1 / 1024, True)
    assert not left and sum(b - a for s in seqs for _, a, b in s) == sum(n for n, _ in pieces)
    assert sum(1024 == sum(b - a for _, a, b in s) for s in seqs) == sum(n for n, _ in pieces) // 1024
    seqs, left = packing.assign(pieces, 1024, 1.0, 1 / 1024, False)
    assert all(sum(b - a for _, a, b in s) == 1024 for s in seqs) and sum(b - a for _, a, b in left) < 1024


def test_pieces_go_whole_to_the_cheapest_sequence_that_holds_them():
    rng = random.Random(2)
    pieces = [(rng.randint(1, 60), k) for k in range(300)]
    seqs, left = packing.assign(pieces, 64, 1.0, 1 / 64, True)
    room, spent, at = packing.capacities(sum(n for n, _ in pieces), 64, True), None, {k: [] for _, k in pieces}
    spent = [0.0] * len(room)
    for i, s in enumerate(seqs):
        for key, a, b in s:
            at[key].append((a, b, i))
    for n, key in sorted(pieces, key=lambda x: (-x[0], x[1])):
        holders = [i for i, r in enumerate(room) if r >= n]
        if holders:  # never cut if a sequence holds it, and then put where cost is least
            assert len(at[key]) == 1 and spent[at[key][0][2]] == min(spent[i] for i in holders)
        for a, b, i in at[key]:
            room[i] -= b - a
            spent[i] += packing.cost(b - a, 1.0, 1 / 64)
    assert not left and not any(room)


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('some words ', cast(5 + pow(id * 7 % 500, 2) / 600 AS int)) AS text", "'x' AS ids", "1 AS offset")
    cut = {}
    for partitions in (1, 64, 211, 500):
        found = packing.pack(docs.repartition(partitions), BYTES, with_ids=False).toPandas()
        lengths = found.groupby("sequence_id").length.sum()
        total = int(found.length.sum())
        assert all(n & (n - 1) == 0 and n <= 1024 for n in lengths)  # no padding at all
        assert (lengths < 1024).sum() <= 10 and len(lengths) <= total // 1024 + 10
        assert (found.groupby("id").length.sum() == found.groupby("id").doc_tokens.first()).all()
        cut[partitions] = (found[found.doc_tokens <= 1024].groupby("id").size() > 1).mean()
    # documents that would fit a sequence are cut as seldom as from one partition
    assert max(cut.values()) <= cut[1] + 0.02 and cut[1] <= 0.25


def test_pools_of_tasks_and_of_their_rests(spark, monkeypatch):
    # tiny pools, so that tasks pack their own rows, and rests are brought together in several groups
    monkeypatch.setattr(packing, "POOL", 6000)
    monkeypatch.setattr(packing, "ENOUGH", 3000)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('some words ', cast(id AS int)) AS text").repartition(12)
    found = packing.pack(docs, BYTES).toPandas()
    lengths = found.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 and n <= 1024 for n in lengths)
    for _, doc in found.sort_values("start").groupby("id"):
        assert doc.length.sum() == doc.doc_tokens.iloc[0] and (doc.start == doc.length.cumsum() - doc.length).all()
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_codes_round_trip(numbers):
    a = np.array(numbers, np.uint32)
    control, data = binary_output.encode_ranks(a)
    assert len(control) == -(-len(a) // 4)
    assert binary_output.decode_ranks(control, data, len(a)).tolist() == numbers


def test_binary_output_round_trip(spark, odd_docs, monkeypatch, tmp_path):
    monkeypatch.setattr(binary_output, "SEGMENT", 100)
    rows, plain = [(r["doc_id"], r["text"]) for r in odd_docs.collect()], direct(WORDS)
    path = f"{tmp_path}/files"
    binary_output.write(odd_docs, path, WORDS, end_id=1)
    found = binary_output.read(spark, path).orderBy("start").collect()  # the path is all that it takes
    at = 0
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    assert sorted(repr((r["id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == sorted(repr((i, [*plain(t), 1])) for i, t in rows)
    order = [-1 if r["id"] is None else r["id"] for r in found]
    assert order == sorted(order)


def brute_unigram(word, scores, unknown):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        top = (best[e - 1][0] + unknown * n, best[e - 1][1] + n)
        found = None
        for s in range(e):
            if word[s:e] in scores:
                c = best[s][0] + scores[word[s:e]]
                if found is None or c > found[0]:
                    found = (c, best[s][1] + 1)
        if found and found[0] >= top[0]:
            top = found
        best.append(top)
    return best[-1]


def test_trie_matches_brute_force(odd_docs):
    scores = token_counts.zipf_scores(token_counts.load_pieces(PIECES))
    model = token_counts.UnigramCounter(scores)
    found = {}
    for r in token_counts.token_counts(odd_docs, PIECES).collect():
        found.setdefault(r["id"], []).append((r["n_words"], r["n_tokens"], r["score"]))
    for r in odd_docs.collect():
        ws = (r["text"] or "").split()
        known = {w: brute_unigram(token_counts.MARK + w, scores, model.unknown) for w in set(ws)}
        each = [known[w] for w in ws]
        want = (len(ws), sum(n for _, n in each), sum(s for s, _ in each))
        assert any(x[:2] == want[:2] and abs(x[2] - want[2]) < 1e-4 for x in found[r["doc_id"]])


def test_empty(no_docs):
    assert packing.pack(no_docs, BYTES).count() == 0
    assert binary_output.round_trip(no_docs, WORDS, end_id=1).count() == 0
    assert token_counts.token_counts(no_docs, PIECES).count() == 0
