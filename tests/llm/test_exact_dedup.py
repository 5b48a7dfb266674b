import hashlib
import re

import pytest
from pyspark.sql import functions as F

from remitweave.llm import exact_dedup, simhash


def brute(rows):
    groups = {}
    for k, (ident, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), ident is None, ident or 0, k, ident))
    out = []
    for norm, members in groups.items():
        members.sort()
        for m in members:
            sha = hashlib.sha256(norm.encode()).hexdigest()
            out.append((m[4], members[0][4], len(members), sha, m[3] == members[0][3]))
    return out


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize(("key_bytes", "log2_bits", "fanout"), [(32, 8, 2), (32, 24, 1024), (1, 8, 1024), (1, 24, 2)])
def test_matches_brute_force(odd_docs, monkeypatch, key_bytes, log2_bits, fanout):
    monkeypatch.setattr(exact_dedup, "FANOUT", fanout)
    odd_docs = odd_docs.repartition(11)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = exact_dedup.assign(odd_docs, key_bytes=key_bytes, log2_bits=log2_bits).collect()
    assert key((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == key(r[:4] for r in brute(rows))
    kept = [(r["keep_id"], r["text_sha256"]) for r in found if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in found})


def test_survivors_keep_one_row_of_each_group(odd_docs):
    found = exact_dedup.survivors(odd_docs, log2_bits=8)
    assert found.columns == odd_docs.columns
    norms = [re.sub(r"\s", "", r["text"] or "", flags=re.A) for r in found.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub(r"\s", "", r["text"] or "", flags=re.A) for r in odd_docs.collect()})


def test_columns_with_the_names_used_inside(spark):
    names = "_maybe", "_pos", "_word", "_bits", "_sha", "_length", "id", "run", "row", "key", "fp", "keep_id", "kept", "word", "bits"
    rows = [(k, f"some text {k % 3}" + " " * k, *(f"{n}{k}" for n in names)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(tuple, exact_dedup.survivors(docs).collect())) == rows[3:]  # the longest of each
    near = docs.withColumn("text", F.expr("concat(repeat('same words all over ', 20), repeat(' ', doc_id), if(doc_id > 2, 'END', 'end'))"))
    assert sorted(map(tuple, simhash.survivors(near, words_each=3, radius=2).collect())) == [tuple(near.collect()[0])]


def test_empty(no_docs):
    assert exact_dedup.assign(no_docs).count() == 0
    assert exact_dedup.survivors(no_docs).count() == 0
