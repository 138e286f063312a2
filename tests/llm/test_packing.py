"""Containers: nothing lost, nothing overfull, nothing split that need not be, little room left."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm.packing import encoder, fill_containers, pack, pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80))
def test_pack(sizes):
    bins = pack(list(enumerate(sizes)), 60)
    assert sorted(x for b in bins for x in b) == sorted(enumerate(sizes))
    assert all(sum(s for _, s in b) <= 60 for b in bins) and all(bins)
    assert all(sum(s > 20 for _, s in b) <= 2 for b in bins)
    if sizes:
        assert len(bins) <= math.ceil(1.34 * sum(sizes) / 60) + 2 + sum(s > 20 for s in sizes) // 2


def test_room_left_on_a_usual_mix():
    r = random.Random(4)
    sizes = [min(2048, int(r.lognormvariate(5, 1))) + 1 for _ in range(20000)]
    bins = pack(list(enumerate(sizes)), 2048)
    assert len(bins) <= math.ceil(sum(sizes) / 2048) * 1.002 + 1


def test_pieces():
    assert pieces(0, 10) == [0] and pieces(10, 10) == [10] and pieces(25, 10) == [10, 10, 5] and pieces(20, 10) == [10, 10]


def test_documents(spark):
    data = [(1, "word " * 9000), (2, None), (3, ""), (4, "short text"), (4, "short text"), (5, "a" * 30000)] + [(10 + i, "some words here " * (i % 90)) for i in range(500)]
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id long, text string, container_id string, tokens int")
    got = fill_containers(rows).collect()
    enc = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    room, total = {}, {}
    for r in got:
        room[r.container_id] = room.get(r.container_id, 0) + r.tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
    assert max(room.values()) <= 2048
    want = {}
    for i, t in data:
        want[i] = want.get(i, 0) + (len(enc.encode_ordinary(t)) if t else 0)
    assert total == want
    split = {r.doc_id for r in got if r.piece_no > 1}
    assert split == {i for i, t in data if t and len(enc.encode_ordinary(t)) > 2048}
    assert len(room) <= math.ceil(sum(want.values()) / 2048) + 2
    assert fill_containers(rows.limit(0)).collect() == []


def test_sizes_given(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([5, 6, 4, None, 25])], "doc_id long, n int")
    got = fill_containers(rows, tokens="n", text="n", capacity=10).collect()
    assert sum(r.tokens for r in got) == 40 and len({r.container_id for r in got}) == 4
    with pytest.raises(ValueError):
        fill_containers(rows, tokens="n", capacity=0)


def test_many_groups(spark, monkeypatch):
    from quillspan.llm import packing

    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 50)
    rows = spark.range(400).selectExpr("id as doc_id", "id % 37 as n")
    got = packing.fill_containers(rows, tokens="n", text="n", capacity=100).collect()
    assert {r.doc_id for r in got} == set(range(400)) and len({r.container_id.split("-")[0] for r in got}) == 8
