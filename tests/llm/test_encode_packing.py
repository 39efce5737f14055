from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwright.llm import encode, packing

tiktoken = pytest.importorskip("tiktoken")
RANKS = encode.read_vocabulary()
OWN = encode.Encoder(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=encode.WORD_PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_ids_are_those_of_the_public_library(text):
    assert OWN.encode(text) == OTHER.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_heap_and_array_merge_alike_and_spell_the_word(word):
    spell = {rank: token for token, rank in RANKS.items()}
    assert OWN.scan_merge(word) == OWN.heap_merge(word)
    assert b"".join(spell[i] for i in OWN.heap_merge(word)) == word


def test_texts_of_all_kinds(spark):
    texts = [None, "", " ", "a", "Räthlitzbrügg am Quast\r\n\n", "x" * 50_000, "\x1c\u3000 \ufeff", "<|endoftext|>", "KDR_118 " * 30_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "b"), (None, "b")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("tokens", F.lit(1))
    rows = encode.encode_texts(df).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 12 and got[0] == got[1] == []
    assert all(got[i] == OTHER.encode_ordinary(t) for i, t in enumerate(texts) if t)
    assert sum(r.doc_id is None and r.ids == OTHER.encode_ordinary("b") for r in rows) == 2
    assert {r.doc_id: r.tokens for r in encode.count_tokens(df).collect() if r.doc_id is not None} == {i: len(v) for i, v in got.items() if i is not None}
    assert encode.encode_texts(df.limit(0)).count() == 0


def check(places, runs, capacities, sizes):
    held = {}
    for r in places:
        if r.container_id is not None:
            held[r.container_id] = held.get(r.container_id, 0) + r.tokens
    declared = {}
    for first, number, capacity, used in runs:
        for k in range(number):
            declared[first + k] = (capacity, used)
    assert set(held) == set(declared)
    for c, used in held.items():
        assert used == declared[c][1] <= declared[c][0] and declared[c][0] in capacities
        assert not any(used <= s < declared[c][0] for s in capacities)
    assert sum(held.values()) == sum(sizes)
    return declared


@pytest.mark.parametrize("capacities, count", [((100,), 400), ((25, 50, 100), 400), ((100,), 3), ((7, 100), 1)])
def test_containers_hold_everything_once(spark, capacities, count):
    rnd = random.Random(count)
    sizes = [rnd.choice([rnd.randint(1, 100), rnd.randint(1, 9), 50, 0, 250]) for _ in range(count)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, n long").withColumn("tokens", F.lit("x"))
    places, runs = packing.pack(df, "id", "n", capacities)
    rows = places.collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.id, []).append(r)
    for i, s in enumerate(sizes):
        mine = sorted(whole[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in mine) == s and len(mine) == max(1, -(-s // 100)) and all(r.pieces == len(mine) for r in mine)
        assert [r.start for r in mine] == [100 * k for k in range(len(mine))]
        assert all((r.container_id is None) == (r.tokens == 0) for r in mine)
    declared = check(rows, [tuple(r) for r in runs.collect()], capacities, sizes)
    if count > 100:
        assert len(declared) <= 1.02 * sum(sizes) / 100 + 2


def test_hot_length_null_and_empty(spark):
    df = spark.createDataFrame([(None, 40)] * 100 + [(i, 40) for i in range(200)] + [(1, None), (2, -3)], "id long, n long")
    places, runs = packing.pack(df, "id", "n", (100,))
    check(places.collect(), [tuple(r) for r in runs.collect()], (100,), [40] * 300)
    assert places.where("container_id is null").count() == 2 and runs.agg(F.sum("number")).first()[0] == 150
    places, runs = packing.pack(df.limit(0), "id", "n", (100,))
    assert places.count() == runs.count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_equals_best_fit_one_by_one(counts):
    plan = packing.plan_packing(counts, (64,))
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                free.append(64 - length)
            else:
                free[free.index(room)] = room - length
    assert sorted(64 - r for r in free) == sorted(u for _, n, _, u in plan.containers for _ in range(n))


def test_lengths_out_of_bounds():
    with pytest.raises(ValueError):
        packing.plan_packing({5: 1}, (4,))
    with pytest.raises(ValueError):
        packing.plan_packing({5: 1}, ())
