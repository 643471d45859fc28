"""Packing, sharding and mixing: round trips and laws, and odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, packing, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "\n\n", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "naïve Straße 東京  x　y", "it's 12,345.67!\t\r\n  end",
       "x" * 3000, "ab " * 9000, "No stop in sight " * 700, "🙂🙃 \U0001f1e9\U0001f1ea", "\x00\x7f\x85"]


def test_ids_are_the_tokenizers(tokenizer):
    encoding, ends = packing.load(None)
    for text in ODD:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(text, encoding).tolist() == [*expected, 1]
    assert packing.token_ids(None, encoding).tolist() == [1] and ends.sum() > 0


def _pieces(df):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in df.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    return by_doc, by_sequence


def _padding(by_sequence, window):
    lengths = [sum(r.length for r in rows) for rows in by_sequence.values()]
    assert max(lengths) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in lengths) / sum(lengths)


@pytest.mark.parametrize("window, buffer", [(64, 300), (256, 1000), (64, 64)])
def test_a_stream_is_cut_as_it_comes(window, buffer):
    draw = random.Random(window + buffer)
    ends = np.zeros(100, bool)
    ends[:9] = True
    docs = [np.array([draw.randrange(100) for _ in range(draw.choice([1, 3, 40, 700]))], np.uint32) for _ in range(120)]
    stream, pieces = packing.Stream(0, window, buffer, ends), []
    for key, ids in enumerate(docs):
        for cut in stream.add(key, ids):
            pieces += cut
        assert stream.held <= buffer + 700
    for cut in stream.close():
        pieces += cut
    for key, ids in enumerate(docs):
        own = [p for p in pieces if p[0] == key]
        assert b"".join(p[3] for p in own) == ids.astype("<u4").tobytes() and {p[4] for p in own} == {len(ids)}
        assert [p[1] for p in own] == [0, *np.cumsum([p[2] for p in own])[:-1]]
    lengths = defaultdict(int)
    for _, _, length, _, _, sequence, offset in pieces:
        assert offset == lengths[sequence]
        lengths[sequence] += length
    assert max(lengths.values()) <= window and sorted(lengths) == list(range(len(lengths)))


@pytest.mark.parametrize("window", [2048, 256])
def test_packing_gives_every_id_once(frame, tokenizer, window):
    draw = random.Random(3)
    texts = [" ".join(f"wo{draw.randrange(999)}" + "." * (draw.random() < 0.1) for _ in range(draw.randrange(1, 900))) for _ in range(150)]
    rows = list(enumerate([*texts, *ODD, None]))
    df = packing.pack(frame("doc_id long, text string, length string, ids int", [(*r, "x", 1) for r in rows]), window=window)
    by_doc, by_sequence = _pieces(df)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array([*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 1], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == ids.tobytes()
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert {p.doc_tokens for p in pieces} == {len(ids)} and all(len(p.ids) == 4 * p.length for p in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
    assert _padding(by_sequence, window) < (0.01 if window == 2048 else 0.05)


def test_packing_repeated_null_and_no_rows(frame):
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (None, None)]
    got = packing.pack(frame("doc_id long, text string", rows, 1)).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == {1: 2, None: 2}
    assert packing.pack(frame("doc_id long, text string", [])).collect() == []


def test_cuts_are_the_cheapest():
    draw = random.Random(8)
    for _ in range(60):
        window = 32
        end = draw.randrange(1, 200)
        places = sorted({*(draw.randrange(1, end + 1) for _ in range(60)), *range(8, end, 8), end})
        penalties = [draw.choice([0, 4, 24]) for _ in places]
        cost = {0: 0}
        for place, penalty in zip(places, penalties):
            cost[place] = penalty + min(cost[p] + window - (place - p) for p in cost if place - window <= p < place)
        best = min(cost[p] + packing.tail_cost(end - p, window) for p in cost if p >= end - window)
        cuts = packing.best_cuts(np.array(places), np.array(penalties), end, window, True)
        assert cuts[-1] == end and all(b - a <= window for a, b in zip([0, *cuts], cuts))
        extra = dict(zip(places, penalties))
        tails = [i for i in range(len(cuts) + 1) if all(c in extra for c in cuts[:i])]

        def price(i):
            head = [0, *cuts[:i]]
            whole = sum(window - (b - a) + extra[b] for a, b in zip(head, head[1:]))
            return whole + packing.tail_cost(end - head[-1], window) if end - head[-1] <= window else 10**9

        assert min(price(i) for i in tails) == best


def _size(text):
    return len((text or "").encode()) + 16


@pytest.mark.parametrize("shards, n", [(40, 1003), (7, 500), (40, 11)])
def test_shards_differ_by_one_and_match_the_mixture(frame, shards, n):
    draw = random.Random(4)
    sources = ["hot"] * 6 + ["a", "b", "c", None]
    rows = [(i, draw.choice(sources), f"t{i}" * draw.randrange(9)) for i in range(n)]
    df = frame("doc_id long, source string, text string, slot string", [(*r, "x") for r in rows])
    got = sharding.shard(df.withColumn("size", sharding.row_size("text")), shards).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    assert all(r["size"] == _size(r.text) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = Counter(r.source for r in got)
    per_shard = Counter((r.source, r.shard) for r in got)
    for source, count in total.items():
        for s in range(shards):
            assert abs(per_shard[source, s] - count / shards) <= 2
    again = sharding.shard(df.repartition(5).withColumn("size", sharding.row_size("text")), shards).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


@pytest.mark.parametrize("total", [1, 39, 1_000_001, 2_000_001, 3_000_001, 20_000_001, 100_000_003, 10**12 + 7, 9 * 10**17 + 1])
@pytest.mark.parametrize("shards", [40, 7])
def test_shards_begin_at_whole_positions(frame, total, shards):
    starts = [-(-s * total // shards) for s in range(shards + 1)]
    near = sorted({p for b in starts for p in (b - 2, b - 1, b, b + 1) if 0 <= p < total})
    shard_of, slot = sharding.place(F.col("p"), total, shards)
    got = frame("p long", [(p,) for p in near]).select("p", shard_of.alias("shard"), slot.alias("slot")).collect()
    expected = [(p, p * shards // total, p - starts[p * shards // total]) for p in near]
    assert sorted(tuple(r) for r in got) == expected and min(r.slot for r in got) == 0


def test_sharding_odd_rows(frame):
    schema = "doc_id long, source string, text string"
    rows = [(None, None, None)] * 30 + [(5, "a", "same")] * 40 + [(i, f"s{i}", "") for i in range(30)]
    got = sharding.shard(frame(schema, rows), 10).collect()
    assert Counter(r.shard for r in got) == {s: 10 for s in range(10)}
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(10) for i in range(10)]
    assert sharding.shard(frame(schema, []), 10).collect() == []


def _filled(sizes, weights, repeats=3):
    """Targets by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > repeats * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("skew", [1, 60])
def test_mix_meets_its_targets(frame, skew):
    draw = random.Random(5)
    rows = []
    for s, n in (("a", 40), ("b", 40 * skew), ("é", 25), ("z", 90), (None, 30), ("w", 4)):
        rows += [(s, draw.randrange(0, 30)) for _ in range(n)]
    rows = [(i, s, n, "x") for i, (s, n) in enumerate(rows)]
    df = frame("doc_id long, source string, size long, repeats string", rows)
    got = mixing.curriculum(df, "size").collect()
    sizes = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    targets, taken = _filled(sizes, mixing.WEIGHTS), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.repeats <= 3 and len(r.positions) == r.repeats and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r["size"] * r.repeats
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 16
    assert {(r.doc_id, r.repeats) for r in mixing.curriculum(df.repartition(7), "size").collect()} == {
        (r.doc_id, r.repeats) for r in got
    }


def test_weights_change_over_time(frame):
    rows = [(i, "abc"[i % 3], 1) for i in range(3000)]
    df = frame("doc_id long, source string, size long", rows)
    ordered = mixing.in_training_order(mixing.curriculum(df, "size", weights=(1.0,), slopes=())).collect()
    assert len(ordered) == 3000
    steep = mixing.curriculum(df, "size", weights=(1.0, 1.001, 1.002), slopes=(-0.9, 0.0, 0.9))
    turns = mixing.in_training_order(steep).collect()
    assert [r.position for r in turns] == sorted(r.position for r in turns)
    early = Counter(r.source for r in turns[:600])
    late = Counter(r.source for r in turns[-600:])
    assert early["a"] > 2 * early["c"] and late["c"] > 2 * late["a"]
    with pytest.raises(ValueError):
        mixing.curriculum(df, "size", slopes=(1.0,))


def test_mixing_odd_rows(frame):
    schema = "doc_id long, source string, text string"
    rows = [(None, None, None)] * 3 + [(1, "a", "x y")] * 4 + [(2, "b", ""), (3, "b", " \t"), (4, "c", "w " * 50_000)]
    df = frame(schema, rows).withColumn("size", mixing.word_count("text"))
    got = mixing.curriculum(df, "size").collect()
    assert sorted(r["size"] for r in got) == [0] * 5 + [2] * 4 + [50_000]
    assert mixing.curriculum(df.limit(0), "size").collect() == []
    assert all(r.repeats == 0 for r in mixing.curriculum(df.where("size = 0"), "size").collect())
    assert mixing.in_training_order(mixing.curriculum(df.limit(0), "size")).collect() == []


def test_crc_and_sizes_of_the_query(spark, middle):
    from textloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{middle}/documents.parquet").collect()}
    got = QUERIES["op5_sharding"](spark, middle).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"rows"}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_packing_query(spark, middle, tokenizer):
    from textloom.llm.queries import QUERIES

    by_doc, by_sequence = _pieces(QUERIES["op4_packing"](spark, middle))
    for r in spark.read.parquet(f"{middle}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sum(p.length for p in by_doc[r.doc_id]) == len(ids)
        for p in by_doc[r.doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert _padding(by_sequence, 2048) < 0.01


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", " \u3000", "\x85"])
def test_millions_of_blanks(blank):
    import public_tokenizers
    import tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding, _ = packing.load(None)
    long = blank * (1_500_000 // len(blank))
    short = blank * (packing.LONG // len(blank) + 1)
    for text in (long + "x", f"a{short}b  c{short} 1{short}'s{short}", f"{short}<|endoftext|>{short}.<|endoftext|>", short, f"a {short}"):
        expected = own.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(text, encoding).tolist() == [*expected, packing.END]


def test_five_million_blanks_are_packed(frame):
    got = packing.pack(frame("doc_id long, text string", [(1, " " * 5_000_000 + "x"), (2, "\n" * 5_000_000)])).collect()
    assert {r.doc_id: r.doc_tokens for r in got}.keys() == {1, 2}
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_every_end_of_a_document_is_a_cut_place():
    ends = np.array([3, 5, 6, 20, 33])
    places, penalties = packing.cut_places(np.zeros(33, bool), ends)
    assert set(ends) <= set(places.tolist()) and all(p == 0 for e, p in zip(places.tolist(), penalties.tolist()) if e in ends)
