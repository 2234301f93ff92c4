import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidenceframe.llm import packing, token_files
from evidenceframe.llm.tokens import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, ids string, shard int, row string"
ODD = ["", None, "  a  b", "Don't stop,  'tis", "x  \n y", " lead", "trail ", "H̱ é É", "a\x1fb \x1cc", "THE!! and.,\n\nfoo|bar 12 3,4", "<|endoftext|> hi <|startoftext|>", "日本 語。", "\0abc \0", "İ ς Σ", "word " * 9000, "word " * 9000]

_made: dict = {}


def pair(name):
    if name not in _made:
        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.encode_special_tokens = True
        _made[name] = t, Encoder(public_tokenizers.path(name), limit=300)
    return _made[name]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\t.,!'sTtheé́#|19 　\0"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_encoder_equals_the_library(name, texts):
    t, e = pair(name)
    ids, lens = e.encode(pa.array(texts, pa.string()))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens))[: len(texts)]] == want


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1, "z") for i, t in zip(ids, texts)], DOCS)


def test_packing_holds_every_token_once(spark):
    t, _ = pair(FILES[0])
    rows = packing.pack(documents(spark, ODD), public_tokenizers.path(FILES[0]), shard_bytes=30_000).collect()
    for i, text in enumerate(ODD):
        want = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == want.tobytes()
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and {r.doc_tokens for r in own} == {len(want)}
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in by.values())


def test_packing_edge_tables(spark):
    path = public_tokenizers.path(FILES[0])
    assert packing.pack(documents(spark, ["a"]).where("false"), path).count() == 0
    rows = packing.pack(documents(spark, ["same", "same"], [None, None]), path).collect()
    assert len(rows) == 2 and {r.id for r in rows} == {None}


def test_repeated_rows_are_dealt_apart(spark):
    rows = [(1, "some words that repeat " * 80)] * 300 + [(k, f"number {k} and more words " * 80) for k in range(300)]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    got = packing.pack(df, public_tokenizers.path(FILES[0]), shard_bytes=60_000).collect()
    shards = {}
    for r in got:
        shards[r.sequence_id >> 24] = shards.get(r.sequence_id >> 24, 0) + r.length
    mean = sum(shards.values()) / len(shards)
    assert len(shards) >= 10 and max(shards.values()) < 2 * mean


def brute_costs(lengths, length):
    """Descending pieces, each to the cheapest sequence with room for it, else cut at the cheapest's room; plain loops."""
    rooms = packing.capacities(int(sum(lengths)), length)
    cost, left = [0.0] * len(rooms), list(rooms)
    for n in sorted(lengths, reverse=True):
        while n:
            fit = [k for k in range(len(rooms)) if left[k] >= n] or [k for k in range(len(rooms)) if left[k]]
            k = min(fit, key=lambda i: cost[i])
            part = min(n, left[k])
            left[k] -= part
            cost[k] += part + part * part / length
            n -= part
    return cost


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_balanced(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 400).astype(np.int64) + 1, 4096 if seed == 4 else 1500)
    plan = packing.assign(lengths, 4096, 1.0, 1 / 4096)
    got = np.zeros(len(lengths), int)
    rooms = packing.capacities(int(lengths.sum()), 4096)
    cost = np.zeros(len(rooms))
    for piece, a, b, at, _ in plan:
        got[piece] += b - a
        cost[at] += (b - a) + (b - a) ** 2 / 4096
    assert (got == lengths).all() and np.allclose(cost, brute_costs(lengths.tolist(), 4096))
    # against dealing in the given order: the full sequences' costs are nearer to each other
    dealt, full = np.zeros(len(rooms)), [k for k, r in enumerate(rooms) if r == 4096]
    at, room = 0, list(rooms)
    for n in lengths.tolist():
        while n:
            part = min(n, room[at])
            room[at] -= part
            dealt[at] += part + part * part / 4096
            n -= part
            at += room[at] == 0
    assert seed == 4 or cost[full].std() < dealt[full].std() / 2  # a piece that fills a sequence costs what it costs
    assert packing.capacities(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for case in range(200):
        ids = rng.integers(0, rng.choice([2, 3, 5, 60]), rng.integers(0, 500)).astype(np.uint32)
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(ids == 0) + 1]))
        ids = ids[: sizes.sum()]
        shard = token_files.Shard(token_files.pack_shard(ids, sizes, 0, 100))
        assert (shard.all() == ids).all()
        if len(ids):
            a = int(rng.integers(0, len(ids)))
            n = int(rng.integers(0, len(ids) - a + 1))
            assert (shard.read(a, n) == ids[a : a + n]).all()
            assert all(shard.document(k)[-1] == 0 for k in range(len(sizes)))


@pytest.mark.parametrize("seed", range(12))
def test_repair_leaves_no_pair_that_pays(seed):
    rng = np.random.default_rng(seed)
    ids = rng.zipf(1.3, 4000).clip(0, 40).astype(np.uint32) - 1
    if seed % 3 == 0:
        ids = np.repeat(ids, rng.integers(1, 9, len(ids)))
    seq, rules = token_files.repair(ids, 0, 100, least=4)
    counts, last = {}, {}
    for i, (a, b) in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
        if 0 in (a, b) or last.get((a, b)) == i - 1 and a == b:  # side by side, no overlap
            continue
        counts[a, b], last[a, b] = counts.get((a, b), 0) + 1, i
    assert max(counts.values(), default=0) < 4 and len(seq) < len(ids) and not (rules == 0).any()
    assert len(np.unique(rules, axis=0)) == len(rules) and not {tuple(r) for r in rules.tolist()} & set(counts)
    shard = token_files.Shard(token_files.pack_shard(ids, np.diff(np.concatenate([[0], np.flatnonzero(ids == 0) + 1])), 0, 65_530))
    assert (shard.all() == ids).all()


def test_repair_shortens_repeats():
    ids = np.tile(np.array([5, 6, 7, 8], np.uint32), 500)
    seq, rules = token_files.repair(ids, 0, 100)
    assert len(seq) <= len(ids) / 4 and len(rules) >= 2


def test_token_files_round_trip(spark, tmp_path):
    t, _ = pair(FILES[1])
    path = f"{tmp_path}/files"
    token_files.write_token_files(documents(spark, ODD), path, public_tokenizers.path(FILES[1]), shard_tokens=5000, part_bytes=40_000)
    rows = sorted(token_files.read_token_digests(spark, path).collect(), key=lambda r: r.id)
    start = 0
    for r, text in zip(rows, ODD):
        want = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(rows) == len(ODD)
    assert token_files.read_token_files(spark, path).where("id = 0").first().ids == b"\0\0\0\0"


def test_token_files_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/none"
    token_files.write_token_files(documents(spark, ["a"]).where("false"), path, public_tokenizers.path(FILES[1]))
    assert token_files.read_token_digests(spark, path).count() == 0
