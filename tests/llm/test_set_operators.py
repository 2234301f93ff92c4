import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evidenceframe.llm import common, components, exact_dedup, mixing, simhash, warc
from evidenceframe.llm.queries import ORACLES, QUERIES

from ..conftest import SF, same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id long, size int, id string, shard long, fingerprint long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "d", 9, 9, "z", 1, 2) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_exact_groups(spark):
    long = "same start " * 20
    rows = [(5, "a  b", "s"), (3, "a\tb", "s"), (3, "a b", "s"), (None, "a\n\nb", "s"), (7, None, "s"), (8, "", "s"), (9, long + "x", "s"), (10, long + "y", "s"), (11, "  ", "s"), (12, " ", "s"), (13, "z" * 100_000, "s")]
    got = exact_dedup.exact_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.id].append(r)
    assert {r.keep_id for i in (5, 3, None) for r in by[i]} == {3} and by[5][0].group_size == 4
    assert sorted(r.kept for r in by[3]) == [False, True] and not by[None][0].kept
    assert (by[7][0].keep_id, by[8][0].keep_id, by[8][0].kept) == (7, 7, False)
    assert by[9][0].kept and by[10][0].kept and by[9][0].group_size == 1
    assert by[12][0].keep_id == 11 and by[5][0].digest == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup.exact_groups(documents(spark, rows).where("false")).count() == 0


def test_keep_first_keeps_columns_and_repeated_rows_once(spark):
    rows = [(5, "a b", "s"), (3, "a b", "t"), (3, "a b", "t"), (None, "a  b", "s"), (None, "c", "s"), (None, "c", "s"), (9, None, "s"), (8, "d", "s")]
    df = documents(spark, rows)
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, "a b"), (None, "c"), (9, None), (8, "d")], key=str)
    assert sorted(r.doc_id for r in exact_dedup.keep_first(documents(spark, [(1, "x", "s"), (2, "x", "s"), (3, "y", "s")])).collect()) == [1, 3]


def test_frequent_keys_are_broadcast(spark):
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)], "key long, v long")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    for how, want in (("inner", 1000), ("left", 1000), ("left_semi", 1000)):
        got = common.join_counted(rows, table, ["key"], "n", 1000, how, parts=10)
        assert got.count() == want and got.select("key", "v").distinct().count() == 1000
    few = table.where("key in (0, 950)")
    assert common.join_counted(rows, few, ["key"], "n", 1000, "left", parts=10).where("n is not null").count() == 301
    assert common.join_counted(rows, few, ["key"], "n", 1000, "left_semi", parts=10).count() == 301


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_dir(Session)


def fingerprint(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = ["", None, "One", "one TWO", "a b c d e f", "É é É é É", " \x1c x ", "w " * 100_000]
    got = {r.id: r.fingerprint & (2**64 - 1) for r in simhash.fingerprints(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), width=3).collect()}
    assert got == {i: fingerprint(t, 3) for i, t in enumerate(texts)}


def test_near_fingerprints_are_all_found(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 25)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(k)
            prints.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    for budget in (1, 2):
        got = [tuple(r) for r in simhash.near_fingerprints(df, budget).collect()]
        want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= budget}
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_paths_and_stars(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 201), (7, 7)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[x] == 100 for x in range(100, 140)) and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(components, "HUB", 10)
    assert {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == got


def test_simhash_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_simhash_trie"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: fingerprint(t, 3) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(rows[i].fingerprint == f"{prints[i]:016x}" and rows[i].component_id == find(i) for i in ids) and len(rows) == len(ids)


def test_near_duplicate_edges(spark):
    rows = [(4, None, "s"), (2, "", "s"), (None, " ", "s"), (9, "alpha beta gamma delta", "s"), (9, "alpha beta gamma delta", "s")]
    got = [(r.id, r.component_id) for r in simhash.near_duplicates(documents(spark, rows), width=3).collect()]
    assert sorted(got, key=str) == sorted([(4, 2), (2, 2), (None, 2), (9, 9), (9, 9)], key=str)
    assert simhash.near_duplicates(documents(spark, rows).where("false")).count() == 0


def test_similar_documents_by_jaccard(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    near = list(words)
    for k in (50, 250):
        near[k] = "changed"
    half = words[:200] + [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(3, " ".join(words), "s"), (1, " ".join(near), "s"), (5, " ".join(half), "s"), (8, "something else altogether here", "s"), (9, None, "s"), (10, "", "s"), (11, " ".join(words), "s")]
    got = {r.id: r.component_id for r in simhash.similar_documents(documents(spark, rows)).collect()}
    assert got == {3: 1, 1: 1, 5: 5, 8: 8, 9: 9, 10: 9, 11: 1}
    assert simhash.similar_documents(documents(spark, rows).where("false")).count() == 0


def test_similar_documents_tell_rows_of_one_id_apart(spark):
    rng = np.random.default_rng(12)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**9, 200))
    near = lambda t: t.replace(t.split(" ")[90], "changed")
    a, b, c, d = text(), text(), text(), text()
    rows = [(3, a, "s"), (5, near(a), "s"), (5, b, "s"), (7, c, "s"), (None, d, "s"), (None, near(d), "s"), (None, None, "s"), (None, "", "s"), (9, near(c), "s"), (None, near(b), "s")]
    got = simhash.similar_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 6 and {r.id for r in got if r.kept} == {3, 5, 7, None}
    df = documents(spark, rows)
    kept = corpus_pipeline.drop_near_copies(spark, df, SF).collect()
    texts = sorted((r.text or "" for r in kept))
    assert len(kept) == 5 and texts == sorted([a, b, c, next(r.text for r in kept if r.doc_id is None and r.text), ""])
    again = corpus_pipeline.drop_near_copies(spark, df.union(df).union(df), SF).collect()
    assert sorted(r.text or "" for r in again) == texts


def test_near_copies_are_found_by_jaccard(spark):
    """Recall of the pipeline's near copies against all pairs."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = np.random.default_rng(2)
    n = max(texts) + 1
    for k, t in list(texts.items()):
        words = (t or "").split()
        if len(words) > 60:  # one to three words are replaced, so the similarity is 0.8 and more
            for at in rng.integers(0, len(words), 1 + k % 3):
                words[at] = f"x{rng.integers(10**9)}"
            texts[n] = " ".join(words)
            n += 1
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := (t or "").lower().split())}
    by = collections.defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    pairs = {(a, b) for group in by.values() for a in group for b in group if a < b}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in simhash.similar_documents(documents(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert len(alike) > 50 and sum(got[a] == got[b] for a, b in alike) >= 0.95 * len(alike)
    linked = {x for p in alike for x in p}
    alone = [i for i in sets if i not in linked]
    assert all(got[i] == i for i in alone) and len(alone) > 10


def test_similar_documents_in_a_template(spark):
    rng = np.random.default_rng(3)
    fresh = iter(range(10**9))
    word = lambda: f"w{next(fresh)}"
    template = [word() for _ in range(300)]
    rows, pairs = [], 150
    for k in range(600):
        own = template + [word() for _ in range(64)]
        rows.append((k, own))
        if k < pairs:  # 33 of 360 + 33 shingles differ: a similarity of 0.83
            at = int(rng.integers(0, len(own) - 28))
            rows.append((10_000 + k, [*own[:at], *(word() for _ in range(28)), *own[at + 28 :]]))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert len(links) >= pairs
    got = {r.id: r.component_id for r in simhash.similar_documents(documents(spark, [(i, " ".join(w), "s") for i, w in rows])).collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    graph = {i: {i} for i in sets}
    for a, b in links:
        graph[a].add(b), graph[b].add(a)
    assert all(c in graph[i] or any(c in graph[m] for m in graph[i]) for i, c in got.items())


def test_single_links_to_a_large_component(spark):
    """Texts that are near one member of a component of 700 each, and hardly to another."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 30, n)]
    base = word(120)
    members = []
    for _ in range(700):
        t = list(base)
        at = int(rng.integers(20, 110))
        t[at : at + 1] = word(1)
        members.append(t)
    probes = []
    for t in members[:24]:
        t = list(t)
        t[:4] = word(4)
        t[-3:] = word(3)
        probes.append(t)
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    sets, near = [grams(t) for t in members], lambda x, y: len(x & y) / len(x | y)
    wanted = [k for k, t in enumerate(probes) if max(near(grams(t), s) for s in sets) >= 0.8]
    rows = [(k, " ".join(t), "s") for k, t in enumerate(members)] + [(10_000 + k, " ".join(t), "s") for k, t in enumerate(probes)]
    found = {r.id: r.component_id for r in simhash.similar_documents(documents(spark, rows)).collect()}
    assert len(wanted) > 12 and sum(found[10_000 + k] == 0 for k in wanted) >= 0.95 * len(wanted)


def test_similar_documents_of_repeated_shingles(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(["0"] * 300 + [f"w{x}" for x in rng.integers(0, 10**9, 200)]) for _ in range(6)]
    words = [f"v{x}" for x in rng.integers(0, 10**9, 200)]
    texts += [" ".join(words + ["1"] * 400), " ".join(words + ["2"] * 400), " ".join(words + ["1"] * 90)]
    got = [r.component_id for r in simhash.similar_documents(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("id").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


@settings(max_examples=8, deadline=None)
@given(votes=st.lists(st.integers(0, 1000), min_size=1, max_size=9).filter(any), seats=st.integers(0, 200))
def test_apportionment(spark, votes, seats):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(votes)], "g int, i int, v double").withColumn("seats", F.lit(seats).cast("long"))
    got = [r.quota for r in mixing.apportion(df, "g", "seats", "i", "v").orderBy("i").collect()]
    assert sum(got) == seats and got == sainte_lague(votes, seats)


def test_apportionment_of_no_seats(spark):
    df = spark.createDataFrame([(g, i, float(i), 5 * g) for g in range(2) for i in range(3)], "g int, i int, v double, seats long")
    assert [r.quota for r in mixing.apportion(df, "g", "seats", "i", "v").orderBy("g", "i").collect()] == [0, 0, 0, *sainte_lague([0, 1, 2], 5)]


def test_words_of_less_than_half_a_block(spark):
    rows = mixing.mix(documents(spark, [(1, "two words", "a"), (2, None, "b")])).orderBy("id").collect()
    assert [(r.id, r.size, r.target, r.taken) for r in rows] == [(1, 2, 3.0, 0), (2, 0, 0.0, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_apportionment_with_bounds(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(g, i, int(rng.integers(0, 40)), int(rng.integers(0, 12))) for g in range(4) for i in range(25)]
    seats = [30, 10_000, 0, 90]
    df = spark.createDataFrame([(*r, seats[r[0]]) for r in rows], "g int, i int, v int, b long, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, "g", "seats", "i", "v", "b").collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        tries = sorted(((-v / (2 * k - 1), i, k) for _, i, v, b in own for k in range(1, b + 1) if v), key=lambda t: t)[: seats[g]]
        assert [got[g, r[1]] for r in own] == [sum(i == r[1] for _, i, _ in tries) for r in own]


def test_small_sources_get_their_words(spark):
    """One large source and twenty small ones, of short documents: each within a block and half a hundredth of its target."""
    large = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 30).alias("text"), F.lit("a").alias("source"))
    small = spark.range(20 * 600).select((F.col("id") + 1_000_000).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 20 + 1).cast("int")).alias("text"), F.format_string("b%02d", F.col("id") % 20).alias("source"))
    out = mixing.mix(large.unionByName(small)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("above")).collect()
    assert len(out) == 21 and all(abs(r.taken - r.target) <= 16 + 0.005 * r.target and r.above <= 0 for r in out)


def filled(sizes):
    """Targets by sharing and resharing, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    total = 1.5 * sum(sizes.values())
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
    return out


def test_targets_and_mix(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for source, docs, most in (("b", 40, 300), ("a", 300, 60), ("Ä", 5, 50), (None, 30, 400), ("zero", 2, 1)):
        for _ in range(docs):
            rows.append((n if n % 50 else None, " ".join(["w"] * int(rng.integers(0, most))), source))
            n += 1
    rows += [(None, None, "b"), (1, "x y", "b"), (1, "x y", "b")]
    df = documents(spark, rows)
    out = mixing.mix(df, shard_docs=64).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = filled(dict(sizes))
    taken = collections.Counter()
    assert len(out) == len(rows)
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 + 0.02 * want[s]
    again = mixing.mix(df.repartition(7), shard_docs=64).collect()
    key = lambda rs: sorted((str(r.id), r.size, str(r.source), r.taken) for r in rs)
    assert key(out) == key(again)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [(1, "", "a")]).where("false")).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(documents(spark, [(1, "", "a"), (2, None, None)])).collect()] == [(0.0, 0), (0.0, 0)]


REC = "record_id long, url string, time timestamp, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits(spark):
    import datetime as dt

    t = lambda s: None if s is None else dt.datetime(2024, 1, 1, 0, 0, s)
    u = "http://WWW.a.org:80/x/?b=2&utm_source=f&a=1#top"
    full = {"Content-Type": "text/html", "ETag": '"1"', "Content-Length": "9"}
    rows = [
        (1, u, t(1), "response", '"1"', "m1", "d1", full), (2, "https://a.org/x?a=1&b=2", t(5), "response", '"2"', None, "d2", None),
        (10, "a.org/x?a=1&b=2", t(3), "revisit", 'W/"1"', None, None, {"etag": 'W/"1"', "Content-Length": "0"}), (11, u, t(1), "revisit", '"1"', None, None, None), (12, u, t(9), "revisit", '"1"', None, None, None),
        (13, u, t(9), "revisit", None, "m1", "d2", None), (14, u, t(9), "revisit", None, None, None, None), (15, None, t(9), "revisit", '"1"', None, None, None), (16, "http://b.org", t(9), "revisit", '"1"', None, None, None), (17, u, None, "revisit", '"1"', None, None, None),
    ]
    df = spark.createDataFrame(rows, REC)
    for blocks in (1, 3, 7):
        got = {r.record_id: r for r in warc.resolve_revisits(df, blocks).collect()}
        assert {k: (r.status, r.target_id) for k, r in got.items()} == {10: ("resolved", 1), 11: ("no_response", None), 12: ("changed", None), 13: ("resolved", 2), 14: ("unverified", None), 15: ("no_url", None), 16: ("no_response", None), 17: ("no_response", None)}
        assert got[10].headers == {"Content-Type": "text/html", "Content-Length": "9", "etag": 'W/"1"'}
    assert warc.resolve_revisits(df.where("false")).count() == 0


def test_pipeline_stages(spark):
    rng = np.random.default_rng(9)
    words = lambda k: [f"word{x}" for x in rng.integers(0, 3000, k)]
    a = words(200)
    b = list(a)
    b[70] = "other"
    rows = [(1, " ".join(a), "s0"), (2, " ".join(a), "s0"), (3, " ".join(b), "s1"), (4, " ".join(words(120)), "s1"), (5, "12 34", "s1"), (6, None, "s0")] + [(k, " ".join(words(80)), f"s{k % 3}") for k in range(10, 40)]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = df.withColumns({c: F.lit(1) for c in ("id", "key", "row", "run", "laps", "size", "begin", "_id", "_doc", "component_id")})
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda d: {r.doc_id for r in d.collect()}
    one = stages["language"](spark, df, SF)
    assert kept(one) == kept(df) - {5, 6} and one.columns == df.columns
    two = stages["exact"](spark, one, SF)
    assert kept(two) == kept(one) - {2} and two.columns == df.columns
    three = stages["near"](spark, two, SF)
    assert kept(three) == kept(two) - {3} and three.columns == df.columns
    four = stages["mix"](spark, three, SF)
    sizes = {r.doc_id: len(r.text.split()) for r in three.collect()}
    taken = {r.id: r.taken for r in mixing.mix(three).collect()}
    found = collections.Counter()
    for r in four.collect():
        found[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert four.columns == df.columns and all(found[i] == taken[i] <= 2 * sizes[i] for i in sizes)
    for name, before, after in (("language", df, one), ("exact", one, two), ("near", two, three), ("mix", three, four)):
        more = before.withColumns({c: F.lit(1) for c in clash.columns if c not in before.columns})
        assert kept(stages[name](spark, more, SF)) == kept(after)
        assert stages[name](spark, before.where("false"), SF).count() == 0
    packed = stages["pack"](spark, four, SF).collect()
    assert {r.doc_id for r in packed} == set(found)


def test_pipeline_over_the_tables(spark):
    """Every stage works on what the one before kept, and each token of the mixture is packed once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF))
        kept.append(docs.count())
    assert kept[0] >= kept[1] > kept[2] >= kept[3] > 50
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want, got = collections.Counter(), collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ends = collections.Counter()
    for r in sorted(rows, key=lambda r: r.offset):
        got[r.doc_id] += r.length
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert got == want and all(n <= 4096 and n & (n - 1) == 0 for n in ends.values())
