"""The search for near copies in groups of texts that are nearly alike."""

import itertools

import numpy as np

from evidenceframe.llm import simhash

DOCS = "doc_id long, text string"


def test_nearly_alike_texts_meet_without_their_pairs(spark, monkeypatch):
    """Texts with a passage in common, similar by 0.6 to 0.7: their rows grow with their number, and few pairs leave the tasks."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 30, n)]
    passage, n = word(90), 400
    texts = [passage + word(20) for _ in range(n)]
    texts += [[*t[:-2], *word(2)] for t in texts[:20]]  # 2 of 106 shingles differ
    seen, close = [], simhash._close_in_tasks

    def counted(rows, *args):
        out = close(rows, *args)
        seen.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "_close_in_tasks", counted)
    found = {r.id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)).collect()}
    assert found == {k: k if k < n else k - n for k in range(len(texts))}
    (rows, pairs), (_, segments) = seen[0], simhash.plan_segments(len(texts), 0.8, 0.95)
    assert 0 < rows <= 2 * segments * len(texts) and pairs < 2 * len(texts)


def test_counts_lose_no_similar_pair():
    rng = np.random.default_rng(2)
    sets = []
    for size in (0, 1, 5, 90, 256, 300, 1100, 9000):
        base = rng.integers(-(1 << 62), 1 << 62, size)
        for changed in (0.0, 0.05, 0.1, 0.12, 0.2, 0.4):
            fresh = rng.integers(-(1 << 62), 1 << 62, int(size * changed))
            sets += [np.unique(np.concatenate([base[len(fresh) :], fresh])), base[: int(size * (1 - changed))]]
    sets = [s for s in sets if len(s)]
    frame = lambda h: max(simhash.COUNTS[0], min(simhash.COUNTS[1], 1 << len(h).bit_length()))
    counts = [np.bincount(h & (frame(h) - 1), minlength=frame(h)).clip(0, 255).astype(np.uint8) for h in sets]
    x, y = (np.array(c) for c in zip(*itertools.combinations(range(len(sets)), 2)))
    may = simhash._can_be_similar(x, y, np.array([len(h) for h in sets]), counts, 0.8)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)])
    exact = common / np.array([len(sets[a]) + len(sets[b]) for a, b in zip(x, y)] - common)
    assert may[exact >= 0.8].all() and (exact >= 0.8).sum() > 20 and not may[exact < 0.65].any()


def test_few_others_meet_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK", 8)
    rows = [(0, 0, 5, k % 3, k, -1 if k < 400 else k) for k in range(406)] + [(0, 1, 5, 0, k, k) for k in range(30)]
    got = simhash._tasks_of(spark.createDataFrame(rows, "segment int, way int, shared long, rest long, key long, root long")).collect()
    by, met = {}, []
    for r in got:
        by.setdefault(r.task, []).append(r)
    for own in by.values():
        assert len({r.way for r in own}) == 1
        for a, b in itertools.combinations(own, 2):
            if a.root != b.root and (a.side == b.side == 2 or a.side != b.side):
                met.append((a.way, *sorted((a.key, b.key))))
    want = {(w, *sorted((a[4], b[4]))) for w in (0, 1) for a, b in itertools.combinations([r for r in rows if r[1] == w], 2) if a[5] != b[5]}
    assert len(met) == len(set(met)) and set(met) == want and sum(r.way == 0 for r in got) < 3 * 406
