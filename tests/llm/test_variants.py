import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidenceframe.llm import variants


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    out, near = {}, {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def found(spark, words, **how):
    rows = variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), **how).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@settings(max_examples=500, deadline=None)
@given(st.text("ab" , min_size=4, max_size=9) | st.text("abcé", min_size=4, max_size=12), st.dictionaries(st.sampled_from(["aa", "ab", "ba", "bb", "ac", "éa"]), st.integers(1, 9)))
def test_every_edit_leaves_a_common_key(word, often):
    letters = "abcéz"
    edits = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in (*letters, "")}
    own = variants.keys(word, often)
    for other in edits - {word}:
        if len(other) < 4:
            continue
        theirs = variants.keys(other, often)
        assert {k for k, p in own if p} & {k for k, p in theirs if not p} or {k for k, p in theirs if p} & {k for k, p in own if not p}, (word, other)


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = random.Random(5)
    for _ in range(300):
        word = "".join(draw.choices("abcd", k=12))
        often = {a + b: draw.randrange(5) for a in "abcd" for b in "abcd"}
        places = draw.sample(range(11), 5)
        cost = lambda p: sum(often[word[i : i + 2]] for i in p)  # noqa: E731, B023
        first, second = variants.pivots(word, places, often)
        pairs = [(i, j) for i in places for j in places if j >= i + 2]
        assert (first, second) in pairs and cost((first, second)) == min(map(cost, pairs))


def vocabulary(seed, size):
    draw = random.Random(seed)
    words = {"".join(draw.choices("abcdé", k=draw.randrange(4, 8))): draw.choice([5, 6, 20, 30, 200, 1500]) for _ in range(size)}
    for w in draw.sample(sorted(words), size // 3):
        i = draw.randrange(len(w))
        words.setdefault(w[:i] + draw.choice("abcdé") + w[i + draw.randrange(2) :], draw.choice([5, 7, 40, 250]))
    return words


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    words = {w: n for w, n in vocabulary(seed, 600).items() if len(w) > 3}
    assert found(spark, words) == brute(words)


def test_crowded_keys_are_dealt_in_blocks(spark, monkeypatch):
    words = {f"same{a}{b}start": 5 + (a == "q") * 45 for a in "bcdefghijklmnopq" for b in "rstuvwxyzé"}
    near = variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), parts=10, block=4)
    got = collections.Counter((r.word, r.other) for r in near.collect())
    assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b)} and set(got.values()) == {1}


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdefg": 1, "abcdefh": 5, "abcdeih": 25, "abcjeih": 125, "kbcjeih": 625, "kbcjeil": 3125}
    got = found(spark, words)
    assert {r[4] for r in got.values()} == {"kbcjeil"} and got["abcdefg"][:4] == (1, 1, "abcdefh", 5) and got["kbcjeil"][2] is None


def test_edges(spark):
    rows = [("abcdef", 3, 1), ("abcdef", 2, 1), (None, 9, 1), ("ab", 4, 1), ("ac", 40, 1), ("", 5, 1), ("abcdeg", 25, 1), ("abcdeh", 25, 1), ("zero" * 2, 0, 1), ("a" * 50_000, 5, 1), ("a" * 50_001, 30, 1)]
    df = spark.createDataFrame(rows, "spelt string, times long, n int")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.spelling_variants(df, "spelt", "times").collect()}
    assert got["abcdef"] == (5, 2, "abcdeg", 25, "abcdeg") and got["abcdeg"][2] is None and got["ac"] == (40, 0, None, None, "ac")
    assert set(got) == {"abcdef", "ab", "ac", "", "abcdeg", "abcdeh", "a" * 50_000, "a" * 50_001} and got["a" * 50_000][4] == "a" * 50_001
    assert variants.spelling_variants(df.where("false"), "spelt", "times").count() == 0


def test_words_of_documents(spark):
    text = {7: "Straße ÉCOLES écoles Écoles abcdef ABCDEF abcdefĀabcdef x1longer " + "w" * 300, None: "longer words", 8: None, 9: ""}
    rows = [(i, t, "x", 1) for i, t in text.items()] * 2
    got = {r.word: r.n for r in variants.document_words(spark.createDataFrame(rows, "doc_id long, text string, word string, n int"), every=3).collect()}
    want = collections.Counter()
    for i, t in text.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 2
    assert got == {w: n for w, n in want.items() if len(w) >= 6}
