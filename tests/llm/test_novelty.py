import collections
import hashlib
import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidenceframe.llm import novelty
from evidenceframe.llm.queries import QUERIES

from ..conftest import SF

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def assignment_at(t, i):
    """Where an assignment that begins at i ends, and its value's length."""
    for w in WORDS:
        if lower(t[i : i + len(w)]) != w:
            continue
        j = i + len(w)
        j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
        while t[j : j + 1] == " ":
            j += 1
        if t[j : j + 1] not in (":", "=") or j >= len(t):
            continue
        j += 1
        while t[j : j + 1] == " ":
            j += 1
        j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
        k = j
        while k < len(t) and t[k] in VALUE:
            k += 1
        if k > j:
            return k, k - j
    return None


def brute_base(t):
    """Base spans by a walk over the characters."""
    out, i = [], 0
    while i < len(t):
        if hit := assignment_at(t, i):
            if hit[1] >= 12:
                out.append(("assign", i, hit[0]))
            i = hit[0]
        else:
            i += 1
    for kind, head, letters, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 18), ("hex", "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(t):
            j = i + len(head)
            while t.startswith(head, i) and j < len(t) and t[j] in letters:
                j += 1
            if t.startswith(head, i) and j > i + len(head):
                if j - i >= least:
                    out.append((kind, i, j))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


PIECES = st.sampled_from(["token", "Token = '", "secret:", "api_key=", "APIKEY ", '": "', "AKIA", "AKIAQ7", "0123456789abcdef", "ABCDEFGH12", "é", "ſecret", " ", "\n", "=", "=" * 13, "deadbeef", "x", "_.-", "password = \"", "toKen"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_a_walk(text):
    assert novelty.base_spans(text) == brute_base(text)


def frame(spark, texts, ids=None):
    rows = [(i, t, "a", 1, "b") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int, spans string")


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_zstd_novelty_secrets"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    meter = novelty.Meter(novelty.dictionary(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in rows:
        base = brute_base(docs[r.doc_id])
        kinds = collections.Counter(k for k, *_ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k != "novel"] == base and r.n_novel == len(spans) - len(base)
        for k, a, b in spans:
            if k == "novel":
                a, b, t = int(a), int(b), docs[r.doc_id]
                assert meter.novelty(t[max(0, a - 128) : a], t[a:b], t[b : b + 128]) >= novelty.NOVELTY


def test_parts_are_counted_over_all_texts(spark):
    texts = ["Alpha beta alpha9alpha", None, "", "be beta" * 3, "x" * 60]
    got = {r.part: r.n for r in novelty.word_parts(frame(spark, texts), held=1).collect()}
    assert got == {"alpha": 3, "beta": 2, "betabe": 2, "x" * 24: 2, "x" * 12: 1}


def test_dictionary_is_bounded_and_ordered(spark):
    texts = ["rare " + "common " * 5 + "middle " * 3]
    held = novelty.dictionary(frame(spark, texts)).decode()
    assert held.startswith("rare middle common ") and held.endswith(novelty.CODE)
    many = frame(spark, [" ".join("".join(random.Random(k).choices(string.ascii_lowercase, k=9)) for k in range(5000))])
    assert len(novelty.dictionary(many, size=8192)) <= 8192


@pytest.fixture(scope="module")
def meter(spark):
    return novelty.Meter(novelty.dictionary(spark.read.parquet(f"{SF}/documents.parquet")))


def test_planted_secrets_are_found_and_identifiers_are_not(spark, meter):
    draw = random.Random(3)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 400 and 3000").limit(40).collect()]
    words = [r.part for r in novelty.word_parts(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("n", ascending=False).limit(400).collect()]
    heads = ['aws_secret_access_key = "', "Authorization: Bearer ", "export DB_PWD=", "private key ", 'session_id => "', "credentials: user "]
    secret = lambda: "".join(draw.choices(string.ascii_letters + string.digits + "+/", k=draw.choice([20, 32, 40])))
    plain = lambda: draw.choice(["_", "-", ""]).join([*draw.sample(words, 3), str(draw.randrange(10))]).ljust(16, "0")
    hit = false = 0
    for k in range(400):
        t = draw.choice(prose)
        at = t.find(" ", len(t) // 2)
        for make, novel in ((secret, True), (plain, False)):
            value = make()
            text = f"{t[:at]}\n{draw.choice(heads)}{value}\n{t[at:]}"
            a = text.index(value, at)
            found = any(kind != "hex" and s < a + len(value) and a < e for kind, s, e, _ in novelty.scan(text, meter))
            hit += novel and found
            false += not novel and found
    assert hit >= 0.98 * 400 and false <= 0.08 * 400, (hit, false)


def test_a_copy_nearby_does_not_make_a_secret_known(meter):
    value = "kR7vZq2LxW9pTn4HsB6yMd3F"
    text = f"bearer {value}\nbearer {value}\n"
    assert [s[:3] for s in novelty.scan(text, meter)] == [("novel", 7, 31), ("novel", 39, 63)]


def test_what_is_no_candidate(meter):
    for text in ("bearer\nkR7vZq2LxW9pTn4HsB6yMd3F", "kR7vZq2LxW9pTn4HsB6yMd3F", "bearer " + "x" * 64 + " kR7vZq2LxW9pTn4HsB6yMd3F", "bearer krvzqlxwptnhsbymdf", "bearer 1234567890_23456789", "bearer your_api_key_here_1"):
        assert novelty.scan(text, meter) == []


def test_edges(spark):
    long = "é" * 200_000 + "\nBearer kR7vZq2LxW9pTn4HsB6yMd3F"
    rows = novelty.digests(novelty.secrets(frame(spark, [None, "", "token = abcdefghijkl", "token = abcdefghijkl", long], [1, 2, 3, 3, None]))).collect()
    assert len(rows) == 5
    by = collections.defaultdict(list)
    for r in rows:
        by[r.id].append(r)
    assert by[1][0].base_sha256 == by[2][0].base_sha256 == hashlib.sha256(b"").hexdigest() and by[1][0].spans == ""
    assert [r.spans for r in by[3]] == ["assign:0:20"] * 2
    assert by[None][0].spans == "novel:200008:200032" and by[None][0].n_novel == 1
    assert novelty.secrets(frame(spark, ["x"]).where("false")).count() == 0
