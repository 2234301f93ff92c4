import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from evidenceframe.llm import chunks, language, licenses, repetition
from evidenceframe.llm.queries import QUERIES

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, place int, score int, id string"


def documents(spark, texts, ids=None, lang=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, (lang or ["en"] * len(texts))[k], "s", 0, "d", 1, 2, "z") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_counts_against_brute_force(spark):
    texts = ["", None, "a b c a b c", "x\n\nx\n x\nx ", "é#*$ é#*$ é#*$ é#*$", "  \x1c a\x0bb", *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect())]
    rows = {r.id: r for r in repetition.repetition(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(grams)
        inside = {k for i_, g in enumerate(grams) if n[g] > 1 for k in (i_, i_ + 1, i_ + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_spans_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        w = [f"w{x}" * (1 + x % 3) for x in rng.integers(0, 6, rng.integers(0, 120))]
        m = repetition.measure(" ".join(w).encode())
        for k, got in zip(repetition.SPANS, m["span_chars"]):
            seen, inside = set(), set()
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                if g in seen:
                    inside |= set(range(i, i + k))
                seen.add(g)
            assert got == sum(len(w[i]) for i in inside)


def test_repeating_text_is_dropped_and_plain_kept():
    plain = " ".join(f"word{i}" for i in range(200))
    assert repetition.measure(plain.encode())["kept"]
    loop = " ".join(f"word{i % 60}" if i % 2 else f"other{i % 58}" for i in range(100)) + " " + plain
    assert not repetition.measure((plain[:300] + "\n" + plain[:300] + "\n" + plain[:500]).encode())["kept"]
    assert repetition.measure(loop.encode())["n_words"] == 300


def test_gear_hash_is_local():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    h = 0
    want = []
    for b in data.tolist():
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear_hashes(data).tolist() == want
    assert chunks.gear_hashes(data)[-100:].tolist() == chunks.gear_hashes(data[-140:])[-100:].tolist()


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    cut = lambda t: {t[a:b] for a, b in zip([0, *chunks.cut_points(t, 5, 16, 256)], chunks.cut_points(t, 5, 16, 256))}
    ends = chunks.cut_points(text, 5, 16, 256)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= 256 and sizes[:-1].min() >= 16
    a, b = cut(text), cut(text[:7000] + b"INSERTED" + text[7000:])
    assert len(a & b) > 0.97 * len(a)
    assert chunks.cut_points(b"", 5, 16, 256) == []


def test_repeated_passage_is_found_and_others_left(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    passage = words(60)
    texts = [words(80) + " " + passage + " " + words(70), words(33) + "\n" + passage + words(20), words(150), None, "", "short"]
    rows = chunks.repeated_spans(documents(spark, texts)).collect()
    assert {r.id for r in rows} == {0, 1} and {r.first_id for r in rows} == {0} and len(rows) == 2
    for r in rows:
        assert texts[r.id].encode()[r.start : r.start + r.length].decode() in passage and r.length > 150
        assert (r.other_id, r.removed_bytes) == ((1, 0) if r.id == 0 else (0, r.length))


def brute_repeats(texts, bits=5, least=16, most=256, span=100):
    """Every (text, start, end) of whole chunks that reach ``span`` bytes and stand twice or more, by dictionary."""
    seen = collections.defaultdict(list)
    for i, t in texts.items():
        data = (t or "").encode()
        ends = chunks.cut_points(data, bits, least, most)
        for a in [0, *ends[:-1]][: len(ends)]:
            b = next((e for e in ends if e >= a + span), None)
            if b is not None:
                seen[data[a:b]].append((i, a, b))
    return {x for places in seen.values() if len(places) > 1 for x in places}


def test_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = QUERIES["op6_gear_chunk_dedup"](spark, SF).collect()
    want = brute_repeats({i: t.decode() for i, t in data.items()})
    inside = {(i, a, b) for i, a, b in want for r in rows if r.doc_id == i and r.start <= a and b <= r.start + r.length}
    assert want and inside == want  # every repeat lies in a span
    edges = {(i, a) for i, a, _ in want}, {(i, b) for i, _, b in want}
    for r in rows:  # every span begins and ends with a repeat, and stands whole at the other place
        assert (r.doc_id, r.start) in edges[0] and (r.doc_id, r.start + r.length) in edges[1]
        own, other = data[r.doc_id][r.start : r.start + r.length], data[r.other_doc_id][r.other_start : r.other_start + r.length]
        assert own == other and len(own) >= 100 and (r.doc_id, r.start) != (r.other_doc_id, r.other_start)


def test_neighbours_from_different_places_do_not_join(spark):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    a, b = words(60), words(60)
    texts = [a + " " + words(40), words(40) + " " + b, a + b]
    for r in chunks.repeated_spans(documents(spark, texts)).collect():
        assert texts[r.id][r.start : r.start + r.length] in a or texts[r.id][r.start : r.start + r.length] in b + " "
    assert {r.other_id for r in chunks.repeated_spans(documents(spark, texts)).where("id = 2").collect()} == {0, 1}


def test_equal_rows_and_nulls_in_chunks(spark):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(100))
    rows = chunks.repeated_spans(documents(spark, [text, text, text], [5, 5, None])).collect()
    assert sorted((str(r.id), r.first_id, r.removed_bytes > 0) for r in rows) == [("5", 5, False), ("5", 5, True), ("None", 5, True)]
    assert chunks.repeated_spans(documents(spark, ["a"]).where("false")).count() == 0


def test_code_lengths_are_ppm():
    zero = np.zeros(256, np.int64)
    low, high = zero.copy(), zero.copy()
    low[[97, 98]] = [3, 1]
    high[97] = 2
    bits = language._code_lengths([high, low])
    assert np.isclose(bits[97], -np.log2(2 / 3))
    assert np.isclose(bits[98], -np.log2(1 / 3) - np.log2(1 / 2))  # escape, then b without the a ruled out
    assert np.isclose(bits[99], -np.log2(1 / 3) - np.log2(1 / 2) + np.log2(254))
    assert np.isclose((2.0**-bits).sum(), 1.0)


def slow_length(model_counts, order, text):
    data = bytes(language.LOWER[np.frombuffer(text, np.uint8)])
    total = 0.0
    for i, b in enumerate(data):
        chain = [model_counts[data[j:i]] for j in range(max(0, i - order), i + 1) if data[j:i] in model_counts]
        total += language._code_lengths(chain)[b]
    return total


def test_walk_equals_definition():
    train = {"en": b"the cat and the hat and the bat", "de": b"der hund und die katze und der hut"}
    order, rows = 3, []
    for lang, t in train.items():
        for d in range(order + 1):
            for g, n in collections.Counter(t[i : i + d + 1] for i in range(len(t) - d)).items():
                rows.append((lang, d, int.from_bytes(g, "big"), n))
    model = language.build_model(rows, order)
    trees = {}
    for lang, d, g, n in rows:
        raw = g.to_bytes(d + 1, "big")
        trees.setdefault(lang, {}).setdefault(raw[:-1], np.zeros(256, np.int64))[raw[-1]] += n
    texts = [b"the hut and the cat", "ünd étre THE".encode(), b"", b"x" * 300, b"hat der"]
    got = model.lengths(texts, columns=7)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert np.isclose(got[i, k], slow_length(trees[lang], order, t), rtol=1e-4, atol=1e-3)


def test_language_query(spark):
    rows = QUERIES["op7_ppm_language"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    en, fr = "the cat sat on the mat and the dog ran", "le chat est sur la table et le chien court"
    train = documents(spark, [en, fr] * 10, list(range(20)), ["en", "fr"] * 10)
    model = language.train(train)
    rows = language.identify(documents(spark, [None, "", "123 #!", "the dog sat", "le chien", "x" * 200_000], [None, 1, 1, 2, 3, 4]), model).collect()
    assert [r.lang_pred for r in rows][:5] == ["und", "und", "und", "en", "fr"] and [r.score for r in rows][:3] == [0.0] * 3
    assert rows[0].held_out is False
    blank = language.train(documents(spark, [en], [None], [None]))
    assert [r.lang_pred for r in language.identify(documents(spark, [en]), blank).collect()] == ["und"]
    assert language.identify(train.where("false"), model).count() == 0


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Words. Released under the MIT License.\nMore", ["MIT"]),
        ("A\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3. And on.", ["GPL-3.0-only"]),
        ("licensed UNDER the apache license, version 2.0", ["Apache-2.0"]),
        (MIT, ["MIT"]),
        ("It was licensed. The license is good.", []),
        ("", []),
        ("Released under the MIT License.\n" * 2, ["MIT", "MIT"]),
    ],
)
def test_licences(text, want):
    found = licenses.scan(text)
    assert [m["license"] for m in found] == want
    assert all(text[m["start"] : m["end"]].strip() for m in found)


def test_licence_rules_need_their_order():
    m = licenses.scan(MIT)
    assert m[0]["sentence_ids"] == ["mit-title", "mit-grant", "mit-condition"] or m[0]["sentence_ids"] == ["mit-grant", "mit-condition"]
    assert licenses.scan("x\n" * 9 + "Apache License") == []


def test_licence_rows(spark):
    texts = [None, "", "plain text", "Released under the MIT License.", "Released under the MIT License.", "word " * 50_000 + ".\nLicensed under CC BY-NC 4.0."]
    rows = sorted((r.id, r.match, r.license) for r in licenses.license_matches(documents(spark, texts, [0, 1, 2, 3, 3, 5])).collect())
    assert rows == [(3, 0, "MIT"), (3, 0, "MIT"), (5, 0, "CC-BY-NC-4.0")]
    brute = [(r.doc_id, len(licenses.scan(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if licenses.scan(r.text)]
    assert sum(n for _, n in brute) == QUERIES["op10_license_sentences"](spark, SF).count()


def test_the_sample_is_bounded(spark):
    rows = documents(spark, [f"text {k % 7}" for k in range(600)], [k % 300 if k % 3 else 5 for k in range(600)], ["en" if k % 4 else "fr" for k in range(600)])
    got = language.sample_rows(rows.select(*(rows[c].alias(n) for c, n in (("doc_id", "id"), ("text", "text"), ("lang", "lang")))), 16).collect()
    n = collections.Counter(r.lang for r in got)
    assert set(n) == {"en", "fr"} and max(n.values()) <= 16 and len({(r.id, r.lang) for r in got}) == len(got)


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(4)
    alphabets = [rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:9].tolist() for _ in range(35)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k], 5)) for _ in range(60))
    langs = [f"l{k:02d}" for k in range(35) for _ in range(4 if k else 2)]
    texts = [text(int(x[1:])) for x in langs]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][: len(texts)]
    docs = documents(spark, texts, ids, langs)
    model = language.train(docs)
    assert model.languages == sorted(set(langs)) and len(model.packed) == 5
    got = {r.id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert [got[i] for i in ids] == langs


def test_the_pipeline_keeps_languages_not_learnt(spark):
    other = "просто текст на другом языке без разметки"
    texts, langs = ["the dog sat on the mat and the cat ran " * 9, other, "123"], ["en", None, None]
    kept = lambda names: sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, documents(spark, texts, [0, 3, 4], names), "").collect())
    assert kept(langs) == [0, 3] and kept([None] * 3) == [0, 3]


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")


def test_every_known_sentence_is_met():
    single = {rule[0]: name for name, rules in licenses.RULES.items() for rule in rules if len(rule) == 1}
    for key, texts in licenses.SENTENCES.items():
        for text in texts:
            assert [m[2] for m in licenses.known_sentences(f"Before.\n{text}.\nAfter")] == [key], text
            assert key not in single or [m["license"] for m in licenses.scan(text)] == [single[key]]
    for text, name, two in ((GPL3, "GPL-3.0-or-later", "gpl-free"), (GPL2, "GPL-2.0-or-later", "gpl2-free")):
        assert [(m["license"], m["sentence_ids"]) for m in licenses.scan(text)] == [(name, [two, "gpl-hope"])]


def test_every_identifier_stands_in_a_rule():
    used = {k for rules in licenses.RULES.values() for rule in rules for k in rule}
    assert used == set(licenses.SENTENCES) and len(licenses.KNOWN) == sum(len({licenses.normalise(t) for t in texts}) for texts in licenses.SENTENCES.values())


BSD3 = """Copyright (c) 2019, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""


def brute_scan(text, gap=3):
    """Licences by trying every run of pieces as a sentence and every rule at every place."""
    text = licenses.LEADER.sub(lambda m: " " * len(m[0]), text)
    cut = list(licenses.pieces(text, text.lower()))
    met, at = [], 0
    while at < len(cut):
        runs = [(k, " ".join(licenses.normalise(text[a:b]) for a, b, *_ in cut[at : k + 1])) for k in range(at, min(len(cut), at + 60))]
        known = [(k, key) for k, said in runs for key, texts in licenses.SENTENCES.items() if said in {licenses.normalise(t) for t in texts}]
        if known:
            k, key = known[-1]
            met.append((cut[at][2], cut[k][2], key))
            at = k
        at += 1
    out, at = [], 0
    while at < len(met):
        fits = [(len(rule), name) for name, rules in licenses.RULES.items() for rule in rules if [m[2] for m in met[at : at + len(rule)]] == list(rule) and all(b[0] - a[1] - 1 <= gap for a, b in zip(met[at : at + len(rule)], met[at + 1 : at + len(rule)]))]
        if fits:
            n, name = min(fits, key=lambda x: (-x[0], x[1]))
            out.append(name)
            at += n - 1
        at += 1
    return out


def test_licences_equal_brute_force(spark):
    spdx = "// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT\nCopyright. All rights reserved."
    texts = [MIT, GPL3, GPL2, BSD3, spdx, MIT + BSD3, "Apache License\nVersion 2.0, January 2004\n", "Distributed under the Boost Software License, Version 1.0.\n"]
    assert [brute_scan(t) for t in texts[3:5]] == [["BSD-3-Clause"], ["GPL-2.0-or-later", "MIT", "All-Rights-Reserved"]] and [brute_scan(t) for t in texts[6:]] == [["Apache-2.0"], ["BSL-1.0"]]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = [t for t in texts if any(a in t.lower() for a in licenses.ANCHORS)]
    assert [[m["license"] for m in licenses.scan(t)] for t in texts] == [brute_scan(t) for t in texts] and len(texts) > 10


def test_licences_in_comments_and_broken_lines(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    for lead in ("# ", " * ", "// ", "-- ", "dnl "):
        comment = lambda t: "".join(f"{lead}{line}\n" for line in t.splitlines())  # noqa: B023, E731
        assert [[m["license"] for m in licenses.scan(comment(t))] for t in (MIT, isc, GPL3)] == [["MIT"], ["ISC"], ["GPL-3.0-or-later"]], lead
        assert licenses.scan(comment(MIT))[0]["sentence_ids"] == licenses.scan(MIT)[0]["sentence_ids"]
    texts = ["Released\nunder  CC BY\n4.0.", "# This work is dedicated to the public\n# domain.", "This is free and unencumbered software released into the public\ndomain."]
    rows = sorted((r.id, r.license) for r in licenses.license_matches(documents(spark, texts)).collect())
    assert rows == [(0, "CC-BY-4.0"), (1, "CC0-1.0"), (2, "Unlicense")]
