"""The pipeline operators against brute force, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsift.llm import components, decontaminate, dedup, language, license_scan, line_dedup
from fieldsift.llm import common, ngram_lm, packing, quality, sharding, similarity
from fieldsift.llm.queries import held_out, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, sig string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(120)]
    for k in range(40):  # near copies in chains and groups
        parts = base[k % 7].split()
        parts[rng.randrange(len(parts))] = f"x{k}"
        base.append(" ".join(parts))
    base += [base[3]] * 9 + [None, "", "  \n", "A b", "a  B ", "łąka Ünï", "!!! 123 ???"]
    base += ["a page<|endoftext|>next page", "<|endoftext|>", "² ½ Ⅷ ①", "x" + "<|endoftext|>\n" * 30]
    base += [words(rng, 30_000), "nospaces" * 4000, "a b c d e a b c d e f"]
    return base


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}", len(t or ""), 1, "z") for k, t in enumerate(texts)]
    rows += [rows[3], (None, "null id text here", "en", None, None, 1, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_dedup(docs, none):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = dedup.decide(docs).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r, text in ((g, None) for g in got):
        kept[bytes(r.digest)] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for history in (F.lit(True), F.lit(False)):
        assert sorted(map(str, dedup.decide(docs, history).drop("row").collect())) == sorted(
            str(r) for r in dedup.decide(docs).drop("row").collect()
        )
    left = dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert dedup.decide(none).count() == 0 and dedup.deduplicated(none).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    sizes, bits = dedup.perfect_hash(keys)
    assert sorted(dedup.slots_of(keys, sizes, bits)) == list(range(5000))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_hits(text, items, window):
    own = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item, other in items:
        their = WORD.findall(lowered(other))
        size = min(window, len(their))
        for k in range(len(their) - size + 1 if size else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == their[k : k + size]:
                    hit.update(range(p, p + size))
                    found |= {str(item)} if item is not None else set()
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [decontaminate.PASS_BYTES, 400])
def test_decontamination(spark, docs, none, texts, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", limit)
    items = [(1, texts[0]), (2, " ".join(texts[10].split()[:14])), (30, "A, b"), (4, None), (5, "...")]
    items += [(1, texts[0]), (None, texts[20]), (None, texts[10]), (6, "Ünï"), (7, " ".join(texts[150].split()[2:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, bench).collect()
    assert len(got) == docs.count()
    source = defaultdict(list)
    for r in docs.collect():
        source[r.doc_id].append(r.text)
    for r in got:
        text = source[r.doc_id][0]
        n, hit, ids = brute_hits(text, items, decontaminate.WINDOW)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(ids)), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        spans = [WORD.findall(lowered(text[a:b])) for a, b in zip(r.begins, r.ends)]
        assert sum(map(len, spans)) == hit
    clean = decontaminate.cleaned(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.report(none, bench).count() == 0
    assert not decontaminate.report(docs, bench.limit(0)).where("contaminated").count()
    alone = bench.where("item_id IS NULL")  # hits, but no id to list
    hit = {r.doc_id: (r.contaminated, r.n_items) for r in decontaminate.report(docs, alone).collect()}
    assert hit[20] == (True, 0) and decontaminate.cleaned(docs, alone).where("doc_id = 20").count() == 0


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.packed(docs, tokenizer_path()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        want = [
            (k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
            for k, (a, n) in enumerate(packing.cut(len(ids), 1024))
        ]
        have = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc_id]})
        assert have == want, doc_id
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.packed(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 1025): rng.choice([1, 2, 7, 900]) for _ in range(rng.randrange(1, 200))}
    fill, placed = defaultdict(int), Counter()
    spans = defaultdict(list)
    for n, first, last, sequence, offset, repeat in packing.plan(counts):
        for k in range(last - first + 1):
            spans[sequence + k // repeat].append((offset + n * (k % repeat), n))
        placed[n] += last - first + 1
    assert placed == Counter(counts)
    for sequence, places in spans.items():
        for offset, n in sorted(places):
            assert offset == fill[sequence]
            fill[sequence] += n
        assert fill[sequence] <= 1024
    # Best fit needs at most 11/9 of the best possible, and that at least the sum.
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    halves = sum(c for n, c in counts.items() if n > 512)
    assert len(spans) <= max(least, halves) * 11 / 9 + 1


WHITE = re.compile("[\x20\x09-\x0d]+")


def brute_sets(texts, size):
    sets = []
    for t in texts:
        own = [w for w in WHITE.split(lowered(t)) if w]
        if len(own) < size:
            sets.append({tuple(own)} if own else set())
        else:
            sets.append({tuple(own[k : k + size]) for k in range(len(own) - size + 1)})
    return sets


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 60)])
@pytest.mark.parametrize("short", [32, 2])
def test_similarity(docs, none, texts, monkeypatch, size, percent, short):
    monkeypatch.setattr(similarity, "SHORT_LIST", short)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 8 if short == 2 else 8192)
    sets = brute_sets(texts, size)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = similarity.components(docs, size, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)), r.doc_id
    assert similarity.components(none, size, percent).count() == 0


def test_similarity_of_one_large_group(spark, monkeypatch):
    """A dense group whose lists are long: few sets are compared, none is lost."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 64)
    rng = random.Random(1)
    base = words(rng, 200, 10**6).split()
    rows = []
    for k in range(300):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    sets = brute_sets([t for _, t in rows], 4)
    seen, todo = {0}, [0]
    while todo:
        a = todo.pop()
        for b in range(300):
            both = len(sets[a] & sets[b])
            if b not in seen and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                seen.add(b)
                todo.append(b)
    got = similarity.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.component_id == 0} == seen


def test_frequent_shingles_are_counted_once_a_task(spark, monkeypatch):
    """Counts from small flushes, with shingles repeated within and between them."""
    monkeypatch.setattr(similarity, "_FLUSH", 50)
    monkeypatch.setattr(similarity, "LEAST_FREQUENT", 2)
    rng = random.Random(3)
    rows = [f"{words(rng, 12, 9)} a b c d e" for _ in range(90)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    got = similarity._counted(table, 4, 4).collect()
    counts = Counter(s for own in brute_sets(rows, 4) for s in own)
    found = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in got])
    assert sorted(found.tolist()) == sorted(n for n in counts.values() if n >= 2)


def test_similarity_of_long_texts(spark, monkeypatch):
    """Parity cells that are few for the size of a set rule out nothing that links."""
    monkeypatch.setattr(similarity, "MOST_CELLS", 64)
    rng = random.Random(5)
    base = words(rng, 3000, 10**6).split()
    rows = []
    for k in range(12):
        own = list(base)
        for at in rng.sample(range(3000), 20 + 12 * k):
            own[at] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    sets = brute_sets([t for _, t in rows], 4)
    links = [
        (a, b) for a in range(12) for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = list(range(12))
    for _ in range(12):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    got = similarity.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert 1 < len(set(want)) < 12


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 103: 100}


def test_language(spark, docs, none, texts):
    rng = random.Random(2)
    makers = {"en": ["the", "and", "ing"], "de": ["der", "ung", "sch"], "fr": ["eau", "que", "ée"], "es": ["ción", "los", "ñar"]}
    rows = [
        (k, " ".join("".join(rng.choices(makers[lang], k=3)) for _ in range(rng.randrange(3, 40))), lang)
        for k, lang in ((k, list(makers)[k % 4]) for k in range(400))
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(table, ~held_out(4))
    pred = {r.doc_id: r for r in language.identified(table, model).collect()}
    assert sum(pred[k].lang_pred == lang for k, _, lang in rows) >= 396
    own = {r.doc_id: r for r in language.identified(docs, model).collect()}
    for k, t in enumerate(texts):
        letters = any(c.isalpha() for c in t or "")
        assert (own[k].lang_pred == "und") == (not letters) and 0 <= own[k].score <= 1
    alone = language.identified(table.where("doc_id = 5"), model).head()
    assert alone.score == pytest.approx(pred[5].score) and alone.lang_pred == pred[5].lang_pred
    assert language.identified(none, model).count() == 0
    assert language.learned(none, ~held_out(4)) is None
    assert language.identified(docs, None).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 12])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(row) for row in code.tolist()}) == n


def test_sharding(docs, none):
    got = sharding.sharded(docs, 7, ("lang", "source", "n_chars", "doc_id"), 3).collect()
    count = docs.count()
    assert len(got) == count
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} <= {count // 7, -(-count // 7)} and len(slots) == 7
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
    assert sharding.sharded(none).count() == 0


def test_shards_are_written_and_prune(spark, docs, tmp_path):
    placed = sharding.sharded(docs, 6)
    sharding.write_shards(docs.withColumn("shard", F.lit("own")), str(tmp_path / "out"), 6)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, written.select("document.*").drop("shard").collect())) == sorted(
        map(str, docs.collect())
    )
    counts = {r["shard"]: r["count"] for r in written.groupBy("shard").count().collect()}
    assert counts == {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    wide = sharding.ranges(placed).selectExpr("avg(max_n_chars - min_n_chars) AS w").head().w
    assert wide < docs.agg(F.max("n_chars") - F.min("n_chars")).head()[0]


MIT = """Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL3 = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
LGPL2 = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
LICENSED = {
    1: ("Text. Released under the MIT License.\nMore.", "MIT"),
    2: (MIT, "MIT"),
    3: (re.sub(r"(?<!\n)\n(?!\n)", " ", MIT), "MIT"),
    4: (GPL3, "GPL-3.0-or-later"),
    5: (GPL3 + GPL3, "GPL-3.0-or-later"),
    6: (GPL3.replace("\n * ", " "), "GPL-3.0-or-later"),
    7: (LGPL2, "LGPL-2.1-or-later"),
    8: (GPL3.replace("General", "Affero General"), "AGPL-3.0-or-later"),
    9: (BSD, "BSD-2-Clause"),
    10: (BSD + BSD_NAME, "BSD-3-Clause"),
    11: (BSD.replace("\n", "\r\n"), "BSD-2-Clause"),
    12: (APACHE, "Apache-2.0"),
    13: (APACHE + "\n" + MIT, "Apache-2.0,MIT"),
    14: (ISC, "ISC"),
    15: ("intro words here\nLicensed under CC BY-NC 4.0\nmore words and no mark", "CC-BY-NC-4.0"),
    16: ("SPDX-License-Identifier: MPL-2.0\nint main() {}", "MPL-2.0"),
    17: ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    18: ("This work is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    19: (None, ""), 20: ("", ""), 21: ("My own licence terms! Some License.", ""),
    22: ("A long story without any notice. " * 4000 + GPL3, "GPL-3.0-or-later"),
    23: (GPL3.replace("either version 3 of the License, or\n * (at your option) any later version", "version 3"),
         "GPL-3.0-only"),
}


def test_licenses(spark, none):
    rows = [(k, t, "x", [k]) for k, (t, _) in LICENSED.items()]
    rows += [(24, "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", "x", [1])]
    rows += [rows[3], (None, MIT, "x", [1])]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string, licenses array<int>")
    found = license_scan.scanned(table).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    assert {k: got[k].licenses for k in LICENSED} == {k: name for k, (_, name) in LICENSED.items()}
    assert got[None].licenses == "MIT"
    assert got[21].n_unknown == 2 and got[24].sentence_ids == "ccbync4,ccbync4,reserved"
    assert got[24].licenses == "CC-BY-NC-4.0"
    assert license_scan.scanned(none).count() == 0


def test_the_filter_lets_every_known_sentence_pass():
    for sentence in license_scan.SENTENCES:
        assert any(hint in sentence for hint in license_scan.HINTS), sentence
        assert sentence == sentence.lower() and "  " not in sentence
    used = {i for _, ids in license_scan.RULES for i in ids}
    assert used <= set(license_scan.SENTENCES.values())


PAGES = "page_id long, url string, html string, host string, lines string, copy long"


def page_rows():
    def page(k, *lines, host="H.example"):
        return (k, f"http://{host}/{k}", "<p>".join(lines), "x", "y", 7)

    rows = [page(k, "menu", f"own {k}", "menu") for k in range(10)]
    rows += [page(10, "own 1"), (11, None, "menu<br>menu", "x", "y", 7)]
    rows += [page(12, "menu", host="b.example"), (13, "http://b.example", None, None, None, None)]
    # Two pages of a host hold the banner; of ten pages, three are exactly the ratio.
    rows += [page(k, "banner", f"t{k}", host="two.example") for k in (14, 15)]
    rows += [page(20 + k, "tie" if k < 3 else "no", f"u{k}", "four" if k < 4 else "", host="c.example") for k in range(10)]
    rows += [page(None, "again", "again", host="d.example")] * 3 + [page(40, "", host="d.example")]
    return rows


def brute_lines(rows, ratio, least):
    host = lambda url: url.split("/")[2].lower() if url else None
    split = lambda html: [s.strip() for s in re.split("<p>|<br>", html or "") if s.strip()]
    pages = Counter(host(r[1]) for r in rows)
    found = Counter((host(r[1]), s) for r in rows for s in set(split(r[2])))
    out = []
    for r in rows:
        h, own = host(r[1]), split(r[2])
        gone = lambda s: h and found[h, s] >= least and found[h, s] > ratio * pages[h]  # noqa: E731,B023
        kept = [s for s in own if not gone(s)]
        out.append((r[0], h, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, -1])
def test_line_dedup(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEY_PAGES", 3)
    rows = page_rows()
    table = spark.createDataFrame(rows, PAGES)
    got = line_dedup.cleaned(table, broadcast_bytes=broadcast_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows, 0.3, 2)
    by_id = {r.page_id: r for r in got.collect()}
    assert all(by_id[k].text == f"own {k}" and by_id[k].n_dropped == 2 for k in range(10))
    assert by_id[14].text == "t14" and by_id[20].text == "tie\nu0" and by_id[21].n_dropped == 1
    assert by_id[11].text == "menu\nmenu" and by_id[12].text == "menu" and by_id[13].n_lines == 0
    assert line_dedup.cleaned(table.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


def test_search_in_sorted_lists(spark):
    rows = [(sorted(set(range(0, 3 * n, 3))), v) for n in range(1, 40) for v in range(-1, 3 * n + 1)]
    table = spark.createDataFrame(rows, "a array<long>, v long")
    got = table.select("a", "v", line_dedup.holds(F.col("a"), F.col("v")).alias("in")).collect()
    assert all(r["in"] == (r.v in r.a) for r in got)


def test_line_dedup_of_a_very_long_page(spark):
    lines = "<p>".join(f"line {k}" for k in range(200_000))
    rows = [(k, "http://h/", lines + f"<p>own {k}") for k in range(2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    start = time.monotonic()
    got = line_dedup.cleaned(table).collect()
    assert {(r.n_lines, r.n_dropped, r.text) for r in got} == {(200_001, 200_000, f"own {k}") for k in range(2)}
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("sent", [common.SENT_IDS, 0])
def test_deduplicated_rows_of_repeated_and_null_ids(spark, sent, monkeypatch):
    monkeypatch.setattr(common, "SENT_IDS", sent)
    rows = [
        (1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c"), (3, None), (4, ""), (5, None),
        (None, "d"), (None, "d"), (None, "e"), (None, "c"), (6, "x"), (7, "b"), (7, "b"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def brute(rows):
        best = {}
        for doc_id, text in rows:
            key = text or ""
            best[key] = max(best.get(key, -1), -1 if doc_id is None else doc_id)
        kept = {(i, t or "") for i, t in rows if best[t or ""] == (-1 if i is None else i)}
        return sorted(kept, key=str)

    for part in (rows, [r for r in rows if r[0] is not None], rows[:4], rows[9:13], rows[:1]):
        table = spark.createDataFrame(part, "doc_id long, text string")
        got = sorted(((r.doc_id, r.text or "") for r in dedup.deduplicated(table).collect()), key=str)
        assert got == brute(part)


def test_language_model(docs, none, texts):
    got = ngram_lm.scored(docs, held_out(7)).collect()
    rows = docs.collect()
    assert len(got) == len(rows)

    def parts(text):
        return [w for w in WHITE.split(lowered(text)) if w] + [None]

    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not out(r.doc_id) for w in parts(r.text))
    n, v = sum(counts.values()), len(counts)
    text = {r.doc_id: r.text for r in rows}
    for r in got:
        own = parts(text[r.doc_id])
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert r.held_out == out(r.doc_id) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own), sum(counts[w] > 0 for w in own))
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert ngram_lm.scored(none, held_out(7)).count() == 0


def random_model(words_, seed=0):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(1, 1 << 63, words_, dtype=np.uint64))
    counts = (rng.pareto(1.0, len(keys)) * 20 + 1).astype(np.int64)
    return ngram_lm.Model(keys, counts, int(counts.sum()) + 300, len(keys) + 300), rng


def random_features(rng, n):
    return [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(3)]


@pytest.mark.parametrize("words_", [0, 1, 500, 3000, 80_000])
def test_model_probabilities_sum_to_one(words_):
    model, rng = random_model(words_)
    for _ in range(3 * (words_ > 0)):
        model.learn(random_features(rng, 9000), rng.integers(0, len(model.keys), 9000))
    named = np.flatnonzero(~model.unnamed(np.arange(len(model.keys))))
    assert len(named) == model.named == (model.log_counts >= np.log10(ngram_lm.NAMED + 1) - 1e-9).sum()
    one = random_features(rng, 1)
    chance = model.log10([np.repeat(f, len(named)) for f in one], named)
    rest = model.log10(one, np.array([-1]))
    assert (10**chance).sum() + (10**rest).sum() == pytest.approx(1, abs=1e-4)
    assert len(model.firsts) == 1 + (model.named > 992) + (model.named > 992 + 31 * 1024)


def test_untrained_model_is_the_counts_and_paths_are_distinct():
    model, rng = random_model(80_000)
    at = np.arange(-1, len(model.keys))
    chance = model.log10(random_features(rng, len(at)), at)
    named = ~model.unnamed(at)
    counts = 10 ** model.log_counts - 1
    assert 10 ** chance[named] * model.tokens == pytest.approx(counts[at[named]], rel=1e-3)
    taken = [[] for _ in at]
    for token, node, way in model.paths(at):
        assert (way < ngram_lm.WAYS).all() and (node < len(model.bias)).all()
        for k, step in zip(token.tolist(), zip(node.tolist(), way.tolist(), strict=True), strict=True):
            taken[k].append(step)
    assert len({tuple(x) for x, own in zip(taken, named, strict=True) if own}) == model.named
    # Frequent words are two steps away, and no node is met twice on a way.
    assert {len(x) for x in taken} == {2, 3, 4, 6} and all(len({n for n, _ in x}) == len(x) for x in taken)


def test_found_words():
    for words_ in (0, 1, 2, 5000):
        model, rng = random_model(words_)
        asked = np.concatenate([model.keys, rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        place = {int(k): i for i, k in enumerate(model.keys)}
        assert model.found(asked).tolist() == [place.get(int(k), -1) for k in asked]


def test_one_gradient_step_by_brute_force():
    model, rng = random_model(2000)
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    # Few contexts, so that runs of one row are short and long.
    features = [rng.choice(f[:k], 40) for f, k in zip(random_features(rng, 40), (1, 5, 40), strict=True)]
    at = rng.integers(-1, len(model.keys), 40)
    weights = model.weights.astype(np.float64)
    shift = 64 - model.bits
    for token, node, way in model.paths(at):
        rows = [
            [
                ((int(f[k]) ^ (int(n) * ngram_lm._SALTS[1] % 2**64)) * ngram_lm._SALTS[2] % 2**64) >> shift
                for k, n in zip(token, node, strict=True)
            ]
            for f in features
        ]
        gradients = []
        for i in range(len(token)):
            logits = model.bias[node[i]].astype(np.float64) + sum(weights[r[i]] for r in rows)
            chance = np.exp(logits) / np.exp(logits).sum()
            chance[way[i]] -= 1
            gradients.append(chance)
        for r in rows:
            for row in set(r):
                own = [g for g, x in zip(gradients, r, strict=True) if x == row]
                weights[row] -= ngram_lm.RATE * sum(own) / (len(own) + ngram_lm.DAMPING)
    model.learn(features, at)
    assert np.abs(model.weights - weights).max() < 1e-4


def test_model_grows_with_the_corpus():
    assert ngram_lm.row_bits(0) == 16 and ngram_lm.row_bits(10**9) == 18
    assert ngram_lm.row_bits(2 * 10**8) == 17
    assert ngram_lm.table_words(10) < ngram_lm.table_words(10**7) < ngram_lm.table_words(10**9)
    assert random_model(300)[0].named < random_model(30_000)[0].named


def test_model_learns_contexts():
    sequence, first = ngram_lm.tokens([b"a b c d e f g h " * 400] * 3)
    keys, counts = np.unique(sequence, return_counts=True)
    model = ngram_lm.Model(keys, counts, len(sequence), len(keys))
    features, at = ngram_lm.contexts(sequence, first), model.found(sequence)
    before = model.log10(features, at).sum()
    for _ in range(5):
        model.learn(features, at)
    assert model.log10(features, at).sum() > 0.8 * before


def test_held_out_texts_gain_over_counts(spark):
    """Words that follow from the two before them, in texts that taught nothing."""
    rng = random.Random(8)
    follow = {k: [rng.randrange(60) for _ in range(3)] for k in range(60)}
    rows = []
    for k in range(600):
        own, word = [], rng.randrange(60)
        for _ in range(80):
            word = rng.choice(follow[word])
            own.append(f"w{word}")
        rows.append((k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [r for r in ngram_lm.scored(table, held_out(7)).collect() if r.held_out]
    tokens_ = sum(r.n_tokens for r in out)
    assert sum(r.score - r.base_score for r in out) / tokens_ > 0.3


def test_quality(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        good = k % 5 > 0
        text = words(rng, 80) + "." if good else " ".join(["BUY!!! ###"] * rng.randrange(5, 60))
        rows.append((k, text, k % 2))
        labels.append((k, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (5, 0, 1), (5, 0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learned(table, marks, ~held_out(4))
    got = {r.doc_id: r.score for r in quality.scored(table, model).collect()}
    assert all((got[k] >= 0.7) == (k % 5 > 0) for k in range(300) if k != 5)
    kept = quality.accepted(table, model)
    assert kept.columns == table.columns and kept.count() == sum(s >= 0.7 for s in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 10**6)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, model).collect())
    assert quality.learned(table, marks.where("quality = 1"), ~held_out(4)) is None
    assert quality.scored(none, model).count() == 0 and quality.accepted(none, None).count() == 0


def test_cached_words_give_the_ids_of_whole_texts():
    """Random short texts with odd white space, marks and letters, with a full cache too."""
    own, rng = packing.WordTokens(tokenizer_path()), random.Random(1)
    letters = ["a", "b", " ", "\n", "é", ".", "!", "ą", "\t", "\u3000", "7", "the", "'s", "\r"]
    for k in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.ids([text]) == [np.array(want, "<u4").tobytes()], text
        if k % 500 == 0:
            own.words.clear()


def test_columns_with_the_names_of_helpers_stay(spark):
    rows = [(1, "a b c d e f", 7, 8, 9, 10), (2, "a b c d e f", 17, 18, 19, 20), (3, None, 27, 28, 29, 30)]
    table = spark.createDataFrame(
        rows, "doc_id long, text string, _digest int, _kept_id int, _kept_digest int, _gone_id int"
    )
    kept = dedup.deduplicated(table)
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[2]]
    left = similarity.representatives(table)
    assert left.columns == table.columns
    assert sorted(map(tuple, left.collect())) == [rows[0], rows[2]]


def test_letters():
    assert not any(map(language.has_letter, (None, "", " 1!", "²", "½", "Ⅷ", "①", "_")))
    assert all(map(language.has_letter, ("a", "ł", "中", "ª", "1 ж")))
