"""The training-data operators against brute-force versions on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, chunks, exact_dedup, license_scan, line_dedup, mixing, quality, queries, simhash, substring_dedup, suffix_dedup, suffixes, topk
from pulsegrid.llm.components import components

WORDS = "alpha beta gamma delta the of and in on for lorem ipsum dolor sit amet".split()
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, ord long, row string, pos int, h long, fp long, u long, chunk int, copies int")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def corpus(seed=3):
    """Texts with copies, near copies, shared lines and passages, odd white space, nulls, repeated rows and ids."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 45), sentence(rng, 9)
    texts = [sentence(rng, rng.randint(1, 80)) for _ in range(20)]
    texts += [texts[0], texts[1].replace(" ", "\n\t"), texts[2] + " ", " " + texts[2], texts[3] + " extra"]
    texts += [f"{sentence(rng, 12)} {passage}\n{sentence(rng, 5)}" for _ in range(4)]
    texts += [f"{line}\n{sentence(rng, 30)}\n {line.upper()} \nshort\nshort" for _ in range(4)]
    texts += ["", "   ", "\n", None, None, "x", "é中🙂 " * 60, "same same " * 200, "a" * 5000, sentence(rng, 6000), " odd space \x1c x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[5], (None, texts[4]), (None, "no id at all " * 30)]


def frame(spark, rows, parts=3):
    full = [(i, t, None if i is None or i % 5 == 0 else "en", None if i is None or i % 7 == 0 else f"s{i % 3}", None, *([None] * 9)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def distinct_ids(rows):
    seen, out = set(), []
    for i, t in rows:
        if i is not None and i not in seen:
            seen.add(i)
            out.append((i, t))
    return sorted(out)


def result(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [(x is None, x) for x in r])


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# -- exact dedup --------------------------------------------------------------
@pytest.mark.parametrize("block, weak", [(1024, False), (16, False), (7, True)])
def test_exact_dedup(spark, block, weak):
    rows = corpus()
    route = (lambda c: F.length(c).cast("bigint")) if weak else F.xxhash64
    got = exact_dedup.exact_dedup(frame(spark, rows), block=block, route=route).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(norm(t)), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(ids))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in rows)


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- byte-level BPE -----------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(queries.RANKS, "rb").read(), queries.PATTERN)


def test_bpe_joins_at_any_seam(codec):
    rng = random.Random(1)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "'", "'re", "'ll", "1", "23", "!", "é", "中", "\t", "\x1c", "\xa0", "🙂", "\r\n"]
    for _ in range(3000):
        part = rng.sample(alphabet, rng.randint(1, 6))
        text = "".join(rng.choice(part) for _ in range(rng.choice([3, 10, 40, 150])))
        ids = codec.encode(text, leaf=rng.choice([1, 2, 3, 5, 16]))
        assert ids == codec.enc.encode_ordinary(text)
        assert codec.decode(ids, leaf=3) == text.encode()


def test_bpe_long_matches(codec, monkeypatch):
    for text in ("a" * 9000, " " * 9000, "ab" * 6000, "x" * 5000 + " " * 5000 + "!" * 5000, "中" * 5000, "it's" * 3000):
        assert codec.encode(text) == codec.enc.encode_ordinary(text)
    monkeypatch.setattr(bpe, "PIECE_LEAF", 8)
    rng = random.Random(2)
    for _ in range(400):
        piece = "".join(rng.choice("abcdefghij"[:rng.choice([1, 2, 10])]) for _ in range(rng.randint(1, 700))).encode()
        assert codec.piece(piece) == codec.enc._encode_single_piece(piece)


def test_bpe_round_trip(spark, codec):
    rows = corpus()
    df = frame(spark, rows)
    got = result(bpe.round_trip(df, queries.RANKS, queries.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in rows:
        ids = codec.enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert got == sorted(want, key=lambda r: [(x is None, x) for x in r])
    both = bpe.decode(bpe.encode(df, queries.RANKS, queries.PATTERN), queries.RANKS, queries.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.select("text", "decoded").collect())


# -- substring dedup ------------------------------------------------------------
def brute_substrings(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


@pytest.mark.parametrize("window, chunk_bytes", [(20, 8 << 20), (20, 2000), (7, 3000), (2, 4000)])
def test_substring_dedup(spark, window, chunk_bytes):
    rows = distinct_ids(corpus())
    got = substring_dedup.substring_dedup(frame(spark, rows), window=window, chunk_bytes=chunk_bytes, with_text=True)
    assert result(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, window)
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got.collect())


def test_substring_dedup_ids_and_nulls(spark):
    rows = corpus()
    in_order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    got = substring_dedup.substring_dedup(frame(spark, rows), chunk_bytes=3000)
    want = sorted(brute_substrings(in_order, 20), key=lambda r: [(x is None, x) for x in r])
    assert result(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


# -- line dedup -----------------------------------------------------------------
def brute_lines(rows):
    ws, key = " \t\n\v\f\r", lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    assert ws
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                k = (i is None, i or 0)
                owner[key(x)] = min(owner.get(key(x), k), k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (i is None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = corpus()
    got = line_dedup.line_dedup(frame(spark, rows), keep=["source", "size"], batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "source", "size", "n_lines", "n_dropped", "kept_text"]
    assert result(got.withColumn("s", F.sha2("kept_text", 256)), "doc_id", "n_lines", "n_dropped", "s") == brute_lines(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_run_")]


@pytest.mark.parametrize("same", [True, False])
def test_lines_of_many_rows_without_an_id(spark, same):
    """A third of the rows has no id (and even one text): what is dropped of them is kept row by row."""
    shared = [f"a shared line number {i}" for i in range(6)]
    rows = [(i, "\n".join([shared[i % 6], f"own line of document {i}"])) for i in range(80)]
    rows += [(None, "\n".join([shared[0], "x" if same else f"a line without an id {i}", shared[i % 6 if not same else 1]])) for i in range(40)]
    got = line_dedup.line_dedup(frame(spark, rows))
    from collections import Counter
    want = [(i, *r) for i, *r in ((a, b, c, d) for a, b, c, d in brute_lines(rows))]
    have = [(r.doc_id, r.n_lines, r.n_dropped, sha(r.kept_text)) for r in got.collect()]
    assert Counter(have) == Counter(want)


# -- mixing -----------------------------------------------------------------------
def cheapest(capacity, member_of, quota, repeats):
    """Least cost over all ways to fill the quotas as far as they can be filled (tiny cases)."""
    import itertools
    best = None
    options = []
    for c, members in zip(capacity, member_of):
        options.append([x for x in itertools.product(*[range(c * repeats + 1) if s in members else [0] for s in range(len(quota))]) if sum(x) <= c * repeats])
    for pick in itertools.product(*options):
        fed = [sum(p[s] for p in pick) for s in range(len(quota))]
        if any(f > q for f, q in zip(fed, quota)):
            continue
        cost = sum(k * min(c, max(0, sum(p) - k * c)) for p, c in zip(pick, capacity) for k in range(repeats))
        if best is None or (-sum(fed), cost) < best:
            best = (-sum(fed), cost)
    return best


def test_min_cost_flow_is_cheapest():
    rng = random.Random(4)
    for _ in range(25):
        n, m = rng.randint(1, 3), rng.randint(1, 2)
        capacity = [rng.randint(1, 2) for _ in range(n)]
        member_of = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)]
        quota = [rng.randint(0, 5) for _ in range(m)]
        flow = mixing.min_cost_flow(capacity, member_of, quota, 3)
        fed = sum(sum(f.values()) for f in flow)
        cost = sum(k * min(c, max(0, sum(f.values()) - k * c)) for f, c in zip(flow, capacity) for k in range(3))
        assert (-fed, cost) == cheapest(capacity, member_of, quota, 3)
        assert all(s in member_of[p] for p, f in enumerate(flow) for s in f)
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota))


def test_mix(spark):
    rows = corpus()
    df = frame(spark, rows)
    mixed = mixing.mix(df, keep=["source", "copies"])
    got = mixed.rows.collect()
    about = {r.source: r for r in mixed.sources.collect()}
    assert len(got) == len(rows)
    assert list(about) == sorted((s for s in about if s is not None)) + [None]
    assert sum(r.target for r in about.values()) == pytest.approx(sum(r.source_size for r in about.values()))
    for s, a in about.items():
        taken = sum(r.taken for r in got if r.source == s)
        assert a.source_size == sum(r.size for r in got if r.source == s)
        assert abs(taken - a.target) <= 3 and a.target <= 3 * a.source_size
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.mix(frame(spark, list(reversed(rows)), parts=5)).rows
    assert result(again, "doc_id", "size", "taken") == result(mixed.rows, "doc_id", "size", "taken")


def test_mix_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 2 else ["b", "b", "c"] if i % 3 else None) for i in range(60)],
                               "doc_id long, text string, s array<string>")
    mixed = mixing.mix(df, sources=F.col("s"))
    about = mixed.sources.collect()
    assert [r.source for r in about] == ["a", "b", "c", None]
    assert sum(r.taken for r in mixed.rows.collect()) == sum(r.routed for r in about)
    assert all(abs(r.routed - r.target) <= 1 for r in about)


def test_targets_reshare():
    got = mixing.targets([100, 1, 100], [1, 2, 3], 201)
    assert got[1] == 3 and sum(got) == pytest.approx(201) and got[2] == pytest.approx(3 * got[0])
    assert mixing.targets([], [], 0) == [] and mixing.targets([0], [1], 0) == [0.0]


@pytest.mark.parametrize("n", [1, 4, 200])
def test_shared_targets_equal_the_plain_rounds(spark, n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 3, 10, 1000, 10 ** 6]) for _ in range(n)]
    weights = [rng.randint(1, 9) for _ in range(n)]
    df = spark.createDataFrame(list(zip(range(n), sizes, weights)), "i long, source_size long, weight long")
    got = [r.target for r in mixing.shared_targets(df, sum(sizes)).orderBy("i").collect()]
    assert got == pytest.approx(mixing.targets(sizes, weights, sum(sizes)), rel=1e-12)


_ORDER: dict = {}  # Spark's xxhash64 of (seed, id, size), as the unsigned number that documents are ordered by


def brute_choice(rows, targets):
    """Words taken of each (id, source, size) of disjoint sources: whole uses, then documents in hash order, the last one in part."""
    out = {}
    for s, goal in targets.items():
        own = sorted((_ORDER[i, n], i, n) for i, src, n in rows if src == s and n)
        size = sum(n for *_, n in own)
        goal = round(goal)
        whole, rest = (goal // size, goal % size) if size else (0, 0)
        for _, i, n in own:
            out[i] = whole * n + min(n, rest)
            rest -= min(n, rest)
    return out


@pytest.mark.parametrize("n_sources", [3, 400])
def test_mix_chooses_as_the_plain_version(spark, n_sources):
    """More sources than documents share: every source's own words, chosen in hash order, the document at the cut in part."""
    rng = random.Random(n_sources)
    rows = [(i, f"s{min(rng.randrange(n_sources), rng.randrange(n_sources))}", rng.choice([0, 1, 5, 30, 200])) for i in range(900)]
    df = spark.createDataFrame([(i, "w " * n, s) for i, s, n in rows], "doc_id long, text string, source string").repartition(4)
    hashes = spark.createDataFrame([(i, n) for i, _, n in rows], "i long, n long").select("i", "n", F.xxhash64(F.lit(mixing.SEED), "i", "n").alias("u"))
    _ORDER.update({(r.i, r.n): r.u & (1 << 64) - 1 for r in hashes.collect()})
    mixed = mixing.mix(df)
    about = {r.source: r for r in mixed.sources.collect()}
    names = sorted(about)
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    want = dict(zip(names, mixing.targets(sizes, [i % 3 + 1 for i in range(len(names))], sum(sizes))))
    assert all(about[s].target == pytest.approx(want[s]) and about[s].routed == round(about[s].target) for s in names)
    taken = brute_choice(rows, {s: about[s].target for s in names})
    assert {r.doc_id: r.taken for r in mixed.rows.collect()} == {i: taken.get(i, 0) for i, _, _ in rows}


# -- SimHash ------------------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_near_dedup(spark):
    rows = corpus()
    got = simhash.near_dedup(frame(spark, rows)).withColumn("hex", simhash.as_hex(F.col("fp"))).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = linked({f for _, f in fps}, 2)
    first = {}
    for i, f in fps:
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", first.get(root[f])) for i, f in fps), key=lambda r: [(x is None, x) for x in r])
    assert sorted(((r.doc_id, r.hex, r.component_id) for r in got), key=lambda r: [(x is None, x) for x in r]) == want
    stay = simhash.heads(frame(spark, rows)).collect()
    assert len(stay) == len(set(root.values()))
    assert sorted(r.doc_id for r in stay if r.doc_id is not None) == sorted(first.values())


@pytest.mark.parametrize("bits, up_to", [(2, 64), (2, 3), (1, 3), (0, 2)])
def test_simhash_links_of_crowded_keys(spark, bits, up_to):
    rng = np.random.default_rng(bits + up_to)
    values = set()
    for base in rng.integers(0, 1 << 62, 2).tolist():
        for _ in range(150):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            values.add(x - (1 << 64) if x >= 1 << 63 else x)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, bits, up_to)).collect()}
    want = linked(values, bits)
    assert all(got.get(v, v) == want[v] for v in values)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}


# -- licences ------------------------------------------------------------------------
def test_licence_scan(spark):
    rng = random.Random(5)
    plain = [(i, "\n".join(sentence(rng, rng.randint(3, 15)) for _ in range(4))) for i in range(60)]
    noticed = [(100 + k, f"{sentence(rng, 9)}\n{text}\n{sentence(rng, 8)}") for k, text in enumerate(t for v in license_scan.NOTICES.values() for t in v)]
    odd = [(200, None), (201, ""), (202, "\n \n"), (None, "Released under the MIT License."), (203, "the license of the road was in the public eye " * 3)]
    got = {r.doc_id: r for r in license_scan.licence_scan(frame(spark, plain + noticed + odd)).collect()}
    assert len(got) == len(plain + noticed + odd)
    assert all(got[i].licence == "unknown" and got[i].n_notices == 0 for i, _ in plain)
    names = [f for f, v in license_scan.NOTICES.items() for _ in v]
    assert [got[100 + k].licence for k in range(len(names))] == names
    assert got[200].n_paragraphs == got[201].n_paragraphs == got[202].n_paragraphs == 0
    assert got[None].licence == "mit" and got[203].licence == "unknown"


def test_licence_scan_wrapped(spark):
    """Notices wrapped at any width, in prose or a comment, count as on one line."""
    rng = random.Random(6)
    plain = [(i, "\n".join(sentence(rng, rng.randint(3, 15)) for _ in range(4))) for i in range(60)]
    every = [(f, t) for f, texts in license_scan.NOTICES.items() for t in texts]
    wrapped, want = [], {}
    for width in (16, 40, 72, 80):
        for mark in ("", " * "):
            for lead in (0, 5):
                for f, text in every:
                    lines = textwrap.wrap(f"{sentence(rng, lead)} {text} {sentence(rng, lead)}".strip(), width, break_long_words=False)
                    want[1000 + len(want)] = f
                    wrapped.append((999 + len(want), "\n".join(mark + x for x in lines)))
    bsd = ("Copyright (c) 2020, The Authors.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain this.")
    whole = [(1, bsd), (2, bsd.replace("reserved.\n\n", "reserved.\n")), (3, "MIT License\n\nCopyright (c) 2020 A\n\n" + textwrap.fill(
        license_scan.NOTICES["mit"][1] + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights', 72)),
        (4, textwrap.fill(license_scan.NOTICES["gpl-3.0"][1] + " as published by the Free Software Foundation, either version 3 of the License.", 72)),
        (5, "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */")]
    docs = frame(spark, [(i + 10000, t) for i, t in plain] + wrapped + whole)
    got = {r.doc_id: r for r in license_scan.licence_scan(docs).collect()}
    assert not {i: (got[i].licence, f) for i, f in want.items() if got[i].licence != f}
    assert all(got[i].families == [f] and got[i].n_notices == 1 and got[i].n_paragraphs == 1 for i, f in want.items())
    assert [got[i].families for i in range(1, 6)] == [["bsd", "proprietary"]] * 2 + [["mit"], ["gpl-3.0"], ["mpl-2.0"]]
    assert [got[i].n_paragraphs for i in range(1, 6)] == [3, 2, 3, 1, 1]
    assert all(got[i + 10000].licence == "unknown" for i, _ in plain)


def test_licence_scan_customary(spark):
    """Customary headers, wrapped as published, that are no example of the training: recall and precision by family."""
    rng = random.Random(8)
    wrap = lambda t: textwrap.fill(t, 76)
    offered = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    found = [
        ("gpl-2.0", wrap(offered.format("This program", "", "2"))),
        ("gpl-2.0", "/*\n * " + wrap(offered.format("This program", "", "2")).replace("\n", "\n * ") + "\n */"),
        ("gpl-2.0", "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991"),
        ("gpl-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later"),
        ("gpl-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
        ("gpl-3.0", wrap(offered.format("This program", "", "3"))),
        ("gpl-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
        ("lgpl", wrap(offered.format("This library", "Lesser ", "2.1"))),
        ("lgpl", wrap(offered.format("This program", "Lesser ", "3"))),
        ("lgpl", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999"),
        ("agpl-3.0", wrap(offered.format("This program", "Affero ", "3"))),
        ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
        ("mit", "The MIT License (MIT)\n\nCopyright (c) 2015 Someone"),
        ("mit", "## License\n\nThis project is licensed under the MIT License - see the LICENSE.md file for details"),
        ("mit", wrap("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation")),
        ("isc", wrap("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")),
        ("isc", "This code is licensed under the ISC license."),
        ("bsd", wrap("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
        ("bsd", "# SPDX-License-Identifier: BSD-2-Clause"),
        ("bsd", wrap("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")),
        ("apache-2.0", "   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License."),
        ("apache-2.0", wrap("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")),
        ("apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004"),
        ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License (http://creativecommons.org/licenses/by/4.0/)."),
        ("cc-by-sa", "This article is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("cc-by-nd", "The text is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
        ("cc-by-nc", "Content licensed under CC BY-NC 4.0 unless noted."),
        ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this */"),
        ("public-domain", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish"),
        ("public-domain", "// SPDX-License-Identifier: CC0-1.0"),
    ]
    clean = ["A fishing license is required at the lake, and the general public may apply for it in January.",
             "The library offers free software courses; you can register for them under the usual terms.",
             "They were permitted to use the hall, provided that the following rules were met.",
             "The company was licensed under state law to sell insurance to the public.",
             "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
             "The apache tribe granted no license; version 2 of the story is longer."]
    plain = [(i, "\n".join(sentence(rng, rng.randint(3, 15)) for _ in range(4))) for i in range(60)]
    docs = plain + [(100 + i, f"{sentence(rng, 7)}\n\n{t}\n\n{sentence(rng, 7)}") for i, (_, t) in enumerate(found)] + [(200 + i, t) for i, t in enumerate(clean)]
    got = {r.doc_id: r.families for r in license_scan.licence_scan(frame(spark, docs)).collect()}
    wrong = [(f, got[100 + i]) for i, (f, _) in enumerate(found) if set(got[100 + i]) - {f}]
    missed = [f for i, (f, _) in enumerate(found) if f not in got[100 + i]]
    assert not wrong, wrong
    assert len(missed) <= 0.1 * len(found), missed
    assert not [got[200 + i] for i in range(len(clean)) if got[200 + i]]
    assert not [got[i] for i, _ in plain if got[i]]


def test_licence_scan_shared_ids(spark):
    """Rows without an id, or with one id, have findings of their own."""
    rng = random.Random(7)
    plain = [(i, sentence(rng, 12)) for i in range(40)]
    rows = [(None, "Released under the MIT License."), (None, "SPDX-License-Identifier: Apache-2.0"), (None, None), (None, sentence(rng, 9)),
            (50, "All rights reserved."), (50, "All rights reserved."), (50, "Licensed under CC BY 4.0.\n\nAll rights reserved.")]
    got = license_scan.licence_scan(frame(spark, plain + rows)).where("doc_id IS NULL OR doc_id = 50").collect()
    want = [(50, 1, ["proprietary"])] * 2 + [(50, 2, ["cc-by", "proprietary"]), (None, 0, []), (None, 1, []), (None, 1, ["apache-2.0"]), (None, 1, ["mit"])]
    key = lambda r: (r[0] is None, *r[1:])
    assert sorted([(r.doc_id, r.n_paragraphs, r.families) for r in got], key=key) == sorted(want, key=key)


# -- suffix-array dedup ------------------------------------------------------------------
def test_difference_cover_shifts():
    for v in (3, 16, 32):
        d = suffixes.shifts(v)
        cover = set(suffixes.difference_cover(v))
        assert (d >= 0).all() and (d < v).all()
        assert all((a + d[a, b]) % v in cover and (b + d[a, b]) % v in cover for a in range(v) for b in range(v))


def test_suffix_classes():
    rng = np.random.default_rng(1)
    for trial in range(20):
        base = bytes(rng.integers(97, 99 + trial % 4, 300).astype(np.uint8))
        text = b"".join(base[a:a + rng.integers(1, 200)] for a in rng.integers(0, 250, 15))
        pos = np.flatnonzero(rng.random(len(text) - 49) < 0.7)
        order, group = suffixes.suffix_classes(np.frombuffer(text, np.uint8), pos, 50, bucket=64)
        keys = [text[p:p + 50] for p in order]
        assert sorted(order) == list(pos) and keys == sorted(keys)
        assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], group, group[1:]))


def brute_bytes(rows, length):
    by_id = {}
    for i, t in rows:
        data = (t or "").encode()
        by_id.setdefault((i is None, i or 0), set()).update(data[s:s + length] for s in range(len(data) - length + 1))
    out, seen = [], set()
    for key in sorted(by_id):
        for i, t in rows:
            if (i is None, i or 0) != key:
                continue
            data = (t or "").encode()
            gone = np.zeros(len(data) + 1, dtype=int)
            for s in range(len(data) - length + 1):
                if data[s:s + length] in seen:
                    gone[s:s + length] = 1
            runs = int((np.diff(np.append(0, gone)) == 1).sum())
            out.append((i, len(data), int(gone.sum()), runs, sha(bytes(x for x, g in zip(data, gone) if not g))))
        seen |= by_id[key]
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("length, chunk_bytes", [(50, 4 << 20), (50, 2000), (33, 3000)])
def test_suffix_dedup(spark, length, chunk_bytes):
    rows = corpus()
    got = suffix_dedup.suffix_dedup(frame(spark, rows), length=length, chunk_bytes=chunk_bytes, with_bytes=True)
    assert result(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, length)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got.collect())


# -- rows that share an id -------------------------------------------------------------------
def crowded_rows():
    """A third of all rows without an id, a third with one id, the least long among the ids, passages shared within and across."""
    rng = random.Random(9)
    passages = [sentence(rng, 40) for _ in range(6)]
    some = lambda: f"{sentence(rng, rng.randint(1, 25))} {rng.choice(passages)} {sentence(rng, rng.randint(0, 9))}"
    copies = [some() for _ in range(4)]
    rows = [(i, some()) for i in (*range(28), -(1 << 63), (1 << 63) - 2)]
    for own in (None, 11, -(1 << 63)):
        rows += [(own, some()) for _ in range(18)] + [(own, rng.choice(copies)) for _ in range(10)] + [(own, ""), (own, None)]
    rng.shuffle(rows)
    return rows


def test_rows_that_share_an_id_fill_several_chunks(spark):
    rows, size = crowded_rows(), 1500
    held = chunks.deal(frame(spark, rows), chunk_bytes=size)
    packed = held.frame.toPandas()
    got = [chunks.Texts(pa.Table.from_pandas(t)) for _, t in packed.groupby("chunk")]
    assert sum(len(t.texts) for t in got) == len(rows) and packed.chunk.max() < held.chunks
    assert max(sum(map(len, t.texts)) for t in got) < size + max(len((t or "").encode()) for _, t in rows)
    begin, end = held.shared_ids
    assert len(begin) == 3 and ((end - begin) > 3).all()
    alone = [set(t.ids.tolist()) for t, c in zip(got, sorted(packed.chunk.unique())) if ((begin <= c) & (c < end)).any()]
    assert all(len(ids) == 1 for ids in alone) and set().union(*alone) == {-(1 << 63), 11, (1 << 63) - 1}
    assert chunks.group_of(held.shared_ids, np.arange(held.chunks))[begin[1]:end[1]].tolist() == [begin[1]] * (end[1] - begin[1])


@pytest.mark.parametrize("size", [1500, 4000])
def test_dedup_of_rows_that_share_an_id(spark, size):
    rows = crowded_rows()
    got = suffix_dedup.suffix_dedup(frame(spark, rows), chunk_bytes=size)
    assert result(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 50)
    in_order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    got = substring_dedup.substring_dedup(frame(spark, rows), chunk_bytes=size)
    want = sorted(brute_substrings(in_order, 20), key=lambda r: [(x is None, x) for x in r])
    assert result(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


# -- quality -------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_odd_rows(spark):
    rows = corpus()
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, None if i % 9 == 0 else i % 2, 0) for i in range(30)] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, quality.train(df, labels), keep=["u", "source"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    none = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.classify(df, none).collect()} == {0.5}


def test_quality_features_do_not_depend_on_slices(monkeypatch):
    text = sentence(random.Random(8), 300)
    whole = np.bincount(np.concatenate(list(quality.features(text))), minlength=quality.BUCKETS)
    monkeypatch.setattr(quality, "WORDS_AT_ONCE", 7)
    assert (np.bincount(np.concatenate(list(quality.features(text))), minlength=quality.BUCKETS) == whole).all()


# -- top-k -----------------------------------------------------------------------------------
def brute_topk(vectors, k, every):
    ints = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = min(ints.get(i, v), v)
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in ints.items()}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered", "alike", "wide", "odd"])
def test_topk(spark, kind):
    rng = np.random.default_rng(9)
    n = 400
    if kind == "clustered":
        x = rng.normal(size=(8, 12))[rng.integers(0, 8, n)] + 0.02 * rng.normal(size=(n, 12))
    elif kind == "alike":
        x = np.where(rng.random((n, 1)) < 0.6, 0.5, rng.normal(size=(n, 6)))
    elif kind == "wide":
        x = rng.normal(size=(n, 4)) * 1e5
    else:
        x = rng.normal(size=(n, 8))
    vectors = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)]
    if kind == "odd":
        vectors += [(500, None), (510, [1.0, None]), (520, [float("nan")] * 8), (530, [float("inf")] * 8), (540, []), (541, []), (550, [1.0] * 3),
                    (None, [1.0] * 8), (10, vectors[10][1]), (20, [9.0] * 8), (560, [2.0] * 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = topk.search(df, F.col("vec_id") % 10 == 0, k=5, pivots=7, block=60, chunk=9, leaf=8)
    assert result(got, "query_id", "rank", "vec_id", "score") == brute_topk(vectors, 5, 10)


# -- empty tables, and the pipeline's stages on odd rows -----------------------------------------
def test_empty_tables(spark):
    df = frame(spark, []).limit(0)
    empty = [exact_dedup.exact_dedup(df), bpe.round_trip(df, queries.RANKS, queries.PATTERN), substring_dedup.substring_dedup(df),
             line_dedup.line_dedup(df), mixing.mix(df).rows, mixing.mix(df).sources, simhash.near_dedup(df), simhash.heads(df),
             license_scan.licence_scan(df), suffix_dedup.suffix_dedup(df),
             quality.classify(df, quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))),
             topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)]
    assert [len(x.collect()) for x in empty] == [0] * len(empty)


def test_registered_queries_agree_with_tiktoken(spark):
    sf = "/root/testdata/sf0.001"
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.Codec(open(queries.RANKS, "rb").read(), queries.PATTERN).ranks)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_byte_bpe(spark, sf).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
