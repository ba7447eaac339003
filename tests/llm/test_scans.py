import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reportlens.llm import chat, licenses, secrets
from reportlens.llm.arrays import PLAIN, words

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def base(text):
    text, found = text or "", []
    for k, (p, group, least) in enumerate((
            (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[group]) >= least]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "api_key", "APIKEY", "ſecret", "toKen", "secret", "=", ": ", " = \"", "'", "abc", "AKIA", "AKIAAKIA", "0123456789abcdef", "Z9", "é", " ", "\n", "deadbeef" * 3]), max_size=14).map("".join))
def test_base_spans(text):
    assert sorted(secrets.base_spans(text)) == base(text)


def test_random_strings():
    encoding = secrets.vocabulary(PATH, public_tokenizers.PATTERN)
    random_ones = ["wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9", "ghp_x7Kq92LmZt4Vb81RcNwYpD3sHfJ6aUe0GiT", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZmc0Nz=="]
    public = ["d41d8cd98f00b204e9800998ecf8427e"[:31] + "z", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "thehetionthatesharingblethe", "some_long_identifier_name", "SomeCamelCaseIdentifierName", "2024-01-01-12-30-45-000", "internationalization/of/words"]
    for s in random_ones:
        assert secrets.random_spans(f"é {s} b", [], encoding) == [(2, 3, 2 + len(s))], s
    for s in public[1:]:
        assert secrets.random_spans(f"a {s} b", [], encoding) == [], s
    assert secrets.random_spans(random_ones[0], [(3, 0, 9)], encoding) == []


def test_random_strings_of_one_case():
    encoding = secrets.vocabulary(PATH, public_tokenizers.PATTERN)
    for x in ("qzxkwjvbnmtrplkhgf", "XKQZVWJPLMTRBNHG", "qzxk1234-wjvb5678-mtrp9012"):
        assert secrets.random_spans(f"a {x} b", [], encoding) == [(2, 3, 2 + len(x))], x
    for x in ("MAX_RETRY_COUNT_VALUE", "HTTPServerConnectionPool2", "v-1234-5678-9012-3456", "1234567890123456789"):
        assert secrets.random_spans(f"a {x} b", [], encoding) == [], x


def test_patterns_take_linear_time():
    start = time.process_time()
    for x in ("a" * 5000 + "=", "A" * 5000 + "=", "word-" * 2000 + "aB1c", "aa/" * 2000 + "="):
        secrets._IDENTIFIER.fullmatch(x), secrets._CAMEL.fullmatch(x), secrets._PART.findall(x)
    assert time.process_time() - start < 2


def test_random_spans_take_linear_time_and_leave_base_spans():
    encoding = secrets.vocabulary(PATH, public_tokenizers.PATTERN)
    start = time.process_time()
    text = "token=abcdefgh12 qzxkwjvbnmtrplkhgf 0123456789abcdef0123456789 " * 50000  # 3 MB
    base_found = secrets.base_spans(text)
    more = secrets.random_spans(text, base_found, encoding)
    assert len(more) == 50000 and len(base_found) == 100000 and time.process_time() - start < 30
    rng = random.Random(5)
    for _ in range(300):
        x = "".join(rng.choice(["qzxkwjvbnmtrplkhgf", " ", "a ", "=", "wJalrXUtnFEMIK7MDENG"]) for _ in range(20))
        spans = sorted((a, 0, a + rng.randrange(1, 30)) for a in (rng.randrange(200) for _ in range(3)))
        want = [m for m in secrets.random_spans(x, [], encoding) if not any(a < m[2] and m[0] < b for a, _, b in spans)]
        assert secrets.random_spans(x, spans, encoding) == want


def test_scan(spark, sf):
    odd = [(None, "secret = 'abcdef1'"), (10**9, None), (10**9 + 1, ""), (3, "AKIA" + "Q7" * 9), (3, "AKIA" + "Q7" * 9), (10**9 + 2, "x " * 200000 + "token:AAAAAAAA")]
    data = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as spans", "2 as n_hex")
    got = {(r.doc_id, r.base_sha256): r for r in secrets.scan(data, PATH, public_tokenizers.PATTERN).collect()}
    for r in data.collect():
        spans = base(r.text)
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        own = got[(r.doc_id, hashlib.sha256(text.encode()).hexdigest())]
        assert [own.n_assign, own.n_access, own.n_hex] == [sum(k == x for _, x, _ in spans) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(own.spans.split(","))
    assert secrets.scan(data.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def snapshots(rng):
    rows, conv = [], 0
    for _ in range(40):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "<|im_end|>", "", None])) for _ in range(rng.randrange(1, 7))]
        for n in rng.sample(range(1, len(turns) + 1), min(len(turns), 3)):
            rows += [(conv, k, *turn, "x") for k, turn in enumerate(turns[:n])]
            conv += 1
    return rows + [(None, 1, "user", "a", None), (None, None, None, None, None), (900, 5, None, "", "x"), (900, 5, None, "", "x"), (901, None, None, None, "x"), *((902, k, "user", "z", "x") for k in range(3000))]


def test_chat_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    rows = snapshots(random.Random(3))
    by = {}
    for c, k, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    whole = {c: tuple(t[1:] for t in sorted(ts)) for c, ts in by.items()}
    proper = {t[:k] for t in whole.values() for k in range(1, len(t))}
    want, seen = {}, set()
    for c in sorted(whole, key=lambda c: (c is not None, c)):
        if whole[c] not in proper and whole[c] not in seen:
            seen.add(whole[c])
            want[c] = (len(whole[c]), "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in whole[c]))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(7)
    got = chat.render(turns).collect()
    assert len(got) == len(want) and {r.conv_id: (r.n_turns, r.text) for r in got} == want
    assert chat.render(turns.limit(0)).count() == 0


def folded(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


@pytest.fixture(scope="module")
def templates():
    return [(name, folded(t)) for name, t in licenses.default_templates()]


def holding(text, templates, widened):
    """Licenses with a passage that some window of its length holds, widened by a quarter on both sides or not."""
    w = folded(text)
    g = [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
    where = {}
    for k, x in enumerate(g):
        where.setdefault(x, []).append(k)
    found = set()
    for name, t in templates:
        own = {tuple(t[k: k + 5]) for k in range(len(t) - 4)}
        n = len(t) - 4
        more = max(n // 4, next((x for x in licenses.LENGTHS if x >= n), n) - n) if widened else 0
        for p in {q for x in own for k in where.get(x, []) for q in range(max(0, k - n - more), k + 1)}:
            if len(own & set(g[max(0, p - more): p + n + more])) >= (0.8 if n >= licenses.STRICT else 1) * len(own):
                found.add(name)
                break
    return found


def test_licenses_same_as_brute_force(spark, templates):
    rng = random.Random(11)
    vocabulary = [f"w{k}é" for k in range(90)]
    every = licenses.default_templates()
    rows = []
    for k in range(240):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 30, 400]))]
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(every if k % 2 else every[:40])[1].split()
            if len(part) > 30 and k % 3:
                part[rng.randrange(len(part))] = "CHANGED"
            at = rng.randrange(len(w) + 1)
            w[at:at] = ["so", *(x.upper() if k % 3 == 0 else x for x in part), "end"]
        rows.append((k, " ".join(w)))
    rows += [(None, licenses.PASSAGES["MIT"][0]), (500, None), (501, ""), (502, "Released under the MIT License. " * 5000), (503, "x"), (503, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as start")
    have = {}
    for r in licenses.scan(docs).collect():
        have.setdefault(r.doc_id, []).append(r)
    found = 0
    for i, text in rows:
        must, may, got = holding(text, templates, False), holding(text, templates, True), have.get(i, [])
        assert {r.license for r in got} <= may and bool(got) >= bool(must), (i, must, may, got)
        found += len(must)
        spans = sorted((r.start, r.stop) for r in got)
        assert all(a[1] <= b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))  # none overlaps another
    assert found > 150 and len(have[502]) == 5000
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,license", [
    ("Licensed under the MIT License", "MIT"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("distributed under the Apache License 2.0, see below", "Apache-2.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "GPL-3.0"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "GPL-2.0"),
])
def test_wordings_and_versions(text, license):
    for around in ("", "a few other words stand here "):
        raw = np.frombuffer(f"{around}{text} {around}".encode(), np.uint8)
        index = licenses.Index.of(licenses.default_templates())
        got = index.matches(words(raw, np.array([0, len(raw)]), PLAIN))
        assert {index.names[m[1]] for m in got} == {license}, [(index.names[m[1]], m) for m in got]


@pytest.mark.parametrize("text", [
    "This work is licensed under the GNU General Public License, version 7.", "Licensed under the terms of our agreement with the MIT", "the public license of the city is under review by the general assembly",
    "redistribution of wealth in source and other forms", "Licensed under CC BY-SA 9.0.", "SPDX-License-Identifier: MIT"])
def test_texts_that_are_no_license(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    assert licenses.Index.of(licenses.default_templates()).matches(words(raw, np.array([0, len(raw)]), PLAIN)) == []


def test_matches_are_counted(spark):
    text = f"Released under the MIT License. and {'other words ' * 40} Released under the MIT License."
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.license, r.start, r.stop) for r in got] == [("MIT", 0, 5), ("MIT", 86, 91)]
