"""The operators against SQL, brute force, exact round trips and held-out accuracy; odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from carecohort.llm import decontaminate, fingerprint, language, licenses, line_dedup, mixing, near_dup, secrets, sharding, tokens
from carecohort.llm import components
from carecohort.llm.components import connected_components
from carecohort.llm.queries import QUERIES, STATEMENTS
from carecohort.storage import written
from carecohort.llm.token_coder import BLOCK, decode_blocks, encode_blocks

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(tokens.TOKENIZER)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, _row string, keys string, h int"
LONG = "mira tolen " * 40_000
ROWS = [
    (5, "the cat sat on the mat and then it went to the old house by the sea", "en", "a"),
    (5, "the cat sat on the mat and then it went to the old house by the sea", "en", "a"),
    (7, "the cat sat on the mat and then it went to the old house by the sea", "en", "b"),
    (9, None, "en", "a"),
    (10, "", None, None),
    (11, " \n\t ", "fr", "b"),
    (12, LONG, "fr", "a"),
    (13, "Ünï cödé, ça va? İ don't", "fr", None),
    (None, "an id is missing here but the words are many enough for shingles", None, "c"),
    (14, 'x token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" and 9807915762804490.', "en", "c"),
    (15, "Released under the MIT License.\nAll rights reserved.", "en", "c"),
    (15, "another text of the same id", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    return spark.createDataFrame([(*r, None, 1, "x", "y", 2) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cursor = con.execute(STATEMENTS[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cursor.fetchall())


def run_all(spark, docs, folder):
    bench = spark.createDataFrame([(1, "sat on the mat and then it went to the old house"), (2, None), (3, "")], "item_id int, text string")
    return {
        "tokens": tokens.token_documents(docs, f"file://{folder}/tokens", TOKENIZER, ranges=3),
        "licenses": licenses.scan_licenses(docs),
        "secrets": secrets.scan_secrets(docs),
        "decontaminate": decontaminate.decontaminate(docs, bench),
        "sharding": sharding.shard_records(docs, [1.0, 2.0], [1.0, 2.0, 1.0]),
        "language": language.identify_language(docs),
        "near_dup": near_dup.near_duplicates(docs, 3, 85),
        "line_dedup": line_dedup.remove_widespread_lines(docs, min_sites=2),
        "mixing": mixing.mixed_positions(docs),
        "fingerprint": fingerprint.fingerprint_documents(docs),
    }


def test_odd_rows(spark, odd, tmp_path):
    out = {k: v.collect() for k, v in run_all(spark, odd, tmp_path).items()}
    for k, rows in out.items():
        assert k == "secrets" or len(rows) == len(ROWS), k
    by = lambda k, i: next(r for r in out[k] if r.doc_id == i)
    assert [r.start for r in sorted(out["tokens"], key=lambda r: r.start)][0] == 0
    assert by("tokens", 9).n_tokens == by("tokens", 10).n_tokens == 1
    assert by("licenses", 15).licenses in ("MIT All-Rights-Reserved", "All-Rights-Reserved MIT", "")
    assert {(r.doc_id, r.length) for r in out["secrets"]} == {(14, 40), (14, 16)}
    assert by("decontaminate", 7).contaminated and not by("decontaminate", 12).contaminated
    assert by("decontaminate", 9).n_words == 0 and by("decontaminate", 9).items_sha256 == hashlib.sha256(b"").hexdigest()
    assert by("sharding", 9).size == 16 and by("sharding", 9).text_crc32 == 0
    assert [by("language", i).lang_pred for i in (9, 10, 11)] == ["und"] * 3
    assert by("near_dup", 7).component_id == 5 and not by("near_dup", 7).kept and by("near_dup", 5).kept
    assert by("near_dup", 9).n_shingles == 0 and by("near_dup", 11).kept
    assert next(r for r in out["near_dup"] if r.doc_id is None).kept
    assert by("line_dedup", 7).text == "" and by("line_dedup", 9).text is None
    assert sorted(r.position for r in out["mixing"]) == list(range(len(ROWS)))
    assert by("fingerprint", 9).fingerprint == "" and len(by("fingerprint", 12).fingerprint) == 256
    same = {r.fingerprint for r in out["fingerprint"] if r.doc_id in (5, 7)}
    assert len(same) == 1


def test_empty_table(spark, odd, tmp_path):
    for name, df in run_all(spark, odd.limit(0), tmp_path).items():
        assert df.count() == 0, name


def test_coder_round_trip():
    rng = np.random.default_rng(3)
    blocks = [
        np.zeros(0, int), np.array([7]), np.array([2**32 - 1, 0, 5]), rng.integers(0, 49_000, BLOCK),
        np.tile(np.arange(50), 60), np.minimum(rng.zipf(1.3, BLOCK), 49_000), np.zeros(BLOCK, int),
    ]
    coded = encode_blocks(blocks)
    for before, after in zip(blocks, decode_blocks(coded), strict=True):
        assert np.array_equal(before, after)
    assert len(coded[-1]) < BLOCK // 16 and decode_blocks([]) == encode_blocks([]) == []
    assert np.array_equal(decode_blocks([coded[3]])[0], blocks[3])
    broken = bytearray(coded[3])
    broken[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_blocks([bytes(broken)])


def test_token_files(spark, docs, plain, tmp_path):
    got = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, FOLDER).collect()}
    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    for i, text in plain:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", [
    "İstanbul. don't DON'T x's", "<|endoftext|>. a.b a..b !!!", "x y 12.5% ñ. ǅ ſ ª º 漢字. ﬁ \x1c z\u0085q", "á. x̸ .̸", "",
])
def test_words_are_coded_as_whole_texts(text):
    t = tokens.WordTokenizer(TOKENIZER)
    assert list(np.frombuffer(t.encode([text])[0], "<u4")) == t.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [3, 1_000_000])
def test_words_go_to_the_model_once(monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", remembered)
    t, rng = tokens.WordTokenizer(TOKENIZER), np.random.default_rng(9)
    t.encode(["Word word, WORD. words", "x"])
    assert t.known.to_pylist() == ["word", "words", "x"]  # three words, however they are written
    alphabet = list("aAbZéÉÀßŉ.,!'’-_0 9\n\t ́̌Jjİıſ東<>|")
    for _ in range(4):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(300)]
        assert t.encode(texts) == t._whole(texts)


def test_words_the_model_cannot_end():
    t = tokens.WordTokenizer(TOKENIZER)
    t.ends_word[:] = False  # as of a model without a mark of a word's end
    texts = ["Word by word, été.", "", "by"]
    assert t.encode(texts) == t._whole(texts)


@pytest.mark.parametrize("seed", range(3))
def test_random_blocks(seed):
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, rng.integers(1, 5000), rng.integers(0, BLOCK + 1)) for _ in range(40)]
    blocks += [rng.permutation(BLOCK), np.repeat(np.arange(BLOCK // 2), 2), rng.integers(0, 2**32, BLOCK)]
    coded = encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(coded), strict=True))
    assert coded == [c for b in blocks for c in encode_blocks([b])]  # blocks don't depend on each other


def test_license_rules(spark):
    mit = ("MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including sale, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in "
           "all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any "
           "kind, express or implied. In no event shall the authors or copyright holders be liable for any claim, damages or "
           "other liability.")
    rows = [(1, mit), (2, "// SPDX-License-Identifier: Apache-2.0\nint x;"), (3, "the license plate"), (4, "See the GNU General Public License for more details. ok")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4)] == ["MIT", "Apache-2.0", "", ""]
    assert got[4].unmatched == "gpl-see"


GPL = """This program is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program{end}"""
SEE = ".  If not, see <https://www.gnu.org/licenses/>."
WRITE = "; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301, USA."
BSD = """Copyright (c) 2001, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{endorse}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT DAMAGES (INCLUDING PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."""
ENDORSE = """3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
GNU = " gpl-warranty gpl-see gpl-received"
NOTICES = [
    (GPL.format(colon=":", comma=",", kind="", version=3, end=SEE), "GPL-3.0-or-later", "gpl-free" + GNU),
    (GPL.format(colon=";", comma=";", kind="", version=2, end=WRITE), "GPL-2.0-or-later", "gpl2-free" + GNU),
    (GPL.format(colon=":", comma=",", kind="Affero ", version=3, end=SEE), "AGPL-3.0-or-later", "agpl3-free" + GNU),
    (GPL.format(colon=";", comma=";", kind="Lesser ", version="2.1", end=WRITE).replace("program", "library"), "LGPL-2.1-or-later", "lgpl21-free" + GNU),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not "
     "distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", "mpl2-form mpl2-copy"),
    ("""Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""", "Apache-2.0", "apache2-grant apache2-use apache2-copy apache2-warranty apache2-see"),
    (BSD.format(endorse=""), "All-Rights-Reserved BSD-2-Clause", "rights bsd-grant bsd-source bsd-binary bsd-warranty"),
    *((BSD.format(endorse=ENDORSE.format(n)), "All-Rights-Reserved BSD-3-Clause",
       "rights bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty") for n in ("the copyright holder", "Some Inc.")),
    ("""Copyright (c) 2004, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.""", "ISC", "isc-grant isc-warranty"),
]


@pytest.mark.parametrize("sign", ["", " * ", "# ", "// ", "-- ", ";; "])
def test_canonical_notices(spark, sign):
    texts = ["\n".join((sign + line).rstrip() for line in text.split("\n")) for text, _, _ in NOTICES]
    texts = [f"/*\n{t}\n */\nint x;" if sign == " * " else t for t in texts]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.licenses, r.sentences, r.unmatched) for r in sorted(got)] == [(name, ids, "") for _, name, ids in NOTICES]


@pytest.mark.parametrize("sign", ["", " * ", "# ", "// ", "-- ", ";; "])
def test_canonical_notices_through_the_sql(sign):
    texts = ["\n".join((sign + line).rstrip() for line in text.split("\n")) for text, _, _ in NOTICES]
    texts = [f"/*\n{t}\n */\nint x;" if sign == " * " else t for t in texts]
    with duckdb.connect() as connection:
        connection.execute("create table documents (doc_id int, text varchar)")
        connection.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
        got = connection.execute(f"select doc_id, licenses, sentences, unmatched from ({licenses.SQL}) order by doc_id").fetchall()
    assert [r[1:] for r in got] == [(name, ids, "") for _, name, ids in NOTICES]


TAGS = [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0 MIT"), ("/* SPDX-License-Identifier: MIT */", "MIT"),
    ("# SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1-only"), ("# SPDX-License-Identifier:GPL-3.0-or-later\r\nx", "GPL-3.0-or-later"),
    ("<!-- SPDX-License-Identifier: GPL-2.0+ -->\n<p>", "GPL-2.0-or-later"), ("; SPDX-License-Identifier: GPL-2.0", "GPL-2.0"),
    (" * SPDX-License-Identifier: (MIT AND (ISC OR Zlib)) \n */", "ISC MIT Zlib"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\nmore", "GPL-2.0-only"),
    ("SPDX-License-Identifier: Unheard-1.0", ""), ("An SPDX-License-Identifier: MIT tag in a sentence", ""),
    ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"),
    ("This work is released into the\n# public\n# domain.", "Public-Domain"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 which is available at\nhttp://x", "EPL-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.\n", "BSL-1.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any "
     "damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding "
     "commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. x", "Zlib"),
]


def test_tags_and_wrapped_lines(spark):
    """Expressions, comment ends, -only and -or-later, mentions over a line end; the SQL agrees."""
    rows = [(i, text) for i, (text, _) in enumerate(TAGS)]
    got = sorted(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    with duckdb.connect() as connection:
        connection.execute("create table documents (doc_id int, text varchar)")
        connection.executemany("insert into documents values (?, ?)", rows)
        names = "doc_id, n_sentences, sentences, licenses, unmatched"
        assert [tuple(r) for r in got] == connection.execute(f"select {names} from ({licenses.SQL}) order by doc_id").fetchall()
    for r, (text, wanted) in zip(got, TAGS, strict=True):
        assert r.licenses == wanted, text


def test_short_lines_spread_too(spark):
    rows = [(i, f"Menu\n\n \nbody {i}", f"site{i % 5}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_widespread_lines(docs).collect()}
    assert got == {i: (1, f"\n \nbody {i}") for i in range(10)}


def test_secret_candidates(spark, docs, plain):
    texts = dict(plain)
    for r in QUERIES["op3_secret_forest"](spark, FOLDER).collect():
        found = texts[r.doc_id][r.start : r.start + r.length]
        assert hashlib.sha256(found.encode()).hexdigest() == r.secret_sha256
        assert r.secret == ("token = " in texts[r.doc_id][max(0, r.start - 9) : r.start].lower())


def test_wide_secret_candidates(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow+/\nabcd==\n-----END RSA PRIVATE KEY-----"
    jwt, late, letters = "eyJhbGciOi.eyJzdWIi.c2ln-_x", "q" * 300 + "7", "QwZxKjVbPmRtYlHgAbCd"
    texts = [
        ('password = "hunter2x!"', ["hunter2x!"]), ("pwd: Tr0ub4dor&3.", ["Tr0ub4dor&3"]),
        ("api_key='abc123def456', other = 5", ["abc123def456"]), (f"a {letters} b {late} c", [letters, late]),
        (f"\U0001f600 \x01 key\n{pem}\nend", [pem]), (f"x {jwt}, AKIA1234ABCD", [jwt, "AKIA1234ABCD"]),
        ('DATABASE_PASSWORD_PROD=ab!c;uid=5 {"secret": "two words"}', ["ab!c", "two words"]),
        ('pwd: str = "a\\"b" token "q1"', ['a\\"b', "q1"]), ("Authorization: Bearer zz9", ["zz9"]),
        ('password = ""  short words and the token of it', []), ("", []),
        ("url?token=abc&x=1 /path/to/secret=xyz1", ["abc&x=1", "xyz1"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    got = sorted(secrets.candidates(docs, path_col=None).collect(), key=lambda r: (r.doc_id, r.start))
    for i, (text, wanted) in enumerate(texts):
        assert [r.candidate for r in got if r.doc_id == i] == wanted
    for r in got:
        text = texts[r.doc_id][0].replace("\x01", " ")
        assert text[r.start :].startswith(r.candidate) and text[: r.start].endswith(r.before)
        assert text[r.start + len(r.candidate) :].startswith(r.after)


def labelled_findings(n=1200):
    """Made-up texts of one finding each: (text, label); secrets and what looks like them, told by no single feature."""
    rng = np.random.default_rng(17)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    letters, lower = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base62, digits = letters + "0123456789", "0123456789"
    words = "user name page value order index table first last print value read write total amount client server".split()
    camel = lambda k: "".join(w.title() for w in rng.choice(words, k))
    kinds = [
        (1, lambda: f'api_key = "{pick(base62, rng.integers(18, 41))}"'),
        (1, lambda: f"export DB_PASSWORD={pick(base62 + '!$&', rng.integers(10, 20))}"),
        (1, lambda: f'conn = open("{pick(base62 + "+/", 40)}") # private'),
        (1, lambda: f"Authorization: Bearer {pick(base62, 32)}"),
        (1, lambda: f"uses ghp_{pick(base62, 36)} here"),
        (0, lambda: f"commit {pick('0123456789abcdef', 40)} fixes it"),
        (0, lambda: f"see {camel(4)} for more"),
        (0, lambda: f'token = "{"-".join(rng.choice(words, 3))}"'),
        (0, lambda: f"password: {rng.choice(words)}"),
        (0, lambda: f"order number {pick(digits, 18)} shipped"),
        (0, lambda: f"sha256:{pick('0123456789abcdef', 64)} ok"),
        (0, lambda: f"path src/{'/'.join(rng.choice(words, 4))} is new"),
    ]
    return [(kinds[k][1](), kinds[k][0]) for k in rng.integers(0, len(kinds), n)]


def held_out_quality(spark):
    """(precision, recall, findings) on the quarter of the labelled findings that the forest never saw."""
    rows = [(i, text, "src", label) for i, (text, label) in enumerate(labelled_findings())]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, label int")
    seen = docs.where("doc_id % 4 <> 0")
    learned = secrets.candidates(seen).join(seen.select("doc_id", "label"), "doc_id")
    got = secrets.scan_secrets(docs.where("doc_id % 4 = 0"), labelled=learned).join(docs.select("doc_id", "label"), "doc_id").collect()
    hits = sum(r.secret and r.label for r in got)
    return hits / sum(r.secret for r in got), hits / sum(label for i, _, _, label in rows if i % 4 == 0), len(got)


def test_forest_on_findings_held_out(spark):
    precision, recall, n = held_out_quality(spark)
    print(f"precision {precision:.3f}, recall {recall:.3f} of {n} findings")
    assert precision > 0.9 and recall > 0.9 and n >= 290


def test_very_many_candidates_of_one_text(spark):
    """Places of 3,000 candidates of one text, whose lengths are added up in runs."""
    secret = lambda i: f"{hashlib.md5(str(i).encode()).hexdigest()[: 16 + i % 7]}"
    text = " ".join(f"\U0001f600 w{i} {secret(i)}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:90])], "doc_id int, text string")
    got = Counter(tuple(r) for r in secrets.candidates(docs, path_col=None).select("doc_id", "start", "candidate").collect())
    wanted, at = Counter(), 0
    for i in range(3000):
        at = text.index(secret(i), at)
        wanted[1, at, secret(i)] += 2
        at += len(secret(i))
    assert {k: n for k, n in got.items() if k[0] == 1} == wanted


def test_files_of_findings_hold_no_secrets(spark, docs, monkeypatch):
    kept, written = [], secrets.written

    def noted(df, name, *rest):
        out = written(df, name, *rest)
        kept.append(out)
        return out

    monkeypatch.setattr(secrets, "written", noted)
    rows = docs.select("doc_id", "text", "source").limit(50).unionByName(
        spark.createDataFrame([(-1, 'password = "hunter2x!"', "x")], "doc_id bigint, text string, source string"))
    secrets.scan_secrets(rows).collect()
    assert [len(k.columns) for k in kept] and all(not {"candidate", "before", "after"} & set(k.columns) for k in kept)
    assert not any("hunter2x!" in str(v) for k in kept for r in k.collect() for v in r)


def test_short_passwords_are_secrets(spark, docs):
    more = spark.createDataFrame([(-1, 'password = "hunter2x!"'), (-2, "pwd: Tr0ub4dor&3"), (-3, "api_key='abq123def456'"),
                                  (-4, "secret = QwZxKjVbPmRtYlHg")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text", "source").unionByName(more.withColumn("source", F.lit("x")))
    got = {r.doc_id: r.secret for r in secrets.scan_secrets(rows).where("doc_id < 0").collect()}
    assert got == {-1: True, -2: True, -3: True, -4: True}


def test_items_in_several_passes(spark, docs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    one, many = (decontaminate.decontaminate(docs, bench, per_pass=p) for p in (20_000, 7))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, many.collect()))


def test_passes_are_bounded_and_end_before_the_next(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    one = decontaminate.decontaminate(docs, bench).collect()
    steps, windows_of, written = [], decontaminate.windows_of, decontaminate.written

    def noted(items, window):
        steps.append(sum(len(t) for _, t in items))
        return windows_of(items, window)

    def wrote(df, name):
        steps.append(name)
        return written(df, name)

    monkeypatch.setattr(decontaminate, "windows_of", noted)
    monkeypatch.setattr(decontaminate, "written", wrote)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 15)
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    many = decontaminate.decontaminate(docs, bench, pass_bytes=size // 3).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, many))
    assert steps[:2] == ["benchmark_pieces", "searched_rows"] and len(steps) >= 8
    assert all(x < size for x in steps[2::2]) and set(steps[3::2]) == {"pass_hits"}


def test_shards(spark, plain):
    rows = QUERIES["op5_rendezvous_shards"](spark, FOLDER).collect()
    texts = dict(plain)

    def winner(key, shards):
        def score(s):
            h = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), 42)
            h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), h)
            return -np.log(((h >> 11) + 0.5) * 2.0**-53)
        return min(range(shards), key=score)

    slots = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (winner(r.doc_id, 40), winner(r.doc_id, 41))
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_language_against_brute_force(spark, docs):
    """The whole registered result from sets of n-grams and dense normal equations of the kernel matrix."""
    def grams(text):
        text = text.lower()
        kept = [c if c.isalpha() else " " for i, c in enumerate(text) if c.isalpha() or i == 0 or text[i - 1].isalpha()]
        found = set()
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                h = n
                for c in kept[i : i + n]:
                    h = (h * 0x01000193 + ord(c)) % 2**32
                found.add(((h ^ h >> 15) * 0x9E3779B1 % 2**32) >> 14)
        return found

    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("at")).collect()
    sets = {r.doc_id: grams(r.text or "") for r in rows}
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    learned = sorted((r.at, r.lang, r.doc_id) for r in rows if r.lang and letters[r.doc_id] and not held[r.doc_id])
    languages = sorted({lang for _, lang, _ in learned})
    marks = [d for lang in languages for d in [d for _, x, d in learned if x == lang][: language.LANDMARKS_PER_LANGUAGE]]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    among = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in marks])
    seen = np.array([[kernel(sets[d], sets[b]) for b in marks] for _, _, d in learned])
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang, _ in learned])
    # copies among the landmarks leave a solution of least norm
    weights = np.linalg.lstsq(seen.T @ seen + language.RIDGE * len(learned) * 1e-2 * among, seen.T @ target, rcond=1e-9)[0]
    got = QUERIES["op6_string_kernel_language"](spark, FOLDER).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held[r.doc_id]
        raw = np.array([kernel(sets[r.doc_id], sets[b]) for b in marks]) @ weights
        share = np.exp(4 * (raw - raw.max()))
        if not letters[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert abs(r.score - share.max() / share.sum()) < 1e-4
            assert r.lang_pred == languages[raw.argmax()] or np.ptp(np.sort(raw)[-2:]) < 1e-5


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] > 0.98 and right[1] > 150


def test_tokenizer_that_keeps_blanks():
    t = tokens.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two words, and\n three  more.", "", " x"]
    assert not t.by_word and tokens.WordTokenizer(TOKENIZER).by_word
    assert [list(np.frombuffer(b, "<u4")) for b in t.encode(texts)] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("rows", [2048, 5])
def test_near_copies_of_an_absent_text(spark, monkeypatch, rows):
    monkeypatch.setattr(near_dup, "CELL_ROWS", rows)
    monkeypatch.setattr(near_dup, "TEXT_CELL_ROWS", rows)
    monkeypatch.setattr(near_dup, "BROADCAST_TEXTS", 0 if rows == 5 else 500_000)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    table = []
    for i in range(60):
        words = base.copy()
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"new{rng.integers(0, 10**6)}"
        table.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 3]) for j in range(118)} for _, t in table]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_dup.near_duplicates(spark.createDataFrame(table, "doc_id int, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in range(60)}


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    order = np.random.default_rng(4).permutation(1000).tolist()
    for names in (range(1001), [*order, 1000]):
        rounds.clear()
        links = [(int(names[i]), int(names[i + 1])) for i in range(1000)] + [(5000, 5000)]
        got = dict(connected_components(spark.createDataFrame(links, "a int, b int").repartition(3)).collect())
        assert got == {**dict.fromkeys(range(1001), 0), 5000: 5000} and rounds.count("links") <= 25


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (103, 102), (101, 103)]
    got = dict(connected_components(spark.createDataFrame(links, "a int, b int")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100)}


def test_mix(spark, docs):
    rows = sorted(QUERIES["op9_pfair_mix"](spark, FOLDER).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(200))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    # the whole result against the schedule worked out slot by slot
    sizes = Counter(r.source for r in docs.select("source").collect())
    given = {s: Fraction(n**mixing.ALPHA) for s, n in sizes.items()}
    share = {s: w / sum(given.values()) for s, w in given.items()}
    left, expected, slot = {s: 0 for s in given}, [], 0
    while any(16 * left[s] < sizes[s] for s in given):
        ready = [s for s in given if 16 * left[s] < sizes[s] and math.floor(left[s] / share[s]) <= slot]
        if ready:
            s = min(ready, key=lambda s: (math.ceil((left[s] + 1) / share[s]), s is not None, s))
            expected.append((s, left[s], slot))
            left[s] += 1
        slot += 1
    seen = list(dict.fromkeys((r.source, r.block, r.slot) for r in rows))
    assert seen == expected
    # rows of a source follow one another in the order of their ids' hashes
    docs = docs.withColumn("at", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    for s in sizes:
        ids = [r.doc_id for r in docs.where(F.col("source").eqNullSafe(F.lit(s))).orderBy("at").collect()]
        assert [r.doc_id for r in rows if r.source == s] == ids


@pytest.mark.parametrize("weights", [None, {"a": 0.9, "b": 0.0999, "c": 0.0001}, {"a": 1e-9, "b": 3, "c": 2.5, "d": 1}])
def test_mix_keeps_to_the_weights_given(spark, weights):
    # many windows, so that their borders are met
    sizes = {"a": 4000, "b": 700, "c": 5}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id int, source string")
    got = sorted(mixing.mixed_positions(docs, weights, block_rows=1, window_blocks=97).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(4705)) and len({r.slot for r in got}) == 4705
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    given = {s: Fraction(w) for s, w in (weights or {s: n**mixing.ALPHA for s, n in sizes.items()}).items()}
    share = {s: w / sum(given.values()) for s, w in given.items()}
    for r in got:
        w = share[r.source]
        assert (r.release, r.deadline) == (math.floor(r.block / w), math.ceil((r.block + 1) / w))
        assert r.release <= r.slot < r.deadline
        # done before and after this slot, against the share of the slots
        assert abs(r.block - r.slot * w) < 1 and abs(r.block + 1 - (r.slot + 1) * w) < 1


@pytest.mark.parametrize("seed", range(30))
def test_mix_windows_fit(seed):
    """From what is likely done no deadline is missed, and repeated windows come to the one pass over all slots."""
    rng = np.random.default_rng(seed)
    numerators = [int(w) for w in 10 ** rng.uniform(0, 5, rng.integers(1, 25)) + 1]
    blocks = [int(n) for n in rng.integers(0, 120, len(numerators))]
    schedule = mixing.Schedule(numerators, blocks)
    whole = list(schedule.window(0, schedule.end, [0] * len(blocks)))
    assert len(whole) == sum(blocks) and [w[4] for w in whole] == sorted({w[4] for w in whole})
    for size in (1, 7, 50):
        count = -(-sum(blocks) // size)
        borders = [schedule.border(k, size) for k in range(count + 1)]
        assert borders == sorted(borders) and borders[-1] == schedule.end
        begins = [schedule.ahead(t, schedule.likely(t)) for t in borders[:-1]]
        while True:
            parts, ends = [], []
            for k, state in enumerate(begins):
                done = schedule.done(borders[k], state)
                parts.append(list(schedule.window(borders[k], borders[k + 1], done)))
                ends.append(schedule.ahead(borders[k + 1], done))
            fitted = begins[:1] + ends[:-1]
            if fitted == begins:
                break
            begins = fitted
        assert [b for p in parts for b in p] == whole


def test_fingerprints(spark, plain):
    rows = sorted(QUERIES["op10_one_permutation_fingerprint"](spark, FOLDER).collect())
    texts = [t for _, t in plain]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    errors = []
    for k, r in enumerate(rows):
        half, after = len(texts[k]) // 2, texts[(k + 1) % len(texts)]
        edited = texts[k][: len(texts[k]) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = shingles(texts[k]), shingles(other)
            errors.append(near - len(a & b) / len(a | b))
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.01


def test_pipeline(spark, plain):
    """Rows that stay, by brute force: letters, one of each group by shared shingles, no benchmark passage."""
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    texts = {i: t for i, t in plain if any(c.isalpha() for c in t or "")}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    kept = {i for i in sets if group[i] == i}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    passages = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = split(r.text)
        passages |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} - {()}
    sizes = {len(p) for p in passages}
    for i in sorted(kept):
        words = split(texts[i])
        if any(tuple(words[k : k + n]) in passages for n in sizes for k in range(len(words) - n + 1)):
            kept.discard(i)
    assert {r.doc_id for r in rows} == kept and len(rows) == len({r.doc_id for r in rows})
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


HELPERS = (
    "_bucket _at _inside _block _rank _no _before _name _mix _mixed _near_dup_node _row _order0 _n row mix _key _tie0 "
    "_source _id _first _slot position _language _benchmark node component"
).split()


def test_stages_leave_all_columns_alone(spark, odd):
    """A table that holds the name of every helper column, with values of its own."""
    table = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns(
        {c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in HELPERS}
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, FOLDER)
        assert out.columns[: len(table.columns)] == table.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for r in rows for c in HELPERS), name


def test_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, FOLDER)
        assert name == "sharding" or out.columns == odd.columns
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
        kept = out.count()
        assert kept == {"language": 9, "near_duplicates": 10}.get(name, kept) and kept
