"""Vector codes, whitening and web archives against brute force, SQL and exact round trips; odd rows."""

import gzip
import hashlib
import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from carecohort.llm import cover_codes, cover_tree, warc, whitening

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, width int, i int, code string, _label int"


@pytest.fixture(scope="module")
def odd(spark):
    """Unusable vectors, repeated rows and ids, null ids and labels, clashing extra columns."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 10).tolist(), i % 3) for i in range(40)]
    rows += [rows[3]] * 30 + [(4, rng.normal(0, 1, 10).tolist(), None), (None, [0.5] * 10, None)]
    rows += [(90, None, 1), (91, [], 1), (92, [None] + [1.0] * 9, 1), (93, [NAN] * 10, 2), (94, [INF] + [0.0] * 9, 2), (95, [1.0] * 4, 0)]
    return spark.createDataFrame([(*r, "v", 1, 2, "c", None) for r in rows], SCHEMA).repartition(5)


def usable(rows):
    good = [r for r in rows if r.embedding and len(r.embedding) == 10]
    return [r for r in good if all(v is not None and math.isfinite(v) for v in r.embedding)]


@pytest.mark.parametrize("kind", ["normal", "clusters", "repeats", "huge", "one"])
def test_subtrees_are_assigned_like_single_points(kind):
    rng = np.random.default_rng(1)
    points = {
        "normal": rng.integers(-900, 900, (700, 4)),
        "clusters": rng.integers(0, 4, (900, 1)) * 5000 + rng.integers(-20, 20, (900, 3)),
        "repeats": np.repeat(rng.integers(-3, 3, (30, 2)), 40, axis=0),
        "huge": rng.integers(-(2**58), 2**58, (60, 3)),
        "one": np.array([[3, -4]]),
    }[kind]
    tree = cover_tree.CoverTree.from_bytes(cover_tree.build(points).to_bytes())
    assert sorted(tree.order) == list(range(len(points)))
    for _ in range(5):
        centres = points[rng.integers(0, len(points), 7)]
        exact = ((points.astype(object)[:, None] - centres.astype(object)[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.array_equal(cover_tree.nearest_centres(tree, points, centres), exact)
        sums, counts = cover_tree.sums_by_centre(tree, points, centres)
        for c in range(7):
            assert counts[c] == (exact == c).sum()
            assert list(sums[c]) == list(points.astype(object)[exact == c].sum(axis=0)) or counts[c] == 0


def test_whole_subtrees_are_decided_at_once():
    points = np.random.default_rng(2).integers(0, 4, (4000, 1)) * 5000 + np.random.default_rng(3).integers(-20, 20, (4000, 3))
    starts, ends, _, single, _ = cover_tree.assign(cover_tree.build(points), points, np.arange(4)[:, None] * [[5000] * 3][0])
    assert len(single) == 0 and len(starts) < 20 and (ends - starts).sum() == 4000


def lloyd(rows, parts, entries, rounds, scale):
    """Codebooks, codes and errors from plain integers, point by point."""
    each = -(-len(rows[0].embedding) // parts)
    grid = [[math.floor(scale * v) for v in r.embedding] for r in rows]
    grid = [g + [0] * (parts * each - len(g)) for g in grid]
    cut = [[g[p * each : (p + 1) * each] for p in range(parts)] for g in grid]
    first = sorted(range(len(rows)), key=lambda k: (rows[k].vec_id is None, rows[k].vec_id or 0, list(rows[k].embedding)))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (gap(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for c in cut:
                of[nearest(c[p], books[p])].append(c[p])
            for e, members in of.items():
                books[p][e] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(gap(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    return books, ["".join(f"{v:02x}" for v in k) for k in codes], errors


def test_codes_of_odd_rows(spark, odd):
    rows = usable(odd.collect())
    books, codes, errors = lloyd(rows, 4, 5, 3, 64)
    df, found = cover_codes.compress_vectors(odd, 4, 5, 3, 64, keep=("label",))
    assert [b.tolist() for b in found] == books
    expected = Counter(zip((r.vec_id for r in rows), (r.label for r in rows), codes, errors, strict=True))
    assert Counter(map(tuple, df.collect())) == expected


def test_coded_vectors_of_odd_rows(spark, odd):
    rows = usable(odd.collect())
    books, codes, errors = lloyd(rows, 8, 16, 6, 4096)
    sums = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        sums[r.label] += e
    digest = hashlib.sha256(cover_codes.codebook_text([np.array(b) for b in books]).encode()).hexdigest()
    expected = Counter(
        (r.vec_id, c, e, sums[r.label], digest) for r, c, e in zip(rows, codes, errors, strict=True)
    )
    assert Counter(map(tuple, cover_codes.coded_vectors(odd).collect())) == expected


def eigen(rows, scale=1024, shift=100_000):
    x = np.floor(scale * np.array([r.embedding for r in rows], float)).astype(np.int64) + shift
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], vectors[:, ::-1].T


@pytest.mark.parametrize("table", ["odd", "given"])
def test_whitening(spark, odd, table):
    data = odd if table == "odd" else spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = usable(data.collect()) if table == "odd" else data.collect()
    x, values, vectors = eigen(rows)
    n, sums = len(x), x.sum(axis=0)
    got = whitening.whitened_components(data).collect()
    assert Counter(r.component for r in got) == {k: n for k in range(1, 9)}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert 0 <= got[0].identity_error < 1e-9
    for r in got:
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
    scores = (x - sums / n) @ vectors[:8].T / np.sqrt(values[:8])
    deviations = ((n * x - sums) ** 2).sum(axis=1)
    for k in range(8):
        of = lambda sign: sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation), round(sign * r.whitened, 6) + 0.0) for r in got if r.component == k + 1)  # noqa: B023, E731
        want = sorted((r.vec_id is None, r.vec_id or 0, int(d), round(s, 6) + 0.0) for r, d, s in zip(rows, deviations, scores[:, k], strict=True))
        close = [all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-5 for a, b in zip(of(s), want, strict=True)) for s in (1, -1)]
        assert any(close)


def test_directions_without_spread(spark):
    data = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whitened_components(data).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert whitening.whitened_components(data.where("vec_id = 1")).collect() == []


@pytest.mark.parametrize("size, rank", [(1, 1), (7, 7), (12, 5), (30, 30)])
def test_factorisation(size, rank):
    rng = np.random.default_rng(size)
    half = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-2, 3, rank)
    matrix = half @ half.T
    factor, order = whitening.pivoted_cholesky(matrix)
    assert factor.shape == (size, rank)
    assert np.allclose(factor @ factor.T, matrix[order][:, order], rtol=1e-10, atol=1e-10 * np.abs(matrix).max())
    values, directions = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-7, atol=1e-11 * np.abs(matrix).max())
    assert np.allclose(directions.T @ directions, np.eye(rank), atol=1e-12)


def test_empty_vector_tables(spark, odd):
    for rows in (odd.limit(0), odd.where("vec_id = 91")):
        assert cover_codes.coded_vectors(rows).count() == 0
        assert whitening.whitened_components(rows).count() == 0


START = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a.b/c?d#e", "x" * 100), (2, None, "x" * 100), (2, None, "x" * 100), (None, "http://z", "x" * 100),
    (4, "http://q\r\nWARC-Type: x", "a\r\n\r\n" + START + START), (5, "u", None), (6, "u", ""), (7, "u", ""),
    (8, "ü", "é" * 60 + "\r\n"), (9, "u", "é" * 60 + "\r\n"), (10, "u", "\r\n\r\n"), (11, "u", START * 3000),
    (12, "u", "\r\n\r\n" + START * 3000 + "\r\n"), (0, "u", "y" * 99), (3, "u", "y" * 99), (None, None, None),
    (13, "u", "z" * 3_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(*p, "r", "d", 1) for p in PAGES], "page_id bigint, url string, html string, response string, digest string, place int"
    ).repartition(3)


def test_archived_pages(spark, pages, tmp_path):
    smallest = {}
    for i, _, html in PAGES:
        if i is not None:
            smallest[html] = min(i, smallest.get(html, i))
    expected, seen = Counter(), set()
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= 100 and html in seen
        seen.add(html)
        kind = ("revisit", smallest[html]) if again else ("response", None)
        expected[(i, len(data), hashlib.sha256(data).hexdigest(), *kind)] += 1
    got = warc.archived_pages(pages, f"file://{tmp_path}/w")
    assert Counter(map(tuple, got.collect())) == expected
    assert warc.archived_pages(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_transactions_hold_what_was_written(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w", "page_id", "url", "html")
    for file in Path(tmp_path, "w").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    records = warc.read_records(spark, f"file://{tmp_path}/w")
    kinds = Counter(r.type for r in records.collect())
    assert kinds == {"request": 14, "metadata": 17, "revisit": 4, "response": 13}
    captures = warc.resolve_revisits(warc.assemble(records)).collect()
    assert len(captures) == len(PAGES) and len({c.capture_id for c in captures}) == len(PAGES)
    text = lambda p: (p or "").encode()
    stored = Counter(bytes(c.response.payload) for c in captures if c.response.type == "response")
    assert stored == Counter({text(p[2]) for p in PAGES if len(text(p[2])) >= 100}) + Counter(text(p[2]) for p in PAGES if len(text(p[2])) < 100)
    for c in captures:
        assert len(c.metadata) == 1 and c.more_requests == []
        assert (c.request is None) == (c.target_uri is None)
        if c.response.type == "revisit":
            assert c.response.payload == b"" and c.response.digest_field == f"sha256:{c.original.payload_digest}"
        else:
            assert c.original is None and c.response.digest_field == f"sha256:{c.response.payload_digest}"


def test_binary_payloads(spark, tmp_path):
    data = bytes(range(256)) * 3
    one = spark.createDataFrame([("a\nb", "http://x/", data)], "k string, u string, p binary")
    warc.write_archives(one, f"file://{tmp_path}/w", "k", "u", "p")
    (capture,) = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w")).collect()
    assert bytes(capture.response.payload) == data and capture.metadata[0].text == "k: a%0Ab\r\n"


def record(kind, rid, block="", *fields):
    lines = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2020-01-01T00:00:00Z", *fields]
    return "\r\n".join([*lines, f"CONTENT-LENGTH: {len(block)}"]) + f"\r\n\r\n{block}\r\n\r\n"


def test_links_in_either_direction_and_orphans(spark, tmp_path):
    beside = "WARC-Concurrent-To: "
    http = "Content-Type: application/http; msgtype=response"
    parts = [
        record("warcinfo", "i"), record("response", "r1", "HTTP/1.1 200 OK\r\n\r\nbody", http, beside + "q1"),
        record("request", "q1", "", beside + "r1"), record("request", "q0", "", beside + "r1"),
        record("metadata", "m1", "a: b", beside + "r1", beside + "r2"), record("response", "r2", "no head", http),
        record("request", "q2", "", beside + "gone"), record("metadata", "m2", "", beside + "gone"), record("metadata", "m3"),
        record("resource", "r3", "plain"),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(gzip.compress(p.encode()) for p in parts))  # a member each
    got = {c.capture_id: c for c in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/a")).collect()}
    assert set(got) == {"r1", "r2", "r3", "gone", None}
    assert got["r1"].response.payload == b"body" and got["r1"].response.http == "HTTP/1.1 200 OK"
    assert got["r1"].request.record_id == "q0" and [r.record_id for r in got["r1"].more_requests] == ["q1"]
    assert got["r2"].response.payload == b"no head" and got["r2"].metadata[0].record_id == "m1"
    assert got["r3"].response.payload == b"plain" and got["r3"].request is None
    assert got["gone"].response is None and got["gone"].request.record_id == "q2" and len(got["gone"].metadata) == 1
    assert got[None].metadata[0].record_id == "m3"


def test_cut_archive(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(gzip.compress(record("response", "r", "abcdef").encode()[:-8]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_records(spark, f"file://{tmp_path}/a").collect()


@pytest.mark.parametrize("cut", [1, 7, 4096])
def test_pieces_of_any_cut(cut):
    """The reader may miss a separator that lies across its buffers: pieces then hold several records."""
    whole = [record("response", f"r{i}", "\r\n" * i + "x\r\n") for i in range(40)]
    text = "".join(whole).removesuffix("\r\n\r\n")
    pieces = text.split("\r\n\r\nWARC/1.")
    joined = [("\r\n\r\nWARC/1.".join(pieces[i : i + cut])).encode() for i in range(0, len(pieces), cut)]
    stream = warc._Stream("f")
    found = [r for i, p in enumerate(joined) for r in stream.add(p, True)]
    stream.close()
    assert [r[0] for r in found] == [f"r{i}" for i in range(40)]
    assert [r[-1] for r in found] == [b"\r\n" * i + b"x\r\n" for i in range(40)]
