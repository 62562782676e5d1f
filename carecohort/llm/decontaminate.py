"""Benchmark decontamination by Wu-Manber search over words.

Test items are cut into windows of consecutive words.  All windows of one length form a
pattern set: a table says how far the search may move on when it sees a block of two words
(one for one-word windows), windows are kept in buckets by the block they end with, and a
document position is compared word by word only with the windows of its bucket.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecohort.llm.common import free_name
from carecohort.storage import written

WINDOW = 10
#: Items, and bytes of their text, searched for in one pass over the documents; more take more
#: passes.  Tables take some hundred bytes a word.
ITEMS_PER_PASS = 20_000
PASS_BYTES = 4 << 20
#: Longer items are cut into pieces that begin so many words apart, for the passes.
PIECE_WORDS = 10_000
_HITS = "n_words bigint, hit array<int>, items array<bigint>"


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text or its UTF-8 with A-Z lower-cased: runs of 0-9, a-z and anything beyond ASCII."""
    if not isinstance(text, bytes):
        text = (text or "").encode("utf-8", "surrogatepass")
    return text.translate(_TABLE).split()


#: Lower-cases A-Z and blanks every other byte that no word holds.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class WuManber:
    """Occurrences of word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.patterns = patterns
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end] if b == 2 else p[end - 1]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets[p[-b:] if b == 2 else p[-1]].append(p)

    def search(self, words: list[bytes]):
        """(start, owners of the pattern) of every occurrence."""
        m, pairs = self.length, self.block == 2
        shift, buckets, owners = self.shift, self.buckets, self.patterns
        missed, end, n = m - self.block + 1, m - 1, len(words)
        while end < n:
            key = (words[end - 1], words[end]) if pairs else words[end]
            move = shift.get(key, missed)
            if move:
                end += move
                continue
            start = end - m + 1
            first = words[start]
            for p in buckets[key]:
                if p[0] == first and list(p) == words[start : end + 1]:
                    yield start, owners[p]
            end += 1


def windows_of(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One pattern set per window length: ``window`` words, or a shorter item's own length."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners = by_length[size][tuple(words[i : i + size])]
            if item not in owners:
                owners.append(item)
    return [WuManber(dict(p)) for _, p in sorted(by_length.items())]


def _search(text: Column, sets: list[WuManber]) -> Column:
    @F.arrow_udf(_HITS)
    def search(texts: pa.Array) -> pa.Array:
        counts, hits, found = [], [], []
        for t in texts:  # one text at a time leaves Arrow's memory
            words = words_of(t.as_buffer().to_pybytes() if t.is_valid else None)
            hit, items = set(), set()
            for s in sets:
                for start, owners in s.search(words):
                    hit.update(range(start, start + s.length))
                    items.update(owners)
            counts.append(len(words))
            hits.append(sorted(hit))
            found.append(sorted(x for x in items if x is not None))
        columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["n_words", "hit", "items"])

    return search(text)


def _pieces(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Items (``item``, ``text``, ``bytes``) cut into pieces that overlap, so that each window is in one of them."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"]):
                words = words_of(text if isinstance(text, str) else None)
                for i in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = b" ".join(words[i : i + PIECE_WORDS + window - 1])
                    out.append((item, piece.decode("utf-8", "surrogatepass"), len(piece)))
            yield pd.DataFrame(out, columns=["item", "text", "bytes"]).astype({"item": "Int64", "bytes": "int64"})

    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))
    return written(items.mapInPandas(cut, "item bigint, text string, bytes bigint").where("bytes > 0"), "benchmark_pieces")


def with_contamination(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW,
                       per_pass: int = ITEMS_PER_PASS, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with ``name``: struct (n_words, hit, items) of hit word positions and items found.

    The test strings are carried to the tasks in passes of about ``per_pass`` items and
    ``pass_bytes`` bytes of text at most, dealt by hash.  If one pass does not hold them all, each is
    a job of its own over the written rows and writes its hits before the next one's tables are
    built, so driver and tasks hold one pass at a time whatever the size of the benchmark.
    """
    size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()
    if size[0] <= per_pass and size[1] <= pass_bytes:
        items = benchmark.select(F.col(item_col).cast("bigint"), F.col(item_text_col))
        sets = windows_of([tuple(r) for r in items.toLocalIterator()], window)
        return docs.withColumn(name, _search(F.col(text_col), sets))
    pieces = _pieces(benchmark, window, item_col, item_text_col)
    n, total = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    passes = max(1, -(-n // per_pass), -(-total // pass_bytes))
    row = free_name(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "searched_rows")
    hits = None
    for k in range(passes):
        mine = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).select("item", "text")
        sets = windows_of([tuple(r) for r in mine.toLocalIterator()], window)
        found = rows.select(F.col(row).alias("row"), _search(F.col(text_col), sets).alias("f")).select("row", "f.*")
        if k:  # the first pass gives the words of all rows
            found = found.where(F.size("hit") > 0)
        found = written(found, "pass_hits")
        hits = found if hits is None else hits.unionAll(found)
    every = hits.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).select(F.col("row").alias(row), F.struct("n_words", "hit", "items").alias(name))
    return rows.join(every, row).drop(row)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_pass: int = ITEMS_PER_PASS,
                  id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words have no windows; items that
    repeat a text are all reported; an item without an id marks words but is not counted
    among the items.  An empty benchmark hits nothing.  Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_contamination(named, benchmark, "_f", window, per_pass, pass_bytes=pass_bytes).select("doc_id", "_f")
    names = F.array_sort(F.transform("_f.items", lambda i: i.cast("string")))
    return rows.select(
        "doc_id", "_f.n_words", F.size("_f.hit").cast("bigint").alias("n_hit"),
        F.size("_f.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_f.hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, lens WHERE len(w) >= m),
ds AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM dw),
occ AS (SELECT ds.doc_id, ds.i, ds.m, win.item_id FROM ds JOIN win ON ds.m = win.m AND ds.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
