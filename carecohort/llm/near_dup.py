"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact checks.

A signature holds one 16-bit code per hash function, the low bits of a MinHash.  It is
split into chunks of four codes.  Two signatures that differ in fewer than twice as many
codes as there are chunks differ in at most one code of some chunk (pigeonhole), so each
chunk is indexed once per code left out, and all pairs within that distance meet under one
of these keys.  The number of chunks is chosen from the similarity threshold so that
linked documents exceed the distance with a probability below one in a million.

Documents with equal shingle sets are one class.  Within a key, all classes first meet one
pivot, the class that meets most others, on full sets; what it links is one component.
Only classes of different components then need a comparison, which tasks make in blocks:
signatures first, under the first key that a pair shares, then the full sets of the classes
that have a partner left.  A task gives no pairs but the links that join components, fewer
than its classes, so no table holds a key's pairs, and no link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carecohort.llm.common import free_name
from carecohort.llm.components import connected_components
from carecohort.llm.shingles import mix, shingle_sets
from carecohort.storage import written

CHUNK = 4
#: Chance that a pair at the threshold differs in more codes than the join allows.
MISS = 1e-6
#: Rows of a block whose signatures a task compares with another block's; more rows make more blocks.
CELL_ROWS = 2048
#: The same for blocks whose full sets are compared, and shingles of such a block.
TEXT_CELL_ROWS = 768
TEXT_CELL_SHINGLES = 250_000
_COLUMNS = 2048
#: Texts up to which a broadcast of their hashes thins out the documents before their shuffle
#: (8 bytes each); more are found by the shuffle alone.
BROADCAST_TEXTS = 500_000
_SEED = 20_011


def chunks_for(threshold: float) -> int:
    """Chunks of four codes so that pairs at ``threshold`` stay within the distance."""
    for m in range(2, 200):
        k, t = CHUNK * m, 2 * m
        if sum(comb(k, i) * (1 - threshold) ** i * threshold ** (k - i) for i in range(t, k + 1)) <= MISS:
            return m
    raise ValueError(f"a threshold of {threshold} is too low for this join")


def _signatures(sets: list[np.ndarray], codes: int) -> np.ndarray:
    """One row of 16-bit codes per set; rows of empty sets mean nothing."""
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(0, 2**63, codes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, codes, dtype=np.uint64)
    out = np.zeros((len(sets), codes), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[i]) for i in full])
    starts, values = np.cumsum(sizes) - sizes, np.concatenate([sets[i] for i in full])
    for j in range(codes):
        least = np.minimum.reduceat(values * factor[j] + shift[j], starts)
        out[full, j] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def sketch(text: Column, words: int, chunks: int) -> Column:
    """Struct of a text: set size, two hashes of the whole set, signature."""

    @F.pandas_udf("n bigint, set1 bigint, set2 bigint, signature array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sizes, one, two, codes = [], [], [], []
            held: list[np.ndarray] = []

            def settle():
                codes.extend(_signatures(held, CHUNK * chunks).astype(np.int32))
                held.clear()

            waiting = 0
            for s in shingle_sets([t if isinstance(t, str) else None for t in texts], words):
                sizes.append(len(s))
                m = mix(s)
                one.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(mix(m + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64)))
                held.append(s)
                waiting += len(s)
                if waiting > 1 << 17:
                    settle()
                    waiting = 0
            settle()
            yield pd.DataFrame({"n": sizes, "set1": one, "set2": two, "signature": codes})

    return run(text)


def _index_keys(chunks: int):
    """Adds ``keys``: one per chunk and code left out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("signature").flatten().to_numpy().reshape(-1, chunks, CHUNK).astype(np.uint64)
            keys = np.empty((len(codes), chunks, CHUNK), np.uint64)
            for out in range(CHUNK):
                h = np.arange(chunks, dtype=np.uint64)[None, :] * np.uint64(CHUNK) + np.uint64(out + 1)
                h = np.broadcast_to(h, codes.shape[:2])
                for j in range(CHUNK):
                    if j != out:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, :, j])
                keys[:, :, out] = h
            flat = keys.reshape(-1).view(np.int64)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * chunks * CHUNK
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("n"), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                ["node", "n", "keys"],
            )

    return run


def _linked(words: int, share: int):
    """Whether two texts' full sets reach ``share`` percent of their union."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        of, texts = pd.factorize(pd.concat([a, b], ignore_index=True))
        sets = list(shingle_sets(list(texts), words))
        out = []
        for i, j in zip(of[: len(a)], of[len(a) :], strict=True):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            out.append(100 * common >= share * (len(sets[i]) + len(sets[j]) - common))
        return pd.Series(out, dtype=bool)

    return run


def _node(id_col: str, text_col: str) -> Column:
    """Name of a text: its id (null after all others) and a hash."""
    return F.struct(
        F.col(id_col).isNull().alias("unnamed"), F.col(id_col).cast("bigint").alias("id"),
        F.xxhash64(F.col(text_col)).alias("h"),
    )


def near_duplicate_nodes(docs: DataFrame, words: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """node, n_shingles and component (a node) of every row of ``docs``."""
    chunks = chunks_for(share / 100)
    rows = docs.select(_node(id_col, text_col).alias("node"), sketch(F.col(text_col), words, chunks).alias("s"))
    rows = written(rows.select("node", "s.*"), "sketches")
    same = ["n", "set1", "set2"]
    # equal sets have equal signatures, so min() takes the smallest node's name
    classes = written(
        rows.where(F.col("n") > 0).groupBy(*same).agg(F.min(F.struct("node", "signature")).alias("r"))
        .select(*same, "r.node", "r.signature"),
        "classes",
    )
    links = _links(docs, classes, chunks, words, share, id_col, text_col)
    component = connected_components(links) if links is not None else None
    if component is None:
        named = classes.select(*same, F.col("node").alias("component"))
    else:
        named = classes.join(component, "node", "left").select(
            *same, F.coalesce("component", "node").alias("component")
        )
    named = written(named, "classes")  # both sides of the next join are shuffled, so hot sets can be split
    return rows.select("node", *same).join(named, same, "left").select(
        "node", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component")
    )


def _links(docs, classes, chunks, words, share, id_col, text_col) -> DataFrame | None:
    """Confirmed links (a, b) that connect what all links connect; None if there are none."""
    node_type = classes.schema["node"].dataType.simpleString()
    keyed = classes.select("node", "n", "signature").mapInArrow(
        _index_keys(chunks), f"node {node_type}, n bigint, keys array<bigint>"
    )
    keyed = keyed.select("node", "n", F.posexplode("keys").alias("slot", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    members = written(keyed.join(written(shared, "keys"), "key"), "members")
    if members.isEmpty():
        return None
    # A text that others were made from meets all of them, so it makes the best pivot.
    needed = written(members.groupBy("node").agg(F.sum("m").alias("met")), "met")
    members = members.drop("m")
    texts = docs.select(_node(id_col, text_col).alias("node"), F.col(text_col).alias("text"))

    pivots = members.join(needed, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("first"))
    pivots = written(pivots.select("key", F.col("first.node").alias("pivot")), "pivots")
    met = members.join(pivots, "key").where(F.col("node") != F.col("pivot"))
    pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = _confirmed(pairs, classes, texts, chunks, words, share)
    component = written(connected_components(links), "components")

    # a pivot has met all texts under its key
    rest = members.join(pivots.withColumnRenamed("pivot", "node"), ["key", "node"], "left_anti")
    rest = rest.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = written(rest.withColumn("cid", F.xxhash64("component")).drop("component"), "rest")
    near = _cells(rest, CELL_ROWS, None).join(classes.select("node", "signature"), "node")
    near = _in_cells(near).mapInArrow(
        _near_in_cell(chunks, share), f"key bigint, node {node_type}, n bigint, cid bigint"
    )
    near = written(near.distinct(), "near")
    mine = _texts_of(texts, near.select("node").distinct())
    full = _in_cells(_cells(near, TEXT_CELL_ROWS, TEXT_CELL_SHINGLES).join(mine, "node"))
    more = full.mapInArrow(_linked_in_cell(words, share), f"a {node_type}, b {node_type}")
    return links.union(written(more.distinct(), "links"))


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, chunks: int, words: int, share: int) -> DataFrame:
    """Those of (a, b) that are linked; ``pairs`` are distinct."""
    distance = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x != y), lambda x: x))
    sketches = lambda end: classes.select(
        F.col("node").alias(end), F.col("signature").alias(f"_s{end}"), F.col("n").alias(f"_n{end}")
    )
    near = (
        pairs.join(sketches("b"), "b").join(sketches("a"), "a")
        .where((100 * F.least("_na", "_nb") >= share * F.greatest("_na", "_nb")) & (distance < 2 * chunks))
        .select("a", "b")
    )
    near = written(near, "candidates")
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    mine = written(_texts_of(texts, ends), "texts")
    text = lambda end: mine.select(F.col("node").alias(end), F.col("text").alias(f"_t{end}"))
    both = near.join(text("b"), "b").join(text("a"), "a")
    return written(both.where(_linked(words, share)("_ta", "_tb")).select("a", "b"), "links")


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of ``nodes``, each once."""
    nodes = written(nodes, "nodes")
    if nodes.count() <= BROADCAST_TEXTS:
        hashes = nodes.select(F.xxhash64("node").alias("_h")).distinct()
        texts = texts.withColumn("_h", F.xxhash64("node")).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    return texts.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _cells(members: DataFrame, rows: int, shingles: int | None) -> DataFrame:
    """Members of keys with several components, once per cell (key, x, y) they are compared in.

    A key's largest component is cut into blocks, all its other members into blocks of their
    own; every block of others meets each block of either kind, so that two members of
    different components share a cell, and no block of the largest meets another of it.
    A single block of others meets itself beside any block of the largest.
    A block has about ``rows`` rows and ``shingles`` shingles at most, or one longer text.
    """
    parts = members.groupBy("key", "cid").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    keys = parts.groupBy("key").agg(
        F.max(F.struct("size", "n", "cid")).alias("most"), F.sum("size").alias("size"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("parts"),
    ).where(F.col("parts") > 1)

    def blocks(size: Column, n: Column) -> Column:
        by_rows = F.ceil(size / rows)
        return (by_rows if shingles is None else F.greatest(by_rows, F.ceil(n / shingles))).cast("int")

    keys = keys.select(
        "key", F.col("most.cid").alias("most"), blocks(F.col("size"), F.col("n")).alias("all_blocks"),
        blocks(F.col("most.size"), F.col("most.n")).alias("most_blocks"),
        blocks(F.col("size") - F.col("most.size"), F.col("n") - F.col("most.n")).alias("other_blocks"),
    )
    found = members.join(written(keys, "keys"), "key")
    spread = F.xxhash64("node", F.lit(7))
    in_most = F.col("cid") == F.col("most")
    mine = F.pmod(spread, F.when(in_most, F.col("most_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    found = found.withColumn("block", mine)
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_most = F.transform(upto("most_blocks"), lambda i: cell(-1 - i, F.col("block")))
    with_others = F.transform(upto("other_blocks"), lambda i: cell(F.least(i, F.col("block")), F.greatest(i, F.col("block"))))
    of_most = F.transform(upto("other_blocks"), lambda i: cell(-1 - F.col("block"), i))
    cells = (
        F.when(F.col("all_blocks") == 1, F.array(cell(F.lit(0), F.lit(0))))
        .when(in_most, of_most)
        .when(F.col("other_blocks") == 1, with_most).otherwise(F.concat(with_most, with_others))
    )
    return found.select(*members.columns, F.explode(cells).alias("cell")).select(*members.columns, "cell.x", "cell.y")


def _in_cells(rows: DataFrame) -> DataFrame:
    """Rows of a cell next to each other in one partition."""
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of cells that lie next to each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
        edges = np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *edges], [*edges, len(of)], strict=True):
            if held and tuple(of[start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = tuple(of[start])
    if held:
        yield pa.Table.from_batches(held)


def _near_in_cell(chunks: int, share: int):
    """Members (key, node, n, cid) with a partner of another component within the distance.

    A pair counts under the first key that it shares, so that it is looked at once.
    """

    def marked(codes: np.ndarray, n: np.ndarray, cid: np.ndarray, slot: int) -> np.ndarray:
        order = np.argsort(n, kind="stable")
        codes, n, cid = codes[order], n[order], cid[order]
        upto = np.searchsorted(100 * n, 100 * n * 100 // share, side="right")
        keep = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            j = np.arange(i + 1, upto[i])
            j = j[cid[j] != cid[i]]
            same = codes[j] == codes[i]
            close = same.sum(axis=1) > len(codes[i]) - 2 * chunks
            j, same = j[close], same[close].reshape(-1, chunks, CHUNK)
            if len(j):
                wrong = CHUNK - same.sum(axis=2)
                first = (wrong <= 1).argmax(axis=1)
                left_out = same[np.arange(len(j)), first].argmin(axis=1)  # 0 if all agree
                here = j[first * CHUNK + left_out == slot]
                keep[here] = True
                keep[i] |= len(here) > 0
        back = np.zeros(len(n), bool)
        back[order] = keep
        return back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each_cell(batches):
            if cell.num_rows < 2:
                continue
            codes = cell.column("signature").combine_chunks().flatten().to_numpy().astype(np.uint16)
            keep = marked(
                codes.reshape(cell.num_rows, -1), cell.column("n").to_numpy(), cell.column("cid").to_numpy(),
                cell.column("slot")[0].as_py(),
            )
            if keep.any():
                yield from cell.select(["key", "node", "n", "cid"]).filter(pa.array(keep)).to_batches()

    return run


def _linked_in_cell(words: int, share: int):
    """Links (a, b) that connect the components which linked texts of a cell connect."""

    def common(sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of all sets with each other."""
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        inside = count[at] > 1
        of, at = of[inside], place[at[inside]]
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        out = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2 ** 24
        for start in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
            lo, hi = np.searchsorted(at, [start, start + _COLUMNS])
            held = np.zeros((len(sets), _COLUMNS), np.float32)
            held[of[lo:hi], at[lo:hi] - start] = 1
            out += held @ held.T
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each_cell(batches):
            if cell.num_rows < 2:
                continue
            sets = list(shingle_sets(cell.column("text").to_pylist(), words))
            sizes = np.array([len(s) for s in sets])
            both = common(sets)
            linked = 100 * both >= share * (sizes[:, None] + sizes[None, :] - both)
            label = np.unique(cell.column("cid").to_numpy(), return_inverse=True)[1]
            a, b = [], []
            for i in range(len(sets)):
                for other in np.unique(label[linked[i] & (label != label[i])]):
                    a.append(i)
                    b.append(int(np.flatnonzero(linked[i] & (label == other))[0]))
                    label[label == other] = label[i]
            if a:
                node = cell.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked if their sets of ``words``-word shingles have 100 * intersection >=
    ``share`` * union, confirmed on the full sets.  Null, empty and blank texts have an empty
    set and are linked with nothing.  Rows that repeat a doc_id with another text are texts
    of their own; repeated rows appear as often as they come.  A null doc_id never names a
    component that has another name; rows in a component without a name are all kept.
    Other columns are not read.  An empty table gives no rows.
    """
    found = near_duplicate_nodes(docs, words, share, id_col, text_col)
    return found.select(
        F.col("node.id").alias("doc_id"), "n_shingles", F.col("component.id").alias("component_id"),
        F.col("node.id").eqNullSafe(F.col("component.id")).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns as they are.

    The row of the smallest doc_id stays; of rows that repeat its id and text, one.
    """
    found = near_duplicate_nodes(docs, words, share, id_col, text_col)
    name = free_name(docs, "_near_dup_node")
    stay = found.where(F.col("node") == F.col("component")).select(F.col("node").alias(name)).distinct()
    marked = docs.withColumn(name, _node(id_col, text_col))
    kept = marked.join(stay, name, "left_semi")
    return kept.dropDuplicates([name]).drop(name)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
