"""Compression of embeddings to product codes: Lloyd's method on cover trees local to a partition.

Vectors on an integer grid are cut into parts; each part position has its own codebook.  The
trees are built once, block by block, and written to the shared folder.  Every round assigns
whole subtrees by the triangle inequality and compares single points only where that leaves
doubt; its sums, a few per codebook entry, are added up by Spark.  All of it is in whole numbers, so codes
don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carecohort.llm.cover_tree import CoverTree, build, nearest_centres, sums_by_centre
from carecohort.llm.vectors import on_grid, usable_vectors
from carecohort.operators.skew import join_lookup
from carecohort.storage import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block, which has one tree per part.
BLOCK = 4096


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    """Zeros added at the end, so that vectors have ``parts`` equal parts."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def _blocks(vectors: DataFrame, width: int, parts: int, scale: float) -> DataFrame:
    """Rows in blocks: the other columns as lists, the parts' points and trees as bytes; written."""
    kept = vectors.schema.fields[:-1]
    each = -(-width // parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _padded(on_grid(batch.column(batch.num_columns - 1), width, scale), parts)
                trees = [build(x[:, p * each : (p + 1) * each]).to_bytes() for p in range(parts)]
                yield pa.RecordBatch.from_arrays([
                    *(pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), c) for c in batch.columns[:-1]),
                    pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary())),
                ], [*(f.name for f in kept), "points", "trees"])

    schema = T.StructType([
        *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept),
        T.StructField("points", T.BinaryType()), T.StructField("trees", T.ArrayType(T.BinaryType())),
    ])
    return written(vectors.mapInArrow(task, schema), "cover_trees", compression="zstd")


def _unpacked(batch: pa.RecordBatch, each: int, parts: int) -> Iterator[tuple[int, list]]:
    """(row number, [(tree, points) of each part]) of a batch of blocks."""
    for i, (points, trees) in enumerate(zip(batch.column("points"), batch.column("trees"), strict=True)):
        x = np.frombuffer(points.as_buffer(), "<i8").reshape(-1, each * parts)
        yield i, [
            (CoverTree.from_bytes(t.as_py()), x[:, p * each : (p + 1) * each]) for p, t in enumerate(trees)
        ]


def _round(blocks: DataFrame, codebooks: list[np.ndarray], each: int) -> list[np.ndarray]:
    """Codebooks after one round; an entry that is nobody's nearest stays."""
    parts = len(codebooks)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = defaultdict(int)
        counts: dict[tuple, int] = defaultdict(int)
        for batch in batches:
            for _, trees in _unpacked(batch, each, parts):
                for p, (tree, points) in enumerate(trees):
                    found, n = sums_by_centre(tree, points, codebooks[p])
                    for e in np.flatnonzero(n):
                        counts[p, e] += int(n[e])
                        for i, v in enumerate(found[e]):
                            sums[p, e, i] += int(v)
        if sums:
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c, pa.int32()) for c in zip(*sums, strict=True)),
                pa.array([Decimal(v) for v in sums.values()], pa.decimal128(38, 0)),
                pa.array([counts[k[:2]] for k in sums], pa.int64()),
            ], ["part", "entry", "at", "total", "n"])

    partial = blocks.select("points", "trees").mapInArrow(task, "part int, entry int, at int, total decimal(38,0), n bigint")
    found = partial.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    new = [c.copy() for c in codebooks]
    for r in found:  # one row per codebook component
        new[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return new


def learn_codebooks(vectors: DataFrame, blocks: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES,
                    rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id") -> list[np.ndarray]:
    """One codebook per part: entries start as the parts of the smallest ids, then ``rounds`` of Lloyd's method."""
    each = -(-width // parts)
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return [np.zeros((0, each), np.int64)] * parts
    x = on_grid(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width, scale)
    codebooks = [c.copy() for c in np.split(_padded(x, parts), parts, axis=1)]
    for _ in range(rounds):
        codebooks = _round(blocks, codebooks, each)
    return codebooks


def apply_codebooks(blocks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """One row per vector: the other columns, ``code`` and ``error`` (squared distance to what the code stands for)."""
    parts, each = len(codebooks), codebooks[0].shape[1]
    kept = blocks.schema.fields[:-2]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in _unpacked(batch, each, parts):
                codes = np.stack([nearest_centres(t, x, c) for (t, x), c in zip(trees, codebooks, strict=True)], axis=1)
                errors = np.zeros(len(codes), object)
                for p, (_, x) in enumerate(trees):
                    gap = x - codebooks[p][codes[:, p]]
                    wide = int(np.max(np.abs(gap), initial=0)) ** 2 * each >= 2**63
                    errors += ((gap.astype(object) if wide else gap) ** 2).sum(axis=1).astype(object)
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(i, 1).flatten() for c in batch.columns[:-2]),
                    pa.array(["".join(f"{v:02x}" for v in row) for row in codes.tolist()], pa.string()),
                    pa.array(errors, pa.int64()),
                ], [*(f.name for f in kept), "code", "error"])

    schema = T.StructType([
        *(T.StructField(f.name, f.dataType.elementType) for f in kept),
        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    return blocks.mapInArrow(task, schema)


def compress_vectors(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
                     id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors (id, ``keep`` columns, code, error) and the codebooks.

    Components become ``floor(scale * x)``.  Rows whose vector is null, empty, of another
    width than most or holds null or non-finite entries are left out; components too large for
    64-bit integers raise an error.  Widths that ``parts`` does not divide are filled up with zeros.  Codebooks start at
    the smallest ids (nulls last, repeated ids by vector), each row for itself, and are shorter
    if there are fewer rows; entries may be equal, the lowest is used.  At most 256 entries.  An
    empty table gives no rows and empty codebooks.  Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits per part")
    vectors, width, _ = usable_vectors(df, vector_col, [id_col, *keep])
    blocks = _blocks(vectors, max(width, 1), parts, scale)
    codebooks = learn_codebooks(vectors, blocks, max(width, 1), parts, entries, rounds, scale, id_col)
    return written(apply_codebooks(blocks, codebooks), "vector_codes"), codebooks


def codebook_text(codebooks: list[np.ndarray]) -> str:
    """Components of all entries by part, entry and position, comma-joined."""
    return ",".join(str(int(v)) for book in codebooks for v in book.ravel())


def coded_vectors(df: DataFrame) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` is the error summed over the rows of the same label, null being one of them.
    """
    rows, codebooks = compress_vectors(df, keep=("label",))
    text = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = rows.withColumn("_label", text)
    sums = rows.groupBy("_label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    return join_lookup(rows, sums, ["_label"], "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The same in SQL: vectors unnested to components, one pair of queries per round."""
    steps = [f"""x AS MATERIALIZED (
  SELECT r, vec_id, label, (i - 1) // w AS p, (i - 1) % w AS i, CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT row_number() OVER () AS r, vec_id, label, len(embedding) // {PARTS} AS w,
      unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i
    FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
)""", f"""c0 AS MATERIALIZED (
  SELECT p, e, i, v FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT r, vec_id FROM x)) USING (r)
  WHERE e < {ENTRIES}
)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (
  SELECT x.r, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON c.p = x.p AND c.i = x.i GROUP BY 1, 2, 3
), a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d{k} GROUP BY 1, 2
)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM x JOIN a{k} USING (r, p) GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (
  SELECT p, e, i, CASE WHEN n IS NULL THEN v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v FROM c{k} LEFT JOIN s{k} USING (p, e, i)
)""")
    return "WITH " + ",\n".join(steps) + f""",
o AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} JOIN (SELECT DISTINCT r, vec_id, label FROM x) USING (r) GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{ROUNDS}) AS codebooks_sha256
FROM o
"""


SQL = _sql()
