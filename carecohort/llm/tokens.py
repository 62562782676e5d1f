"""Token-id files: tokenised documents in a compressed, checksummed binary format.

A token folder is a parquet table of blocks, each coded by ``token_coder``:

    range_id   number of the doc_id range, ascending
    block_no   number of the block within the range
    n_tokens   ids in the block (``BLOCK``, fewer in a range's last block)
    doc_ids    documents that end in this block, in order
    doc_ends   number of ids of the block up to and with each one's end id
    payload    the coded ids

Documents follow each other in ascending doc_id order (null first; equal doc_ids by
text) without regard to blocks.  A document may span any number of blocks, and any
block can be decoded alone.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecohort.llm.common import running_offsets, shuffle_partitions
from carecohort.llm.token_coder import BLOCK, LANES, decode_blocks, encode_blocks

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words, marks and numbers that tell tokenizers that drop white space from others.
_PROBE = "ab cd\nEf  g, 12 3.x don't \u00e9A \u2014 \u00dfu (y) "
#: Words whose ids a Python worker remembers; beyond, it starts anew.
REMEMBERED_WORDS = 1_000_000
#: Words handed to the tokenizer's model in one string.
WORDS_A_STRING = 2_000
_BLOCKS = (
    "range_id int, block_no int, n_tokens int, doc_ids array<bigint>, doc_ends array<int>, payload binary"
)


class WordTokenizer:
    """Ids of whole texts, found once per distinct word.

    The tokenizer drops white space and never merges across it, so a text's ids are those of
    its pieces between spaces and line ends, one after the other.  Pieces that are a word of
    Latin letters with marks behind it are two pieces; the words go to the tokenizer's model
    as its own normaliser and splitter would hand them over, letter by letter, many in a string.
    A tokenizer whose ids of ``_PROBE`` are not those of its pieces, such as one that keeps
    blanks, or that has added tokens with blanks, gets whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        probe, pieces = self._whole([_PROBE]), self._whole(re.split("[ \n]", _PROBE))
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_word = probe[0] == b"".join(pieces) and not any(re.search(r"\s", t) for t in added)
        if not self.by_word:
            return
        self.letters: dict[int, str] = {}
        for code in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)):
            plain = self.tokenizer.normalizer.normalize_str(chr(code))
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
            if plain.isalpha() and len(plain) == len(pieces) == 1:
                self.letters[code] = pieces[0][0]
        self.lowers = all(self.letters.get(c) == self.letters.get(c + 32) for c in range(65, 91))
        # a word of such letters, and marks that never join what is before them
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        marks = [m for m in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~" if split(f"a{m}{m}")[0][0] == split("a")[0][0]]
        letters, marks = "".join(map(chr, self.letters)), re.escape("".join(marks))
        self.plain = f"\\A(?P<word>[{letters}]+)(?P<marks>" + (f"[{marks}]*)\\z" if marks else ")\\z")
        # the model alone, for words between blanks; ids that end a word tell them apart
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _whole(self, pieces: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    def _coded(self, pieces: pa.Array):
        """Ids of all ``pieces`` and how many each has."""
        coded = self._whole(pieces.to_pylist())
        return np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4

    def _coded_words(self, words: pa.Array):
        """The same for words of ``letters``."""
        offsets = np.append(np.arange(0, len(words), WORDS_A_STRING, np.int32), np.int32(len(words)))
        lists = pc.binary_join(pa.ListArray.from_arrays(offsets, words), pa.scalar(" ", words.type)).to_pylist()
        strings = [s if self.lowers and s.isascii() else s.translate(self.letters) for s in lists]
        ids, sizes = [], []
        for string, coded in zip(strings, self.words.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            found, n = np.array(coded.ids, "<u4"), string.count(" ") + 1
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) != n or ends[-1] != len(found):
                each = [[t.id for t in self.tokenizer.model.tokenize(w)] for w in string.split(" ")]
                found, ends = np.array([i for e in each for i in e], "<u4"), np.cumsum([len(e) for e in each])
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Places of ``words`` among those whose ids are known, which they are from now on."""
        places = pc.index_in(words, value_set=self.known)
        if places.null_count and len(self.known) > REMEMBERED_WORDS:
            self._forget()
            places = pc.index_in(words, value_set=self.known)
        new = words.filter(places.is_null())
        numbers = places.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            numbers[places.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(new)) + len(self.known)
            ids, sizes = self._coded_words(new)
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as 32-bit integers in the machine's byte order, which is little-endian."""
        if not self.by_word:
            return self._whole(texts)
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        pieces = pc.split_pattern(lines, " ")
        numbered = pieces.values.dictionary_encode()
        distinct = numbered.dictionary
        split = pc.extract_regex(distinct, self.plain)
        words, marks = split.field("word"), split.field("marks")
        words = (pc.ascii_lower(words) if self.lowers else words).filter(split.is_valid()).dictionary_encode()
        marks = marks.filter(split.is_valid()).dictionary_encode()
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        numbers = self._numbers(words.dictionary)
        # stretches of ids: known words, then marks, then other pieces, then an empty one
        parts = [
            (self.ids, self.sizes), self._coded(marks.dictionary),
            self._coded(distinct.filter(split.is_null())), (np.zeros(0, "<u4"), np.zeros(1, np.int64)),
        ]
        pool, sizes = (np.concatenate(p) for p in zip(*parts, strict=True))
        before = np.cumsum([0, *(len(s) for _, s in parts)])
        first, second = np.empty(len(plain), np.int64), np.full(len(plain), before[3])
        first[plain], second[plain] = numbers[words.indices.to_numpy()], before[1] + marks.indices.to_numpy()
        first[~plain] = np.arange(before[2], before[3])
        pool, ends = _strung(pool, np.cumsum(sizes) - sizes, sizes, np.column_stack([first, second]).ravel())
        ends = ends[::2]
        stream, ends = _strung(pool, ends[:-1], np.diff(ends), numbered.indices.to_numpy())
        edges = ends[pieces.offsets.to_numpy()]
        return [stream[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _strung(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray, numbers: np.ndarray):
    """The stretches of ``pool`` that ``numbers`` names, one after the other, and where they start and end."""
    n = sizes.take(numbers)
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    source = np.repeat(begins.take(numbers) - ends[:-1], n)
    source += np.arange(ends[-1])
    return pool.take(source), ends


#: Tokenizers of a Python worker, which outlives its tasks.
_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 8 << 20):
    """(doc_id, text) lists of a few MB of text."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py())
            held += len(texts[-1])
            if held > size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(
    docs: DataFrame, path: str, ranges: int, tokenizer_path: str, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Tokenise whole texts (null as empty), append ``end_id`` to each, write a token folder.

    Text is shuffled once, into ranges of ``id_col``.  Repeated ids and rows are kept.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        ends: list[tuple[int | None, int]] = []
        position, first = 0, 0  # ids so far; number of the first block not written

        def flush(last: bool):
            nonlocal held, ends, first
            stream = np.frombuffer(b"".join(held), "<u4")
            whole = len(stream) if last else len(stream) // BLOCK * BLOCK
            blocks = [stream[i : i + BLOCK] for i in range(0, whole, BLOCK)]
            of: list[list] = [[] for _ in blocks]
            later = []
            for doc, at in ends:
                b = (at - 1) // BLOCK - first
                (of[b] if b < len(blocks) else later).append((doc, at))
            for i in range(0, len(blocks), LANES):
                coded = encode_blocks(blocks[i : i + LANES])
                numbers = range(first + i, first + i + len(coded))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(coded), pa.int32()),
                    pa.array(numbers, pa.int32()),
                    pa.array([len(b) for b in blocks[i : i + LANES]], pa.int32()),
                    pa.array([[d for d, _ in x] for x in of[i : i + LANES]], pa.list_(pa.int64())),
                    pa.array(
                        [[at - n * BLOCK for _, at in x] for n, x in zip(numbers, of[i : i + LANES], strict=True)],
                        pa.list_(pa.int32()),
                    ),
                    pa.array(coded, pa.binary()),
                ], ["range_id", "block_no", "n_tokens", "doc_ids", "doc_ends", "payload"])
            first += len(blocks)
            held, ends = [stream[whole:].tobytes()], later

        for ids, texts in _pieces(batches):
            for doc, coded in zip(ids, tokenizer.encode(texts), strict=True):
                held += coded, end
                position += len(coded) // 4 + 1
                ends.append((doc, position))
            if position - first * BLOCK >= LANES * BLOCK:
                yield from flush(False)
        if position > first * BLOCK:
            yield from flush(True)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, _BLOCKS).write.mode("errorifexists").parquet(path)


def decoded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(the row, its ids) for rows that end with a payload, decoded many at a time."""
    held: list[tuple] = []

    def emptied():
        yield from zip(held, decode_blocks([r[-1] for r in held]), strict=True)
        held.clear()

    for row in rows:
        held.append(row)
        if len(held) == LANES:
            yield from emptied()
    yield from emptied()


def read_token_documents(spark: SparkSession, path: str, ranges: int) -> DataFrame:
    """Per document of a token folder: doc_id, start, n_tokens, ids_crc32, all from decoded ids."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range_id", "doc_id", "local_start", "n_tokens", "ids_crc32"]
        found: list[tuple] = []
        part, position, start, crc = None, 0, 0, 0
        rows = (
            tuple(x[n] for n in ("range_id", "block_no", "doc_ids", "doc_ends", "payload"))
            for b in batches for x in b.to_pylist()
        )
        for (number, block, docs, ends, _), ids in decoded(rows):
            if number != part:
                part, position, start, crc = number, 0, 0, 0
            data, base = memoryview(ids.astype("<u4").tobytes()), position
            if base != block * BLOCK:
                raise ValueError(f"block {block} of range {number} does not follow its predecessor")
            at = 0
            for doc, end in zip(docs, ends, strict=True):
                crc = zlib.crc32(data[4 * at : 4 * end], crc)
                found.append((part, doc, start, base + end - start, crc))
                start, crc, at = base + end, 0, end
            crc = zlib.crc32(data[4 * at :], crc)
            position = base + len(ids)
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    blocks = spark.read.schema(_BLOCKS).parquet(path)
    per_doc = (
        blocks.repartitionByRange(ranges, "range_id").sortWithinPartitions("range_id", "block_no")
        .mapInArrow(measure, "range_id bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    )
    totals = blocks.groupBy(F.col("range_id").cast("bigint").alias("range_id")).agg(F.sum("n_tokens").alias("_n"))
    before = running_offsets(totals, ["range_id"], "_n", "_before").drop("_n")  # at most ``ranges`` rows
    return per_doc.join(F.broadcast(before), "range_id").select(
        "doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their decoded ids (array<bigint>); payload is dropped."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = decode_blocks(batch.column("payload").to_pylist())
            kept = batch.drop_columns(["payload"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(values, pa.list_(pa.int64()))], [*kept.schema.names, "ids"]
            )

    schema = _BLOCKS.replace("payload binary", "ids array<bigint>")
    return spark.read.schema(_BLOCKS).parquet(path).mapInArrow(ids, schema)


def token_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, ranges: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to the token folder ``path`` and measure the documents read back from it.

    Null text counts as empty: its only id is ``end_id``.  Null ids come first; repeated
    rows are separate documents.  An empty table gives an empty folder and no rows.  Other
    columns are not read.
    """
    n = ranges or shuffle_partitions(docs.sparkSession)
    write_token_files(docs, path, n, tokenizer_path, end_id, id_col, text_col)
    return read_token_documents(docs.sparkSession, path, n)


