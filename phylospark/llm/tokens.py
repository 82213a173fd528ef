"""Token counts by a scan for separators in flat, unindexed token files.

``write_tokens`` packs documents into flat files of 16-bit token identifiers: each document's tokens, then the end-of-document
identifier, nothing else. A file is the output of one task and is kept as a table of blocks in the shared folder (Parquet with a
binary column, so that any store that Spark reaches can hold it); beside each block stand the keys of the documents that end in
it, in order, but no positions. ``token_files`` reads plain binary files of any size as such blocks: a task gets byte ranges
(path, offset, length) and reads these alone.

``count_tokens`` finds the separators of a block with one vectorised comparison. Gaps between separators are counts at once; what
lies before the first and after the last separator is stitched across blocks by a prefix scan over one row of fixed width per block: the
carry into a block is the running sum of tokens less the running sum at the last block that held a separator. The scan has two levels, ranges of
``RANGE`` blocks and the blocks of a range, so one file of any length is many tasks' work; counts and keys don't take part in it and get their
block's carry by a join.

Defined cases: a null or empty text has 0 tokens; a document longer than a block spans many; tokens after a file's last separator
belong to no document and are reported by ``open_tail``; repeated rows and keys count separately; an empty table gives an empty
result; columns beyond the key and the text are ignored, so their names can't clash. The vocabulary (about a megabyte; more than
``MAX_VOCABULARY`` bytes raise an error) is read on the driver from a path that is a parameter and sent to the workers.
"""

from __future__ import annotations

import base64
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospark.llm._shared import slices, small_batches, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1 << 18
RANGE = 1 << 12
MAX_VOCABULARY = 16 << 20

# Fixed values of the public byte-level vocabulary: how it splits text, and the free identifier that ends a document.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256

BLOCKS = "file int, block bigint, payload binary, keys array<{key}>"


class Vocabulary:
    """Encodes with a rank file; built once in each worker."""

    _built: dict[int, object] = {}

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            content = f.read(MAX_VOCABULARY + 1)
        if len(content) > MAX_VOCABULARY:
            raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
        self.content = spark.sparkContext.broadcast(content)

    def encoding(self):
        import tiktoken

        content = self.content.value
        stamp = zlib.crc32(content)
        if stamp not in self._built:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
            self._built[stamp] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._built[stamp]


def write_tokens(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The flat files of all documents as blocks (file, block, payload, keys)."""
    rows = small_batches(docs).select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        encoding, file = vocabulary.encoding(), TaskContext.get().partitionId()
        block, held, size, keys = 0, [], 0, []
        names = ["file", "block", "payload", "keys"]
        for batch in slices(batches, "text"):
            for k, t in zip(batch.column("key"), batch.column("text").to_pylist(), strict=True):
                tokens = np.array([*encoding.encode_ordinary(t), end], np.uint16)
                while size + len(tokens) >= block_tokens:  # fill the block; its last token may be this document's separator
                    head, tokens = tokens[: block_tokens - size], tokens[block_tokens - size :]
                    own = keys if len(tokens) else [*keys, k]
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([np.concatenate([*held, head]).tobytes()], pa.binary()), listed(own, batch)], names)
                    block, held, size, keys = block + 1, [], 0, []
                    if not len(tokens):
                        break
                else:
                    held.append(tokens)
                    size += len(tokens)
                    keys.append(k)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary()), listed(keys, batch)], names)

    def listed(keys, batch):
        return pa.array([[k.as_py() for k in keys]], pa.list_(batch.column("key").type))

    return stage(rows.mapInArrow(pack, BLOCKS.format(key=kind)), "tokens")


def opened(path: str):
    """A file by the name that Spark has for it, which isn't escaped."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, place = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(place)


def token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of plain files of 16-bit identifiers; keys are not known. Files are listed with their lengths and dealt by ranges of one block, so
    neither their number nor their size is bounded; a last odd byte is no token. Workers open the files themselves: local ones, and the
    stores that pyarrow knows (HDFS, S3, GCS, Azure); others raise an error."""
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content isn't read
    whole = F.floor(F.col("length") / 2) * 2
    ranges = files.where(whole > 0).select("path", F.xxhash64("path").alias("file"), whole.alias("end"), F.posexplode(F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(size).cast("long"))).alias("block", "offset"))
    ranges = ranges.select("path", "file", F.col("block").cast("long").alias("block"), "offset", F.least(F.lit(size), F.col("end") - F.col("offset")).cast("long").alias("length"))

    def cut(batches):
        last = None
        for batch in batches:
            for path, file, block, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "block", "offset", "length")), strict=True):
                if last is None or last[0] != path:
                    last = path, opened(path)
                payload = last[1].read_at(length, offset)
                if len(payload) < length:
                    raise OSError(f"{path} ends before byte {offset + length}")
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([payload], pa.binary()), pa.array([None], pa.list_(pa.int64()))], ["file", "block", "payload", "keys"])

    dealt = ranges.repartition("file", (F.col("block") / 64).cast("long")).sortWithinPartitions("file", "block")  # 64 blocks of a file together
    return dealt.mapInArrow(cut, "file bigint, block bigint, payload binary, keys array<bigint>")


def search(blocks: DataFrame, end: int) -> DataFrame:
    """For each block: tokens, whether it holds a separator, tokens after the last, counts of all that end in it; staged."""
    kinds = [f"{n} {blocks.schema[n].dataType.simpleString()}" for n in ("file", "block", "keys")]

    def look(batches):
        for batch in slices(batches, "payload", 16 << 20):
            found = []
            for payload in batch.column("payload").to_pylist():
                tokens = np.frombuffer(payload, "<u2")
                ends = np.flatnonzero(tokens == end)
                found.append((len(tokens), len(ends) > 0, len(tokens) - 1 - int(ends[-1]) if len(ends) else len(tokens), np.diff(ends, prepend=-1) - 1))
            n, has, tail, counts = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("keys"), pa.array(n, pa.int64()), pa.array(has), pa.array(tail, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], ["file", "block", "keys", "n", "has_end", "tail", "counts"])

    return stage(blocks.select("file", "block", "keys", "payload").mapInArrow(look, ", ".join([*kinds, "n bigint, has_end boolean, tail bigint, counts array<bigint>"])), "found")


def scan(found: DataFrame) -> DataFrame:
    """(file, block, n, has_end, tail, carry): carry is the tokens before a block that belong to the document that is open at its start."""
    # ahead: tokens of all blocks before, in the range or the file; settled: what of them lies before the last separator among them
    rows = found.select("file", "block", "n", "has_end", "tail", F.expr(f"block div {RANGE}").alias("range"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = before(["file", "range"], "block")
    rows = rows.withColumn("ahead", F.coalesce(F.sum("n").over(own), F.lit(0)))
    ended = F.when(F.col("has_end"), F.col("ahead") + F.col("n") - F.col("tail"))
    rows = rows.withColumn("settled", F.last(ended, ignorenulls=True).over(own))
    ranges = rows.groupBy("file", "range").agg(F.sum("n").alias("all"), F.max(ended).alias("end"))  # a later end is greater
    whole = before(["file"], "range")
    ranges = ranges.withColumn("first", F.coalesce(F.sum("all").over(whole), F.lit(0)))
    ranges = ranges.withColumn("done", F.last(F.col("first") + F.col("end"), ignorenulls=True).over(whole)).select("file", "range", "first", "done")
    rows = rows.join(ranges, ["file", "range"])
    carry = F.col("first") + F.col("ahead") - F.coalesce(F.col("first") + F.col("settled"), F.col("done"), F.lit(0))
    return rows.select("file", "block", "n", "has_end", "tail", carry.alias("carry"))


def count_tokens(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, place, key, n_tokens): a row for every document in the files; place counts separators within the block."""
    found = search(blocks, end)
    rows = found.where("has_end").select("file", "block", "keys", "counts").join(scan(found).select("file", "block", "carry"), ["file", "block"])
    rows = rows.select("file", "block", "keys", "carry", F.posexplode("counts").alias("place", "own"))
    return rows.select("file", "block", "place", F.get("keys", F.col("place")).alias("key"), (F.col("own") + F.when(F.col("place") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def open_tail(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, n_tokens): tokens after the last separator of each file."""
    last = scan(search(blocks, end)).groupBy("file").agg(F.max_by(F.when(F.col("has_end"), F.col("tail")).otherwise(F.col("carry") + F.col("n")), "block").alias("n_tokens"))
    return last.where("n_tokens > 0")


def op1_tokens(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The number of tokens of every document, counted in flat token files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = write_tokens(docs, "doc_id", "text", Vocabulary(spark, vocabulary))
    return count_tokens(blocks).select(F.col("key").alias("doc_id"), "n_tokens")
