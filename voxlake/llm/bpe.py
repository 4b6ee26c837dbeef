"""Byte-level BPE: higher-order functions fold ranked merges over the distinct words of a corpus.

A text is cut by the tokenizer's pattern. Rows are taken in blocks: a block keeps a code for each word and lists its distinct
words once, packed by shares of the words' hashes. The lists of a share meet in one task, where every distinct word is folded
once; its ids go back to the blocks that have it, and there codes become ids. Texts are not shuffled, only packed lists of
distinct words and ids, and packed codes.

The fold carries two strings: the word's symbols, and for each neighbouring pair the symbol that it merges to. A symbol is
one character: a byte's own, or one that stands for a token's rank, in order of rank; a pair that does not merge has a
character above all of these. So array_min finds the merge of least rank, and instr its leftmost place. Ranks come from a
literal map: an array of small buckets, as a lookup in a map literal reads the map from end to end. Decoding concatenates
the tokens' binary pieces.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import ensure_checkpoint_dir, tasks_for
from .text import release, utf8

#: Characters: FIRST is that of rank 0, the next ranks follow without the surrogates; from NONE on, pairs that do not merge.
FIRST, SURROGATES, NONE = 0x800, range(0xD800, 0xE000), 0x90000
SEP, CUT = "\U0010ffff", "\U0010fffe"
BUCKETS = 1 << 16
BLOCK_WORDS = 3_000_000  # a block ends with the batch of rows that reaches so many words
BATCH_ROWS = 1000
PART_WORDS = 1 << 18  # words decoded at a time
CHUNK = 1 << 14  # words folded as one row
PLAN_CONF, PLAN_TEXT = "spark.sql.maxPlanStringLength", 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_char(rank: int) -> str:
    """The character of a token of that rank."""
    c = FIRST + rank
    return chr(c if c < SURROGATES.start else c + len(SURROGATES))


class RankMap:
    """The rank map and the fold."""

    def __init__(self, ranks: dict[bytes, int]):
        if ord(rank_char(max(ranks.values(), default=0))) >= NONE:
            raise ValueError("more ranks than characters for them")
        symbol = lambda t: chr(t[0]) if len(t) == 1 else rank_char(ranks[t])
        buckets = [chr(NONE)] * BUCKETS
        bytes_, merged = [], []
        for token, rank in ranks.items():
            if len(token) == 2:
                bytes_.append(chr(NONE + token[0] * 256 + token[1]))
                merged.append(rank_char(rank))
            for cut in range(1, len(token)):
                a, b = token[:cut], token[cut:]
                if a in ranks and b in ranks:
                    key = SEP + symbol(a) + symbol(b)
                    buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS] += key + rank_char(rank)
        self.text = CUT.join(buckets)
        self.bytes, self.merged = "".join(bytes_), "".join(merged)

    def merge(self, buckets: Column, a: Column, b: Column) -> Column:
        """The symbol that two neighbours merge to: what follows the pair in its bucket, else the bucket's first character."""
        key = F.concat(F.lit(SEP), a, b)
        bucket = F.get(buckets, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.substring(F.call_function("substring_index", bucket, key, F.lit(-1)), 1, 1)

    def pairs_of_bytes(self, symbols: Column, n: Column) -> Column:
        """What each pair of neighbouring bytes merges to: pairs become characters from NONE on, then the known ones ranks."""
        spread = F.regexp_replace(symbols, F.lit("(?s)(.)(?=(.))"), F.lit("\x00" + chr(NONE >> 16) + "$1$2"))
        pairs = F.decode(F.encode(F.substring(spread, F.lit(1), 4 * (n - 1)), "ISO-8859-1"), "UTF-32")
        return F.translate(pairs, self.bytes, self.merged)

    def table(self, spark: SparkSession) -> DataFrame:
        """(buckets) in one row. Its scalar() reaches tasks as a literal does, but not the text of plans, which the driver writes
        for each change that adaptive execution makes."""
        return spark.createDataFrame([(self.text,)], "text string").select(F.split("text", F.lit(CUT)).alias("buckets"))

    def fold_all(self, words: Column, buckets: Column) -> Column:
        """The tokens of each of an array of words; buckets is the value of table()."""
        return F.transform(F.array(buckets), lambda buckets: F.transform(words, lambda word: self.fold(word, buckets)))[0]

    def fold(self, word: Column, buckets: Column) -> Column:
        """The word's tokens as symbols, after all ranked merges."""
        one, rest = F.lit(1), F.lit(1 << 30)
        n = F.octet_length(word)
        symbols = F.decode(word.cast("binary"), "ISO-8859-1")

        def step(state: Column, look: Column) -> Column:
            s, r, m, i = state["s"], state["r"], state["m"], state["i"]
            least = F.array_min(F.split(r, F.lit("")))
            found = F.struct(s.alias("s"), r.alias("r"), least.alias("m"), F.instr(r, least).alias("i"))
            left = F.when(i > 1, self.merge(buckets, F.substring(s, i - 1, one), m)).otherwise("")
            right = F.when(i < F.length(r), self.merge(buckets, m, F.substring(s, i + 2, one))).otherwise("")
            joined = F.struct(
                F.concat(F.substring(s, one, i - 1), m, F.substring(s, i + 2, rest)).alias("s"),
                F.concat(F.substring(r, one, F.greatest(i - 2, F.lit(0))), left, right, F.substring(r, i + 2, rest)).alias("r"),
                F.lit("").alias("m"), F.lit(0).alias("i"),
            )
            return F.when(m >= chr(NONE), state).when(look, found).otherwise(joined)

        start = F.struct(symbols.alias("s"), self.pairs_of_bytes(symbols, n).alias("r"), F.when(n < 2, chr(NONE)).otherwise("").alias("m"), F.lit(0).alias("i"))
        # Steps find the least merge and carry it out by turns; a word has one merge fewer than bytes at most.
        turns = F.sequence(F.lit(0), F.greatest(2 * n - 3, F.lit(0)))
        return F.aggregate(turns, start, lambda state, k: step(state, k.bitwiseAND(F.lit(1)) == 0), lambda state: state["s"])


@dataclass
class Vocabulary:
    """Ranks and pieces as arrays, for tasks."""

    byte_rank: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        size = np.array([len(p) for p in pieces], np.int64)
        byte_rank = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        return cls(byte_rank, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)

    def ids(self, symbols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all values one after another, number of ids of each value)."""
        raw, at = utf8(symbols)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
        count = np.diff(np.append(0, np.cumsum((raw & 0xC0) != 0x80))[at])
        skip = np.where(chars < SURROGATES.start, FIRST, FIRST + len(SURROGATES))
        return np.where(chars < 256, self.byte_rank[np.minimum(chars, 255)], chars - skip).astype(np.int32), count

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces of ids, one after another."""
        return self.data[_ranges(self.start[ids], self.size[ids])].tobytes()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays of bytes or of numbers below 2 ** 32, compressed; numbers byte by byte of their places."""
    planes = [p if p.dtype == np.uint8 else np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel() for p in parts]
    head = np.array([[len(p), p.dtype == np.uint8] for p in parts], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(p.tobytes() for p in planes)]), 3)


def _unpack(data: bytes, parts: int) -> list[np.ndarray]:
    """The arrays of _pack, numbers as 32 unsigned bits."""
    raw, out = np.frombuffer(zstandard.decompress(data), np.uint8), []
    at = 16 * parts
    for n, plain in raw[:at].view(np.int64).reshape(-1, 2):
        size = int(n) if plain else 4 * int(n)
        part, at = raw[at : at + size], at + size
        out.append(part if plain else np.ascontiguousarray(part.reshape(4, -1).T).ravel().view("<u4"))
    return out


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The elements of data from start on, size of each, one after another."""
    return data[_ranges(start, size)]


@dataclass
class Tokenizer:
    """A rank file and a pattern. Unicode classes follow the JVM's tables."""

    spark: SparkSession
    ranks: dict[bytes, int]
    pattern: str
    block_words: int = BLOCK_WORDS

    def words(self, text: Column) -> Column:
        """The matches of the pattern, in order; none for null or empty texts."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))  # (?U): \s is Unicode white space

    def blocks(self, docs: DataFrame, shares: int) -> DataFrame:
        """The rows of docs in blocks, written to the shared folder as a table in buckets of blocks, so that what comes back to
        a block needs no shuffle of the block. One row for each block: rows (docs' columns but text) and
        packed (number of words of each row, code of every word in order); one for each share of a block's distinct words:
        share, packed (codes, sizes, bytes)."""
        others = [c for c in docs.columns if c != "text"]
        row = T.StructType([docs.schema[c] for c in others]) if others else T.StructType([T.StructField("none", T.IntegerType())])
        schema = T.StructType([
            T.StructField("block", T.LongType()), T.StructField("share", T.IntegerType()), T.StructField("rows", T.ArrayType(row)), T.StructField("packed", T.BinaryType()),
        ])
        limit = self.block_words

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
            size = 0

            def block() -> pa.RecordBatch:
                coded = pa.chunked_array([words for words, _, _ in held]).unify_dictionaries().combine_chunks()
                rows = pa.concat_arrays([r for _, r, _ in held])
                # Codes in order of frequency are small numbers.
                index = np.asarray(coded.indices)
                order = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
                code = np.empty(len(order), np.uint32)
                code[order] = np.arange(len(order), dtype=np.uint32)
                data, at = utf8(coded.dictionary)
                share = np.array([zlib.crc32(w) % shares for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
                by = np.lexsort((code, share))
                cuts = np.searchsorted(share[by], np.arange(shares + 1))
                packed, length = [_pack(np.concatenate([c for _, _, c in held]), code[index])], np.diff(at)
                used = np.flatnonzero(np.diff(cuts))
                for k in used:
                    some = by[cuts[k] : cuts[k + 1]]
                    packed.append(_pack(code[some], length[some], _take(data, at[some], length[some])))
                rows = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.nulls(len(used), pa.list_(rows.type))])
                columns = [pa.array(np.full(len(used) + 1, number)), pa.array([None, *used.tolist()], pa.int32()), rows, pa.array(packed, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names)

            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append((batch.column(1).flatten().dictionary_encode(), batch.column(0), np.diff(np.asarray(batch.column(1).offsets))))
                size += len(held[-1][0])
                if size >= limit:
                    yield block()
                    held, size, number = [], 0, number + 1
            if held:
                yield block()
            held = []
            release()

        names = schema.names
        ensure_checkpoint_dir(self.spark)
        name = f"bpe_{uuid.uuid4().hex}"
        row_column = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
        packed = docs.select(row_column.alias("row"), self.words(F.col("text")).alias("words")).mapInArrow(pack, schema)
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"  # words take more room than texts
        before = self.spark.conf.get(rows)
        self.spark.conf.set(rows, str(BATCH_ROWS))
        try:
            packed.write.bucketBy(shares, "block").option("path", f"{self.spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
        finally:
            self.spark.conf.set(rows, before)
        return self.spark.table(name)

    def encoded(self, docs: DataFrame, finish: Callable[..., Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
        """finish(vocabulary, rows: struct array, ids: of all rows one after another, ends: offsets of the rows' ids) for
        every block."""
        shares = tasks_for(self.spark)
        blocks = self.blocks(docs, shares)
        vocabulary = self.spark.sparkContext.broadcast(Vocabulary.of(self.ranks))  # as large as the rank file

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distinct words of a task's shares in rows of CHUNK words, and their places: word, block's number, code."""
            blocks, lists, codes, at = [], [], [], []
            for batch in batches:
                for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    code, size, data = _unpack(packed, 3)
                    offsets = np.append(0, np.cumsum(size.astype(np.int64))).astype(np.int32)
                    lists.append(pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]))
                    codes.append(code)
                    at.append(np.full(len(code), len(blocks)))
                    blocks.append(block)
            if not blocks:
                return
            coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
            word, code, at, block = np.asarray(coded.indices), np.concatenate(codes), np.concatenate(at), np.array(blocks)
            order = np.argsort(word, kind="stable")
            word, code, at = word[order], code[order], at[order]
            for lo in range(0, len(coded.dictionary), CHUNK):
                words = coded.dictionary.slice(lo, CHUNK)
                a, b = np.searchsorted(word, [lo, lo + CHUNK])
                columns = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([block.tolist()], pa.list_(pa.int64()))]
                places = pa.array([_pack(word[a:b] - lo, at[a:b], code[a:b])], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, places], ["words", "blocks", "places"])
            del lists, codes, coded, word, code, at
            release()

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each block: codes, number of ids and ids of its words."""
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, size = vocabulary.value.ids(batch.column(0)[k].values)
                    start = np.cumsum(size) - size
                    word, at, code = _unpack(batch.column(2)[k].as_py(), 3)
                    order = np.lexsort((code, at))
                    word, at, code = word[order], at[order], code[order]
                    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                    lists = [_pack(code[s], size[word[s]], _take(ids, start[word[s]], size[word[s]])) for s in (slice(*x) for x in zip(cuts, np.append(cuts[1:], len(at))))]
                    blocks = np.asarray(batch.column(1)[k].values)[at[cuts]]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(lists, pa.binary())], ["block", "list"])
            release()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    counts, codes = _unpack(batch.column(1)[k].as_py(), 2)
                    lists = [_unpack(x, 3) for x in batch.column(2)[k].as_py() or []]
                    none = np.zeros(0, np.uint32)
                    code, size, ids = (np.concatenate([none, *x]).astype(np.int64) for x in (zip(*lists) if lists else [()] * 3))
                    order = np.argsort(code)
                    start, size = (np.cumsum(size) - size)[order], size[order]
                    ids, rows, upto = ids.astype(np.int32), batch.column(0)[k].values, np.append(0, np.cumsum(counts.astype(np.int64)))
                    lo = 0
                    while lo < len(rows):  # a part of the block at a time, or one row
                        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PART_WORDS, "right")) - 1)
                        some = codes[upto[lo] : upto[hi]]
                        ends = np.append(0, np.cumsum(size[some]))[upto[lo : hi + 1] - upto[lo]]
                        yield from finish(vocabulary.value, rows.slice(lo, hi - lo), _take(ids, start[some], size[some]), ends)
                        lo = hi
                release()

        shared = blocks.where("share is not null").select("block", "packed", "share").repartition(shares, "share")
        met = shared.select("block", "packed").mapInArrow(meet, "words array<string>, blocks array<long>, places binary")
        ranks = RankMap(self.ranks)
        folded = met.withColumn("buckets", ranks.table(self.spark).scalar()).select(ranks.fold_all(F.col("words"), F.col("buckets")).alias("symbols"), "blocks", "places")
        lists = folded.mapInArrow(back, "block long, list binary").groupBy("block").agg(F.collect_list("list").alias("lists"))
        packed = blocks.where("share is null").select("block", "rows", "packed")
        return packed.join(lists, "block", "left").select("rows", "packed", "lists").mapInArrow(run, schema)


def tokenizer(spark: SparkSession, path: str | None = None, pattern: str | None = None, **options) -> Tokenizer:
    """By default the installed public 50k byte-level vocabulary and its pattern.

    Unless the session sets spark.sql.maxPlanStringLength, it becomes PLAN_TEXT: the driver keeps the text of a query's plan
    for each change that adaptive execution makes, and the literal rank map alone takes megabytes of it.
    """
    import public_tokenizers

    if spark.conf.get(PLAN_CONF, None) is None:
        spark.conf.set(PLAN_CONF, str(PLAN_TEXT))
    return Tokenizer(spark, read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN, **options)


def checked(docs: DataFrame, t: Tokenizer) -> DataFrame:
    """docs' columns other than text, with n_tokens, tokens (array<int>) and decoded (the text that the tokens decode to);
    columns of docs with these names are replaced. Null texts have no tokens and count as empty; repeated rows stay."""
    own = ["n_tokens", "tokens", "decoded"]
    docs = docs.select(*[c for c in docs.columns if c not in own])
    others = [c for c in docs.columns if c != "text"]

    def finish(v: Vocabulary, rows: pa.Array, ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        text = [v.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in others), pa.array(np.diff(ends)), tokens, pa.array(text, pa.string())], [*others, *own])

    fields = [docs.schema[c] for c in others] + [T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return t.encoded(docs, finish, T.StructType(fields))


def digests(docs: DataFrame, t: Tokenizer) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text, ...): digests of the encoded ids
    and of the bytes that they decode to. Null texts count as empty; rows may repeat; extra columns are ignored."""

    def finish(v: Vocabulary, rows: pa.Array, ids: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        packed, text = ids.astype("<u4"), []
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            out.append(hashlib.sha256(packed[a:b].tobytes()).hexdigest())
            text.append(hashlib.sha256(v.decode(ids[a:b])).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.field("doc_id"), pa.array(np.diff(ends)), pa.array(out, pa.string()), pa.array(text, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return t.encoded(docs.select("doc_id", "text"), finish, T.StructType(fields))


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """digests() of every row of documents, by the installed 50k byte-level vocabulary. Null and empty texts have 0 tokens;
    repeated rows give repeated rows; an empty table gives none."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer(spark))
