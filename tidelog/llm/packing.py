"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document's ids, an end id added, are one piece if they fit a sequence; a longer document is cut into pieces of the
full length, the remainder first. Full pieces are sequences of their own. The others are packed by size, largest
first: each goes into the open sequence for which the sum of the squared counts of open sequences per remaining gap
becomes smallest, or into a new one when none has room.

Pieces are dealt to shards of about ``shard_pieces`` by a hash, and shards are packed independently, so the loop that
has to be sequential is bounded whatever the corpus is, and what a shard leaves open (its last few sequences) is a
vanishing part of it. Tokenising runs on Arrow batches; packing sees a piece's number and length only.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship_code, table

PIECES = "doc_id long, piece int, start long, length long, ids binary, row long"
#: Entries of a worker's table of chunks and their ids; it starts anew beyond that.
MEMO = 300_000


class FastIds:
    """Ids of texts by a byte-level BPE tokenizer, as little-endian unsigned 32-bit bytes.

    Such a tokenizer first cuts a text into chunks, and never joins characters across a single space or a single line
    end between two characters that aren't white space; the space goes to the chunk on its right. So the parts of a
    text between such places have ids of their own, and parts seen before need no second encoding. Texts in which
    white space meets white space are cut at the remaining safe places only. ``ranks_path`` may name the same
    vocabulary as ranks, with which new parts are encoded faster; it is used only if it gives a probe the same ids.
    """

    _safe = re.compile(r"(?<=\S) (?=\S)")
    _probe = "The 1st of these isn't odd, and nor is ünï, \u4e2d\u6587  or\t--- <|endoftext|>\n\n end"

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.encode, self.encode_word = self.slow, self.slow
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if self.bytes_of(own.encode_ordinary(self._probe)) == self.slow(self._probe):
                self.encode = lambda text: self.bytes_of(own.encode_ordinary(text))
                self.encode_word = lambda text: self.bytes_of(own._core_bpe.encode_single_piece(text.encode()))
        self.first, self.later = Memo("", self), Memo(" ", self)
        self.ends = {x: self.encode(x) for x in ",."}
        self.line_end = self.encode("\n")

    @staticmethod
    def bytes_of(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def slow(self, text: str) -> bytes:
        return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _join(self, parts: list[str]) -> bytes:
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        for line in text.split("\n"):
            parts = line.split()
            if not parts or " ".join(parts) != line:  # white space at an edge, twice, or of another kind
                return self._join(self._safe.split(text))
            out.append(self._join(parts))
        return self.line_end.join(out)


class Memo(dict):
    """Ids of parts seen, with or without the space before them."""

    def __init__(self, prefix: str, ids: FastIds) -> None:
        self.prefix, self.ids = prefix, ids

    def __missing__(self, part: str) -> bytes:
        if part[-1:] in self.ids.ends and part[:-1].isalpha():
            out = self[part[:-1]] + self.ids.ends[part[-1]]
        elif part.isalpha():
            out = self.ids.encode_word(self.prefix + part)
        else:
            out = self.ids.encode(self.prefix + part)
        if len(part) < 64:
            if len(self) >= MEMO:
                self.clear()
            self[part] = out
        return out


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    return [n] if n <= size else [n % size] * (n % size > 0) + [size] * (n // size)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids, row) of docs (doc_id, text): ids are little-endian unsigned 32-bit numbers.

    A null or empty text has the end id alone. row numbers the rows of an input partition, which tells repeated rows
    apart. doc_id may be null or repeat. Other columns aren't read; an empty table has no pieces.
    """
    ship_code(docs.sparkSession)
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fast, row = FastIds(tokenizer_path, ranks_path), 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for doc_id, text in zip(batch.doc_id[at : at + 256], batch.text[at : at + 256], strict=True):
                    ids = fast(text or "") + tail
                    start = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, size)):
                        out.append((doc_id, k, start, n, ids[4 * start : 4 * (start + n)], row))
                        start += n
                    row += 1
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids", "row"])
                yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, all below size; lengths are taken largest first.

    For an open sequence with gap g the sum of squares changes by 2 * (count[g - n] - count[g]) + 2 on moving one from
    gap g to gap g - n, and by 1 - 2 * count[g] on filling it, as full ones don't count.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(size + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    far = np.iinfo(np.int64).max
    for i in order:
        n = int(lengths[i])
        have = count[n:size]
        cost = 2 * (count[: size - n] - have)
        cost[0] -= 1  # of what is common to all changes, 2, a filled sequence saves 1
        cost[have == 0] = far
        k = int(cost.argmin()) if size > n else 0
        if size > n and have[k]:
            gap = n + k
            s = stacks[gap].pop()
            count[gap] -= 1
        else:
            s, gap = used, size
            used += 1
        where[i], offset[i] = s, size - gap
        if gap > n:
            stacks[gap - n].append(s)
            count[gap - n] += 1
    return where, offset


def place_pieces(pieces: DataFrame, *, size: int = 1024, shard_pieces: int = 65536, keys: tuple[str, ...] = ("doc_id", "row", "piece")) -> DataFrame:
    """keys and length of pieces (keys, length), with sequence_id and offset added.

    pieces must not change between reads (a written table). Every length from 1 to size is allowed; rows are told
    apart by their keys only for the dealing, so repeats are harmless. Sequence ids are unique, not dense.
    """
    n = pieces.where(F.col("length") < size).count()
    shards = max(1, -(-n // shard_pieces))
    rows = pieces.select(*keys, "length").withColumn("_shard", F.when(F.col("length") < size, F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(shards))))
    full = rows.where("_shard IS NULL").select(*keys, "length", (F.monotonically_increasing_id() + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *keys], ascending=False, kind="stable")
        where, offset = sum_of_squares(pdf.length.to_numpy(np.int64), size)
        return pdf.drop(columns="_shard").assign(sequence_id=where * shards + int(pdf._shard.iloc[0]), offset=offset)

    short = rows.where("_shard IS NOT NULL").groupBy("_shard").applyInPandas(run, full.schema)
    return full.unionByName(short)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, size: int = 1024, end_id: int = 2, shard_pieces: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(pieces, places) of docs: pieces as tokenised_pieces has them, in a written table with a number ``part`` for the
    input partition, and places with part, row, doc_id, piece, sequence_id and offset."""
    pieces = cut(tokenised_pieces(docs, tokenizer_path, ranks_path=ranks_path, size=size, end_id=end_id).withColumn("part", F.spark_partition_id()), "pack-pieces")
    return pieces, place_pieces(pieces, size=size, shard_pieces=shard_pieces, keys=("doc_id", "part", "row", "piece"))


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of whole packed sequences, their pieces in order of offset."""
    keys = ["part", "row", "piece"]
    both = pieces.drop("doc_id", "length").join(places.drop("length"), keys)
    got = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return got.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def pack_rows(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces, places = pack_documents(docs, tokenizer_path, **options)
    keys = ["part", "row", "piece"]
    digests = pieces.select(*keys, "start", F.crc32("ids").alias("ids_crc32"))
    return places.join(digests, keys).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_rows(table(spark, sf_dir, "documents"), tokenizer_file(), ranks_path=tokenizer_file("byte_bpe_50k.tiktoken"))
