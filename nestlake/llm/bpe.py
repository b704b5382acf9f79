"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

The vocabulary is a rank file (base64 token, rank). The merge list that the library
wants follows from the ranks: the merge that makes a token is the pair left over when
its bytes are merged with lower ranks only. Bytes become printable characters by the
usual byte-to-character table; decoding reverses that table and joins bytes *before*
it decodes UTF-8, so a character that two tokens share comes back whole.

Defined results: a null text counts as empty and gives no tokens; special-token
strings in a text are ordinary text; a very long text is encoded whole; repeated rows
give repeated results, so ties cannot arise; a row without doc_id is kept; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
#: Characters handed to the library at once; its results take some 200 bytes a token.
CHUNK_CHARS = 200_000


def byte_table() -> list[str]:
    """Character for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in kept else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merges in rank order."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            near = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            lowest = min(near)
            if lowest >= rank:
                raise ValueError(f"token {rank} cannot be merged from lower ranks")
            at = near.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_table()
        name = lambda token: "".join(chars[b] for b in token)
        model = models.BPE(
            vocab={name(t): r for t, r in ranks.items()},
            merges=[(name(a), name(b)) for a, b in merge_pairs(ranks)],
        )
        self.tokenizer = Tokenizer(model)
        own_split = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        if pattern != BYTE_LEVEL_PATTERN:
            own_split = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.Split(Regex(pattern), "isolated"),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False),
                ]
            )
        self.tokenizer.pre_tokenizer = own_split
        back = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in name(token))
        self.decimal = [str(i) for i in range(size)]
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, texts: list[str], offsets: bool = False) -> Iterator:
        """Encodings in order, made over chunks of bounded size."""
        run = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        start, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= CHUNK_CHARS or i + 1 == len(texts):
                yield from run(texts[start : i + 1], add_special_tokens=False)
                start, held = i + 1, 0

    def ends(self, ids: list[int]) -> np.ndarray:
        """Offset in bytes behind each token: tokens cover the text's bytes without a gap."""
        return self.size_of[np.array(ids, np.int64)].cumsum()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of any run of ids; a character cut at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


#: The pattern that the library has built in; a fixed value.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def vocabulary(name: str = RANKS) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids, char_start, char_end: tokens with offsets into the text's characters."""
    common.arrow_rows(df.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(ranks))
        for batch in batches:
            ids, lo, hi = [], [], []
            for e in c.encode(texts_of(batch.column(1)), offsets=True):
                ids.append(e.ids)
                lo.append([a for a, _ in e.offsets])
                hi.append([b for _, b in e.offsets])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, ints), pa.array(lo, ints), pa.array(hi, ints)],
                ["doc_id", "ids", "char_start", "char_end"],
            )

    return df.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, char_start array<int>, char_end array<int>"
    )


def decode(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, decoded (bytes), text: the reverse of ``encode``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(ranks))
        for batch in batches:
            raw = [c.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in raw])],
                ["doc_id", "decoded", "text"],
            )

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary, text string")


def digests(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256, n_split in one pass.

    offsets_sha256 is over the byte offsets behind the tokens (little-endian, 8 bytes each),
    n_split counts those inside a character, whose parts only decode together. No shuffle;
    ids stay inside the batch that made them.
    """
    common.arrow_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(ranks))
        for batch in batches:
            n, ids_hash, text_hash, ends_hash, split = [], [], [], [], []
            for e in c.encode(texts_of(batch.column(1))):
                ids = e.ids
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join([c.decimal[i] for i in ids]).encode()).hexdigest())
                raw, ends = c.decode_bytes(ids), c.ends(ids)
                text_hash.append(hashlib.sha256(raw).hexdigest())
                ends_hash.append(hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest())
                split.append(int(((np.frombuffer(raw, np.uint8)[ends[:-1]] & 0xC0) == 0x80).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()),
                    pa.array(ends_hash, pa.string()), pa.array(split, pa.int64()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"],
            )
        common.release_memory()

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long"
    )


def tokenised(df: DataFrame, ranks: str = RANKS) -> DataFrame:
    """df's columns but text and n_chars, in df's order, with ids, n_tokens, ids_sha256, decoded_sha256.

    Input columns of these four names are replaced.
    """
    common.arrow_rows(df.sparkSession, 200)
    kept = [c for c in df.columns if c.lower() not in ("text", "n_chars", "ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    fields = [f for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*vocabulary(ranks))
        for batch in batches:
            ids = [e.ids for e in c.encode(texts_of(batch.column(len(kept))))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(kept)],
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(" ".join([c.decimal[j] for j in i]).encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode_bytes(i)).hexdigest() for i in ids], pa.string()),
                ],
                [*kept, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        common.release_memory()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*[F.col(f"`{c}`") for c in kept], "text").mapInArrow(run, f"{kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
