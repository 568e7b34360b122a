"""Encoding of a corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packstrata.functions.arrow import slices
from packstrata.session import ship

#: Longer texts are encoded in parts of about this many characters.
PART = 1 << 16

#: Bytes of text whose ids are held together.
TEXT_BYTES = 1 << 20

#: White space as the tokenizer's pattern has it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Where white space follows anything else, the pattern always ends a piece: every alternative that takes
#: white space starts with it. Cutting there changes no id.
_SAFE = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")

#: The pattern's only look-ahead, and the cuts that make it needless: a run of white space before other
#: characters is a piece but for its last character. Without look-ahead the pattern needs no backtracking.
_AHEAD = r"\s+(?!\S)|"
_RUN = re.compile(f"([{_WS}]+)(?=[{_WS}][^{_WS}])")


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(ranks_path: str):  # noqa: ANN201
    """The tiktoken encoding of a local rank file, one per process."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if _AHEAD not in public_tokenizers.PATTERN:
        raise ValueError("the tokenizer's pattern has changed; the safe boundaries must be found anew")
    pattern = public_tokenizers.PATTERN.replace(_AHEAD, "")
    return tiktoken.Encoding("packstrata", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _ship_ranks(spark: SparkSession, ranks_path: str) -> None:
    """Send the rank file to the executors, which need not have it at the driver's path. Once a context and file."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_packstrata_ranks", set())
    if ranks_path not in sent:
        sc.addFile(ranks_path)
        sent.add(ranks_path)


def _here(ranks_path: str) -> str:
    """The rank file on this worker: the one that was sent along, else the path itself."""
    sent = SparkFiles.get(os.path.basename(ranks_path))
    return sent if os.path.exists(sent) else ranks_path


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts that encode to the ids of the whole, each ``size`` or a little more where it can be cut."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc) -> list[int]:  # noqa: ANN001
    """The ids of a text; strings that look like special tokens are ordinary text."""
    whole = [text] if len(text) <= PART else parts(text)
    pieces = [p for part in whole for p in _RUN.split(part)]
    if len(pieces) == 1:
        return enc.encode_ordinary(pieces[0])
    ids: list[int] = []
    for p in pieces:
        if p:
            ids += enc.encode_ordinary(p)
    return ids


def _encoded(batches: Iterator[pa.RecordBatch], ranks_path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    enc = tokenizer(_here(ranks_path))
    for batch in slices(batches, -1, TEXT_BYTES):
        *rest, texts = batch.columns
        ids = [None if t is None else encode(t, enc) for t in texts.to_pylist()]
        if not keep:
            out = pa.array([None if x is None else len(x) for x in ids], pa.int64())
        else:
            out = pa.array(ids, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*rest, out], names=[*batch.schema.names[:-1], "ids" if keep else "n_tokens"])


def token_ids(documents: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """``key`` and ``ids``, the token ids of every text (or n_tokens, their number, without ``keep``).

    An empty text has an empty list, a null text null. Texts are encoded whole;
    long ones in parts cut where the tokenizer's own pattern always cuts. A map
    without shuffle: rows may repeat, other columns are not read.
    """
    ship(documents.sparkSession)
    _ship_ranks(documents.sparkSession, ranks_path)
    kind = documents.schema[key].dataType.simpleString()
    out = f"{key} {kind}, " + ("ids array<int>" if keep else "n_tokens long")
    return documents.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(lambda b: _encoded(b, ranks_path, keep), out)


def _decoded(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    enc = tokenizer(_here(ranks_path))
    for batch in batches:
        raw = pa.array([None if x is None else enc.decode_bytes(x) for x in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=[batch.schema.names[0], "bytes"])


def token_bytes(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``bytes``: the raw bytes that ids stand for, which need not end at character borders."""
    ship(encoded.sparkSession)
    _ship_ranks(encoded.sparkSession, ranks_path)
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(lambda b: _decoded(b, ranks_path), f"{key} {kind}, bytes binary")
