"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the tokenizer's vocabulary files; a parameter of every operator that measures texts.
TOKENIZER_DIR = os.environ.get("LOOMSEARCH_TOKENIZERS", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's texts are cut before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, built once in each process."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_counts(documents: DataFrame, keep: tuple[str, ...] = (), tokenizer_dir: str = TOKENIZER_DIR, file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, *keep, tokens): the size of every text; a null or empty text has 0 tokens.

    The vocabulary (under 1 MB) is read on the driver and broadcast, so executors need no copy of it.
    """
    with open(os.path.join(tokenizer_dir, file), "rb") as stream:
        vocabulary = documents.sparkSession.sparkContext.broadcast(stream.read())
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text)) if text else 0 for text in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    rows = documents.select(*names, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, tokens long")
