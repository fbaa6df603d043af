"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, only where the splitting pattern has a token boundary whatever
stands around: between a character that isn't white space and a blank or line feed. A very long
run of white space is one match of the pattern (less its last character, if text follows); it goes
to the merge routine directly, since the pattern engine has a bounded stack.

Defined cases: a null text counts as empty; an empty text has no ids; ids and decoded bytes are
those of the whole text; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import map_arrow

#: Texts of up to so many characters are encoded in one call.
CHUNK = 1 << 17
#: White-space runs of this length go around the pattern engine.
LONG_RUN = 1 << 15

# White space as the pattern's engine has it: the Unicode property White_Space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(rank_file: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _chunks(text: str):
    at = 0
    while len(text) - at > CHUNK:
        m = _SAFE.search(text, at + CHUNK)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def encode(text: str | None, rank_file: str) -> np.ndarray:
    """The ids of the whole text as little-endian uint32."""
    if not text:
        return np.empty(0, "<u4")
    enc, parts = encoding(rank_file), []
    if len(text) <= CHUNK:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    at = 0
    for m in _RUN.finditer(text):
        piece_end = m.end() if m.end() == len(text) else m.end() - 1
        parts += [enc.encode_to_numpy(c, disallowed_special=()) for c in _chunks(text[at : m.start()]) if c]
        parts.append(np.array(enc._core_bpe.encode_single_piece(text[m.start() : piece_end].encode()), "<u4"))
        at = piece_end
    parts += [enc.encode_to_numpy(c, disallowed_special=()) for c in _chunks(text[at:]) if c]
    return np.concatenate(parts).astype("<u4", copy=False) if parts else np.empty(0, "<u4")


def decode(ids: np.ndarray, rank_file: str) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8 when ids are part of a text's."""
    return encoding(rank_file).decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int; left out unless with_ids), ids_sha256, decoded_sha256
    for each row of docs (doc_id, text); a row of output for each of input, repeats included."""
    rank_file = rank_file or default_ranks()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, sha, back = [], [], [], []
        for text in b.column("text").to_pylist():
            x = encode(text, rank_file)
            n.append(len(x))
            sha.append(hashlib.sha256(x.tobytes()).hexdigest())
            back.append(hashlib.sha256(decode(x, rank_file)).hexdigest())
            if with_ids:
                ids.append(x.astype(np.int32))
        out = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64())}
        if with_ids:
            out["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out | {"ids_sha256": sha, "decoded_sha256": back})

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(slim, run, "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")


def decode_tokens(tokens: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id and raw (binary) of rows doc_id, ids; null ids give null. An id outside the
    vocabulary is an error of the library and is not hidden."""
    rank_file = rank_file or default_ranks()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = [None if x is None else decode(np.asarray(x, np.uint32), rank_file) for x in b.column("ids").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "raw": pa.array(raw, pa.binary())})

    return map_arrow(tokens.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, raw binary")
