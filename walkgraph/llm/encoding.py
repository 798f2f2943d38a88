"""Token ids of whole texts by a rank file, two bytes an id, little-endian.

Texts are encoded whole by the library; strings of special tokens are ordinary text.

Defined cases: a null or empty text has no ids. Repeated rows have equal ids. A very long text is
encoded like any other, never in part."""

from __future__ import annotations

import base64
import sys
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from walkgraph.llm.common import with_arrow

#: The rank file of production.
RANKS = "byte_bpe_50k.tiktoken"
KIND = np.dtype("<u2")


class Ranks:
    """Ids of a vocabulary in a rank file; its content is what goes to the workers.

    `end` is the vocabulary's size, `padding` the largest id that two bytes hold."""

    padding = 65535

    def __init__(self, file: str, pattern: str):
        with open(file, "rb") as f:
            self.content = f.read()
        self.pattern, self.end, self._encode = pattern, self.content.count(b"\n"), None
        if self.end >= self.padding:
            raise ValueError("ids of this vocabulary don't fit in two bytes")

    def encode(self, texts: pa.Array) -> list[bytes]:
        if self._encode is None:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines())}
            self._encode = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        return [self._ids(t) if t else b"" for t in texts.to_pylist()]

    def _ids(self, text: str) -> bytes:
        ids = array("H", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __getstate__(self):
        return self.__dict__ | {"_encode": None}


def public_ranks(name: str = RANKS) -> Ranks:
    import public_tokenizers

    return Ranks(public_tokenizers.path(name), public_tokenizers.PATTERN)


def squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.decompress(data)


def with_ids(docs: DataFrame, ids: Ranks, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry`, `__ids` (the text's ids as bytes) and `__n`, their count."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found = ids.encode(batch.column(text))
        return [pa.array(found, pa.binary()), pa.array([len(x) // KIND.itemsize for x in found], pa.int64())]

    return with_arrow(docs, [T.StructField("__ids", T.BinaryType()), T.StructField("__n", T.LongType())], work, carry, text)
