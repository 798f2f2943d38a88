"""Token counts for a word-level BPE tokenizer by the whole-token shortcut.

Offline, on the driver, each vocabulary string that could be a word is encoded alone by the
tokenizer library; those that give one token are the whole tokens. They go to the workers
together with the tokenizer file's content: both are bounded by the vocabulary. In a text, a
chunk between white space that is a whole token counts one; any other is split into pre-tokens,
each of which counts one if it is a whole token, and is merged by the library's model if not.
Counts of chunks are remembered up to MEMO of them for each worker.

The shortcut holds for characters whose white space, letter case, composition and class are
known to be the library's: SAFE. A text with any other character, or with an added token's
string, is encoded whole by the library, as is every text if the tokenizer isn't of this kind.
Texts are never cut.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows are each counted. A
column of documents named as a result is replaced.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkgraph.llm.common import flat, with_arrow

LIMIT = 2048
MEMO = 400_000
#: What the shortcut is made for. Fixed values of the tokenizer file's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_END = "</w>"
#: ASCII without control characters, Latin-1 and Latin Extended-A, dashes, quotes and dots.
UNSAFE = re.compile("[^\t-\r\x20-\x7e\xa0-ſ‐-‧]")
PRE_TOKEN = regex.compile(PATTERN)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


LETTERS = byte_letters()
BYTES = {c: b for b, c in enumerate(LETTERS)}


def is_plain(config: dict) -> bool:
    """Whether the tokenizer works as the shortcut assumes."""
    pre = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, last, model = pre[0], pre[-1], config["model"]
    return (
        (config.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and len(pre) == 2
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") and first.get("behavior") == "Removed"
        and last.get("type") == "ByteLevel" and not last.get("use_regex") and not last.get("add_prefix_space")
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("continuing_subword_prefix")
        and not model.get("dropout")
    )


def whole_tokens(content: str) -> set[str]:
    """The vocabulary's strings that, alone, the library encodes as one token."""
    from tokenizers import Tokenizer

    config, tokenizer = json.loads(content), Tokenizer.from_str(content)
    strings = []
    for entry in config["model"]["vocab"]:
        if entry.endswith(WORD_END):
            try:
                s = bytes(BYTES[c] for c in entry.removesuffix(WORD_END)).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if s and not UNSAFE.search(s) and s == s.lower() and PRE_TOKEN.fullmatch(s):
                strings.append(s)
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s for s, e in zip(strings, found) if len(e.ids) == 1}


class Counter(dict):
    """Chunk of a lower-cased text -> tokens."""

    def __init__(self, content: str, whole: set[str]):
        super().__init__()
        from tokenizers import Tokenizer

        config = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.model, self.whole = self.tokenizer.model, whole
        self.plain = is_plain(config)
        self.added = [t["content"] for t in config.get("added_tokens", [])]

    def __missing__(self, chunk: str) -> int:
        if chunk in self.whole:
            n = 1
        elif chunk.isalpha():  # one pre-token
            n = self._merged(chunk)
        elif len(chunk) > 1 and chunk[-1] in ",." and chunk[:-1].isalpha():  # two
            n = self[chunk[:-1]] + self[chunk[-1]]
        else:
            n = sum(1 if p in self.whole else self[p] if p.isalpha() else self._merged(p) for p in PRE_TOKEN.findall(chunk))
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = n
        return n

    def _merged(self, part: str) -> int:
        if not part.isascii():
            part = "".join([LETTERS[b] for b in part.encode()])
        return len(self.model.tokenize(part))

    def count(self, text: str) -> int:
        if not self.plain or any(s in text for s in self.added) or UNSAFE.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, text.lower().split()))


_HELD: list = [None, None]


def _counter(shared) -> Counter:
    if _HELD[0] is not shared.value:
        _HELD[:] = [shared.value, Counter(*shared.value)]
    return _HELD[1]


ADDED = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def count_tokens(docs: DataFrame, tokenizer_file: str, carry: list[str] | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """documents with n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read()
    whole = whole_tokens(content) if is_plain(json.loads(content)) else set()
    shared = docs.sparkSession.sparkContext.broadcast((content, whole))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        column, counter = batch.column(text), _counter(shared)
        _, at = flat(column)
        n = [counter.count(t.as_py()) if t.is_valid else 0 for t in column]
        return [pa.array(at[1:] - at[:-1]), pa.array(n, pa.int64())]

    kept = [c for c in (docs.columns if carry is None else carry) if c != "over_limit"]
    return with_arrow(docs, ADDED, work, kept, text).withColumn("over_limit", F.col("n_tokens") > limit)
