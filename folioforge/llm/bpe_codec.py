"""BPE encoding and decoding with the ids of the tokenizers library.

The merges of the byte-level tokenizer file are run by tiktoken's core, which takes
ranks of byte strings; a file whose ids are not in merge order is encoded by the
tokenizers library itself, and so are texts with signs beyond the Latin letters,
whose classes may differ between the libraries' Unicode tables.

A part of a text that stays unsplit over ``LONG`` bytes is encoded by tree
concatenation: its leaves are encoded apart, then neighbours are joined level by
level. At each join a window around the seam is encoded anew and grows until its
outer tokens on both sides are the ones that were there; BPE never changes what
lies beyond two such tokens, so the joined ids are those of the whole. Leaves and
the seams of a level do not depend on each other and go through a thread pool;
tiktoken's core releases the interpreter's lock.

Defined cases: null text counts as empty and gives no ids; null ids stay null; rows are
independent, so ties, repeated rows and extra columns play no part, and an empty table gives an
empty result; texts have no length limit. Where a result's column has a name that the input has
already, it gets underscores before it.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from folioforge.llm.common import column, free_name, text_or_empty

#: Bytes of the longest unsplit part that is encoded in one go, and of a leaf.
LONG, LEAF = 512, 256
#: Tokens on either side of a seam in the first window; doubled until both sides agree.
WINDOW = 4
THREADS = 2
#: Rows whose ids are held at once where ids are returned.
ROWS_AT_ONCE = 256
#: The split pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The last sign of Latin Extended-B.
_LATIN = "\u024f"
_LONG_SPACE = re.compile(r"\s{%d}" % LONG)


def byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TreeEncoder:
    """Ids of an unsplit byte string, by joining the ids of its halves.

    ``encode_part`` gives the ids of a short byte string, ``token_bytes`` the bytes of an id.
    """

    def __init__(self, encode_part, token_bytes, leaf: int = LEAF, window: int = WINDOW) -> None:
        self._encode_part, self._token_bytes = encode_part, token_bytes
        self._leaf, self._window = leaf, window

    def encode(self, part: bytes) -> list[int]:
        """Leaves first, all at once; then all seams of a level at once."""
        if len(part) <= self._leaf:
            return self._encode_part(part)
        with ThreadPoolExecutor(THREADS) as pool:
            ids = list(pool.map(self._encode_part, [part[i : i + self._leaf] for i in range(0, len(part), self._leaf)]))
            while len(ids) > 1:
                joined = list(pool.map(self.join, ids[::2], ids[1::2]))
                ids = joined + ids[2 * len(joined) :]
        return ids[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the two strings' concatenation."""
        width = self._window
        while True:
            middle = self._encode_part(b"".join([self._token_bytes[i] for i in left[-width:] + right[:width]]))
            agrees_left = width >= len(left) or middle[0] == left[-width]
            agrees_right = width >= len(right) or middle[-1] == right[width - 1]
            if agrees_left and agrees_right:
                return left[:-width] + middle + right[width:]
            width *= 2


class Codec:
    """Encodes and decodes as the byte-level tokenizer in ``path`` does."""

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special_ids = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self._special_ids, key=len, reverse=True))) + ")") if self._special_ids else None
        of_sign = {s: b for b, s in byte_signs().items()}
        of_token = {token: bytes(of_sign[s] for s in token) for token in self._tokenizer.get_vocab(with_added_tokens=False) if token not in self._special_ids}
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        ranks = {own: vocab[token] for token, own in of_token.items()}
        self._bytes = {i: own for own, i in ranks.items()} | {i: t.encode() for t, i in self._special_ids.items()}
        self._decimal = {i: str(i).encode() for i in self._bytes}
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        in_order = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs)) and len(ranks) == 256 + len(pairs)
        self._core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self._tree = TreeEncoder(self._encode_part, self._bytes)

    def _encode_part(self, part: bytes) -> list[int]:
        if self._core is not None:
            return self._core._core_bpe.encode_single_piece(part)
        signs = byte_signs()
        return [t.id for t in self._tokenizer.model.tokenize("".join(signs[b] for b in part))]

    @staticmethod
    def _may_be_long(text: str) -> bool:
        """Whether some part of the text may stay unsplit over LONG bytes."""
        if len(text.encode()) <= LONG:
            return False
        words = text.split()
        if 4 * max(map(len, words), default=0) + 4 > LONG and max([len(w.encode()) for w in words], default=0) + 1 > LONG:
            return True
        return len(text) - sum(map(len, words)) - len(words) >= LONG - 1 and _LONG_SPACE.search(text) is not None

    def _encode_long(self, text: str) -> list[int]:
        ids: list[int] = []
        of_sign = {s: b for b, s in byte_signs().items()}
        for signs, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text):
            ids.extend(self._tree.encode(bytes(map(of_sign.__getitem__, signs))))
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        if self._special is not None and self._special.search(text):
            ids: list[int] = []
            for part in self._special.split(text):
                ids.extend([self._special_ids[part]] if part in self._special_ids else self.encode(part) if part else [])
            return ids
        if self._may_be_long(text):
            return self._encode_long(text)
        if self._core is None or not text.isascii() and max(text) > _LATIN:
            return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self._core.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for."""
        return b"".join([self._bytes[i] for i in ids]).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, and of the decoded text."""
        ids = self.encode(text)
        return len(ids), hashlib.sha256(b",".join([self._decimal[i] for i in ids])).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for ``path``; it lives as long as the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            made = [own.digests(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_rows(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``token_ids`` and ``decodes``: whether the ids decode to the text."""
    named = [free_name(docs, x) for x in ("token_ids", "decodes")]
    schema = T.StructType([*docs.schema.fields, T.StructField(named[0], T.ArrayType(T.IntegerType())), T.StructField(named[1], T.BooleanType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                flat, ends, right = array("i"), array("i", [0]), []
                for text in batch.column(at):
                    text = text.as_py() or ""
                    ids = own.encode(text)
                    right.append(own.decode(ids) == text)
                    flat.extend(ids)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(right, pa.bool_())], names=[*batch.schema.names, *named])

    return docs.mapInArrow(run, schema)


def bpe_texts(encoded: DataFrame, tokenizer_path: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded_text``, the text that its ids stand for."""

    @F.pandas_udf("string")
    def decode(ids):
        own = codec(tokenizer_path)
        return ids.map(lambda x: None if x is None else own.decode(list(x)))

    return encoded.select("*", decode(column(ids_col)).alias(free_name(encoded, "decoded_text")))
