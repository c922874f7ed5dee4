"""Token-ID output: a file of coded blocks of ids in ascending id order, and its reader.

The file is a Parquet dataset whose rows are records of ``token_coder``, with the ids and
lengths of the documents in each: ``part`` and ``seq`` give the order, ``before`` the
number of ids of its part before it. Spark's committer writes it, so a lost executor leaves no half
files, and it can be in any store. Documents are range-partitioned by identifier; a
record ends with a document.

Defined cases: null text counts as empty and has just the end id; null document ids come
first, and rows with equal ids are ordered by a hash of their text, so repeated rows stay
beside each other; extra columns play no part, whatever their names; an empty table gives an
empty file and result; texts have no length limit.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm.bpe_codec import byte_signs
from folioforge.llm.common import column, cut, text_or_empty
from folioforge.llm.token_coder import decode, encode

#: Ids of a record, as far as documents allow, and the id that ends a document.
RECORD_IDS, END_ID = 1 << 21, 1
#: Rows that are tokenised at once, and the longest piece that is plain.
ROWS_AT_ONCE, PLAIN_SIGNS = 2048, 512
#: Settings of a tokenizer file that ``WordEncoder`` knows to take pieces between white space apart (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
#: The pre-tokens of lower-case pieces of plain signs, one piece a line; and a sign that is not plain.
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_NOT_PLAIN = re.compile("[^\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: Marks the end of a pre-token; no plain sign.
_END = "\0"


class WordEncoder:
    """Ids of texts for a tokenizer file, whole batches at a time.

    For a file with the settings above no token or normalisation reaches across ASCII white space, so
    a text's ids are those of its pieces in turn. The distinct pieces of a batch are encoded once: plain
    ones all together by tiktoken's core, whose ranks are the file's own merges with the end of a word as
    one more byte, and all others by the tokenizers library. With a file of other settings, whole
    texts go to the library.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self.size = max(self._tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1)
        self._core = self._core_of(path)
        self._line = self._core("\n" + _END)[0] if self._core else None

    def _core_of(self, path: str):
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model = own["model"]
        if own["normalizer"] != _NORMALIZER or own["pre_tokenizer"] != _PRE_TOKENIZER or any(model.get(k) != x for k, x in _MODEL.items()) or any(" " in x for x in self._special):
            return None
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = all(vocab[a.removesuffix("</w>") + b if a.endswith("</w>") else a + b] == 512 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 512 + len(merges)
        if not in_order or any(a.endswith("</w>") for a, _ in merges):
            return None
        of_sign = {s: b for b, s in byte_signs().items()}
        ranks = {bytes(map(of_sign.__getitem__, t.removesuffix("</w>"))) + _END.encode() * t.endswith("</w>"): i for t, i in vocab.items()}
        return tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _plain(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lines in turn, and the number of ids of each."""
        found = np.array(self._core(_END.join(_PARTS.findall(lines.lower())) + _END), np.uint32)
        breaks = np.flatnonzero(found == self._line)
        sizes = np.diff(np.concatenate([[-1], breaks, [len(found)]])) - 1
        return np.delete(found, breaks), sizes

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in turn, and the number of ids of each."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "\n")[0].as_py()
        if pc.max(pc.utf8_length(pieces)).as_py() <= PLAIN_SIGNS and not _NOT_PLAIN.search(lines) and not self._may_be_special(lines):
            return self._plain(lines)
        own = pieces.to_pylist()
        is_plain = [0 < len(p) <= PLAIN_SIGNS and not _NOT_PLAIN.search(p) and not self._may_be_special(p) for p in own]
        made: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(own)
        if any(is_plain):
            ids, sizes = self._plain("\n".join([p for p, x in zip(own, is_plain, strict=True) if x]))
            parts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            made = [next(parts) if x else y for x, y in zip(is_plain, made, strict=True)]
        others = [k for k, x in enumerate(is_plain) if not x and own[k]]
        for k, found in zip(others, self._tokenizer.encode_batch_fast([own[k] for k in others], add_special_tokens=False), strict=True):
            made[k] = np.array(found.ids, np.uint32)
        return np.concatenate(made), np.array([len(x) for x in made], np.int64)

    def _may_be_special(self, text: str) -> bool:
        return "<|" in text and any(s in text for s in self._special)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the number of ids of each text."""
        if self._core is None:
            found = [e.ids for e in self._tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        pieces = pc.ascii_split_whitespace(texts)
        coded = pieces.flatten().dictionary_encode()
        all_ids, sizes = self._of_pieces(coded.dictionary)
        at = coded.indices.to_numpy()
        own = sizes[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = all_ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], own) + np.arange(ends[-1])]
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy())])
        return ids, np.diff(ends[words])

    def encode(self, text: str) -> bytes:
        """The ids of one text as native unsigned 32-bit integers."""
        return self.encode_texts(pa.array([text], pa.string()))[0].tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``; its memo lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_FILE = "part int, seq int, before long, doc_ids array<long>, lengths array<long>, payload binary"
_FILE_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def _write(path: str, end_id: int, record_ids: int):
    def ended(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids with an end id after each text."""
        out = np.full(len(ids) + len(sizes), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[list] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def record() -> pa.RecordBatch:
            payload = encode(np.concatenate(held), own.size)
            values = (part, seq, before, [x for some in doc_ids for x in some], np.concatenate(lengths).tolist(), payload)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _FILE_ARROW, strict=True)], schema=_FILE_ARROW)

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(first, ROWS_AT_ONCE)
                ids, sizes = own.encode_texts(rows.column(1))
                ids, sizes, names = ended(ids, sizes), sizes + 1, rows.column(0).to_pylist()
                ends, lo = np.cumsum(sizes), 0
                while lo < len(names):
                    begin = int(ends[lo] - sizes[lo])
                    hi = min(len(names), int(np.searchsorted(ends, begin + record_ids - size)) + 1)
                    doc_ids.append(names[lo:hi])
                    lengths.append(sizes[lo:hi])
                    held.append(ids[begin : ends[hi - 1]])
                    size += int(ends[hi - 1]) - begin
                    lo = hi
                    if size >= record_ids:
                        yield record()
                        seq, before = seq + 1, before + size
                        doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield record()

    return run


def coded_records(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, record_ids: int = RECORD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the file, to be written where the caller wants it."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("sign", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "sign").sortWithinPartitions("doc_id", "sign").select("doc_id", "text")
    return ordered.mapInArrow(_write(tokenizer_path, end_id, record_ids), _FILE)


def write_token_file(docs: DataFrame, tokenizer_path: str, target: str, **options) -> None:
    """Write the file to ``target``, any path that Spark can write."""
    coded_records(docs, tokenizer_path, **options).write.mode("errorifexists").parquet(target)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file."""
    return spark.read.schema(_FILE).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, before, payload = (batch.column(k)[row].as_py() for k in (0, 1, 4))
            doc_ids, lengths = (batch.column(k)[row].values for k in (2, 3))
            ids, sizes = decode(payload), lengths.to_numpy()
            begins = np.cumsum(sizes) - sizes
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
            n = len(crcs)
            columns = [pa.array(np.full(n, part, np.int32)), doc_ids, pa.array(begins + before), lengths, pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])


def documents_of(file: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, from decoded records."""
    read = file.select("part", "before", "doc_ids", "lengths", "payload").mapInArrow(_read, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    # One row a part, so the window and the broadcast are as small as the number of partitions.
    sizes = file.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return read.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the file to the shared folder, read it back, and give each document's digest."""
    return documents_of(cut(coded_records(docs, tokenizer_path, **options), "token-file"))
