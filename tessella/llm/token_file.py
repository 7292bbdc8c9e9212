"""Token ids in bit-plane files.

A file is one range of documents in ascending order of id. Its ids are cut into chunks of CHUNK ids. A
chunk is transposed: plane b holds bit b of each id, packed, and is compressed with zstandard; planes
above the largest id aren't stored. The layout of a file:

    magic "BPLN1\\0\\0\\0" | planes ... | chunk index | documents | footer

The chunk index has for each chunk its number of ids, its number of planes, and for each plane its
place and length. ``documents`` is a zstandard frame with the number of ids of each document (uint64).
The footer has the place and length of the index and of the documents, the counts, and the magic again.
Any chunk can be read alone. Files are the binary column of a table in the shared folder, written and
committed by Spark: a repeated task leaves no half file, and no executor needs another's disk.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import release, shuffle_parts, slices, small_batches, written

CHUNK = 1 << 16
MAGIC = b"BPLN1\0\0\0"
FOOTER = struct.Struct("<QQQQQQ8s")
#: Ids of a file, about: a task begins a new file beyond it.
FILE_IDS = 1 << 21
#: Word pieces of a generation whose ids a worker keeps.
CACHE = 250_000
#: Bytes of text encoded at once, about.
SLICE = 2_000_000


def write_file(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """ids: uint32 of all documents; counts: ids of each document."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    out, at, index = [MAGIC], len(MAGIC), []
    for s in range(0, len(ids), CHUNK):
        c = ids[s : s + CHUNK]
        planes = max(1, int(c.max()).bit_length())
        index += [len(c), planes]
        for b in range(planes):
            z = pack(np.packbits(((c >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)).tobytes())
            index += [at, len(z)]
            out.append(z)
            at += len(z)
    head = np.array(index, "<u8").tobytes()
    docs = pack(counts.astype("<u8").tobytes())
    out += [head, docs, FOOTER.pack(at, len(head), at + len(head), len(docs), len(ids), len(counts), MAGIC)]
    return b"".join(out)


def read_chunks(file: bytes) -> Iterator[np.ndarray]:
    """The ids, chunk by chunk."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at, size, _, _, _, _, magic = FOOTER.unpack(file[-FOOTER.size :])
    if magic != MAGIC or file[: len(MAGIC)] != MAGIC:
        raise ValueError("not a bit-plane file")
    index, i = np.frombuffer(file, "<u8", size // 8, at).tolist(), 0
    while i < len(index):
        n, planes = index[i : i + 2]
        ids = np.zeros(n, np.uint32)
        for b in range(planes):
            p, z = index[i + 2 + 2 * b : i + 4 + 2 * b]
            ids |= np.unpackbits(np.frombuffer(unpack(file[p : p + z]), np.uint8), count=n).astype(np.uint32) << np.uint32(b)
        i += 2 + 2 * planes
        yield ids


def read_counts(file: bytes) -> np.ndarray:
    import zstandard

    _, _, at, size, _, n, _ = FOOTER.unpack(file[-FOOTER.size :])
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(file[at : at + size]), "<u8", n) if n else np.empty(0, "<u8")


def read_documents(file: bytes) -> Iterator[np.ndarray]:
    """The ids of each document, in order; holds one document and one chunk."""
    chunks = read_chunks(file)
    have = np.empty(0, np.uint32)
    for n in read_counts(file).tolist():
        parts = []
        while n:
            if not len(have):
                have = next(chunks)
            parts.append(have[:n])
            have = have[len(parts[-1]) :]
            n -= len(parts[-1])
        yield np.concatenate(parts) if parts else np.empty(0, np.uint32)


#: Sets a blank between a letter and the sentence marks that end a word: Latin letters that normalisation leaves single letters.
MARKS = (r"([a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([,.;:!?]+)(\s|$)", r"\1 \2\3")
#: The parts of a tokenizer file that let pieces between ASCII blanks be encoded one by one.
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


def piecewise(vocabulary: str) -> bool:
    """The tokenizer never joins over blanks, nor a word of letters with the sentence marks after it, and marks the ends of words."""
    with open(vocabulary, encoding="utf-8") as f:
        said = json.load(f)
    plain = not any(x["normalized"] or x["lstrip"] or x["rstrip"] or not x["content"].startswith("<|") or re.search(r"\s", x["content"]) for x in said["added_tokens"])
    return plain and said["model"].get("end_of_word_suffix") == "</w>" and all(said.get(k) == v for k, v in PIECEWISE.items())


class Encoder:
    """Ids by the tokenizer, with those of recent word pieces kept.

    If the tokenizer's file allows it (``piecewise``), texts are cut at ASCII blanks and between a Latin
    letter and the sentence marks after it, a batch's distinct pieces are looked up or encoded once, and the batch's ids are gathered from theirs. New words of
    letters alone are encoded many in one text: each ends with an id of a word end. ASCII letters are
    lower-cased first, as the tokenizer does, but for texts with combining marks or the beginning of a
    special token. Pieces are kept in two generations: when the young one is full it becomes the old
    one. Texts of any other tokenizer are encoded whole by the library.
    """

    def __init__(self, vocabulary: str):
        # One thread: a task has one core, and more threads keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.by_piece = piecewise(vocabulary)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        words = self.tok.get_vocab()
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for s in range(0, len(words), 5000):
            part = words[s : s + 5000]
            joined = [" ".join(part[i : i + 500]) for i in range(0, len(part), 500)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part):
                out += self._each(part)
                continue
            raw, at = ids.tobytes(), [0, *cuts.tolist()]
            out += [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        new = set(pieces).difference(young)
        kept = new.intersection(old)
        young.update((p, old[p]) for p in kept)
        new -= kept
        words = [p for p in new if p.isalpha() and (p.isascii() or p.lower().isalpha())]
        others = list(new.difference(words))
        young.update(zip(words, self._words(words), strict=True))
        young.update(zip(others, self._each(others), strict=True))
        return list(map(young.__getitem__, pieces))

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (strings), and the number of each text's."""
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, *MARKS))
        said = parts.flatten().dictionary_encode()
        place = said.indices.to_numpy()
        found = self._learn(said.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        edge = np.concatenate(([0], np.cumsum(size[place])))
        where = np.repeat(start[place] - edge[:-1], size[place]) + np.arange(edge[-1])
        bounds = edge[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return pool[where], np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes, none null) one after another, and the number of each text's ids."""
        try:
            said = texts.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            said = pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())
        if not self.by_piece:
            found = self._each(said.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        odd = np.array([b"<|" in x or b"\xcc" in x or b"\xcd" in x for x in texts.to_pylist()], bool)
        if not odd.any():
            return self._gather(pc.ascii_lower(said))
        (a, n), (b, m) = self._gather(pc.ascii_lower(said.filter(pa.array(~odd)))), self._gather(said.filter(pa.array(odd)))
        counts = np.empty(len(odd), np.int64)
        counts[~odd], counts[odd] = n, m
        of = np.repeat(odd, counts)
        ids = np.empty(len(of), np.uint32)
        ids[~of], ids[of] = a, b
        return ids, counts


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """A worker's encoder: the next task finds the pieces that earlier ones kept."""
    return Encoder(vocabulary)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of files: part, file (its place in part), before (ids of the part's files before it), doc_ids, n_ids, payload.

    Documents are range-sorted by id, rows of one id in the order of the table: one id with many rows is
    spread over parts. Null ids come first. A null text is an empty one: the end id alone. Repeated rows
    are rows of their own. Texts are whole: a long one is encoded in parts, cut at blanks, which gives
    the same ids. An empty table gives no files. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = (F.asc_nulls_first("doc_id"), F.asc("row"))
    rows = rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), np.uint32(end_id)
        part, number, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []

        def give() -> pa.RecordBatch:
            file = write_file(np.concatenate(ids), np.concatenate(counts))
            keys = pa.concat_arrays(names)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([size], pa.int64()), pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "file", "before", "doc_ids", "n_ids", "payload"])

        for b in batches:
            each, total = [], np.zeros(len(b), np.int64)
            for texts, places in slices(b.column("text"), SLICE):
                x, n = enc.encode(texts)
                each.append(x)
                np.add.at(total, places, n)
            out = np.full(int(total.sum()) + len(b), end, np.uint32)
            out[np.arange(int(total.sum())) + np.repeat(np.arange(len(b)), total)] = np.concatenate(each) if each else np.empty(0, np.uint32)
            ids.append(out)
            counts.append(total + 1)
            names.append(b.column("doc_id"))
            size += len(out)
            if size > FILE_IDS:
                yield give()
                number, before, size = number + 1, before + size, 0
                ids, counts, names = [], [], []
        if size:
            yield give()
            ids, counts, names = [], [], []
        release()

    return written(rows.mapInArrow(run, "part int, file int, before long, doc_ids array<long>, n_ids long, payload binary"), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of each document, read back from the files.

    Null ids and repeated rows come as they were written; no files give no rows. A task holds one file
    and one document.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at = row["first"]
                out: list[tuple] = []
                for k, ids in zip(row["doc_ids"], read_documents(row["payload"]), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    out.append((k, at, len(ids), zlib.crc32(raw), raw))
                    at += len(ids)
                    if len(out) == 1000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    placed = files.join(F.broadcast(first), "part").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digest(docs: DataFrame) -> DataFrame:
    return read_tokens(write_tokens(docs, vocabulary_path(), 1)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_file(spark, sf_dir: str) -> DataFrame:
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
