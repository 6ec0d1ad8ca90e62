"""Operator 13: files of token ids, each document compressed by itself with a shared zstandard dictionary.

A folder holds one dictionary, trained on serialized id arrays, and files of at most FILE_BYTES (a longer document has
one of its own). A file is::

    header   magic, bytes of an id (2 or 4), sha256 of the dictionary
    frames   one zstandard frame a document, of its ids in little-endian order
    index    a record a document: key, whether it has one, place and size of its frame, its ids, ids before it in its part
    footer   place of the index, documents, magic

so a document is found by a search in the index and read by itself, short ones well compressed by what the dictionary
knows. A reader refuses a dictionary of another hash.

Documents are encoded and compressed where they are read; only frames are shuffled, by ranges of keys. Each range is a
part whose rows, in order, fill files; a file is written under a name of its attempt and then moved, so a lost task's
second attempt writes the same files again. What is summed over all parts is one number each.

Keys are whole numbers; null keys come first, and rows with equal keys stand in the order in which they were read. Null
and empty texts have only the end mark. Repeated rows have a frame each; an empty table gives an empty folder. Where
there are too few documents to train on, the dictionary is empty.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creasework.llm.common import settle, slices, small_side, table
from creasework.sources.shared import checkpoint_dir

MAGIC, HEADER, FOOTER = b"idfile01", struct.Struct("<8sQ32s"), struct.Struct("<QQ8s")
INDEX = np.dtype([("key", "<i8"), ("has_key", "<u8"), ("offset", "<u8"), ("size", "<u8"), ("ids", "<u8"), ("start", "<u8")])
#: Bytes of frames in a file, and in a part; bytes of the dictionary.
FILE_BYTES, PART_BYTES, DICTIONARY_BYTES = 8_000_000, 256_000_000, 65_536
#: What the dictionary is trained on: about so many different documents, chosen by a hash, so many characters of each.
SAMPLE, SAMPLE_CHARS = 1000, 4000
LEVEL = 3

# --- ids ---------------------------------------------------------------------------------------------------------


class ByteTokens:
    """Ids of a byte-level BPE, serialized.

    Its patterns never go on from other characters to white space, so a space with the word after it, and a line feed
    that stands alone, are encoded by themselves. The texts of a batch are cut in such units at once, each different one
    is looked up or encoded once, and the texts' ids are taken together. Texts with other white space, with two white
    spaces side by side, or with what may be a special token, go to the tokenizer whole.

    What was met lately is kept in two dictionaries of half of MEMORY: when the newer is full it becomes the older, and
    what is asked for again moves to the newer.
    """

    MEMORY = 240_000_000
    #: Code points (first, last) that are white space to some, beyond space and line feed.
    SPACES = ((0x09, 0x09), (0x0B, 0x0D), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
    WHOLE = r"  |\n\n| \n|\n |<\||[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SPACES) + "]"
    #: Stands between units; one of SPACES.
    MARK = chr(0x1F)
    #: The last letter of the Latin blocks; up to it, Python and the tokenizer agree on letters and digits.
    LATIN = chr(0x17F)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.fixed = {"": b"", **{u: self._encode(u) for u in (" ", "\n", ".", ",")}}
        self.new, self.old, self.bytes = dict(self.fixed), {}, 0

    def serialized(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _encode(self, text: str) -> bytes:
        return self.serialized(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode_all(self, units: list[str]) -> list[bytes]:
        """The ids of units without line feeds; encoded at once, with line feeds between them, which is quicker."""
        if self.feed is None or len(units) < 2:
            return list(map(self._encode, units))
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, self.kind)
        ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
        raw, w, at, out = ids.tobytes(), self.width, 0, []
        for e in ends:
            out.append(raw[at * w : e * w])
            at = e + 1
        return out

    def _stem(self, unit: str) -> str:
        """The unit without a full stop or comma after a letter or digit, which is encoded by itself."""
        return unit[:-1] if len(unit) > 2 and unit[-1] in ".," and unit[-2] <= self.LATIN and unit[-2].isalnum() else unit

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units that are not in the newer dictionary; short ones are remembered."""
        new, old, stems = self.new, self.old, {u: self._stem(u) for u in units}
        found = {s: new.get(s) or old.get(s) for s in stems.values()}
        unknown = [s for s, ids in found.items() if ids is None]
        found.update(zip(unknown, self._encode_all(unknown), strict=True))
        for s, ids in found.items():
            if len(s) < 64 and s not in new:
                new[s] = ids
                self.bytes += 200 + len(ids)
        for u, s in stems.items():
            if u is not s:
                found[u] = found[s] + self.fixed[u[-1]]
        return found

    def serialize(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; of a null one there are none."""
        if self.bytes > self.MEMORY // 2:
            self.old, self.new, self.bytes = self.new, dict(self.fixed), 0
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.WHOLE)
        rest = pc.if_else(whole, "", texts)
        marked = pc.replace_substring(pc.replace_substring(rest, " ", self.MARK + " "), "\n", f"{self.MARK}\n{self.MARK}")
        lists = pc.split_pattern(marked, self.MARK)
        units = lists.flatten().dictionary_encode()
        different = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.new.get, different))
        if None in got:
            learned = self._learn({u for u, g in zip(different, got, strict=True) if g is None})
            got = [learned[u] if g is None else g for u, g in zip(different, got, strict=True)]
        all_ids = pa.array(got, pa.large_binary()).take(units.indices)
        places = np.frombuffer(all_ids.buffers()[1], np.int64)[all_ids.offset : all_ids.offset + len(all_ids) + 1]
        ends = places[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        raw = all_ids.buffers()[2].to_pybytes() if all_ids.buffers()[2] else b""
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode(texts[i].as_py())
        return out


def by_size(texts: pa.Array, rows: int = 500, size: int = 4_000_000) -> Iterator[pa.Array]:
    """The texts in slices of so many rows, or of so many bytes if there is more than one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))))
        yield texts.slice(at, to - at)
        at = to


#: The worker's own, by path: what it has learned serves later tasks too.
_TOKENS: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path)
    return _TOKENS[path]


def train(docs: DataFrame, tokens: ByteTokens, end: bytes, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of documents; empty where there are too few."""
    import zstandard

    some = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit((1 << 40) * min(1.0, SAMPLE / max(1, docs.count())))
    few = docs.where("text <> ''").where(some).select(F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).dropDuplicates(["h"])
    samples = [ids + end for ids in tokens.serialize(pa.array([r["text"] for r in sorted(few.collect())], pa.string()))]
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 256:
        return b""
    return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()


def frames(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes) -> DataFrame:
    """(doc_id, row, n, frame): each document's ids with the end mark, compressed by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokens = byte_tokens(tokenizer)
        end = tokens.serialized([end_id])
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        for b in slices(batches):
            arrays = [ids + end for part in by_size(b.column(2)) for ids in tokens.serialize(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(a) // tokens.width for a in arrays], pa.int64()), pa.array(map(press.compress, arrays), pa.binary())], names=["doc_id", "row", "n", "frame"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, "doc_id long, row long, n long, frame binary")


# --- files -------------------------------------------------------------------------------------------------------


def file_bytes(records: list[tuple[int | None, int, bytes]], start: int, width: int, dictionary_hash: bytes) -> bytes:
    """A file of (key, ids, frame), start ids after its part's begin."""
    index = np.zeros(len(records), INDEX)
    index["key"], index["has_key"] = [k or 0 for k, _, _ in records], [k is not None for k, _, _ in records]
    index["size"], index["ids"] = [len(f) for _, _, f in records], [n for _, n, _ in records]
    index["offset"] = HEADER.size + np.cumsum(index["size"]) - index["size"]
    index["start"] = start + np.cumsum(index["ids"]) - index["ids"]
    body = b"".join([f for _, _, f in records])
    return b"".join([HEADER.pack(MAGIC, width, dictionary_hash), body, index.tobytes(), FOOTER.pack(HEADER.size + len(body), len(records), MAGIC)])


class IdFile:
    """A file of ids, open for reading: the index is read at once, documents one by one."""

    def __init__(self, file, dictionary: bytes):
        import zstandard

        self.file = file
        magic, self.width, known = HEADER.unpack(self._read(0, HEADER.size))
        size = file.seek(0, 2)
        at, n, mark = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or mark != MAGIC:
            raise ValueError("not a file of ids, or cut off")
        if known != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        self.index = np.frombuffer(self._read(at, n * INDEX.itemsize), INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, i: int) -> np.ndarray:
        """The ids of document number i of the file."""
        r = self.index[i]
        return np.frombuffer(self.unpack.decompress(self._read(int(r["offset"]), int(r["size"]))), f"<u{self.width}").astype("<u4")

    def of(self, key: int) -> list[np.ndarray]:
        """The ids of all documents of a key."""
        nulls = int(np.count_nonzero(self.index["has_key"] == 0))
        keys = self.index["key"][nulls:]
        return [self.ids(nulls + i) for i in range(*np.searchsorted(keys, [key, key + 1]).tolist())]


def _store(folder: str):
    """The file system and path of a folder; local, hdfs, s3, gs and abfs paths are known to Arrow."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(folder)


def fs_selector(path: str):
    """All files of a folder."""
    from pyarrow import fs

    return fs.FileSelector(path)


def _put(store, path: str, content: bytes) -> None:
    """Write a whole file: under a name of its own, then moved; a file that is there already is the same."""
    from pyarrow import fs

    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own) as out:
        out.write(content)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        store.move(own, path)
    else:
        store.delete_file(own)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents to a new folder, in ascending order of doc_id. Returns (part, start, ids) of its parts."""
    spark, tokens = docs.sparkSession, ByteTokens(tokenizer)
    dictionary = train(docs, tokens, tokens.serialized([end_id]))
    store, path = _store(folder)
    store.create_dir(path)
    _put(store, f"{path}/dictionary", dictionary)
    width, digest = tokens.width, hashlib.sha256(dictionary).digest()
    made = settle(frames(docs, tokenizer, end_id, dictionary), "frames")
    total = made.agg(F.sum(F.length("frame"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, (store, path) = TaskContext.get().partitionId(), _store(folder)
        records, held, start, number = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal records, held, start, number
            _put(store, f"{path}/{part:08d}-{number:06d}.ids", file_bytes(records, start, width, digest))
            n = sum(r[1] for r in records)
            done = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, number, len(records), n)], names=["part", "file", "docs", "ids"])
            start, number, records, held = start + n, number + 1, [], 0
            return done

        for b in batches:
            for record in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if records and held + len(record[2]) > FILE_BYTES:
                    yield flush()
                records.append(record)
                held += len(record[2])
        if records:
            yield flush()

    ordered = made.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    files = settle(ordered.select("doc_id", "n", "frame").mapInArrow(fill, "part long, file long, docs long, ids long"), "id_files")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    of_parts = files.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(before, F.lit(0)).alias("start"), "ids")
    of_parts.coalesce(1).write.parquet(f"{folder}/parts")
    return read_parts(spark, folder)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, start long, ids long").parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents of a folder; start: ids of all documents before it."""
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file = IdFile(pa.BufferReader(content.as_buffer()), dictionary)
                for a in range(0, len(file.index), 1000):
                    x = file.index[a : a + 1000]
                    ids = [file.ids(a + i) for i in range(len(x))]
                    columns = [pa.array([int(name)] * len(x), pa.int64()), pa.array(x["key"], mask=x["has_key"] == 0), pa.array(x["start"].astype(np.int64)), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
                    if with_ids:
                        columns.append(pa.array(ids, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start_", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    part = F.regexp_extract("path", r"(\d+)-\d+\.ids$", 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select(part.alias("part"), "content")
    got = found.mapInArrow(run, "part long, doc_id long, start_ long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    got = got.join(small_side(read_parts(spark, folder).select("part", "start")), "part")
    return got.select("doc_id", (F.col("start") + F.col("start_")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a folder of files and read back from it."""
    folder = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read(spark, folder)
