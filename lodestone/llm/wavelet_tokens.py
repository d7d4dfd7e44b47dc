"""Token ids as a wavelet matrix per shard.

Texts are encoded with a byte-level BPE from the tokenizers library, an end id is appended to each
document, and ids are written in ascending doc_id order. A shard file holds the distinct ids of the
shard, the length of each document, and one bit-plane for each bit of a rank among those ids; every
plane is cut into blocks that are compressed on their own, with the ones before each block stored
beside it. Access, counting and lookup of occurrences read the blocks they need.

    magic "WVM1", u32 header length, JSON header (n, planes, zeros, sections), sections

Executors write shards to the shared folder under a temporary name and rename them, so a task that
runs twice leaves the same file; the manifest that lists the shards is committed by Spark.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, table

MAGIC, END_ID = b"WVM1", 0
SHARD_TOKENS = 1 << 21
BLOCK_BITS = 1 << 16
#: Pieces whose ids a worker remembers; beyond it, those used in the fewest batches are forgotten.
REMEMBER = 300_000
#: Bytes of text that a worker encodes at a time.
AT_ONCE = 4 << 20

# Encoding -------------------------------------------------------------------------------------

#: White space other than single blanks and line ends, and special tokens: such texts go to the library whole.
_ODD = r"  |\n\n| \n |\n \n|(?: \n|\n )\z|<\|endoftext\|>|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that begin a piece of the pattern after a letter or digit (not the apostrophe, which may begin a contraction).
_MARKS, _BEFORE_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]\z"


class Encoder:
    """Ids of whole texts, the same as the library's.

    A blank before a non-blank and a single line end always begin a new piece of the byte-level
    pattern. So a batch of texts is cut there, each distinct piece is encoded once, many in one
    call, and remembered, and the ids of the batch are gathered from those of its pieces. Marks that
    end a piece after a letter or digit are a piece of the pattern too, and remembered on their own
    (with a blank before them, which no other piece has)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.break_id = self.library.encode("\n", add_special_tokens=False).ids[0]
        self.known: dict[str, int] = {}  # piece: its row in first, size and used_in
        self.pool, self.used = np.zeros(1 << 20, self.width), 0
        self.first, self.size, self.used_in = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        blank = np.array(self.library.encode(" ", add_special_tokens=False).ids, self.width)
        self._add([" ", ""], blank, np.array([0, len(blank)]))

    def _forget(self) -> None:
        """Keep at most half of ``REMEMBER`` pieces, those used in the most batches of late, and the two always there."""
        n = len(self.known)
        used, half = self.used_in[:n], max(0, REMEMBER // 2)
        least = max(2, int(np.partition(used, n - half)[n - half]) + 1 if 0 < half < n else 2)
        keep = used >= least
        keep[:2] = True
        rows = np.flatnonzero(keep)
        flat, sizes = self._gather(self.pool, self.first[rows], self.size[rows]), self.size[rows]
        self.known = dict(zip([p for p, k in zip(self.known, keep.tolist(), strict=True) if k], range(len(rows)), strict=True))
        self.pool[: len(flat)], self.used = flat, len(flat)
        self.first[: len(rows)], self.size[: len(rows)], self.used_in[: len(rows)] = np.cumsum(sizes) - sizes, sizes, used[rows] // 2
        self.used_in[len(rows) :] = 0

    @staticmethod
    def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The stretches of ``pool``, one after the other."""
        ends = np.cumsum(size, dtype=first.dtype)
        at = np.repeat(first - ends + size, size)
        at += np.arange(len(at), dtype=at.dtype)
        return pool[at]

    def _add(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        row = len(self.known)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while row + len(pieces) > len(self.first):
            self.first, self.size, self.used_in = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.used_in))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[row : row + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.size[row : row + len(pieces)] = sizes
        self.used += len(flat)
        self.known.update(zip(pieces, range(row, row + len(pieces)), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Pieces with a line end before them encode with it, the others with a blank."""
        for some, lead in (([p for p in pieces if p[0] != "\n"], " "), ([p for p in pieces if p[0] == "\n"], "")):
            texts = [lead + lead.join(some[i : i + 64]) for i in range(0, len(some), 64)]
            ids = [np.array(x.ids, self.width) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate([np.zeros(0, self.width), *ids])
            at = np.flatnonzero(self.opens[flat] if lead else flat == self.break_id)
            if len(at) == len(some):
                if len(some):
                    self._add(some, flat, np.diff(at, append=len(flat)))
            else:  # not with this pattern; then one by one
                ids = [np.array(self.library.encode(lead + p, add_special_tokens=False).ids, self.width) for p in some]
                self._add(some, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _learn_marks(self, marks: list[str]) -> None:
        """Marks, each with a blank before it that isn't encoded."""
        ids = [np.array(x.ids, self.width) for x in self.library.encode_batch_fast([m[1:] for m in marks], add_special_tokens=False)]
        self._add(marks, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Two rows for each distinct piece: without its last marks, and of these (none: the row of no ids)."""
        cut = pc.ascii_rtrim(pieces, _MARKS)
        marked = pc.and_(pc.less(pc.binary_length(cut), pc.binary_length(pieces)), pc.match_substring_regex(cut, _BEFORE_MARKS))
        stems = pc.if_else(marked, cut, pieces).to_numpy(zero_copy_only=False).tolist()
        marked = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        whole = pieces.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist()
        marks = [" " + p[len(stems[i]) :] for i, p in zip(marked.tolist(), whole, strict=True)]
        if new := [p for p in dict.fromkeys(stems) if p not in self.known]:
            self._learn(new)
        if new := [p for p in dict.fromkeys(marks) if p not in self.known]:
            self._learn_marks(new)
        rows = np.zeros((len(stems), 2), np.int64)
        rows[:, 0] = np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))
        rows[marked, 1] = np.fromiter(map(self.known.__getitem__, marks), np.int64, len(marks))
        self.used_in[np.unique(rows)] += 1
        return rows

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if len(self.known) > REMEMBER:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out = [np.zeros(0, self.width)] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, self.width)
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy() > 0))
        if not len(plain):
            return out
        some = texts if len(plain) == len(texts) else texts.take(pa.array(plain))
        no, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        cut = pc.split_pattern(pc.binary_join_element_wise(line, pc.replace_substring(some, "\n", " \n"), no), " ")
        pieces = pc.list_flatten(cut).dictionary_encode()
        rows = self._rows(pieces.dictionary)
        # ids of the batch's own distinct pieces, then of all its pieces
        kind = np.int32 if some.nbytes < 1 << 29 else np.int64
        pool, size = self._gather(self.pool, self.first[rows.ravel()], self.size[rows.ravel()]), self.size[rows].sum(axis=1).astype(kind)
        first, which = np.cumsum(size, dtype=kind) - size, pieces.indices.to_numpy()
        size = size[which]
        flat = self._gather(pool, first[which], size)
        stops = np.cumsum(size, dtype=kind)[cut.offsets.to_numpy()[1:] - 1]
        for i, a, b in zip(plain.tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[i] = flat[a + 1 : b]  # without the line end put before the text
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# The file format ------------------------------------------------------------------------------


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file for the ids of consecutive documents."""
    there = np.zeros(int(ids.max(initial=0)) + 1, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there) if len(ids) else np.zeros(0, np.int64)
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    rank = np.zeros(len(there), np.uint16 if planes <= 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    cur = rank[ids]
    body, zeros, table_ = [], [], []
    at = 0

    def section(raw: bytes) -> list[int]:
        nonlocal at
        data = _squeeze(raw)
        body.append(data)
        at += len(data)
        return [at - len(data), len(data)]

    head = {
        "n": len(ids),
        "planes": planes,
        "alphabet": section(alphabet.astype("<u4").tobytes()),
        "docs": section(json.dumps(doc_ids).encode()),
        "lengths": section(lengths.astype("<u8").tobytes()),
    }
    for level in range(planes):
        one = (cur & (1 << (planes - 1 - level))) != 0
        before, blocks = 0, []
        for i in range(0, len(one), BLOCK_BITS):
            part = one[i : i + BLOCK_BITS]
            blocks.append([before, *section(np.packbits(part, bitorder="little").tobytes())])
            before += int(np.count_nonzero(part))
        table_.append(blocks)
        zeros.append(len(one) - before)
        cur = np.concatenate([cur[np.flatnonzero(~one)], cur[np.flatnonzero(one)]])  # places first: several times faster than a mask
    header = json.dumps(head | {"zeros": zeros, "blocks": table_}).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(body)


class WaveletMatrix:
    """Reader of one shard file; decompresses the blocks a question needs."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(raw[4:8], "little")
        self.head = json.loads(bytes(raw[8 : 8 + size]))
        self.raw, self.base = memoryview(raw), 8 + size
        self.n, self.planes, self.zeros = self.head["n"], self.head["planes"], self.head["zeros"]
        self.alphabet = np.frombuffer(self._section(*self.head["alphabet"]), "<u4")
        self.lengths = np.frombuffer(self._section(*self.head["lengths"]), "<u8").astype(np.int64)
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.raw[self.base + at : self.base + at + size])

    def doc_ids(self) -> list[int | None]:
        return json.loads(self._section(*self.head["docs"]))

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._cache:
            _, at, size = self.head["blocks"][level][k]
            bits = np.unpackbits(np.frombuffer(self._section(at, size), np.uint8), bitorder="little")
            self._cache[level, k] = bits[: min(BLOCK_BITS, self.n - k * BLOCK_BITS)]
        return self._cache[level, k]

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        if k == len(self.head["blocks"][level]):
            return self.n - self.zeros[level]
        return self.head["blocks"][level][k][0] + int(np.count_nonzero(self._block(level, k)[:rest]))

    def select(self, level: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) bit of this kind in a plane."""
        blocks = self.head["blocks"][level]
        ones = np.array([b[0] for b in blocks])
        before = ones if bit else np.arange(len(blocks)) * BLOCK_BITS - ones
        k = int(np.searchsorted(before, j, side="right")) - 1
        return k * BLOCK_BITS + int(np.flatnonzero(self._block(level, k) == bit)[j - int(before[k])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank = 0
        for level in range(self.planes):
            k, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(level, k)[rest])
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            rank = rank << 1 | bit
        return int(self.alphabet[rank])

    def _symbol(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _range(self, s: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.planes):
            x, y = self.rank1(level, a), self.rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if s >> (self.planes - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id among positions a..b-1."""
        s = self._symbol(token)
        if s is None:
            return 0
        x, y = self._range(s, a, self.n if b is None else b)
        return y - x

    def occurrence(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of an id."""
        s = self._symbol(token)
        lo, hi = self._range(s, 0, self.n) if s is not None else (0, 0)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for level in reversed(range(self.planes)):
            bit = s >> (self.planes - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, planes undone from the last to the first."""
        bits = []
        for level in range(self.planes):
            packed = b"".join(self._section(at, size) for _, at, size in self.head["blocks"][level])
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: self.n].view(bool))
        cur = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in reversed(range(self.planes)):
            one, z = bits[level], self.zeros[level]
            up = np.empty_like(cur)
            up[np.flatnonzero(~one)] = cur[:z]
            up[np.flatnonzero(one)] = cur[z:] | (1 << (self.planes - 1 - level))
            cur = up
        return self.alphabet[cur] if self.n else self.alphabet


# Spark ----------------------------------------------------------------------------------------


def _write(folder: str, path: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        own = encoder(path)
        end = np.array([END_ID], own.width)
        docs, lengths, held, tokens, shard = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, held, tokens, shard
            ids = np.concatenate(held)
            data = pack(docs, np.array(lengths, np.int64), ids)
            name = f"shard-{task.partitionId():06d}-{shard:05d}.wvm"
            part = f"{root}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(part) as out:
                out.write(data)
            fs.move(part, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([shard]), pa.array([name]), pa.array([len(docs)]), pa.array([tokens]), pa.array([len(data)])], ["part", "shard", "file", "n_docs", "n_tokens", "n_bytes"])
            docs, lengths, held, tokens, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            for some in slices(batch, most=AT_ONCE):
                found = own.encode(some.column("text"))
                for doc, ids in zip(some.column("doc_id").to_pylist(), found, strict=True):
                    docs.append(doc)
                    held += [ids, end]
                    lengths.append(len(ids) + 1)
                    tokens += lengths[-1]
                    if tokens >= shard_tokens:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """Write all documents as shard files; gives the folder and the manifest (part, shard, file, start, n_docs, n_tokens, n_bytes).

    Null and empty texts are the end id alone; a null doc_id comes first; rows equal in id are
    ordered by text, and repeated rows are all written; an empty table writes no shard."""
    spark = docs.sparkSession
    folder = new_path(spark, "shards")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_write(folder, tokenizer, shard_tokens), "part long, shard long, file string, n_docs long, n_tokens long, n_bytes long")
    written.write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one total for each partition, not for each shard, comes to the driver
    totals = sorted(map(tuple, manifest.groupBy("part").agg(F.sum("n_tokens")).collect()))
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    begun = spark.createDataFrame(starts, "part long, at long")
    return folder, manifest.join(begun, "part").withColumn("start", F.col("at") + before).drop("at")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = WaveletMatrix(f.read())
                data = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids(), pa.int64()), pa.array(begins + start), pa.array(shard.lengths), pa.array(crc, pa.int64()), pa.array([name] * len(crc))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    return run


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of each document, from the files the manifest lists."""
    spark = manifest.sparkSession
    files = manifest.select("file", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(*write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))
