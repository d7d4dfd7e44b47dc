"""Language-model scoring by online logistic context mixing.

A text is a run of tokens (words, then an end). A token is coded bit by bit: whether it is new to the
corpus, then for a known one the 8 leading bits of its hash, for a new one the eight bits of each of
its letters. Each bit is predicted from several hashed contexts: for known words no context, the word
before, and the two words before; for letters the last 2, 4 and 6 of the word. The predictors' logits
are combined with weights picked by a gate (how often each context was seen, whether it ever went both
ways, how long the text has been following known triples of words), learned online; an adaptive map
from the mixed logit to the observed rate refines the result. Words that share the 8 bits are told
apart by averaging the contexts' shares, and the text's own words so far, counted as it is read, are
averaged in. Every step is a distribution, so the score is a true log probability, and total bits per
byte follow.

Counts of a context are those of all training text, held as sorted 64-bit keys: 40 bits of the context
first, then the 24 leading bits of the hash of what followed it, so a bit's counts are those of a stretch of neighbouring
keys. Known words that share 24 bits share what such a key is worth in equal parts, so a context's shares never sum above
one; contexts that share 40 bits share their counts. Both widths are the same at every size of corpus.

A training token is left out of the counts that foretell it: shares and whether a context met the word exactly; a bit's
counts up to ``SMALL`` exactly, above that where its way was taken once, else they are as they are, in steps of the logit.

Spark moves: rows are dealt by hash to slices of about ``SLICE_BYTES``; very many equal rows by their number as well. A
slice learns its weights from its own training texts (those of letters from new words as they are scored), so they follow from the
rows, not from how the session cuts them. Its texts are cut into words once, and the words kept. A slice sends its distinct keys with their counts to ranges of keys, at most
``FAN`` lists to a task (more are merged level by level), and gets back one byte for each bit to be predicted and two for
each share. Only the totals of 256 buckets are sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, slices, table

SLICE_BYTES, RANGE_BYTES, FAN = 6 << 20, 12 << 20, 256
#: Bits mixed for a known word, and bits that tell it apart within a context; bits of a letter.
DEPTH, CODE, LETTER = 8, 24, 8
#: Bits of a context in a key.
BITS = 40
#: Letters before, for each context of a letter.
LETTERS = (2, 4, 6)
#: Orders of context whose keys are exchanged together, the largest first; the next follow when the shuffle files of these are gone.
PASSES = ((2,), (1,), (0, 3, 4, 5))
#: Parts of the slices that are scored one after the other.
HALVES = 4
CHUNK = 1 << 15
PRIOR, STEPS = 0.4, 33
GATES = 8 * 8 * 4  # of the longer context, the shorter, and the run of known triples
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# Tokens -----------------------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens (the end is the empty string, the last), which each token of all texts is, in order, and the row of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(words)
    real = pc.greater(pc.binary_length(flat), 0)
    row, flat = row[real.to_numpy(zero_copy_only=False)], flat.filter(real)
    coded = flat.dictionary_encode()
    counts = np.bincount(row, minlength=len(texts))
    which = np.full(len(flat) + len(texts), len(coded.dictionary))
    mine = np.ones(len(which), bool)
    mine[np.cumsum(counts + 1) - 1] = False
    which[mine] = coded.indices.to_numpy()
    return pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())]), which, np.repeat(np.arange(len(texts)), counts + 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def low_bits(bits: int) -> np.uint64:
    return np.uint64((1 << (64 - bits)) - 1)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by slice, packed: what is shuffled is smaller and has fewer rows."""
    for batch in batches:
        for part in slices(batch, most=16 << 20):
            ids = part.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            begins = np.flatnonzero(np.diff(ids[order], prepend=-1))
            part, out = part.drop_columns(["id"]).take(pa.array(order)), []
            for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
                out.append(packed_rows(part.slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][begins]), pa.array(out, pa.binary())], ["id", "rows"])


def packed_rows(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write(rows)
    return zstandard.compress(sink.getvalue(), 1)


_KEPT = "id long, rows binary, word binary, letters binary, ends binary"


def _kept(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """A slice in one row: its rows without their texts, and its tokens."""
    own = Slice(parts)
    rows = pa.table([own.rows.column("doc_id"), own.rows.column("held_out"), pa.array(own.size), pa.array(np.bincount(own.row, minlength=own.n))], ["doc_id", "held_out", "size", "n_tokens"])
    ends = np.frombuffer(own.words.buffers()[1], np.int64)[own.words.offset : own.words.offset + len(own.words) + 1]
    letters = memoryview(own.words.buffers()[2] or b"")[ends[0] : ends[-1]]
    return pa.table({"id": pa.array([key[0].as_py()], pa.int64())} | {k: pa.array([x], pa.binary()) for k, x in (("rows", packed_rows(rows)), ("word", pack(own.word.astype("<u4"))), ("letters", zstandard.compress(letters, 1)), ("ends", pack(np.diff(ends))))})


class Slice:
    """Rows of a slice in an order that follows from their content, their tokens, and keys by order of context:
    0 words, 1 and 2 words after one and two words before, then letters after those of LETTERS.
    ``parts``: its rows as they were dealt, or the one row that ``_kept`` made of them."""

    def __init__(self, parts: pa.Table | pa.RecordBatch):
        rows = pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(x)).read_all() for x in parts.column("rows").to_pylist()])
        if "word" in parts.schema.names:
            word, letters, ends = (parts.column(k)[0].as_py() for k in ("word", "letters", "ends"))
            self.size, self.word = rows.column("size").to_numpy(), unpack(word, "<u4").astype(np.int64)
            self.row = np.repeat(np.arange(rows.num_rows), rows.column("n_tokens").to_numpy())
            ends = np.concatenate([[0], np.cumsum(unpack(ends, "<i8"))])
            self.words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(zstandard.decompress(letters))])
        else:
            rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
            words, self.word, self.row = tokens(rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.large_string()))
            self.size = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy().astype(np.int64)
            self.words = words.cast(pa.large_binary())
        self.rows, self.n = rows, rows.num_rows
        self.train = ~rows.column("held_out").to_numpy(zero_copy_only=False)[self.row]
        self.first = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.at = np.arange(len(self.row)) - self.first[self.row]  # place in the text
        self.trained = np.bincount(self.word[self.train], minlength=len(self.words))

    @cached_property
    def hash(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_numpy(zero_copy_only=False), repeat(7)), np.uint64, len(self.words))

    def by_words(self, o: int) -> np.ndarray:
        """The key of each token after ``o`` words, one or two."""
        h = self.hash[self.word]
        one = np.where(self.at > 0, np.roll(h, 1), np.uint64(1))
        if o == 1:
            context = spread(one + np.uint64(11))
        else:
            context = spread(one * _B + spread(np.where(self.at > 1, np.roll(h, 2), np.uint64(2)) + np.uint64(23)))
        return (context & ~low_bits(BITS)) | (h >> np.uint64(64 - CODE)) << np.uint64(64 - CODE - BITS)

    def by_letters(self, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each letter of each word (of the words ``some``) and the six before it, the word of each, and where each word begins."""
        words = self.words if some is None else self.words.take(pa.array(some))
        stops = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        size = np.diff(stops)
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        of = np.repeat(np.arange(len(size)), size + 1)
        # words one after the other with seven blanks before each: the eight bytes that end with a letter are one number
        data = np.full(begin[-1] + 7 * len(size), 32, np.uint8)
        at = np.arange(begin[-1]) + 7 * of
        there = np.ones(begin[-1], bool)
        there[begin[1:] - 1] = False
        if stops[-1] > stops[0]:
            data[at[there] + 7] = np.frombuffer(words.buffers()[2], np.uint8)[stops[0] : stops[-1]]
        return np.ndarray(len(data) - 7, ">u8", data, strides=1)[at].astype(np.uint64) & low_bits(8), of, begin

    def lists(self, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By order of context, for those of ``orders``: sorted distinct keys, their counts in training texts (letters: in distinct training
        words), and whether each is asked for (letters: those of words that no training text of the slice has)."""
        if 0 in orders:
            order = np.argsort(self.hash)
            yield 0, self.hash[order], self.trained[order], np.ones(len(order), bool)
        for o in {1, 2} & set(orders):
            keys = self.by_words(o)
            found, counts = distinct(keys, keys[self.train])
            yield o, found, counts, np.ones(len(found), bool)
        if set(orders) - {0, 1, 2}:
            raw, of, _ = self.by_letters()
            mine = (self.trained > 0)[of].astype(np.uint64)
            for o, k in enumerate(LETTERS, 3):
                if o in orders:
                    keys = np.sort(letter_keys(raw, k) | mine)  # a key's last byte is free
                    begins = np.flatnonzero(np.diff(keys >> np.uint64(8), prepend=~keys[:1] >> np.uint64(8)))
                    counts = np.add.reduceat((keys & np.uint64(255)).astype(np.int64), begins)
                    yield o, keys[begins] & ~np.uint64(255), counts, counts < np.diff(np.append(begins, len(keys)))


def distinct(keys: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``keys``, and how often each is among ``taught``."""
    keys = np.sort(keys)
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    taught = np.sort(taught)
    begins = np.flatnonzero(np.diff(taught, prepend=~taught[:1]) != 0)
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, taught[begins])] = np.diff(np.append(begins, len(taught)))
    return keys, counts


def letter_keys(raw: np.ndarray, k: int) -> np.ndarray:
    """Keys of letters after the ``k`` before."""
    raw = raw & np.uint64((1 << 8 * (k + 1)) - 1)
    return (raw >> np.uint64(8)) * _A << np.uint64(16) | (raw & np.uint64(255)) << np.uint64(8)


def places(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted distinct ones."""
    order = np.argsort(keys)
    keys = keys[order]
    out = np.empty(len(keys), np.uint32 if len(keys) < 2**32 else np.int64)
    out[order] = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
    return out


def pack(x: np.ndarray) -> bytes:
    """Numbers by their first bytes, then their second ones and so on: neighbours alike compress."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unpack(x: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_states(states: np.ndarray, depth: int) -> bytes:
    """States by keys: of the first ``depth`` rows that of the first bit, which keys have the same for all bits, and the others' for
    the other bits; the further rows whole."""
    bits = states[:depth]
    same = (bits == bits[0]).all(axis=0)
    return zstandard.compress(b"".join([np.uint32(states.shape[1]).tobytes(), bits[0].tobytes(), np.packbits(same).tobytes(), states[depth:].tobytes(), bits[1:, ~same].tobytes()]), 1)


def unpack_states(x: bytes, depth: int, further: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(x), np.uint8)
    n = int(flat[:4].view("<u4")[0])
    whole = 4 + n + -(-n // 8)
    same = np.unpackbits(flat[4 + n : whole], count=n).astype(bool)
    out = np.repeat(flat[None, 4 : 4 + n], depth + further, axis=0)
    out[depth:] = flat[whole : whole + further * n].reshape(further, n)
    out[1:depth, ~same] = flat[whole + further * n :].reshape(depth - 1, -1)
    return out


# Counts by key ----------------------------------------------------------------------------------

_LISTS = "ord int, rng int, id long, keys binary, counts binary, asked binary"
_TOTALS = "ord int, rng int, id long, data binary"


_LIST = pa.schema([("ord", pa.int32()), ("rng", pa.int32()), ("id", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("asked", pa.binary())])


def list_row(o: int, r: int, i: int, keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> dict:
    return {"ord": o, "rng": r, "id": i, "keys": pack(np.diff(keys, prepend=np.uint64(0))), "counts": pack(counts.astype("<i8")), "asked": zstandard.compress(np.packbits(asked).tobytes(), 1)}


def _listed(ranges: int, orders: tuple[int, ...] = sum(PASSES, ())):
    # neither a context nor words of one code are in two ranges
    cuts = np.array([(i * 2**64 // ranges) & ~int(low_bits(min(BITS, CODE))) for i in range(ranges)], np.uint64)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Distinct keys of a slice with their training counts, by range; a context's keys are in one range."""
        own, out = Slice(rows), []
        for o, keys, counts, asked in own.lists(orders):
            at = [*np.searchsorted(keys, cuts).tolist(), len(keys)]
            out += [list_row(o, r, key[0].as_py(), keys[a:b], counts[a:b], asked[a:b]) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pa.Table.from_pylist(out, _LIST)

    return run


def _each(run):
    """``run`` on each slice of a table of slices."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run((batch.column("id")[i],), batch.slice(i, 1)).to_batches()

    return over


def _joined(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Lists in order of their ids, the keys of all, sums of their counts, which keys each list asks for, and all asked for."""
    rows = rows.sort_by("id")
    keys = [np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.diff(keys, prepend=~keys[:1]) != 0
    begins, at = np.flatnonzero(first), np.empty(len(keys), np.int64)
    at[order] = np.cumsum(first) - 1
    total = np.add.reduceat(np.concatenate([unpack(x, "<i8") for x in rows.column("counts").to_pylist()])[order], begins)
    asked, any_ = [], np.zeros(len(begins), bool)
    for mine, a in zip(np.split(at, ends[:-1]), rows.column("asked").to_pylist(), strict=True):
        asked.append(mine[np.unpackbits(np.frombuffer(zstandard.decompress(a), np.uint8), count=len(mine)).astype(bool)])
        any_[asked[-1]] = True
    return rows, keys[begins], total, asked, any_


def _merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    _, found, total, _, asked = _joined(rows)
    return pa.Table.from_pylist([list_row(*(k.as_py() for k in key), found, total, asked)], _LIST)


# What a predictor knows of a bit, in one byte: counts (seen, of them the way taken) up to SMALL exactly, above
# that the logit, or that it always, never, once or but once went this way. Both ways' bytes mirror each other, so they sum to one.
SMALL = 16
_SEEN = np.concatenate([np.full(a + 1, a) for a in range(SMALL + 1)])
_TOOK = np.concatenate([np.arange(a + 1) for a in range(SMALL + 1)])
_EXACT, _WIDE = len(_SEEN), 98
_ALWAYS, _NEVER, _ONCE, _BUT_ONCE = (_EXACT + _WIDE + i for i in range(4))


def state(seen: np.ndarray, took: np.ndarray) -> np.ndarray:
    a = np.minimum(seen, SMALL + 1).astype(np.uint16)
    out = (a * (a + np.uint16(1)) // np.uint16(2) + np.minimum(took, a).astype(np.uint16)).astype(np.uint8)
    wide = np.flatnonzero(seen > SMALL)
    a, b = seen[wide], took[wide]
    logit = np.floor(np.log((b + PRIOR) / (a - b + PRIOR)) * 5) + _WIDE // 2
    out[wide] = np.select([b == a, b == 0, b == 1, b == a - 1], [_ALWAYS, _NEVER, _ONCE, _BUT_ONCE], _EXACT + np.clip(logit, 0, _WIDE - 1))
    return out


#: Counts of a bucket that a share keeps exactly; steps of an octave beyond.
SURELY, OCTAVE = 40, 6


def share_planes(seen: np.ndarray, took: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A share of a bucket in two bytes: how often it was met, up to 254, and of how many, exactly up to SURELY and then rounded up; from 255
    on the share itself, rounded down. So shares sum to one at most."""
    b = np.minimum(took, 255).astype(np.uint8)
    a = np.minimum(seen, 255).astype(np.uint8)
    wide, often = np.flatnonzero(seen > SURELY), np.flatnonzero(took >= 255)
    a[wide] = np.minimum(SURELY + np.ceil(OCTAVE * np.log2(seen[wide] / SURELY)), 255)
    a[often] = np.minimum(np.ceil(-OCTAVE * np.log2(took[often] / seen[often])), 255)
    return b, a


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit and class (for the gate) by state, and share by its two bytes; the second half with one occurrence of the way taken left out."""
    logit, kind = np.zeros(512, np.float32), np.zeros(512, np.uint8)
    for own in (0, 1):
        a, b = np.maximum(_SEEN - own, 0), np.maximum(_TOOK - own, 0)
        at = slice(256 * own, 256 * own + _EXACT)
        logit[at] = np.log((b + PRIOR) / (a - b + PRIOR))
        kind[at] = np.where(a == 0, 0, np.where(a == 1, 1, np.where(a < 4, 2, 4) + ((b > 0) & (b < a))))
        wide = 256 * own + _EXACT
        logit[wide : wide + _WIDE] = (np.arange(_WIDE) - (_WIDE - 1) / 2) / 5
        logit[wide + _WIDE : wide + _WIDE + 4] = 6, -6, (-4, -6)[own], 4
        kind[wide : wide + _WIDE + 4] = 7
        kind[[wide + _WIDE, wide + _WIDE + 1]] = 6
    kind[256 + _ONCE] = 6
    b, code = np.arange(255)[:, None], np.arange(256)[None, :]
    of = np.where(code <= SURELY, code, SURELY * 2.0 ** ((code - SURELY) / OCTAVE))
    share = np.zeros((2, 256, 256))
    share[0, :255] = np.minimum(1, b / np.maximum(of, 1))
    share[1, :255] = np.minimum(1, np.maximum(b - 1, 0) / np.maximum(of - 1, 1))
    share[1, :255, SURELY + 1 :] = np.maximum(b - 1, 0) / of[:, SURELY + 1 :]
    share[0, 255] = 2.0 ** (-code[0] / OCTAVE)
    share[1, 255] = share[0, 255] * 254 / 255
    return logit, kind, share.ravel()


_LOGIT, _KIND, _SHARE = _tables()
#: Classes as parts of a gate's number.
_CLASS = {k: _KIND.astype(np.intp) * k for k in (1, 4, 32)}
_HALF = np.minimum(_KIND >> 1, 3).astype(np.intp)


def shares(own: np.ndarray, met: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Shares by their two bytes; ``own``: whether an occurrence is left out."""
    return _SHARE.take((own.astype(np.intp) << 16) + (met.astype(np.intp) << 8) + of)


def told(keys: np.ndarray, total: np.ndarray, code: int, depth: int, ends: bool) -> np.ndarray:
    """States (bits by keys) of each sorted key's bits, from the stretches of keys that agree so far; with ``ends`` its share of the last stretch."""
    apart = np.concatenate([keys[:1] | ~keys[:1], keys[1:] ^ keys[:-1]])  # each key from the one before
    first = (apart >> np.uint64(code)).astype(bool)
    alone = first & np.append(first[1:], True)
    if np.count_nonzero(alone) <= len(keys) // 4:
        return _told(apart, total, code, depth, ends)
    out, one, rest = np.empty((depth + 2 * ends, len(keys)), np.uint8), total[alone], np.flatnonzero(~alone)
    out[:depth, alone] = state(one, one)
    if ends:
        out[depth:, alone] = share_planes(one, one)
    if len(rest):
        out[:, rest] = _told(apart[rest], total[rest], code, depth, ends)
    return out


def _told(apart: np.ndarray, total: np.ndarray, code: int, depth: int, ends: bool) -> np.ndarray:
    out = np.empty((depth + 2 * ends, len(total)), np.uint8)
    begins = np.flatnonzero(apart >> np.uint64(code - depth))
    apart = apart[begins]
    sums, length = np.add.reduceat(total, begins), np.diff(np.append(begins, len(total)))
    if ends:
        out[depth:] = share_planes(np.repeat(sums, length), total)
    for j in range(depth - 1, -1, -1):  # the stretches of a bit less are made of those of this bit
        firsts = np.flatnonzero(apart >> np.uint64(code - j))
        each, whole = np.diff(np.append(firsts, len(sums))), np.add.reduceat(sums, firsts)
        out[j] = np.repeat(state(np.repeat(whole, each), sums), length)
        sums, apart, length = whole, apart[firsts], np.add.reduceat(length, firsts)
    return out


def sharing(hashes: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each of the sorted hashes of words, how many known words have its code."""
    code = hashes >> np.uint64(64 - CODE)
    begins = np.flatnonzero(np.diff(code, prepend=code[:1] ^ np.uint64(1)))
    return np.repeat(np.add.reduceat((total > 0).astype(np.int64), begins), np.diff(np.append(begins, len(code))))


def _known(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """All lists of a range of keys: what each slice or group of them is told, in the order of its keys. Words
    get their counts and how many known words share their code; a further row (id -1) has words and tokens by bucket."""
    rows, found, total, which, _ = _joined(rows)
    o, r = (k.as_py() for k in key)
    ids = rows.column("id").to_pylist()
    if o == 0:
        both = np.stack([total, sharing(found, total)])
        data = [pack(both[:, w].ravel()) for w in which]
        bucket = (found >> np.uint64(64 - DEPTH)).astype(np.int64)
        low = bucket[:1]
        data.append(np.concatenate([low, np.bincount(bucket - low, total), np.bincount(bucket - low, total > 0)]).astype("<i8").tobytes())
        ids.append(-1)
    else:
        states = told(found, total, 64 - BITS, DEPTH, True) if o < 3 else told(found, total, 16, LETTER, False)
        data = [pack_states(states[:, w], DEPTH if o < 3 else LETTER) for w in which]
    return pa.table({"ord": pa.array([o] * len(ids), pa.int32()), "rng": pa.array([r] * len(ids), pa.int32()), "id": pa.array(ids, pa.int64()), "data": pa.array(data, pa.binary())})


def _handed(key: tuple[pa.Scalar, ...], rows: pa.Table, parent: pa.Table) -> pa.Table:
    """What a group of lists was told, handed on to each of them."""
    if not rows.num_rows:  # the buckets' row
        return parent.select(["ord", "rng", "id", "data"])
    rows, found, _, which, asked = _joined(rows)
    which = [(np.cumsum(asked) - 1)[w] for w in which]  # among the keys that the group asked for
    data, o = parent.column("data").to_pylist()[0], key[0].as_py()
    if o == 0:
        both = unpack(data, "<i8").reshape(2, -1)
        data = [pack(both[:, w].ravel()) for w in which]
    else:
        depth, further = (DEPTH, 2) if o < 3 else (LETTER, 0)
        states = unpack_states(data, depth, further)
        data = [pack_states(states[:, w], depth) for w in which]
    return pa.table({"ord": rows.column("ord"), "rng": rows.column("rng"), "id": rows.column("id"), "data": pa.array(data, pa.binary())})


def exchange(lists: DataFrame, width: int, fan: int = FAN) -> DataFrame:
    """(ord, rng, id, data) for each of ``lists``, whose ids are below ``width``; no task gets more than ``fan`` lists."""
    if width <= fan:
        return lists.groupBy("ord", "rng").applyInArrow(_known, _TOTALS)
    node = F.expr(f"if(id < 0, id, id div {fan})")
    up = materialise(lists.select("ord", "rng", node.alias("id"), "keys", "counts", "asked").groupBy("ord", "rng", "id").applyInArrow(_merged, _LISTS), "merged")
    above = exchange(up, -(-width // fan), fan).withColumn("node", F.col("id"))
    return lists.withColumn("node", node).groupBy("ord", "rng", "node").cogroup(above.groupBy("ord", "rng", "node")).applyInArrow(_handed, _TOTALS)


# Mixing -----------------------------------------------------------------------------------------


class Mixer:
    """Gated weights of some predictors, and the adaptive map."""

    def __init__(self, inputs: int, gates: int):
        self.weights = np.full((inputs, gates), 0.4)
        self.heat = np.full(gates, 40.0)
        self.hits, self.ones = np.zeros((gates, STEPS)), np.zeros((gates, STEPS))

    def refinement(self) -> np.ndarray:
        """By gate and step, what such logits turned out to be."""
        centre = 1 / (1 + np.exp(-((np.arange(STEPS) * 24 / (STEPS - 1)) - 12)))
        return ((self.ones + 20 * centre) / (self.hits + 20)).astype(np.float32).ravel()

    def chances(self, x: list[np.ndarray], gate: np.ndarray, learn: bool, rate: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of the way each bit went; x: logits of that way, by predictor.
        With ``learn`` the weights follow the errors (steps get shorter as evidence grows) and the map counts."""
        w = self.weights.astype(np.float32)
        logit = w[0].take(gate)
        logit *= x[0]
        for i in range(1, len(x)):
            part = w[i].take(gate)
            part *= x[i]
            logit += part
        np.clip(logit, -12, 12, out=logit)
        step = logit + np.float32(12)
        step *= np.float32((STEPS - 1) / 24)
        step += np.float32(0.5)
        step = step.astype(np.intp)
        step += gate * STEPS
        np.exp(np.negative(logit, out=logit), out=logit)
        logit += np.float32(1)
        p = np.reciprocal(logit, out=logit)
        if learn:
            wrong, n = 1 - p, self.weights.shape[1]
            # predictors go together, so a step is as short as if all their curvature were one's own
            curve = x[0] * x[0]
            for v in x[1:]:
                curve += v * v
            curve *= p * wrong
            self.heat += np.bincount(gate, curve, n)
            for i, v in enumerate(x):
                self.weights[i] += np.bincount(gate, wrong * v, n) / self.heat
            # either way a bit might have gone, so that the map of one way mirrors that of the other
            came = np.bincount(step, minlength=self.hits.size).reshape(-1, STEPS)
            self.ones += came
            self.hits += came + came[:, ::-1]
        if rate is not None:
            p += rate.take(step)
            p *= np.float32(0.5)
        return np.log(np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p), out=p)


class Model:
    """All that is learned: mixers for words' bits, for letters' bits and for new words; shares in averages."""

    def __init__(self) -> None:
        self.word, self.letter, self.new = Mixer(3, GATES), Mixer(len(LETTERS), GATES), Mixer(3, 4)
        self.rates = np.ones((64, 2))  # known, new, by classes of the contexts
        self.among = np.ones((GATES, 3))  # shares of the contexts within a bucket
        self.own = np.tile([1.0, 9.0], (GATES * 4, 1))  # the text's own words, the corpus
        self.refined: list[np.ndarray] | None = None

    def settle(self) -> None:
        """From learning to scoring."""
        self.refined = [m.refinement() for m in (self.word, self.letter, self.new)]


#: Tables by state (logits, classes, classes as parts of a gate's number): as they are, with an occurrence left out, and both one after the other.
_TABLES = [[x[a:b] for x in (_LOGIT, _CLASS[1], _CLASS[4], _CLASS[32])] for a, b in ((0, 256), (256, 512), (0, 512))]


def _tables_of(less: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Tables by state for tokens with an occurrence left out or not (``less``), and what is to be added to their states."""
    some, every = less.any(), less.all()
    return _TABLES[1 if every else 2 if some else 0], less.astype(np.intp) << 8 if some and not every else None


def _ways(states: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """States as places in their tables."""
    out = states.astype(np.intp)
    if more is not None:
        out += more
    return out


def _bucketed(n: np.ndarray, *cuts: int) -> np.ndarray:
    out = np.zeros(len(n), np.uint8)
    for c in cuts:
        out += n >= c
    return out.astype(np.intp)


def _columns(planes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``planes[:, which]`` of planes that lie by key, each plane in one piece."""
    return np.ascontiguousarray(planes.T.take(which, axis=0).T)


class Told:
    """A slice with what it was told of its keys."""

    def __init__(self, own: Slice, totals: pa.Table):
        self.own = own
        held: dict[int, list] = {}
        for o, r, d in zip(totals.column("ord").to_pylist(), totals.column("rng").to_pylist(), totals.column("data").to_pylist(), strict=True):
            held.setdefault(o, []).append((r, d))
        bytes_of = lambda o: [d for _, d in sorted(held.get(o, []))]
        # by key in memory, as a key's are read together
        planes = lambda o, k, more: np.concatenate([np.zeros((0, k + more), np.uint8), *(unpack_states(d, k, more).T for d in bytes_of(o))]).T
        both = np.empty((2, len(own.words)), np.int64)
        both[:, np.argsort(own.hash)] = np.concatenate([unpack(d, "<i8").reshape(2, -1) for d in bytes_of(0)], axis=1)
        self.count, self.sharers = both[0][own.word], np.maximum(1, both[1])[own.word]
        self.words = [(planes(o, DEPTH, 2), places(own.by_words(o))) for o in (1, 2)]
        self.letters = [planes(3 + i, LETTER, 0) for i in range(len(LETTERS))]
        self.node = (own.hash >> np.uint64(64 - DEPTH)).astype(np.uint16)[own.word]
        # how often the text has had the word before
        pair = own.row * len(own.words) + own.word
        if own.n * len(own.words) * len(pair) < 2**63:
            pair = np.sort(pair * len(pair) + np.arange(len(pair)))
            order, pair = pair % len(pair), pair // len(pair)
        else:
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        same = np.concatenate([[0], np.flatnonzero(np.diff(pair)) + 1])
        self.before = np.empty(len(order), np.int64)
        self.before[order] = np.arange(len(order)) - np.repeat(same, np.diff(np.append(same, len(order))))

    def run_of(self, hit: np.ndarray) -> np.ndarray:
        """For each token, how many tokens of its text just before it were hits."""
        n = np.arange(len(hit))
        miss = np.maximum.accumulate(np.where(~hit, n, -1))
        last = np.concatenate([[-1], miss[:-1]])
        return n - 1 - np.maximum(last, n - self.own.at - 1)

    def spelled(self, model: Model, words: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each of ``words`` (indices) from its letters; weights are learned on the way."""
        if not len(words):
            return np.zeros(0)
        new = np.flatnonzero(self.own.trained == 0)
        (raw, _, begin), out = self.own.by_letters(new), np.zeros(len(words))
        words = np.searchsorted(new, words)
        asked = [np.unique(letter_keys(raw, k)) for k in LETTERS]
        size = begin[words + 1] - begin[words]
        ends = np.cumsum(size)
        at = 0
        while at < len(words):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
            some = size[at:upto]
            owner = np.repeat(np.arange(at, upto), some)
            place = np.repeat(begin[words[at:upto]] - (np.cumsum(some) - some), some) + np.arange(len(owner))
            some = raw[place]
            planes = [_columns(p, np.searchsorted(keys, letter_keys(some, k))) for p, keys, k in zip(self.letters, asked, LETTERS, strict=True)]
            got, rate = np.zeros(len(owner), np.float32), model.letter.refinement()
            for j in range(LETTER):
                states = [p[j].astype(np.intp) for p in planes]
                gate = _CLASS[32].take(states[2]) + _CLASS[4].take(states[1]) + _HALF.take(states[0])
                got += model.letter.chances([_LOGIT.take(s) for s in states], gate, True, rate)
            out += np.bincount(owner, got, len(words))
            at = upto
        return out

    def chances(self, model: Model, bottom: tuple[np.ndarray, np.ndarray], left_out: np.ndarray, which: np.ndarray, learn: bool) -> np.ndarray:
        """Natural log of the probability of the tokens ``which``. left_out: tokens whose own occurrence is taken out of the
        counts; bottom: logits by node of the tree of buckets, as they are and with one occurrence left out, then tokens by bucket."""
        own, out = self.own, np.zeros(len(which))
        count = self.count - left_out
        fresh = count <= 0
        # logits on the way to the node below, by bit and bucket
        nodes = np.arange(1 << DEPTH)
        roots = [np.concatenate([bottom[0][(nodes >> (DEPTH - 1 - j)) + (less + (2 << j))] for less in (0, 2 << DEPTH)]) for j in range(DEPTH)]
        two, at_two = self.words[1]
        run = _bucketed(self.run_of(two[DEPTH].take(at_two) > left_out), 1, 3, 16).astype(np.uint8)
        news = np.concatenate([[0], np.cumsum(fresh)])
        new_so_far = (news[:-1] - news[own.first[own.row]]).astype(np.float32)
        spell = np.zeros(len(own.words))
        if not learn:
            needed = np.unique(own.word[which[fresh[which]]])
            spell[needed] = self.spelled(model, needed)
        refined = model.refined or [None] * 3
        for a in range(0, len(which), CHUNK):
            t = which[a : a + CHUNK]
            less, new = left_out[t], fresh[t]
            seen = own.at[t]
            (logits, class_1, class_4, class_32), more = _tables_of(less)
            kinds = [class_1.take(_ways(p[0].take(w[t]), more)) for p, w in self.words]
            # is the word new?
            g1, g2 = kinds[0], 8 + kinds[1] * 4 + run[t]
            odds = np.log(model.rates[:, 1] / model.rates[:, 0]).astype(np.float32)
            doc = np.log((new_so_far[t] + 0.3) / (seen - new_so_far[t] + 1.5)).astype(np.float32)
            sign = np.where(new, np.float32(1), np.float32(-1))
            got = model.new.chances([odds.take(g1) * sign, odds.take(g2) * sign, doc * sign], _bucketed(seen, 8, 64, 512), learn, refined[2]).astype(np.float64)
            if learn:
                for g in (g1, g2):
                    model.rates += np.bincount(g * 2 + new, minlength=128).reshape(64, 2)
            # the bits of a known word
            kept = np.flatnonzero(~new)
            if len(kept):
                tk, less = t[kept], less[kept]
                node = self.node[tk]
                planes = [_columns(p, w[tk]) for p, w in self.words]
                r = run[tk]
                bits = np.zeros(len(kept), np.float32)
                place, more = node + (less.astype(np.intp) << DEPTH), None if more is None else more[kept]
                for j in range(DEPTH):
                    states = [_ways(p[j], more) for p in planes]
                    gate = class_32.take(states[1])
                    gate += class_4.take(states[0])
                    gate += r
                    bits += model.word.chances([roots[j].take(place), *(logits.take(x) for x in states)], gate, learn, refined[0])
                # among the words of the bucket
                parts = [np.minimum(1.0, count[tk] / np.maximum(1, bottom[1][node] - less)), *(shares(less, p[DEPTH], p[DEPTH + 1]) / self.sharers[tk] for p in planes)]
                # a context that never met the bucket has no say in it
                there = [np.ones(len(kept)), *((p[DEPTH] == 255) | (p[DEPTH + 1] > less) for p in planes)]
                w = [model.among[:, i].take(gate) * x for i, x in enumerate(there)]
                whole = sum(w)
                within = [wi * pi / whole for wi, pi in zip(w, parts, strict=True)]
                p = np.maximum(sum(within), 1e-300)
                got[kept] += bits + np.log(p)
                if learn:
                    for i, x in enumerate(within):
                        model.among[:, i] += np.bincount(gate, x / p, GATES)
            bare = np.flatnonzero(new)
            got[bare] += spell[own.word[t[bare]]]
            # the text's own words
            gate = ((kinds[1] * 8 + kinds[0]) * 4 + run[t]) * 4 + _bucketed(seen, 8, 64, 512)
            mine = self.before[t] / np.maximum(seen, 1)
            a1 = np.where(seen > 0, model.own[:, 0].take(gate) / model.own.sum(axis=1).take(gate), 0)
            one, other = a1 * mine, (1 - a1) * np.exp(np.maximum(got, -600))
            p = one + other
            out[a : a + CHUNK] = np.log(np.maximum(p, 1e-250))
            faint = np.flatnonzero(p <= 1e-250)
            out[a + faint] = got[faint] + np.log1p(-a1[faint])
            if learn:
                part, some = one / np.maximum(p, 1e-300), (seen > 0) & ~new  # new words aren't spelled out here
                model.own[:, 0] += np.bincount(gate, part * some, len(model.own))
                model.own[:, 1] += np.bincount(gate, (1 - part) * some, len(model.own))
        return out


def bottoms(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the way to each node of the tree of buckets (node 1 is the root), as they are and then with one token of
    that node left out; and tokens by bucket."""
    heap = np.zeros(2 << DEPTH)
    heap[1 << DEPTH :] = buckets
    for i in range((1 << DEPTH) - 1, 0, -1):
        heap[i] = heap[2 * i] + heap[2 * i + 1]
    other = heap[np.arange(2 << DEPTH) ^ 1]
    logits = [np.log((np.maximum(heap - less, 0) + PRIOR) / (other + PRIOR)) for less in (0, 1)]
    return np.concatenate(logits).astype(np.float32), buckets


_DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double, followed double"


def _scored(bottom, n: int, v: int):
    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        """A slice's scores: it learns from its training texts, each token left out of the counts that foretell it, and then
        scores all its texts."""
        own, model = Slice(rows), Model()
        held, taught = Told(own, totals), np.flatnonzero(own.train)
        if len(taught):
            held.chances(model, bottom, own.train, taught, True)
        model.settle()
        per = lambda x: np.bincount(own.row, x, own.n)
        score = per(held.chances(model, bottom, np.zeros(len(own.word), bool), np.arange(len(own.word)), False) / np.log(10))
        size = own.size
        two, at = held.words[1]
        return pa.table([
            own.rows.column("doc_id"), own.rows.column("held_out"), pa.array(np.bincount(own.row, minlength=own.n)), pa.array(per(held.count > 0).astype(np.int64)), pa.array(np.full(own.n, n)),
            pa.array(per(np.log10(held.count + 0.5) - np.log10(n + 0.5 * (v + 1)))), pa.array(score), pa.array(size), pa.array(-score * np.log2(10) / np.maximum(size, 1), mask=size == 0),
            pa.array(per(two[DEPTH].take(at) > own.train) / np.bincount(own.row, minlength=own.n)),
        ], [f.split()[0] for f in _DOC.split(", ")])

    return run


def score_documents(docs: DataFrame, slice_bytes: int = SLICE_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte, followed) of each row.

    Learns from rows that aren't held out (crc32 of doc_id as text, mod 5, is not 1; a null doc_id is
    learned from). followed is the share of tokens that follow the same two words in some other place of the training text too.
    Null text counts as empty: one token, the end. Repeated rows count and are answered each; where
    rows equal in id and text would fill an eighth of a slice, they are dealt to several by their number. Texts of any length are
    read whole, by one task each; ties do not arise; other columns, whatever their names, are not looked at. bits_per_byte
    is null for texts without bytes. An empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    size, hot = equal_rows(rows).agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(many_rows(slice_bytes))).first()
    slices_ = max(1, -(-size // slice_bytes))
    by_slice = dealt_rows(rows, slices_, slice_bytes, hot)
    cut = materialise(by_slice.mapInArrow(_dealt, "id long, rows binary").groupBy("id").applyInArrow(_kept, _KEPT), "slices")
    # what each part of the slices is told is a column of its own, so that it is read without the others'
    halves = min(HALVES, slices_)
    by_half = [F.when(F.pmod("id", F.lit(halves)) == h, F.col("data")).alias(f"data{h}") for h in range(halves)]
    parts = []
    for orders in PASSES:
        lists = cut.mapInArrow(_each(_listed(max(1, -(-size // RANGE_BYTES)), orders)), _LISTS)
        if slices_ > fan:
            lists = materialise(lists, "lists")
        parts.append(materialise(exchange(lists, slices_, fan).select("ord", "rng", "id", *by_half), "totals"))
        if slices_ > fan:
            discard(lists)
    totals = reduce(DataFrame.unionByName, parts)
    buckets, n, v = np.zeros(1 << DEPTH), 0, 0
    for r in totals.where("id = -1").select(F.col(f"data{halves - 1}").alias("data")).mapInArrow(_by_bucket, "bucket long, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        buckets[r["bucket"]], n, v = r["n"], n + r["n"], v + r["v"]
    bottom = bottoms(buckets)
    scored = []
    for h in range(halves):  # what was told is on disk, and in the shuffle again for some of the slices only
        some = F.col("id") % halves == h
        told_ = totals.where("id >= 0").where(F.col(f"data{h}").isNotNull()).select("ord", "rng", "id", F.col(f"data{h}").alias("data")).groupBy("id")
        scored.append(materialise(cut.where(some).groupBy("id").cogroup(told_).applyInArrow(_scored(bottom, n, v), _DOC), "scored"))
    discard(cut, *parts)
    return reduce(DataFrame.unionByName, scored)




def equal_key() -> Column:
    return F.xxhash64("doc_id", "text", F.lit(3))


def equal_rows(rows: DataFrame) -> DataFrame:
    """Rows equal in id and text by a key: their number, the length of each and of all, with a byte more for each."""
    length = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return rows.select(equal_key().alias("key"), length.alias("length")).groupBy("key").agg(F.count("*").alias("n"), F.max("length").alias("length"), F.sum("length").alias("bytes"))


def many_rows(slice_bytes: int) -> Column:
    """Whether equal rows are so many that they are dealt by their number."""
    return (F.col("n") * F.col("length") > max(1, slice_bytes // 8)) & (F.col("n") > 1)


def dealt_rows(rows: DataFrame, slices_: int, slice_bytes: int, hot: int | None = None) -> DataFrame:
    """``rows`` with the slice (id) of each, which follows from what the rows hold alone.

    Rows equal in id and text that together exceed an eighth of a slice are counted (they meet as one row and a number, so
    they need no task of their own) and written out again in runs of that size, each run to a slice of its own choice.
    ``hot``: how many such rows there are, if that is known."""
    slot = lambda *more: F.pmod(F.xxhash64("doc_id", "text", *more), F.lit(slices_))
    part = max(1, slice_bytes // 8)
    many = equal_rows(rows).where(many_rows(slice_bytes)).select("key")
    hot = many.count() if hot is None else hot
    if slices_ == 1 or hot == 0:
        return rows.withColumn("id", slot())
    many = F.broadcast(many) if hot <= 100_000 else many
    marked = rows.withColumn("key", equal_key())
    few = marked.join(many, "key", "left_anti").select("doc_id", "text", "held_out", slot().alias("id"))
    counted = marked.join(many, "key", "left_semi").groupBy("doc_id", "text", "held_out").agg(F.count("*").alias("n")).withColumn("each", F.greatest(F.lit(1), F.expr(f"{part} div (octet_length(coalesce(text, '')) + 1)")))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div each"))))
    runs = runs.withColumn("id", slot("run")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("least(each, n - run * each)"))))
    return few.unionByName(runs.select("doc_id", "text", "held_out", "id"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            low, *rest = np.frombuffer(data, "<i8").tolist()
            half = len(rest) // 2
            yield pa.RecordBatch.from_arrays([pa.array(range(low, low + half), pa.int64()), pa.array(rest[:half], pa.int64()), pa.array(rest[half:], pa.int64())], ["bucket", "n", "v"])


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
