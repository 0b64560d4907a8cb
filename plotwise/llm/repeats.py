"""Repeated passages across documents: triggers of a rolling hash, prefix-free parsing, and the order of suffixes.

A window is ``length`` bytes. Its trigger is the smallest rolling hash of a ``gram`` inside it, so equal windows have
equal triggers wherever they stand; a text's maximal runs of windows with one trigger are its stretches. Triggers that
one document alone has can't hold a repeat, and go no further. The other stretches, each once a part, meet by trigger
as bytes. There a prefix-free parse of them all is made: suffix arrays of its dictionary and of its parse combine into
the order of all their suffixes, in which equal windows stand together (``suffixes``). Hashes only bring strings
together; bytes decide.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import at, cut, placed
from plotwise.llm.suffixes import PrefixFreeParse

U = np.uint64
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The codes of a trigger: one document alone has it; its phrases are compared; its windows are, one by one.
UNIQUE, SHARED, CROWDED = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(_MIX)
    x = (x ^ (x >> U(29))) * U(_BASE)
    return x ^ (x >> U(32))


class Parser:
    """Rolling hashes and phrases of texts laid end to end in one buffer."""

    def __init__(self, length: int = 50, gram: int = 20, seed: int = 7):
        self.length, self.gram = length, gram
        self.codes = _mixed(np.arange(1, 257, dtype=U) * U(_BASE) + U(seed))
        self.power = self.inverse = np.zeros(0, U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            steps = np.ones(n, U)
            steps[1:] = U(_BASE)
            self.power = np.multiply.accumulate(steps)
            steps[1:] = U(_INVERSE)
            self.inverse = np.multiply.accumulate(steps)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """Prefix sums from which the hash of any stretch follows."""
        self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, U)
        np.cumsum(self.codes[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at the given places."""
        return _mixed((sums[at + self.length] - sums[at]) * self.inverse[at])

    def phrases(self, sums: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(trigger, phrase hash, text number, first window, windows) of every stretch; bounds: the texts' ends, from 0."""
        length, gram, n = self.length, self.gram, len(sums) - 1
        if n < length:
            return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64))
        least = _mixed((sums[gram:] - sums[:-gram]) * self.inverse[: n - gram + 1])
        span, wanted = 1, length - gram + 1
        while span * 2 <= wanted:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wanted:
            least = np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :])
        whole = np.ones(len(least), bool)
        for end in bounds[1:-1].tolist() if len(bounds) < 64 else ():
            whole[max(0, end - length + 1) : end] = False
        if len(bounds) >= 64:
            ends = bounds[1:-1]
            step = np.zeros(len(least) + 1, np.int32)
            np.add.at(step, np.minimum(np.maximum(0, ends - length + 1), len(least)), 1)
            np.add.at(step, np.minimum(ends, len(least)), -1)
            whole = np.cumsum(step[:-1]) == 0
        at = np.flatnonzero(whole)
        if not len(at):
            return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64))
        trigger = least[at]
        first = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1))))
        last = np.concatenate((first[1:] - 1, [len(at) - 1]))
        a, z = at[first], at[last]
        size = z - a + 1
        phrase = _mixed((sums[z + length] - sums[a]) * self.inverse[a] + size.astype(U) * U(_MIX))
        phrase[phrase == 0] = U(1)
        # Minima crowd at the low end; mixed again and cut to 40 bits they lie evenly, and pack well.
        return _mixed(trigger[first]) >> U(24), phrase, np.searchsorted(bounds, a, side="right") - 1, a, size


def pack(values: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds their distances from the smallest."""
    if not len(values):
        return b""
    base = int(values.min())
    most = int(values.max()) - base
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"
    shifted = values - values.dtype.type(base)
    return kind[-1:].encode() + base.to_bytes(9, "little", signed=True) + shifted.astype(kind).tobytes()


def unpack(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    return np.frombuffer(raw, f"<u{raw[:1].decode()}", offset=10).astype(kind) + kind(int.from_bytes(raw[1:10], "little", signed=True) & 0xFFFFFFFFFFFFFFFF if kind is U else int.from_bytes(raw[1:10], "little", signed=True))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as the first and packed differences."""
    return int(values[0]).to_bytes(8, "little") + pack(np.diff(values)) if len(values) else b""


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    return np.cumsum(np.concatenate(([U(int.from_bytes(raw[:8], "little"))], unpack(raw[8:], U))), dtype=U)


def pack_ids(ids: np.ndarray, unnamed: np.ndarray) -> tuple[bytes, bytes]:
    """Ids (0 for null) and which of them are null."""
    return pack(ids), np.packbits(unnamed).tobytes() if unnamed.any() else b""


def unpack_ids(ids: bytes, unnamed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return unpack(ids, np.int64), np.unpackbits(np.frombuffer(unnamed, np.uint8), count=n).astype(bool) if unnamed else np.zeros(n, bool)


def squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)


def ranked(ids: np.ndarray, unnamed: np.ndarray) -> np.ndarray:
    """The place of each id among the distinct ones in order, nulls last."""
    order = np.lexsort((ids, unnamed))
    i, u = ids[order], unnamed[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], (i[1:] != i[:-1]) | (u[1:] != u[:-1])))[: len(ids)])
    return out


class Part:
    """The documents of one part, in the order of their ids, and their stretches."""

    def __init__(self, ids: list, raws: list[bytes], parser: Parser, chunk: int = 1 << 20):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raws[i]))
        self.parser, self.chunk = parser, chunk
        self.raws = [raws[i] for i in order]
        self.unnamed = np.array([ids[i] is None for i in order], bool)
        self.ids = np.array([ids[i] or 0 for i in order], np.int64)
        self.doc = ranked(self.ids, self.unnamed)
        columns = [np.concatenate(c) for c in zip(*self._stretches(), strict=True)] if self.raws else [np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64)]
        self.trigger, self.hash, self.text, self.place, self.size = columns
        self.triggers, self.entry = np.unique(self.trigger, return_inverse=True)

    def _stretches(self) -> Iterator[tuple[np.ndarray, ...]]:
        low, size = 0, 0
        for i, raw in enumerate([*self.raws, None]):
            if raw is None or size and size + len(raw) > self.chunk:
                lengths = [len(r) for r in self.raws[low:i]]
                bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                t, p, d, a, n = self.parser.phrases(self.parser.sums(np.frombuffer(b"".join(self.raws[low:i]), np.uint8)), bounds)
                yield t, p, d + low, a - bounds[d], n
                low, size = i, 0
            size += len(raw or b"")

    def notes(self, buckets: int, crowd: int = 64) -> Iterator[tuple[int, bytes, int, bytes]]:
        """(bucket, triggers, their packed size, flags): flag 0 if one document here has the trigger, 1 if more have, 2 if over ``crowd`` different stretches have."""
        doc = self.doc[self.text]
        first = np.full(len(self.triggers), len(self.raws), np.int64)
        np.minimum.at(first, self.entry, self.text)
        several = np.zeros(len(self.triggers), bool)
        several[self.entry[doc != self.doc[first[self.entry]]]] = True
        many = np.flatnonzero((np.bincount(self.entry, minlength=len(self.triggers)) > crowd)[self.entry])
        order = many[np.lexsort((self.hash[many], self.entry[many]))]
        e, h = self.entry[order], self.hash[order]
        kinds = np.bincount(e[np.concatenate(([True], (e[1:] != e[:-1]) | (h[1:] != h[:-1])))[: len(e)]], minlength=len(self.triggers))
        flags = np.where(kinds > crowd, 2, several.astype(np.int64)).astype(np.uint8)
        for b, held in self.routes(buckets):
            packed = pack_sorted(self.triggers[held])
            yield b, squeeze(packed), len(packed), squeeze(flags[held].tobytes())

    def routes(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places of its triggers) in a fixed order."""
        yield from _dealt((_mixed(self.triggers) % U(buckets)).astype(np.int64), buckets)

    def collate(self, replies: dict[int, bytes], buckets: int) -> None:
        """Take the triggers' codes and list the strings to compare: ``strings``, and where each stands.

        A shared trigger's stretch is a string, a crowded one's windows are each. Of equal strings one is listed, with
        the first of its documents.
        """
        code = np.zeros(len(self.triggers), np.uint8)
        for b, held in self.routes(buckets):
            code[held] = np.frombuffer(replies[b], np.uint8)
        own, length = code[self.entry], self.parser.length
        shared, crowded = np.flatnonzero(own == SHARED), np.flatnonzero(own == CROWDED)
        count = self.size[crowded]
        window = np.repeat(self.place[crowded] - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count, count) + np.arange(count.sum())
        self.at_text = np.concatenate((self.text[shared], np.repeat(self.text[crowded], count)))
        self.at_place = np.concatenate((self.place[shared], window))
        self.at_size = np.concatenate((self.size[shared], np.ones(len(window), np.int64)))
        key = np.concatenate((self.trigger[shared], np.zeros(len(window), U)))
        order = np.argsort(self.at_text, kind="stable")
        self.at_text, self.at_place, self.at_size, key = (x[order] for x in (self.at_text, self.at_place, self.at_size, key))
        numbers: dict[bytes, int] = {}
        self.string = np.array([numbers.setdefault(self.raws[t][a : a + n + length - 1], len(numbers)) for t, a, n in zip(self.at_text.tolist(), self.at_place.tolist(), self.at_size.tolist(), strict=True)], np.int64)
        self.strings = list(numbers)
        first = np.unique(self.string, return_index=True)[1]
        self.first = self.at_text[first]
        key = key[first]
        for i in np.flatnonzero(key == 0).tolist():  # a window by itself goes by its own hash
            key[i] = zlib.crc32(self.strings[i]) + 1
        self.key = _mixed(key + U(1))

    def letters(self, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(bucket, keys, sizes, bytes, ids, nulls) of the listed strings."""
        for b, held in self.sent(buckets):
            strings = [self.strings[i] for i in held.tolist()]
            yield b, (self.key[held] >> U(56)).astype(np.uint8).tobytes(), pack(np.array([len(x) for x in strings])), squeeze(b"".join(strings)), *pack_ids(self.ids[self.first[held]], self.unnamed[self.first[held]])

    def sent(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        yield from _dealt((self.key % U(buckets)).astype(np.int64), buckets)

    def gone(self, replies: dict[int, bytes], buckets: int) -> Iterator[np.ndarray]:
        """For each document, which of its bytes go."""
        length = self.parser.length
        windows = np.array([len(s) - length + 1 for s in self.strings], np.int64)
        begin = np.concatenate(([0], np.cumsum(windows)))
        repeated = np.zeros(begin[-1], bool)
        for b, held in self.sent(buckets):
            total = windows[held]
            places = np.repeat(begin[held] - np.concatenate(([0], np.cumsum(total)[:-1])), total) + np.arange(total.sum())
            repeated[places] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=len(places)).astype(bool)
        later = self.doc[self.at_text] > self.doc[self.first[self.string]] if len(self.string) else np.zeros(0, bool)
        string = np.repeat(np.arange(len(self.string)), self.at_size)
        inner = np.arange(len(string)) - np.repeat(np.concatenate(([0], np.cumsum(self.at_size)[:-1])) if len(self.at_size) else self.at_size, self.at_size)
        hit = later[string] | repeated[begin[self.string[string]] + inner]
        text, place = self.at_text[string[hit]], (self.at_place[string] + inner)[hit]
        base = np.concatenate(([0], np.cumsum([len(r) + 1 for r in self.raws], dtype=np.int64)))
        starts = np.zeros(base[-1] + 1, bool)
        starts[base[text] + place] = True
        upto = np.cumsum(starts, dtype=np.int64)
        covered = upto > 0  # a byte goes if one of the last ``length`` places is a start
        covered[length:] = upto[length:] > upto[:-length]
        for i, raw in enumerate(self.raws):
            yield covered[base[i] : base[i] + len(raw)]


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def settle(trigger: np.ndarray, flag: np.ndarray, most: int = 4096) -> np.ndarray:
    """The code of each note of a trigger, from all parts' notes of it: over ``most`` notes, or one that says so, make it crowded."""
    code = np.zeros(len(trigger), np.uint8)
    if len(trigger):
        _, entry, notes = np.unique(trigger, return_inverse=True, return_counts=True)
        flags = np.zeros(len(notes), np.uint8)
        np.maximum.at(flags, entry, flag)
        code = np.where((flags == 2) | (notes > most), CROWDED, np.where((flags > 0) | (notes > 1), SHARED, UNIQUE)).astype(np.uint8)[entry]
    return code


def repeated_windows(strings: list[bytes], doc: np.ndarray, length: int) -> np.ndarray:
    """For every window of every string, in order, whether a string of a smaller document holds the same bytes.

    Of equal strings the one of the smallest document is parsed; the windows of later documents' ones are all repeated.
    """
    numbers: dict[bytes, int] = {}
    alike = np.array([numbers.setdefault(s, len(numbers)) for s in strings], np.int64)
    first = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(first, alike, doc)
    string, _, number = PrefixFreeParse(list(numbers), depth=length).windows(length)
    if not len(string):
        return np.zeros(0, bool)
    smallest = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, number, first[string])
    found = first[string] > smallest[number]
    count = np.bincount(string, minlength=len(numbers))
    begin, own = np.cumsum(count) - count, count[alike]
    places = np.repeat(begin[alike] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return found[places] | np.repeat(doc > first[alike], own)


_ROWS = "kind int, bucket int, part long, a binary, b binary, c binary, d binary, e binary"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
_NOTES = "bucket int, part long, triggers binary, size long, flags binary"
#: Kinds of rows: codes sent back, strings to compare, flags sent back.
CODES, STRINGS, FLAGS = range(3)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 20, splits: int = 2, chunk: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept of every document.

    Removes each byte that a ``length``-byte string covers which also starts in a document with a smaller id. Rows are
    dealt to ``splits`` parts (and strings to as many buckets) a shuffle partition by a hash of id and text, so a task that runs again has the same ones.
    First the parts' notes of triggers meet in buckets and come back as codes, checkpointed. Then the parts send the strings of triggers that several documents share; their buckets compare windows, in
    chunks of about ``chunk`` bytes, and send a bit for each. Last the parts cut their texts. A string that any number
    of documents share is sent once a part; the windows of a trigger with very many strings go to buckets one by one.

    Null and empty texts have no bytes; rows with one id don't count as smaller than each other; null ids come
    after all others; texts shorter than ``length`` stay whole; very long texts are parsed in one piece; repeated rows
    come out each; an empty table gives an empty result; other columns are ignored. ``kept`` is the remaining bytes.
    """
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts_in_all = partitions * splits  # more than partitions, as a hash deals them out unevenly
    doc_id, raw = at(docs, id_col).cast("long"), F.coalesce(at(docs, text_col).cast("string"), F.lit("")).cast("binary")
    rows = placed(docs).select(doc_id.alias("doc_id"), raw.alias("raw"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(parts_in_all)))

    def part_of(texts: pa.Table) -> Part:
        raws = [unsqueeze(r, n) for r, n in zip(texts["raw"].to_pylist(), texts["size"].to_pylist(), strict=True)]
        return Part(texts["doc_id"].to_pylist(), raws, Parser(length, gram))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([squeeze(r) for r in raws], pa.binary()), pa.array([len(r) for r in raws], pa.int64()), batch.column(2)], names=["doc_id", "raw", "size", "part"])

    def note(texts: pa.Table) -> pa.Table:
        number = texts["part"][0].as_py()
        return _table([(b, number, t, len_t, f) for b, t, len_t, f in part_of(texts).notes(buckets)], _NOTES, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))

    def code(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        triggers = [unpack_sorted(unsqueeze(r["triggers"], r["size"])) for r in sent]
        codes = settle(np.concatenate(triggers), np.concatenate([np.frombuffer(unsqueeze(r["flags"], len(t)), np.uint8) for r, t in zip(sent, triggers, strict=True)]))
        ends = np.cumsum([len(t) for t in triggers])
        return _table([(CODES, r["bucket"], r["part"], codes[e - len(t) : e].tobytes(), b"", b"", b"", b"") for r, t, e in zip(sent, triggers, ends, strict=True)])

    def collated(texts: pa.Table, replies: list[dict]) -> Part:
        part = part_of(texts)
        part.collate({r["bucket"]: r["a"] for r in replies if r["kind"] == CODES}, buckets)
        return part

    def send(texts: pa.Table, reply: pa.Table) -> pa.Table:
        part = collated(texts, reply.to_pylist())
        return _table([(STRINGS, b, texts["part"][0].as_py(), *sent) for b, *sent in part.letters(buckets)])

    def compare(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        keys = [np.frombuffer(r["a"], np.uint8) for r in sent]
        sizes = [unpack(r["b"], np.int64) for r in sent]
        ids, unnamed = zip(*(unpack_ids(r["d"], r["e"], len(k)) for r, k in zip(sent, keys, strict=True)), strict=True)
        doc, key, size = ranked(np.concatenate(ids), np.concatenate(unnamed)), np.concatenate(keys), np.concatenate(sizes)
        whole = b"".join(unsqueeze(r["c"], int(n.sum())) for r, n in zip(sent, sizes, strict=True))
        begin = np.concatenate(([0], np.cumsum(size)))
        count = size - length + 1
        at_bit = np.concatenate(([0], np.cumsum(count)))
        flags = np.zeros(at_bit[-1], bool)
        chunks = min(256, -(-len(whole) // chunk))
        for c in range(chunks):  # strings that share a trigger share a key, so they share a chunk
            held = np.flatnonzero(key % chunks == c)
            found = repeated_windows([whole[begin[i] : begin[i + 1]] for i in held.tolist()], doc[held], length)
            flags[np.repeat(at_bit[held] - np.concatenate(([0], np.cumsum(count[held])[:-1])) if len(held) else held, count[held]) + np.arange(len(found))] = found
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        return _table([(FLAGS, r["bucket"], r["part"], np.packbits(flags[at_bit[ends[i]] : at_bit[ends[i + 1]]]).tobytes(), b"", b"", b"", b"") for i, r in enumerate(sent)])

    def finish(texts: pa.Table, reply: pa.Table) -> pa.Table:
        replies = reply.to_pylist()
        part = collated(texts, replies)
        out = []
        for doc_id, unnamed, raw, gone in zip(part.ids.tolist(), part.unnamed.tolist(), part.raws, part.gone({r["bucket"]: r["a"] for r in replies if r["kind"] == FLAGS}, buckets), strict=True):
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
            out.append((None if unnamed else doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return _table(out, _RESULT, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))

    # Texts cross the network compressed, once for the notes and once for both later passes.
    small = rows.mapInArrow(shrink, "doc_id long, raw binary, size long, part long")
    parts = small.repartition(partitions, "part").groupBy("part")
    codes = cut(parts.applyInArrow(note, _NOTES).groupBy("bucket").applyInArrow(code, _ROWS))
    strings = parts.cogroup(codes.groupBy("part")).applyInArrow(send, _ROWS)
    flags = strings.groupBy("bucket").applyInArrow(compare, _ROWS)
    return parts.cogroup(codes.unionAll(flags).groupBy("part")).applyInArrow(finish, _RESULT)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _table(rows: list[tuple], schema: str = _ROWS, kinds: tuple = _KINDS) -> pa.Table:
    names = [part.split()[0] for part in schema.split(",")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[] for _ in kinds], kinds, strict=True)], names=names)
