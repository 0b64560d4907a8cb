"""Packing into fixed windows by order-preserving dynamic programming over document and sentence ends."""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plotwise.llm.common import id_and_text, slices

SPECIAL = "<|endoftext|>"
_RUN = re.compile(r"\s |\s{1000}")


#: Fixed value: the published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's letters for bytes: printable ones stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Word -> ids as bytes, filled on demand with words of up to 64 characters; ``held`` estimates its bytes."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.held = encode, 0

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
            self.held += 200 + 2 * len(word) + len(ids)
        return ids

    def clear(self) -> None:
        super().clear()
        self.held = 0


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as tokenizers gives them, with a cache of words.

    The pre-tokenizer always parts between a character that isn't white space and a space, so such pieces are
    encoded on their own and kept, up to ``most_bytes`` in all. If the file's merges stand in the order of their ids, new
    pieces go through tiktoken over the same vocabulary, which is the same algorithm; else, and for texts with other
    white space before a space, with a thousand white characters in a row, or with the special token's string,
    tokenizers encodes.
    """

    def __init__(self, path: str, most_bytes: int = 96 << 20):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        vocabulary = self.whole.get_vocab()
        self.sentence_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.sentence_end[i] = piece[-1:] in {".", "!", "?", "Ċ"}  # Ċ stands for a line feed
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.words, self.most_bytes = _Words(self._ordinary(model) or self._slow), most_bytes

    def _slow(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _ordinary(self, model: dict) -> Callable[[str], list[int]] | None:
        letters, vocab = byte_alphabet(), model["vocab"]
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        if merged != sorted(x for x in merged if x is not None) or any(c not in vocab for c in letters):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if all(c in letters for c in piece) and piece != SPECIAL}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if SPECIAL in text or _RUN.search(text):
            return np.array(self._slow(text), "<u4").tobytes()
        if self.words.held > self.most_bytes:
            self.words.clear()
        head, *words = text.split(" ")
        return np.array(self.words.encode(head), "<u4").tobytes() + b"".join(map(self.words.__getitem__, words))


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: its bounded cache of words serves one task after another."""
    kept = sys.modules.setdefault("plotwise_worker", types.ModuleType("plotwise_worker")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def tail_lengths(rest: int, size: int, hard: float) -> tuple[float, list[int]]:
    """Cost and lengths for the last ``rest`` tokens: one padded window, or unpadded powers of two cut anywhere."""
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    split = hard * (len(powers) - 1)
    return (split, powers) if split < size - rest else (float(size - rest), [rest])


def choose_cuts(ends: np.ndarray, penalty: np.ndarray, size: int, *, final: bool, overhead: float = 4.0, hard: float = 16.0, least_power: int = 256) -> list[int]:
    """Window ends over tokens 0..ends[-1], each window at most ``size`` long.

    ``ends`` are the allowed cuts, in order, with their truncation penalties; stretches without any get forced
    cuts. Dynamic programming over cuts: cost so far plus padding (none at full or power-of-two length),
    ``overhead`` a window and the cut's penalty. As padding is size - (end - start), the best start is the
    smallest cost + start in reach, kept in a monotone queue: linear time. A final call covers every token,
    its last ones as ``tail_lengths`` says; others stop at the cheapest cut within the last window's reach, the
    rest being the next call's beginning.
    """
    ends = np.concatenate(([0], ends)).astype(np.int64)
    penalty = np.concatenate(([0.0], penalty))
    gaps = np.diff(ends)
    if len(gaps) and gaps.max() > size:
        extra = [a + size * k for a, g in zip(ends[:-1][gaps > size].tolist(), gaps[gaps > size].tolist(), strict=True) for k in range(1, (g - 1) // size + 1)]
        order = np.argsort(both := np.concatenate((ends, extra)), kind="stable")
        ends, penalty = both[order].astype(np.int64), np.concatenate((penalty, np.full(len(extra), hard)))[order]
    n = len(ends)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = least_power
    while power < size:
        at = np.searchsorted(ends, ends - power)
        for j in np.nonzero((ends >= power) & (ends[np.minimum(at, n - 1)] == ends - power))[0].tolist():
            exact[j].append(int(at[j]))
        power *= 2
    place, fine = ends.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        here = place[j]
        while place[queue[0][1]] < here - size:
            queue.popleft()
        best, start = queue[0]
        best += size - here
        for i in exact[j]:
            if cost[i] < best:
                best, start = cost[i], i
        cost[j] = best = best + fine[j] + overhead
        back[j] = start
        best += here
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, j))
    reach = range(int(np.searchsorted(ends, ends[-1] - size)), n)
    tail: list[int] = []
    if final:
        last = min(reach, key=lambda j: cost[j] + (tail_lengths(place[-1] - place[j], size, hard)[0] + overhead if place[j] < place[-1] else 0.0))
        if place[last] < place[-1]:
            tail = (place[last] + np.cumsum(tail_lengths(place[-1] - place[last], size, hard)[1])).tolist()
    else:
        last = min(reach, key=lambda j: (cost[j], -j))
    cuts = []
    while last:
        cuts.append(place[last])
        last = back[last]
    return cuts[::-1] + tail


class Packer:
    """Packs one task's stream of documents; holds about ``block`` tokens at a time."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int, size: int = 2048, block: int = 1 << 19, sentence: float = 2.0):
        self.sentence_end, self.sequence, self.size, self.block, self.sentence = sentence_end, first_sequence, size, block, sentence
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, ids before, ids in all, ids left
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= self.block:
            yield self.flush(final=False)

    def flush(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        tokens = np.concatenate([d[3] for d in self.docs])
        stops = np.cumsum([len(d[3]) for d in self.docs])
        fine = np.where(self.sentence_end[tokens], self.sentence, -1.0)
        fine[stops - 1] = 0.0
        at = np.nonzero(fine >= 0)[0]
        cuts = choose_cuts(at + 1, fine[at], self.size, final=final)
        out, doc, done, begin = [], 0, 0, 0
        raw = memoryview(tokens.astype("<u4").tobytes())
        for cut in cuts:
            while done < cut:
                doc_id, before, total, own = self.docs[doc]
                stop = min(cut, int(stops[doc]))
                start = before + done - (int(stops[doc]) - len(own))
                out.append((doc_id, start, stop - done, zlib.crc32(raw[4 * done : 4 * stop]), total, self.sequence, done - begin))
                done = stop
                doc += done == stops[doc]
            begin = cut
            self.sequence += 1
        rest = self.docs[doc:]
        if rest:
            doc_id, before, total, own = rest[0]
            used = done - (int(stops[doc]) - len(own))
            rest[0] = (doc_id, before + used, total, own[used:])
        self.docs, self.held = rest, len(tokens) - done
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, encoder: Callable[[str], WordEncoder] = worker_encoder) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens, in the order of the input.

    Each task packs its own partition, in one narrow pass without a shuffle, and numbers its sequences from its
    partition's number times 2^40, so a task that runs again gives the same rows. Windows are cut at document
    ends, else at sentence ends, else (a stretch longer than a window, or the task's last tokens) anywhere.

    Returns doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens (with
    ``end_id``), sequence_id, offset. Null and empty texts are one piece of ``end_id`` alone; repeated rows are
    packed each; a null id stays null; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path)
        packer = Packer(model.sentence_end, TaskContext.get().partitionId() << 40, size)
        end = np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for ids, texts in slices(batches, 1 << 20):
            for doc_id, text in zip(ids, texts, strict=True):
                for rows in packer.add(doc_id, np.frombuffer(model.encode(text) + end, "<u4")):
                    if rows:
                        yield batch_of(rows)
        if rows := packer.flush(final=True):
            yield batch_of(rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
