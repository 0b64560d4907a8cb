"""Token counts: Arrow functions that encode in batches balanced by bytes and return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plotwise.llm.common import id_and_text, slices

#: A single space between two letters or digits of any script. No piece of the vocabularies holds such a space inside,
#: and normalisation never joins a letter or digit to a space, so encoding both sides on their own gives the same tokens.
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def split_safely(text: str, most_chars: int) -> list[str]:
    """Parts of ``text`` of about ``most_chars`` characters; the spaces at the cuts are left out.

    A stretch without a safe boundary stays whole, however long it is.
    """
    parts, start = [], 0
    while len(text) - start > most_chars:
        cut = _SAFE.search(text, start + most_chars)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def _sentencepiece(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    dummy = model.encode("a b") == model.encode("a") + model.encode("b")
    splittable = dummy and not any(mark in p.lstrip(mark) for p in pieces)
    return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), splittable


def _tokenizers(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), False


def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    return _sentencepiece(path) if path.endswith(".model") else _tokenizers(path)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    *,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 1 << 20,
    part_chars: int = 1 << 16,
) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``model_path`` is a ``.model`` file of sentencepiece or a ``.json`` file of tokenizers; no begin, end or
    other special tokens are added. One narrow pass, no shuffle; a task holds one Arrow batch and
    ``batch_bytes`` of encoded text. Texts beyond ``part_chars`` are encoded in parts cut at safe spaces
    (sentencepiece only), and their lengths are added up.

    Null and empty texts give zero bytes and tokens; repeated rows are counted each; a null id stays null;
    an empty table gives an empty result; other columns are ignored.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, splittable = _counter(model_path)
        for ids, texts in slices(batches, batch_bytes):
            parts, owner = [], []
            for i, text in enumerate(texts):
                own = split_safely(text, part_chars) if splittable and len(text) > part_chars else [text]
                parts += own
                owner += [i] * len(own)
            tokens = [0] * len(texts)
            for i, n in zip(owner, encode(parts), strict=True):
                tokens[i] += n
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
