"""Token counts: pieces are counted once for each distinct pre-token and summed over documents.

A pre-token's number of pieces depends on nothing but the pre-token. Documents give pre-token frequencies; distinct
pre-tokens meet by hash and are split into pieces once; the counts join the frequencies and are summed. Token ids of
documents never exist.

Pre-tokens of Latin text come from one regular expression over the lower-cased text, equal to the tokenizer's own
normalizer and pre-tokenizer on those characters; any other text goes through the library's normalizer and
pre-tokenizer. Special strings inside a text are one token each, as by the library's default.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows and null ids are counted row by
row; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tarn.llm.memory import lean
from tarn.llm import vocabulary
from tarn.llm.vocabulary import count_blocks, parts_by_bucket, sum_by_document, unpack_types

#: Characters of the fast path: printable Latin up to U+017F, white space of ASCII, common punctuation.
_LATIN = [chr(c) for c in range(0x20, 0x180) if not 0x7F <= c <= 0xA0 and c not in (0xAD, 0x130)]
_FAST = re.compile("[\t\n\r\x0b\x0c" + re.escape("".join(_LATIN)) + "‐-‧€™]*")
_LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Marks a special token among pre-tokens; no UTF-8 text has this byte.
_SPECIAL = b"\xff"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(spare)}


def pre_tokens(path: str) -> Callable[[bytes], Counter]:
    """A function from a text's bytes to the frequencies of its pre-tokens (as bytes)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    split = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
    back = {c: b for b, c in byte_letters().items()}

    def by_library(text: str) -> Counter:
        out: Counter = Counter()
        for k, segment in enumerate(split.split(text) if split else [text]):
            if k % 2:
                out[_SPECIAL + segment.encode()] += 1
            elif segment:
                found = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(segment))
                out.update(bytes(back[c] for c in piece) for piece, _ in found)
        return out

    def run(raw: bytes) -> Counter:
        text = raw.decode("utf-8", "replace")
        if _FAST.fullmatch(text) and not (split and split.search(text)):
            return Counter({k.encode(): v for k, v in Counter(_PIECES.findall(text.lower())).items()})
        return by_library(text)

    return run


def piece_counter(path: str) -> Callable[[bytes], int]:
    """A function from a pre-token to its number of pieces."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(path).model, byte_letters()

    def run(piece: bytes) -> int:
        return 1 if piece[:1] == _SPECIAL else len(model.tokenize("".join(map(letters.__getitem__, piece))))

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = vocabulary.BLOCK_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of ``docs``; ``path``: the tokenizer's file on every machine."""

    def analyse() -> vocabulary.Analyse:
        find = pre_tokens(path)
        return lambda raw: (find(raw), (len(raw),))

    blocks = count_blocks(docs, analyse, ["n_bytes"], id_col, text_col, block_bytes=block_bytes)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, now = piece_counter(path), dict[bytes, int](), None
        for batch in batches:
            values = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if bucket != now:  # rows come by bucket, and no pre-token is in two
                    now, known = bucket, {}
                types = unpack_types(data.as_py())
                for t in types:
                    if t not in known:
                        known[t] = pieces(t)
                values.append(zstandard.compress(np.fromiter(map(known.__getitem__, types), "<f8", len(types)).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(values, pa.binary())], names=["block", "bucket", "value"])

    values = parts_by_bucket(blocks).mapInArrow(count, "block bigint, bucket int, value binary")
    return sum_by_document(blocks, values, lambda pairs, counts, of: [pairs[:, 0] * counts], "n_tokens bigint", ["n_bytes"], id_col)
