"""Encoding of a corpus with a public byte-level BPE tokenizer, by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary marks a certain cut: no merge can ever cross it. Every text
is cut at the first such pair of each stretch of 256 bytes, fragments are encoded on their own and the ids put together
again. Cuts are placed by the position within the text, so copies of a text fall into the same fragments; each distinct
fragment is encoded once while it is remembered, and a very long text never goes through the merges as one piece.

The tokenizer also splits text by a pattern before it merges. A cut keeps that split where it lies between two
characters, the left one is no white space (else a run of it would be split otherwise) and the right one no apostrophe
(else it might begin a contraction). So the right byte begins a character, and the left byte is not the last one of any
white space in UTF-8. Other forced pairs are not used. A run of 1,000 or more white space characters overflows the
pattern library's stack; it is split by hand the way the pattern would split it, which gives the same ids.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; no
special tokens are added; repeated rows are encoded like others; whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Where the vocabulary files lie on every machine.
TOKENIZERS = os.environ.get("TIDEMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this family of tokenizers splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is cut at the first certain cut of each stretch of so many bytes.
FRAGMENT = 256
#: White space as the pattern knows it; runs beyond this length are split by hand.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
#: Bytes of text worked on at once.
SLICE = 8 << 20
#: Distinct fragments that a task remembers between batches, in bytes.
REMEMBER = 24 << 20


def load_tokenizer(path: str):
    """The encoding and a table of 65,536 byte pairs: True where no token has the pair inside. Kept per process."""
    # functions come to a worker by value; what it keeps between tasks lies in a module of its own
    kept = vars(sys.modules.setdefault("tidemill_tokenizers", types.ModuleType("tidemill_tokenizers", "Tokenizers loaded by this process, by path.")))
    if path not in kept:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        never = np.ones(65536, dtype=bool)
        for token in ranks:
            if len(token) > 1:
                raw = np.frombuffer(token, dtype=np.uint8).astype(np.uint16)
                never[(raw[:-1] << 8) | raw[1:]] = False
        # what the pattern needs, see above: the last bytes of all white space, in UTF-8
        blank = np.zeros(256, dtype=bool)
        blank[[ord(c) if c.isascii() else c.encode()[-1] for c in BLANKS]] = True
        pair = np.arange(65536)
        left, right = pair >> 8, pair & 255
        never &= ((right < 128) | (right >= 0xC0)) & ~blank[left] & (right != ord("'"))
        kept[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), never
    return kept[path]


def cuts(data: np.ndarray, bounds: np.ndarray, never: np.ndarray, fragment: int = FRAGMENT) -> np.ndarray:
    """Where fragments begin within the texts that start at ``bounds[:-1]``; the starts themselves are not among them."""
    if len(data) < 2:
        return np.empty(0, dtype=np.int64)
    forced = np.flatnonzero(never[(data[:-1].astype(np.uint16) << 8) | data[1:]]) + 1
    long_ = np.flatnonzero(np.diff(bounds) > fragment)
    stretches = (np.diff(bounds)[long_] - 1) // fragment
    text = np.repeat(long_, stretches)
    nth = np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches) + 1
    from_ = bounds[text] + nth * fragment
    at = np.searchsorted(forced, from_)
    there = at < len(forced)
    cut = forced[at[there]]
    # a certain cut of the next stretch, or of the next text, is not this stretch's
    return cut[cut < np.minimum(from_[there] + fragment, bounds[text[there] + 1])]


def encode_fragment(encoding, text: str) -> np.ndarray:
    """Ids of a fragment. Of a long blank run before other text, all but the last character is one piece for the merges."""
    out, rest = [], text
    if not LONG_BLANK.search(text):
        return encoding.encode_to_numpy(text, disallowed_special=()).view(np.int32)
    while run := LONG_BLANK.search(rest):
        last = run.end() == len(rest)
        blank = run[0] if last else run[0][:-1]
        out += encoding.encode_ordinary(rest[: run.start()])
        out += encoding._encode_single_piece(blank)
        rest = rest[run.start() + len(blank) :]
    return np.array(out + encoding.encode_ordinary(rest), dtype=np.int32)


def encode_column(texts: pa.Array, encoding, never: np.ndarray, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of each text in it. ``known`` remembers fragments."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    if raw is None or bounds[-1] == bounds[0]:
        return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    begins = np.union1d(cuts(data, bounds, never), bounds[:-1])
    begins = begins[begins < len(data)]
    ends = np.append(begins[1:], len(data))
    whole, place, distinct, pieces = data.tobytes(), {}, [], []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        piece = whole[b:e]
        at = place.get(piece)
        if at is None:
            at = place[piece] = len(distinct)
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = encode_fragment(encoding, piece.decode())
            distinct.append(ids)
        pieces.append(at)
    where = np.array(pieces, dtype=np.int64)
    sizes = np.array([len(x) for x in distinct], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate(distinct)
    lengths = sizes[where]
    filled = np.concatenate(([0], np.cumsum(lengths)))
    # position of each id in flat: start of its fragment plus its place in it
    take = np.arange(filled[-1]) + np.repeat(starts[where] - filled[:-1], lengths)
    return flat[take], filled[np.searchsorted(begins, bounds)]


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (last column) have about ``most`` bytes, so that work memory stays bounded. A text
    longer than that is a part of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _batches(batches: Iterator[pa.RecordBatch], path: str, emit) -> Iterator[pa.RecordBatch]:
    encoding, never = load_tokenizer(path)
    known: dict[bytes, np.ndarray] = {}
    for batch in (part for whole in batches for part in slices(whole)):
        ids, offsets = encode_column(batch.column(batch.num_columns - 1), encoding, never, known)
        yield emit(batch, ids, offsets)
        if sum(map(len, known)) > REMEMBER:
            known.clear()


def _schema(frame: DataFrame, keys: list[str], last: str) -> str:
    return ", ".join([*(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys), last])


def encode(documents: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The key columns and ids, a list of integers; one pass without a shuffle."""
    path = tokenizer or f"{TOKENIZERS}/{BYTE_BPE}"

    def run(batches):
        def emit(batch, ids, offsets):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keys, "ids"])

        return _batches(batches, path, emit)

    return documents.select(*keys, text).mapInArrow(run, _schema(documents, keys, "ids array<int>"))


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The key columns and n_tokens; ids never leave the worker."""
    path = tokenizer or f"{TOKENIZERS}/{BYTE_BPE}"

    def run(batches):
        def emit(batch, ids, offsets):
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets), pa.int64())], [*keys, "n_tokens"])

        return _batches(batches, path, emit)

    return documents.select(*keys, text).mapInArrow(run, _schema(documents, keys, "n_tokens bigint"))
